"""Splitting one text into overlapping chunks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coarse to fine. The empty string stands for single characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
# Texts that are split at a time.
_TEXTS = 64


def chunk_shape(size: int | None, overlap: int | None,
                default_size: int = 1000, default_overlap: int = 200) -> tuple[int, int]:
    """Resolve chunk parameters. 0 means "use the default", also for the overlap."""
    size, overlap = size or default_size, overlap or default_overlap
    if overlap > size:
        raise ValueError(f"overlap {overlap} is larger than chunk size {size}")
    return size, overlap


def _windows(text: str, cuts, size: int, overlap: int) -> list[str]:
    """Chunks over one run of small pieces.

    Piece i spans cuts[i]..cuts[i+1] and is shorter than ``size``. A window takes as many pieces as
    fit; the next one starts at the first piece that leaves at most ``overlap`` characters of the
    old window and room for the piece that did not fit. Both ends are binary searches.
    """
    out, first, last = [], 0, len(cuts) - 1
    while True:
        stop = bisect_right(cuts, cuts[first] + size, first, last + 1) - 1
        chunk = text[cuts[first]:cuts[stop]].strip()
        if chunk:
            out.append(chunk)
        if stop == last:
            return out
        floor = max(cuts[stop] - overlap, cuts[stop + 1] - size)
        first = min(bisect_left(cuts, floor, first, stop + 1), stop)


def _split_span(text: str, start: int, end: int, level: int, size: int, overlap: int) -> list[str]:
    """Chunks of text[start:end], cutting at the first separator from ``level`` on that occurs."""
    while SEPARATORS[level] and text.find(SEPARATORS[level], start, end) < 0:
        level += 1
    separator = SEPARATORS[level]
    if not separator:
        if size == 1:
            return list(text[start:end])
        return _windows(text, range(start, end + 1), size, overlap)
    # A separator opens the piece after it; one at the very start makes no empty piece.
    found = [m.start() for m in re.compile(re.escape(separator)).finditer(text, start, end)]
    cuts = [start, *(found[1:] if found[0] == start else found), end]
    out, run = [], 0
    for i in [i for i in range(len(cuts) - 1) if cuts[i + 1] - cuts[i] >= size]:
        if i > run:
            out += _windows(text, cuts[run:i + 1], size, overlap)
        out += _split_span(text, cuts[i], cuts[i + 1], level + 1, size, overlap)
        run = i + 1
    if run < len(cuts) - 1:
        out += _windows(text, cuts[run:], size, overlap)
    return out


def split_text(text: str | None, size: int, overlap: int) -> list[str]:
    """Recursive character chunks: each at most ``size`` long, stripped and not empty."""
    if not text or not text.strip():
        return []
    return _split_span(text, 0, len(text), 0, size, overlap)


def recursive_chunks(text: Column, size: int, overlap: int) -> Column:
    """``split_text`` per row as array<string>; null where a text could not be split."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(texts: pa.Array) -> pa.Array:
        def one(value):
            try:
                return split_text(value, size, overlap)
            except Exception:  # counted as an error by the ingest statistics
                return None

        # A few texts at a time are Python objects.
        parts = [pa.array([one(v) for v in texts.slice(at, _TEXTS).to_pylist()], pa.list_(pa.string()))
                 for at in range(0, len(texts), _TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return split(text)


def estimated_chunks(text: Column, size: int | None = None, overlap: int | None = None) -> Column:
    """Chunk count from the length alone; 1 for empty text."""
    size, overlap = chunk_shape(size, overlap)
    if size == overlap:
        raise ValueError("chunk size and overlap must differ")
    length = F.char_length(text)
    count = F.floor((length - overlap) / (size - overlap)) + 1
    return F.when(length <= size, F.lit(1)).otherwise(F.greatest(F.lit(1), count)).cast("int")


# Windows that are cut from one block of text at a time.
_BLOCK = 64


def fixed_windows(text: Column, size: int | None = None, overlap: int | None = None) -> Column:
    """Windows of ``size`` characters every ``size - overlap``, as many as estimated.

    Finding a character position means walking the text from its start, so a long text is cut into
    blocks first and windows are cut from those.
    """
    count = estimated_chunks(text, size, overlap)
    size, overlap = chunk_shape(size, overlap)
    step = size - overlap

    def block_windows(number: Column) -> Column:
        first = number * _BLOCK
        block = F.substring(text, first * step + 1, F.lit(_BLOCK * step + overlap))
        inside = F.sequence(F.lit(0), F.least(F.lit(_BLOCK), count - first) - 1)
        # The one-element array binds the block, which is then cut once.
        return F.flatten(F.transform(F.array(block), lambda part: F.transform(
            inside, lambda i: F.substring(part, i * step + 1, F.lit(size)))))

    blocks = F.sequence(F.lit(0), ((count - 1) / _BLOCK).cast("int"))
    return F.flatten(F.transform(blocks, block_windows))
