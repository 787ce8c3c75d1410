"""The chunker against a direct rendering of its definition, and its properties."""

import random

import pytest
from pyspark.sql import functions as F

from passagework.functions.chunking import chunk_shape, estimated_chunks, fixed_windows, split_text
from passagework.operators.chunks import chunk_documents, process_documents, window_documents
from passagework.schemas import CHUNK

SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def merge(pieces, size, overlap):
    """Piece by piece, as the definition is worded."""
    out, window, total = [], [], 0
    for piece in pieces:
        if total + len(piece) > size and window:
            if joined := "".join(window).strip():
                out.append(joined)
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    if joined := "".join(window).strip():
        out.append(joined)
    return out


def slow_split(text, size, overlap, separators=SEPARATORS):
    at = next(i for i, s in enumerate(separators) if s in text)
    mark, rest = separators[at], separators[at + 1:]
    parts = text.split(mark) if mark else list(text)
    pieces = [p if i == 0 else mark + p for i, p in enumerate(parts)]
    out, small = [], []
    for piece in (p for p in pieces if p):
        if len(piece) < size:
            small.append(piece)
            continue
        out += merge(small, size, overlap) if small else []
        small = []
        out += slow_split(piece, size, overlap, rest) if rest else [piece]
    return out + (merge(small, size, overlap) if small else [])


def random_texts(n):
    rng = random.Random(11)
    words = ["a", "bb", "ccc", "dddddddd", "e" * 25, " ", "  ", "\n", "\n\n", "\n\n\n", ". ", ".",
             "é", "　", "x" * 60]
    return ["".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("size,overlap", [(20, 5), (20, 20), (10, 1), (50, 49), (2, 1), (7, 3)])
def test_agrees_with_the_definition(size, overlap):
    for text in random_texts(1500):
        if text.strip():
            assert split_text(text, size, overlap) == slow_split(text, size, overlap), text


def test_properties():
    for text in random_texts(500):
        for chunk in split_text(text, 20, 5):
            assert 0 < len(chunk) <= 20 and chunk == chunk.strip() and chunk in text


def test_blank_and_defaults(spark):
    assert split_text(None, 10, 2) == split_text("", 10, 2) == split_text(" \n", 10, 2) == []
    assert chunk_shape(0, 0) == (1000, 200) and chunk_shape(500, None) == (500, 200)
    with pytest.raises(ValueError):
        chunk_shape(100, 101)
    with pytest.raises(ValueError):
        estimated_chunks(F.lit("x"), 100, 100)


def test_estimate(column):
    lengths = [0, 1, 1000, 1001, 1800, 1801, 5000]
    got = column(estimated_chunks, ["x" * n for n in lengths])
    assert got == [1 if n <= 1000 else max(1, (n - 200) // 800 + 1) for n in lengths]


def test_windows_of_long_text(column):
    text = "".join(chr(33 + i * 7 % 9000) for i in range(200_000))
    (got,) = column(lambda c: fixed_windows(c, 100, 30), [text])
    n = (len(text) - 30) // 70 + 1
    assert got == [text[i * 70:i * 70 + 100] for i in range(n)]


def test_metadata_and_empty_documents(spark):
    docs = spark.createDataFrame(
        [(1, "one two three " * 200, "/a/b", "c", "b"), (2, "  ", "/x", "c", "x"),
         (3, None, "/y", None, None), (4, "short", None, None, None)],
        "doc_id long, text string, source string, category string, filename string")
    rows = chunk_documents(docs).orderBy("doc_id", "chunk_index").collect()
    assert [f.name for f in chunk_documents(docs).schema] == CHUNK.fieldNames()
    first = [r for r in rows if r.doc_id == 1]
    assert [r.chunk_index for r in first] == list(range(len(first)))
    assert {r.total_chunks for r in first} == {len(first)} and len(first) > 1
    assert [tuple(r)[3:] for r in rows if r.doc_id == 4] == [
        ("short", "unknown", "uncategorized", "unknown")]
    assert {r.doc_id for r in rows} == {1, 4}
    kept = {r.doc_id: r for r in process_documents(docs, keep_empty=True).collect()
            if r.chunk_index is None}
    assert {k: r.total_chunks for k, r in kept.items()} == {2: 0, 3: 0}
    assert window_documents(docs).where("doc_id = 2").collect()[0].text == "  "
