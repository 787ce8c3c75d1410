"""Packing by powers of two: no sequence crosses documents and none needs padding.

The ids of a document are cut into pieces whose lengths are powers of two, the largest first. Every
piece is a sequence of its own; pieces of one length form a bucket, from which batches are drawn.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.remembered import Remembered
from passagework.llm.sharding import free

LENGTH = 2048
END = 1  # follows the ids of every document

#: Texts of these characters only (Latin, Cyrillic, common punctuation) are in normal form C, have a
#: lower case that does not depend on the neighbours, and split at white space as the tokenizer does.
SIMPLE = regex.compile(r"[\t-\r\x20-\x84\x86-\u02ff\u0400-\u0482\u048a-\u052f\u2010-\u2027]*")
#: The usual names of bytes as characters: printable ones stand for themselves, the others follow 255.
PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = str.maketrans({b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - PLAIN))})


class WordEncoder:
    """A tokenizer that lower-cases, drops white space and never joins words, used word by word.

    Words and their parts are remembered with their ids. Texts outside ``SIMPLE`` and those with the string of a special
    token, which has an id of its own, are encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts with one of these are cut there, before they are lower-cased.
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        split = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]
        self.parts = regex.compile(split["pattern"]["Regex"]).findall
        self.model = self.tokenizer.model
        self.part_ids = Remembered(self._part)
        self.word_ids = Remembered(self._word)

    def _part(self, part: str) -> bytes:
        named = part if part.isascii() else part.encode().decode("latin-1").translate(BYTES)
        return b"".join(x.id.to_bytes(4, "little") for x in self.model.tokenize(named))

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._part(word)
        return b"".join(map(self.part_ids.__getitem__, self.parts(word)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if SIMPLE.fullmatch(text) and not self.special.search(text):
            return b"".join(map(self.word_ids.__getitem__, text.lower().replace("\xa0", " ").split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def piece_lengths(n: int, length: int) -> list[int]:
    """``n`` as whole sequences and the powers of two of the rest, largest first."""
    rest = n % length
    return [length] * (n // length) + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
         length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian), doc_tokens, bucket, sequence_id, offset.

    ``length`` is a power of two. ``start`` counts the ids of the same row's text before the piece,
    ``bucket`` is the binary logarithm of ``length``, and ``offset`` is always 0, as each sequence holds
    one piece. A null or empty text has the end id alone. Rows that repeat an id are packed each for
    themselves; other columns are not read; an empty table gives an empty table. Where the id has the name of a column
    that is added, the new one gets underscores behind its name. Sequence ids follow the
    input's partitions, so no row is moved, and a repeated task gives the same ids again.
    """
    if length & length - 1 or length < 1:
        raise ValueError("length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        last = np.array([end], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, starts, lengths, ids, totals = [], [], [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    found = encode(text or "") + last
                    start, total = 0, len(found) // 4
                    for n in piece_lengths(total, length):
                        rows.append(row)
                        starts.append(start)
                        lengths.append(n)
                        ids.append(found[4 * start:4 * (start + n)])
                        totals.append(total)
                        start += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())],
                    ["key", "start", "length", "ids", "doc_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    # The text may be the id as well, so both get names of their own.
    pieces = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text")).mapInArrow(
        run, f"key {kind}, start long, length long, ids binary, doc_tokens long")
    added = {"start": F.col("start"), "length": F.col("length"), "ids": F.col("ids"), "doc_tokens": F.col("doc_tokens"),
             "bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(),
             "offset": F.lit(0).cast("long")}
    return pieces.select(F.col("key").alias(id_column), *(c.alias(free(n, [id_column])) for n, c in added.items()))
