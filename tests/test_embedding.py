import hashlib
import re

import numpy as np

from passagework.functions.embedding import HashEmbedder, _TokenCodes
from passagework.operators.embed import embed, text_similarity

TEXTS = ["Soil and water", "soil AND soil", "é ñ 12 x_y", "!!!", "a" * 50, "ÀB c"]


def slow(text, dimension):
    counts = np.zeros(dimension)
    for token in re.findall("[A-Za-z0-9]+", text):
        digits = hashlib.md5(token.lower().encode()).hexdigest()
        counts[int(digits[:8], 16) % dimension] += 1 if int(digits[8], 16) % 2 == 0 else -1
    length = np.sqrt((counts ** 2).sum())
    return (counts / length if length else counts).astype(np.float32)


def test_hash_vectors_agree_with_the_definition():
    for dimension in (8, 384):
        got = HashEmbedder(dimension).encode(TEXTS)
        assert (got == np.stack([slow(t, dimension) for t in TEXTS])).all()


def test_token_table_is_bounded():
    codes = _TokenCodes()
    codes.limit = 3
    values = [codes[str(i).encode()] for i in range(10)]
    assert len(codes) <= 4 and values[0] == codes[b"0"]


def test_blank_rows_get_zero_vectors_and_skip_the_provider(spark):
    class Strict:
        """Refuses blank texts and large batches."""

        dimension = 3

        def encode(self, texts):
            assert len(texts) <= 2 and all(t.strip() for t in texts)
            return np.array([[len(t), 0, 1] for t in texts], np.float32)

    df = spark.createDataFrame(list(enumerate(["ab", None, "", " \n", "abc", "x", "yy"])),
                               "i int, text string").coalesce(1)
    got = [r.embedding for r in embed(df, Strict(), batch_size=2).orderBy("i").collect()]
    assert got == [[2, 0, 1], [0, 0, 0], [0, 0, 0], [0, 0, 0], [3, 0, 1], [1, 0, 1], [2, 0, 1]]


def test_similarity(spark):
    df = spark.createDataFrame([("a b", "a b"), ("a", ""), ("a b", "a c")], "l string, r string")
    got = [r.similarity for r in text_similarity(df, HashEmbedder(64), "l", "r").collect()]
    assert abs(got[0] - 1) < 1e-6 and got[1] == 0.0 and -1 <= got[2] < 1


def test_remembered_tokens_take_little_memory():
    """A worker remembers codes of tokens, and there are several workers: many distinct ones must not stay."""
    import sys

    from passagework.functions.embedding import _TokenCodes

    codes, most = _TokenCodes(), 0
    for i in range(300_000):
        codes[b"token%d" % i]
        if i % 10_000 == 0:
            most = max(most, sys.getsizeof(codes) + 100 * len(codes))
    assert most < 24 << 20
