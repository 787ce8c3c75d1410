"""Text to vectors.

A provider is any picklable object with an integer ``dimension`` and a method
``encode(list[str]) -> numpy array of shape (n, dimension)``. A provider that holds a model should
load it on first use, so that it is shipped to workers without weights and loaded once in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.text import is_blank

# ASCII letters in lower case and digits; every other byte of UTF-8 text separates words.
_WORD_BYTES = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz"
                    else ord(chr(b).lower()) if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
                    else ord(" ") for b in range(256))


class _TokenCodes(dict):
    """Token -> first eight hex digits of its md5, doubled, plus the parity of the ninth."""

    limit = 1 << 16  # about 12 MB in each worker

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        digest = hashlib.md5(token).digest()
        code = self[token] = int.from_bytes(digest[:4], "big") << 1 | digest[4] >> 4 & 1
        return code


_CODES = _TokenCodes()


class HashEmbedder:
    """Signed feature hashing of ASCII word counts to unit length (Weinberger et al., 2009)."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        tokens = [t.encode().translate(_WORD_BYTES).split() for t in texts]
        sizes = [len(t) for t in tokens]
        codes = np.fromiter(map(_CODES.__getitem__, chain.from_iterable(tokens)), np.int64,
                            sum(sizes))
        cells = (codes >> 1) % self.dimension
        cells += np.repeat(np.arange(len(texts)) * self.dimension, sizes)
        counts = np.bincount(cells, 1.0 - 2.0 * (codes & 1), len(texts) * self.dimension) \
            .reshape(len(texts), self.dimension)
        # Counts are whole numbers, so the squared length is exact.
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return np.divide(counts, length, out=counts, where=length > 0).astype(np.float32)


def embedding(text: Column, provider, batch_size: int = 32) -> Column:
    """Vector of a text; the zero vector for null or blank text, which never reaches the provider."""
    dimension = provider.dimension

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            values = texts.drop_null()
            vectors = np.zeros((len(texts), dimension), np.float32)
            for i in range(0, len(values), batch_size):
                vectors[rows[i:i + batch_size]] = provider.encode(values.slice(i, batch_size).to_pylist())
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * dimension
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))

    return encode(F.when(~is_blank(text), text))
