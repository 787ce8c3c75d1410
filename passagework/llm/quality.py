"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics come from one pass over the texts and are staged; the trees are fitted on a bounded sample of
labelled rows and flattened into arrays, so that a batch of rows walks all trees level by level in numpy.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.lineage import cut
from passagework.llm.sharding import free

#: Most labelled rows that are fitted on; beyond it, those with the smallest hash of their id.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.15, 1.0, 1.0

UPPER, LOWER, DIGITS = range(65, 91), range(97, 123), range(48, 58)
SPACE = (9, 10, 11, 12, 13, 32)
OTHERS = [b for b in range(128) if b not in (*UPPER, *LOWER, *DIGITS, *SPACE)]
STATISTICS = ("log_bytes", "log_words", "log_lines", "upper", "lower", "digits", "space", "punctuation",
              "not_ascii", "top_punctuation", "entropy", "mean_word", "spread_word", "longest_word",
              "short_words", "distinct_words", "top_word", "distinct_pairs", "words_a_line", "distinct_lines",
              "capitalised", "ends_oddly", "line_ends")


def statistics(text: str) -> list[float]:
    """The numbers named in ``STATISTICS``; an empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    words, lines = text.split(), text.split("\n")
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    times: dict[str, int] = {}
    for word in words:
        times[word] = times.get(word, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(not word[-1].isalnum() and word[-1] not in ".,;:!?" for word in times)
    full = [line for line in lines if line]
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)),
        counts[UPPER].sum() / n, counts[LOWER].sum() / n, counts[DIGITS].sum() / n, counts[list(SPACE)].sum() / n,
        counts[OTHERS].sum() / n, counts[128:].sum() / n, counts[OTHERS].max() / n,
        float(-(share * np.log2(share)).sum()), float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        float((lengths <= 3).sum()) / m, len(times) / m, max(times.values(), default=0) / m,
        pairs / max(len(words) - 1, 1), m / len(lines), len(set(full)) / max(len(full), 1),
        sum(word[0].isupper() for word in times) / max(len(times), 1), ends / max(len(times), 1),
        sum(line[-1] in ".!?" for line in full) / max(len(full), 1)]


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(x.as_py() or "") for x in texts], pa.list_(pa.float32()))


class Trees:
    """Boosted trees of a fixed depth as arrays: node i has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, base: float, feature: np.ndarray, split: np.ndarray, leaf: np.ndarray) -> None:
        self.base, self.feature, self.split, self.leaf = base, feature, split, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; all trees of a level are one gather."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for at in range(0, len(x), 4096):
            part = x[at:at + 4096]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(depth):
                right = part[rows, self.feature[trees, node]] > self.split[trees, node]
                node = 2 * node + 1 + right
            if depth:
                out[at:at + 4096] += self.leaf[trees, node - (2 ** depth - 1)].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Logistic loss, second-order gains over histograms. Without both labels there are no trees."""
    empty = np.zeros((0, 2 ** depth - 1))
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Trees(float(np.log(share / (1 - share))), empty.astype(np.int64), empty, np.zeros((0, 2 ** depth)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(width)], axis=1)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    features, splits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, split = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
        for level in range(depth):
            first, many = 2 ** level - 1, 2 ** level
            local = node - first
            best = np.full(many, 1e-6)
            for f in range(width):
                cell = local * BINS + binned[:, f]
                left_g = np.bincount(cell, g, many * BINS).reshape(many, BINS).cumsum(axis=1)
                left_h = np.bincount(cell, h, many * BINS).reshape(many, BINS).cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g ** 2 / (left_h + L2) + (all_g - left_g) ** 2 / (all_h - left_h + L2) \
                    - all_g ** 2 / (all_h + L2)
                gain[(left_h < LEAST) | (all_h - left_h < LEAST)] = 0
                gain = gain[:, :len(edges[f])]
                if not gain.size:
                    continue
                at = gain.argmax(axis=1)
                top = gain[np.arange(many), at]
                better = top > best
                best[better] = top[better]
                feature[first:first + many][better] = f
                split[first:first + many][better] = edges[f][at[better]]
            right = x[np.arange(n), feature[node]] > split[node]
            node = 2 * node + 1 + right
        at = node - (2 ** depth - 1)
        leaf = RATE * np.bincount(at, g, 2 ** depth) / (np.bincount(at, h, 2 ** depth) + L2)
        margin += leaf[at]
        features.append(feature)
        splits.append(split)
        leaves.append(leaf)
    return Trees(base, np.stack(features), np.stack(splits), np.stack(leaves))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting; a null id is never fitted on and counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(measured: DataFrame, labels: DataFrame, id_column: str, label: str, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``rows`` of the labelled rows outside the held-out third. ``measured`` has the id
    in ``key`` and the statistics in ``x``, or texts in ``text``.

    Rows are sorted before fitting, so the same tables always give the same trees. Null labels and
    labels without a document are left out. Empty tables give a model without trees.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(F.col(id_column))) \
        .select(F.col(id_column).alias("key"), F.col(label).cast("int").alias("target"),
                F.xxhash64(F.col(id_column).cast("string")).alias("draw"))
    order = ["draw", "key", "target"]
    drawn = known.orderBy(*order).limit(rows)  # at most ``rows`` rows, which bounds the broadcast
    x = F.col("x") if "x" in measured.columns else _statistics(F.col("text"))
    found = measured.join(F.broadcast(drawn), "key").select(*order, x.alias("x")) \
        .orderBy(*order, "x").limit(rows).toArrow()
    x = np.array(found["x"].to_pylist(), np.float32).reshape(found.num_rows, len(STATISTICS))
    return fit(x, found["target"].to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (likelihood of label 1), predicted.

    Only the text enters the score. Null counts as empty; empty texts are scored like any other, equal
    texts get equal scores. Without labels of both kinds every row gets the share of label 1, or 0.5.
    Texts of any length are measured whole, rows that repeat stay, and an empty table gives an empty table. Other columns
    are not read. Where the id has the name of a column that is added, the new one gets underscores behind its name.
    """
    held, rating, guess = (free(name, [id_column]) for name in ("held_out", "score", "predicted"))
    measured = cut(docs.select(F.col(id_column).alias("key"), _statistics(F.coalesce(text_column, F.lit(""))).alias("x")))
    rated = _rated(train(measured, labels, id_column, label, rows))
    scored = measured.select("key", rated(F.col("x")).alias("y"))
    return scored.select(F.col("key").alias(id_column), held_out(F.col("key")).alias(held), F.col("y").alias(rating),
                         (F.col("y") >= 0.5).cast("int").alias(guess))


def _rated(model: Trees):
    @F.arrow_udf(T.DoubleType())
    def rated(lists: pa.Array) -> pa.Array:
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(STATISTICS))
        return pa.array(model.score(x))

    return rated


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, with all their columns; see ``score``."""
    text = F.coalesce(text_column, F.lit(""))
    # Statistics are cheap beside a copy of the table: those of labelled rows are taken first, then all.
    measured = docs.select(F.col(id_column).alias("key"), text.alias("text"))
    rated = _rated(train(measured, labels, id_column, label, rows))
    return docs.where(rated(_statistics(text)) >= 0.5)


def checksum_third(doc_id: int) -> int:
    """The remainder that decides about holding out, for use outside Spark."""
    return zlib.crc32(str(doc_id).encode()) % 3
