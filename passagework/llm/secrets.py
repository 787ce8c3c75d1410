"""Secret scans: fixed patterns, and a battery of randomness tests for everything else.

A run of key-like characters gets a span of kind ``random`` when it cannot be told from uniform noise
over its encoding (chi-squared uniformity, runs and serial correlation), and when it is also far more
likely as noise than as an ordinary identifier. The second part is an e-value, a likelihood ratio that
grows with the length of the run; the e-values of a text are thresholded together (e-BH), which keeps
the expected share of false discoveries below ``RATE`` however many candidates there are.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "random")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType())]))

# The patterns of the base kinds. Letters of the key words count in either case.
KEY_WORDS = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile("(" + re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", KEY_WORDS)
                    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24, "random": 20}

# Every match of ASSIGN holds one of these; every long match of ACCESS and HEX lies in a LONG run.
HINTS = ("passw", "secret", "token", "api")
LONG = re.compile("[A-Za-z0-9+/_=-]{20,}")
CANDIDATE = re.compile("[A-Za-z0-9+/_-]{20,}")

LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (DIGIT + LOWER[:6], DIGIT + UPPER[:6], UPPER + "234567", DIGIT + LOWER, DIGIT + UPPER,
             DIGIT + UPPER + LOWER, UPPER + LOWER + DIGIT + "+/", UPPER + LOWER + DIGIT + "-_")
#: Share of each class of characters in ordinary identifiers, paths and file names.
ORDINARY = {x: share / len(chars) for chars, share in
            ((LOWER, 0.8), (UPPER, 0.08), (DIGIT, 0.08), ("+/-_", 0.04)) for x in chars}
#: Uniformity is given up below this p-value; expected share of false discoveries in a text.
LEVEL, RATE = 0.01, 0.001


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(values: np.ndarray, size: int) -> float:
    """p-value of the chi-squared test, over as many equal cells as give four values each."""
    cells = max(2, min(size, len(values) // 4))
    share = np.diff(np.ceil(np.arange(cells + 1) * size / cells)) / size
    seen = np.bincount(values * cells // size, minlength=cells)
    x = float(((seen - share * len(values)) ** 2 / (share * len(values))).sum())
    df = cells - 1
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson-Hilferty
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs(values: np.ndarray, size: int) -> float:
    """p-value of the number of runs in the upper and the lower half of the alphabet."""
    high = values * 2 >= size
    a, n = int(high.sum()), len(values)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 1 + 2 * a * b / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    return _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(max(spread, 1e-9)))


def serial(values: np.ndarray) -> float:
    """p-value of the correlation of neighbours."""
    x = values - values.mean()
    total = float((x * x).sum())
    if not total:
        return 0.0
    return _two_sided((float((x[1:] * x[:-1]).sum()) / total + 1 / len(x)) * math.sqrt(len(x)))


def looks_uniform(token: str, alphabet: str) -> bool:
    values = np.fromiter(map(alphabet.index, token), np.int64, len(token))
    worst = min(uniformity(values, len(alphabet)), runs(values, len(alphabet)), serial(values))
    return 3 * worst >= LEVEL


def evidence(token: str, alphabet: str) -> float:
    """Log e-value: noise over the alphabet, as one of those tried, against ordinary characters."""
    return -len(token) * math.log(len(alphabet)) - sum(math.log(ORDINARY[x]) for x in token) \
        - math.log(len(ALPHABETS))


def _candidate(token: str) -> float | None:
    """Log e-value under the smallest alphabet that fits, or None if the token is not random."""
    chars = set(token)
    if chars <= set(DIGIT) or not chars & set(DIGIT + UPPER):
        return None
    fitting = [a for a in ALPHABETS if chars <= set(a)]
    if not fitting:
        return None
    alphabet = min(fitting, key=len)
    return evidence(token, alphabet) if looks_uniform(token, alphabet) else None


def discoveries(logs: list[float | None], rate: float = RATE) -> list[bool]:
    """e-BH: the largest k such that k of the m e-values are at least m / (k rate)."""
    ranked = sorted((x for x in logs if x is not None), reverse=True)
    k = max((i for i, x in enumerate(ranked, 1) if x >= math.log(len(logs) / (i * rate))), default=0)
    return [bool(k) and x is not None and x >= ranked[k - 1] for x in logs]


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start, then in the order of ``KINDS``."""
    spans = []
    lower = text.lower()
    if any(hint in lower for hint in HINTS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= LEAST["assign"]]
    long = list(LONG.finditer(text))
    for run in long:
        for pattern, kind in ((ACCESS, "access"), (HEX, "hex")):
            spans += [(*m.span(), kind) for m in pattern.finditer(text, *run.span())
                      if m.end() - m.start() >= LEAST[kind]]
    base = list(spans)
    tokens = [m for run in long for m in CANDIDATE.finditer(text, *run.span())]
    random = discoveries([_candidate(m[0]) for m in tokens])
    spans += [(*m.span(), "random") for m, yes in zip(tokens, random, strict=True)
              if yes and not any(m.start() < end and start < m.end() for start, end, _ in base)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


@F.arrow_udf(SPANS)
def _spans(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in find(x)] if x else []
                     for x in texts.to_pylist()], kind)


def secret_spans(text: Column) -> Column:
    """Array of (kind, start, end), in code points, end exclusive. Null and empty texts have none.

    Spans of one kind never overlap, spans of different base kinds may; equal texts get equal spans,
    and a text is always read as a whole.
    """
    return _spans(F.coalesce(text, F.lit("")))


def mask(text: str, mark: str) -> str:
    """The text with every span, overlapping ones taken together, replaced by ``mark``."""
    out, done = [], 0
    for start, end, _ in find(text):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``; spans in the text are replaced, other texts stay as they are.

    Null stays null. Columns of any other name are passed on untouched.
    """
    @F.arrow_udf(T.StringType())
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else mask(x, mark) for x in texts.to_pylist()], pa.string())

    return docs.withColumn(text_column, masked(F.col(text_column)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id and ``found``, its spans. An empty table gives an empty table."""
    return docs.select(id_column, secret_spans(F.col(text_column)).alias("found"))
