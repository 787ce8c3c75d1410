import hashlib
import re

import pytest

from passagework.llm.exact_dedup import COUNTERS, drop_copies, mark_copies, trim


def brute(rows):
    """Group rows by normalised text; among equal texts the smallest id stays."""
    groups = {}
    for doc_id, text in rows:
        text = re.sub("[\x20\x09-\x0d]+", " ", text or "")
        groups.setdefault(hashlib.sha256(text.encode()).hexdigest(), []).append(doc_id)
    out = []
    for digest, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        out += [(i, keep, len(ids), digest) for i in ids]
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (4, None), (1, ""), (2, " "), (7, "ab"), (8, "a\x0bb"),
        (None, "only"), (None, "a\nb"), (6, "x y"), (10, "x\u00a0y"), (3, "a b")]


@pytest.mark.parametrize("k", [1, 2, COUNTERS])
def test_marks_like_brute_force(spark, k):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = mark_copies(docs, k=k).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) \
        == brute(ROWS)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_drop_keeps_all_columns_and_one_row_of_each_text(spark):
    rows = [(i, t, "k", i, "d") for i, t in ROWS] + [(3, "a b", "k", 3, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, row long, digest string")
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 10, 2, 3, 6, 7, 9, None]


def test_one_text_on_most_rows(spark):
    docs = spark.range(5000).selectExpr(
        "id as doc_id", "case when id % 3 > 0 then 'hot' else concat('t', id) end as text")
    got = mark_copies(docs, k=8)
    assert got.where("group_size = 3333 and keep_id = 1").count() == 3333
    assert got.where("kept").count() == 1668


def test_long_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "word\n" * 400_000)],
                                 "doc_id long, text string")
    assert [r.keep_id for r in mark_copies(docs).collect()] == [1, 1]
    assert mark_copies(docs.limit(0)).count() == 0 and drop_copies(docs.limit(0)).count() == 0


def test_counters_fall_together():
    assert trim({"a": 5, "b": 3, "c": 1}, 2) == {"a": 4, "b": 2}
    assert trim({"a": 1, "b": 1}, 1) == {}
