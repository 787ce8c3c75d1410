"""Runs of words that repeat across documents, against a search for all shared windows of words."""

import random

import numpy as np
import pytest

from passagework.llm import anchored_runs as ar
from passagework.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_anchors(hashes, reach):
    three = [int(x) for x in ar.grams(np.array(hashes, np.uint64), 3)] if len(hashes) > 2 else []
    return [i for i, x in enumerate(three) if all(x < y for y in three[max(0, i - reach):i]) and all(x <= y for y in three[i + 1:i + reach + 1])]


@pytest.mark.parametrize("reach", [1, 2, 3, 7, 10])
def test_anchors_like_a_plain_search(reach):
    rng = np.random.default_rng(reach)
    texts = [rng.integers(0, 9, n).astype(np.uint64) for n in (0, 1, 2, 3, 40, 5, 200, 30)]
    number = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = ar.anchors(np.concatenate(texts), number, reach)
    starts = np.cumsum([0, *map(len, texts)])
    assert got.tolist() == [int(starts[i]) + a for i, t in enumerate(texts) for a in brute_anchors(t, reach)]


def test_places_are_code_points():
    texts = ["é one\ttwo", "", " \n ", "\U0001f600x  A"]
    _, text, starts, ends = ar.words_of(texts)
    assert [texts[t][a:b] for t, a, b in zip(text, starts, ends)] == ["é", "one", "two", "\U0001f600x", "A"]


def prose(rng, n):
    return [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnop") + str(rng.randrange(400)) for _ in range(n)]


def shared_words(rows, size):
    """Indexes of the words of each row that lie in a window of ``size`` words that another place has too."""
    seen, words = {}, [(t or "").lower().split() for _, t in rows]
    for r, w in enumerate(words):
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i:i + size]), []).append((r, i))
    out = {}
    for places in seen.values():
        if len(places) > 1:
            for r, i in places:
                out.setdefault(r, set()).update(range(i, i + size))
    return out


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(prose(rng, 300))) for i in range(120)]
    planted = set()
    for n in range(30):  # each passage in two documents, with other words around it and other line breaks
        passage = prose(rng, rng.randrange(51, 90))
        for copy in (2 * n, 2 * n + 1):
            words = rows[copy][1].split()
            at = rng.randrange(len(words))
            broken = [w + ("\n" if rng.random() < 0.1 else " ") for w in passage]
            rows[copy] = (copy, " ".join(words[:at]) + " " + "".join(broken).upper() + " ".join(words[at:]))
            planted.add(copy)
    rows += [(200, None), (201, ""), (202, "too short")]
    got = ar.runs(spark.createDataFrame([(i, t, "?", 0) for i, t in rows], "doc_id long, text string, doc string, row int").repartition(4)).collect()
    found = {r.doc_id for r in got}
    assert found <= planted and len(found) >= 0.9 * len(planted)
    texts = dict(rows)
    shared = shared_words(rows, ar.STRETCH)
    for r in got:  # nothing but repeated words is marked
        words = texts[r.doc_id].split()
        first = len(texts[r.doc_id][:r.start].split())
        many = len(texts[r.doc_id][r.start:r.end].split())
        assert many >= ar.STRETCH and set(range(first, first + many)) <= shared[r.doc_id] and words
        assert r.keep_id == r.doc_id - r.doc_id % 2 and r.copies == 2


def test_copies_ids_and_empty_tables(spark):
    rng = random.Random(6)
    text = " ".join(prose(rng, 200))
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (9, text + " end")], "doc_id long, text string").coalesce(1)
    got = ar.runs(docs).collect()
    assert len(got) == 4 and {r.keep_id for r in got} == {3} and {r.copies for r in got} == {4} and sum(r.kept for r in got) == 1
    assert ar.runs(docs.limit(0)).count() == 0


def test_query_finds_runs_beside_paragraphs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op8_paragraph_dedup"][0](spark, SF).collect()
    assert {r.kind for r in got} <= {"line", "run"}
    want = {rows[r][0] for r in shared_words(rows, 50)}
    assert len(want & {r.doc_id for r in got}) >= 0.9 * len(want) > 0
