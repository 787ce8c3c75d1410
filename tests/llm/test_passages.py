import random

import pytest

from passagework.llm import paragraph_dedup as pd
from passagework.llm import passages as ps
from passagework.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def later_words(rows, least=50):
    """{row: places of the words in a window that is also before, without a common word}, by comparing all windows."""
    first, found = {}, {}
    for row, (_, text) in enumerate(rows):
        words = (text or "").encode().lower().split()
        for s in range(len(words) - least + 1):
            window = tuple(words[s:s + least])
            r, f = first.setdefault(window, (row, s))
            if r != row or s >= f + least:
                found.setdefault(row, set()).update(range(s, s + least))
    return found


def marked_words(rows, got):
    """The same of the result; also checks each passage against the one that stays."""
    place, found = {i: n for n, (i, _) in enumerate(rows)}, {}
    for r in got:
        text, keep = rows[place[r.doc_id]][1], rows[place[r.keep_id]][1]
        words = text[r.start:r.end].encode().lower().split()
        assert len(words) == r.words >= 50 and r.copies > 1
        assert words == keep[r.keep_start:].encode().lower().split()[:r.words]
        before = len(text[:r.start].encode().split())
        found.setdefault(place[r.doc_id], set()).update(range(before, before + r.words))
    return found


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(5), []
    shared = [[f"é{p}w{i}" for i in range(rng.randint(49, 140))] for p in range(8)]
    for doc in range(80):
        words = [f"d{doc}w{i}" for i in range(rng.choice((5, 60, 200)))]
        at = len(words)
        for p in rng.sample(range(8), rng.choice((0, 1, 2))):
            at = rng.randrange(at + 1)
            words[at:at] = shared[p]
        # Lines below 25 words, of any length, and one line for the whole text.
        longest = rng.choice((3, 20, 90, 1000))
        out.append((doc, "".join(w + ("\n" if rng.random() < 1 / longest else " ") for w in words)))
    return [*out, (80, None), (81, ""), (82, "a " * 300), (83, out[3][1])]


@pytest.mark.parametrize("k", [4096, 2])
def test_like_brute_force_whatever_the_lines(spark, rows, k):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ps.passages(docs, k=k).collect()
    assert marked_words(rows, got) == later_words(rows) != {}
    assert ps.passages(docs.limit(0)).count() == 0


def test_query_finds_all_shared_windows(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert marked_words(rows, QUERIES["op8_passage_dedup"][0](spark, SF).collect()) == later_words(rows) != {}


def test_removal_leaves_no_shared_passage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    left = sorted((r.doc_id, r.text) for r in pd.remove_repeats(docs).collect())
    assert len(left) == len(rows) and later_words(rows) != {} == later_words(left)
    whole, cut = ({w for _, t in x for w in (t or "").split() if w[0] == "é"} for x in (rows, left))
    assert whole == cut


def test_spans_are_cut_once():
    assert ps.cut_passages("abcdefgh", [(4, 6), (1, 3), (2, 5)]) == "agh" and ps.cut_passages("a", []) == "a"
