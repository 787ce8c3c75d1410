import random
import re

import numpy as np
import pyarrow as pa
import pytest

from passagework.llm import components as components_module
from passagework.llm import jaccard_join as jj
from passagework.llm.components import components
from passagework.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_set(text, n=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, percent=90):
    """Components over all pairs whose sizes allow a link. ``rows``: (id, text)."""
    sets = [(i, plain_set(t)) for i, t in rows]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if not x or not y or group[a] == group[b] or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            o = len(x & y)
            if 100 * o >= percent * (len(x) + len(y) - o):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(sets, group, strict=True):
        least[g] = min(least.get(g, i), i)
    return sorted((i, len(s), least[g]) for (i, s), g in zip(sets, group, strict=True))


def edits(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at:at + 1] = [[], [f"n{rng.random()}"], [words[at], f"n{rng.random()}"]][kind] or ["x"]
    return words


@pytest.fixture(scope="module")
def rows():
    """Families of near copies of all sizes, with shared passages and very common words."""
    rng, out = random.Random(7), []
    for family in range(60):
        n = rng.choice((1, 2, 3, 5, 9, 11, 12, 18, 22, 25, 28, 31, 36, 60, 120, 400))
        base = [rng.choice(("the", "of", "and", f"w{family}a{i}", f"w{family}b{i}")) for i in range(n)]
        for copy in range(rng.choice((1, 2, 4, 9))):
            words = edits(rng, base, rng.choice((0, 1, 1, 2, 3, max(1, n // 40))))
            out.append((rng.randrange(10 ** 6) * 1000 + len(out), rng.choice((" ", "\n", "\t ")).join(words)))
    return out + [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two")]


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jj.similar(docs, **options).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)


@pytest.mark.parametrize("options", [{}, {"tile": 3, "k": 2}])
def test_like_brute_force(spark, rows, options):
    assert run(spark, rows, **options) == brute(rows)


def test_tiles_by_members(spark, rows):
    assert run(spark, rows, members=200) == brute(rows)


@pytest.mark.parametrize("options", [{}, {"tile": 5, "k": 2}])
def test_another_threshold(spark, rows, options):
    assert run(spark, rows, percent=80, **options) == brute(rows, 80)


def test_one_large_family_over_many_tiles(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edits(rng, base, rng.choice((1, 2, 3, 5, 9))))) for i in range(90)]
    assert run(spark, rows, tile=8) == brute(rows)


def test_query_like_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op4_jaccard_join"][0](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_linked_sets_share_a_key():
    rng, keys = np.random.default_rng(5), jj.Keys()
    for n in [*range(9, 60), 100, 333, 1000, 5000]:
        for _ in range(6):
            pool = np.unique(rng.integers(0, 2 ** 64, n + n // 8 + 2, np.uint64))
            cuts = rng.permutation(len(pool))
            most = len(pool) - n
            a = np.sort(pool[cuts[:n]])
            for m in range(0, most + 1):
                b = np.sort(np.concatenate([a[m:], pool[cuts[n:n + rng.integers(0, most + 1)]]]))
                o = len(np.intersect1d(a, b))
                if 100 * o >= 90 * (len(a) + len(b) - o):
                    assert np.intersect1d(keys.of(a), keys.of(b)).size, (n, m)


def test_a_passage_in_common_ties_no_sets_together(spark, monkeypatch):
    rng, tied = random.Random(11), []
    passage = [f"licence{i}" for i in range(40)]
    rows = []
    for family in range(40):
        words = [f"w{family}a{i}" for i in range(150)]
        rows += [(2 * family, " ".join(words + passage))] + [(2 * family + 1, " ".join(edits(rng, words, 3) + passage))] * (family < 3)
    whole = jj.bounded
    monkeypatch.setattr(jj, "bounded", lambda sets, *rest: tied.extend(sets.collect()) or whole(sets, *rest))
    assert run(spark, rows, percent=80, n=5) == [
        (i, len(plain_set(text, 5)), i - i % 2) for i, text in sorted(rows)]
    assert len(tied) == 6 and len({r.cluster for r in tied}) == 3


def test_linked_sets_share_a_rare_key():
    rng = np.random.default_rng(8)
    for n in [*range(1, 40), 100, 1000]:
        for _ in range(10):
            pool = np.unique(rng.integers(0, 2 ** 64, n + n // 4 + 2, np.uint64))
            kind = rng.integers(0, 4, len(pool)).astype(np.uint8)  # how common others are has no part in it
            cuts = rng.permutation(len(pool))
            one = np.sort(cuts[:n])
            two = np.sort(np.concatenate([cuts[rng.integers(0, n // 4 + 1):n], cuts[n:n + rng.integers(0, n // 4 + 2)]]))
            shared = np.intersect1d(one, two)
            kind[shared] = np.maximum(kind[shared], 1)
            a, b = (jj.rare_keys(pool[x], kind[x], 80) for x in (one, two))
            if 100 * len(shared) >= 80 * (len(one) + len(two) - len(shared)):
                assert np.intersect1d(a, b).size, n
            assert len(a) <= n - -(-80 * n // 100) + 1


def test_what_two_texts_share_is_never_of_the_first_class(spark, monkeypatch):
    monkeypatch.setattr(jj, "SORTED", 50)  # counted in many pieces
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", "alone in here"]
    common = jj.common_grams(spark.createDataFrame([(x,) for x in texts], "text string").repartition(3), 3).value
    sets = jj.shingle_sets(pa.array(texts), 3)
    hashes, times = np.unique(np.concatenate(sets), return_counts=True)
    least = sum((times >= x).astype(int) for x in jj.COMMON)
    assert (common.of(hashes) >= least).all()
    assert (common.of(hashes) == least).mean() > 0.9 and common.of(sets[-1]).max() <= 1
    empty = jj.common_grams(spark.createDataFrame([], "text string"), 3).value
    assert not empty.of(hashes).any()


def test_sets_of_many_texts(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \n", "One", "one TWO", "A b  C\x0bd\x0ce\tf", "\x1c a \x1d b\x85c d é E", "q" * 64 + " " + "q" * 65 + " " + "q" * 300]
    texts += ["".join(rng.choice("ab AB\n\té\x0b") for _ in range(rng.randrange(60))) for _ in range(300)]
    monkeypatch.setattr(jj, "BYTES", 200)
    for kind in (pa.string(), pa.large_string()):
        found, plain = {}, {}
        batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["text"]).slice(1)
        sets = [x for piece in jj.pieces(batch) for x in jj.shingle_sets(piece.column("text"))]
        for text, got in zip(texts[1:], sets, strict=True):
            want = plain_set(text)
            assert len(got) == len(want) and (got[1:] > got[:-1]).all()
            assert found.setdefault(want, got.tobytes()) == got.tobytes() and plain.setdefault(got.tobytes(), want) == want


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64) << np.uint64(45)) for _ in range(40)]
    tile = jj.Tile(sets, 90)
    bits = jj.BitTile([len(s) for s in sets], [jj.bitmap(s) for s in sets], 90)
    for i in range(40):
        links = {j for j in range(40) if tile.linked(i, j)}
        assert set(tile.may_link(i, 0, 40).tolist()) >= links
        assert set(bits.may_link(i, 0, 40).tolist()) >= links


def test_odd_rows(spark):
    rows = [(1, "a b c", 1), (1, "a b c", 1), (None, "a b c", 2), (None, "x y", 3), (None, None, 4), (5, None, 5), (6, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = jj.similar(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [
        ("1", 1, "1"), ("1", 1, "1"), ("5", 0, "5"), ("6", 0, "6"), ("None", 0, "None"), ("None", 1, "1"), ("None", 1, "None")]
    left = jj.drop_similar(docs)
    assert left.columns == docs.columns
    assert sorted(r.row for r in left.collect()) == [1, 3, 4, 5, 6]
    assert jj.similar(docs.limit(0)).count() == 0 == jj.drop_similar(docs.limit(0)).count()


@pytest.mark.parametrize("links", [1_000_000, 4])
@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(2, 1), (None, 3)], [(i, i + 1) for i in range(60)], [(99, i) for i in range(80)],
    [(i, (i * 7) % 50) for i in range(50)], [(i, 100 - i) for i in range(50)] + [(100, 7), (8, 93)]])
def test_components(spark, edges, links, monkeypatch):
    monkeypatch.setattr(components_module, "LINKS", links)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.component for r in components(df).collect()}
    want = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in edges:
        for a, b in edges:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
