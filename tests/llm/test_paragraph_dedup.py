import random

import pytest

from passagework.llm import paragraph_dedup as pd
from passagework.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def grams(line):
    words = line.encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, least=25):
    """All pairs of lines. ``rows``: (id, text). Returns (id, line, keep id, keep line, copies)."""
    lines = [(i, n, grams(x)) for i, t in rows for n, x in enumerate((t or "").split("\n")) if len(x.split()) >= least]
    group = list(range(len(lines)))
    holders = {}
    for a, (_, _, g) in enumerate(lines):
        near = {b for x in g for b in holders.get(x, ())}
        for b in near:
            o = len(g & lines[b][2])
            if group[a] != group[b] and 100 * o >= 80 * (len(g) + len(lines[b][2]) - o):
                old, new = group[a], group[b]
                group = [new if x == old else x for x in group]
        for x in g:
            holders.setdefault(x, []).append(a)
    found = {}
    for a, g in enumerate(group):
        found.setdefault(g, []).append(lines[a][:2])
    return sorted((i, n, *min(x), len(x)) for x in found.values() if len(x) > 1 for i, n in x)


def listed(df):
    return sorted((r.doc_id, r.paragraph, r.keep_id, r.keep_paragraph, r.copies) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(2), []
    passages = [[f"p{p}w{i}" for i in range(rng.randint(40, 90))] for p in range(12)]
    for doc in range(90):
        lines = [" ".join(f"d{doc}l{n}w{i}" for i in range(rng.choice((3, 30, 80)))) for n in range(4)]
        for p in rng.sample(range(12), rng.choice((0, 0, 1, 2))):
            words = list(passages[p])
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = f"x{doc}"
            lines.insert(rng.randrange(5), " ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        out.append((doc, "\n".join(lines)))
    return out


@pytest.mark.parametrize("options", [{}, {"tile": 3, "k": 2}])
def test_like_brute_force(spark, rows, options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert listed(pd.repeats(docs, **options)) == brute(rows)


def test_query_like_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op8_paragraph_dedup"][0](spark, SF).where("kind = 'line'")
    want = brute(rows)
    assert len(set(listed(got)) & set(want)) >= 0.99 * len(want) and len(set(listed(got)) - set(want)) <= 0.01 * len(want)


def test_spans_and_removal(spark, rows):
    odd = [*rows, (90, None), (91, ""), (None, rows[0][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in odd], "doc_id long, text string, doc string, row int")
    texts = {i: t for i, t in rows}
    for r in pd.repeats(docs).where("doc_id is not null").collect():
        assert texts[r.doc_id][r.start:r.end] == texts[r.doc_id].split("\n")[r.paragraph]
    got = pd.remove_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(odd)
    left = got.collect()
    assert pd.repeats(got).count() == 0
    assert {r.text for r in left if r.doc_id in (90, 91)} == {None, ""}
    seen = {line for _, t in rows for line in t.split("\n")}
    assert all(line in seen for r in left if r.text for line in r.text.split("\n"))
    assert pd.repeats(docs.limit(0)).count() == 0 == pd.remove_repeats(docs.limit(0)).count()


def test_bands_and_lines():
    n = pd.bands(80)
    assert 1 - (1 - 0.8 ** 3) ** n >= 0.999 > 1 - (1 - 0.8 ** 3) ** (n - 1)
    assert pd.paragraphs(None) == [] and pd.paragraphs("a b\nc D e", 3) == [(1, 4, 9, [b"c", b"d", b"e"])]
    assert pd.cut_out("a\nb\nc", [(2, 3)]) == "a\nc" and pd.cut_out("a", [(0, 1)]) == ""
