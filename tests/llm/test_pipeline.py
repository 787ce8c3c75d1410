import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from passagework.llm import packing, quality, secrets
from passagework.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def near_groups(rows, n, percent):
    """The first row of each component, over all pairs."""
    def grams(text):
        words = text.encode().lower().split()
        return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()

    sets, group = [grams(t or "") for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and group[a] != group[b] and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, i), i)
    return [r for r, g in zip(rows, group, strict=True) if least[g] == r[0]]


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output, each stage on what the one before kept."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        result = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        out.append((docs, result))
        docs = result
    return out


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_quality_stage(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.score(before, labels).where("predicted = 1").collect()}
    assert pairs(after) == [p for p in pairs(before) if p[0] in good] and after.columns == before.columns
    marked = {r.doc_id: r.quality for r in labels.collect()}
    assert {i for i in marked if marked[i]} <= good
    assert len(good & {i for i in marked if not marked[i]}) <= 0.2 * sum(not q for q in marked.values())


def test_exact_stage(stages):
    before, after = stages[1]
    first = {}
    for i, text in pairs(before):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), (i, text))
    assert pairs(after) == sorted(first.values()) and after.columns == before.columns


def test_near_stage(stages):
    before, after = stages[2]
    assert pairs(after) == near_groups(pairs(before), 5, 80) and after.columns == before.columns


def test_secret_stage(stages):
    before, after = stages[3]
    assert pairs(after) == [(i, secrets.mask(t, "[SECRET]")) for i, t in pairs(before)]
    assert after.columns == before.columns and after.where("n_chars != length(text)").count() == 0


def test_packing_stage_and_the_whole_run(spark, stages):
    before, after = stages[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text in pairs(before):
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for n in packing.piece_lengths(len(ids), 2048):
            want.append((i, at, n, zlib.crc32(ids[at:at + n].tobytes())))
            at += n
    assert sorted((r.doc_id, r.start, r.length, zlib.crc32(r.ids)) for r in after.collect()) == sorted(want)
    whole = QUERIES["pipeline"][0](spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.length, zlib.crc32(r.ids)) for r in whole) == sorted(want)
    assert len({r.sequence_id for r in whole}) == len(want)


@pytest.mark.parametrize("rows", [
    [], [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "some text", None, "s", 9), (2, "some text", "x", None, 9)] * 2])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.packed(spark, docs, SF).count() <= 8
