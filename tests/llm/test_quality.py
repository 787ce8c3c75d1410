import numpy as np
import pytest

from passagework.llm import quality
from passagework.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def walk(model, row):
    """One row through one tree after the other."""
    total = model.base
    for feature, split, leaf in zip(model.feature, model.split, model.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > split[node] else 1)
        total += leaf[node - len(feature)]
    return total


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 5)).astype(np.float32)
    return x, ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1.5)).astype(float)


def test_trees_learn_an_interaction_and_walk_alike(data):
    x, y = data
    model = quality.fit(x[:1000], y[:1000])
    assert ((model.score(x[1000:]) > 0.5) == y[1000:]).mean() > 0.93
    assert np.allclose(model.margin(x[:40]), [walk(model, row) for row in x[:40]])
    again = quality.fit(x[:1000], y[:1000])
    assert (again.margin(x) == model.margin(x)).all()


@pytest.mark.parametrize(("y", "want"), [([], 0.5), ([1.0, 1.0], 0.999), ([0.0], 0.001)])
def test_without_both_labels(y, want):
    model = quality.fit(np.zeros((len(y), 3), np.float32), np.array(y))
    assert np.allclose(model.score(np.ones((2, 3), np.float32)), want)


@pytest.mark.parametrize("text", ["", " ", "\n\n", "a", "é ü", "!!!", "\ud800", "word " * 200_000])
def test_statistics_are_finite(text):
    found = quality.statistics(text)
    assert len(found) == len(quality.STATISTICS) and np.isfinite(found).all()


def test_query_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in QUERIES["op3_quality"][0](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (quality.checksum_third(i) == 1) for i, r in rows.items())
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())
    held = [i for i in labels if rows[i].held_out]
    assert sum(rows[i].predicted == labels[i] for i in held) / len(held) > 0.97


def test_odd_rows_and_the_bound(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "good text here", 0.5), (3, "bad ### ###", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (9, 1), (2, 1)], "doc_id long, quality int")
    got = quality.score(docs, labels, rows=2).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 5
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0 == quality.keep_good(docs.limit(0), labels).count()


@pytest.mark.parametrize("name", ["id", "label", "draw", "key", "target", "x", "y", "text_", "score", "held_out", "Predicted"])
def test_ids_of_any_name(spark, name):
    docs = spark.createDataFrame([(i, "good words here. " * i, 1, 2) for i in range(12)], f"{name} long, body string, other int, source int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], f"{name} long, quality int")
    got = quality.score(docs, labels, name, "body")
    assert got.columns[0] == name and len({c.lower() for c in got.columns}) == 4
    assert sorted(r[0] for r in got.collect()) == list(range(12))
    assert all(r[1] == (quality.checksum_third(r[0]) == 1) and r[3] == (r[2] >= 0.5) for r in got.collect())
    assert quality.keep_good(docs, labels, name, "body").columns == docs.columns
