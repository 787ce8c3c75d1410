import numpy as np
import pytest

from passagework.llm import embedding_dedup as ed
from passagework.llm import hnsw


def brute(rows, cosine=0.98):
    """All pairs, in double precision. ``rows``: (id, vector, label)."""
    units = [ed.unit(v) if k is not None else None for _, v, k in rows]
    n, group = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is None or units[b] is None or rows[a][2] != rows[b][2] or len(units[a]) != len(units[b]):
                continue
            if units[a] @ units[b] >= cosine:
                n[a] += 1
                n[b] += 1
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((r[0], n[x], least.get(group[x])) for x, r in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(3), []
    for _family in range(120):
        base = rng.normal(size=16)
        for _ in range(rng.choice((1, 1, 2, 3, 12))):
            v = base + rng.normal(size=16) * rng.choice((0.0, 0.05, 0.15))
            out.append((len(out) * 3 + 1, [float(x) for x in v.astype(np.float32)], int(rng.choice((0, 0, 0, 1)))))
    odd = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.0]]
    out += [(5000 + i, v, 0) for i, v in enumerate(odd)]
    return out + [(6000, out[0][1], None), (None, out[0][1], out[0][2]), (6001, out[5][1], out[5][2])]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df, ed.near_duplicates(df, **options)


@pytest.mark.parametrize("shard, round_bytes", [(8192, ed.ROUND), (40, ed.ROUND), (40, 10_000)])
def test_like_brute_force(spark, rows, shard, round_bytes):
    got = run(spark, rows, shard=shard, round_bytes=round_bytes)[1].collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_and_clashing_columns(spark, rows):
    df, got = run(spark, rows[:3])
    assert ed.near_duplicates(df.limit(0)).count() == 0
    more = df.selectExpr("*", "1 as node", "'x' as unit", "2 as kept")
    assert ed.near_duplicates(more).columns == ["vec_id", "n_links", "component_id", "kept"]
    assert ed.near_duplicates(more).count() == 3


def test_recall_of_the_graph_without_audits():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 32))
    v = np.concatenate([base, base[rng.integers(0, 300, 1200)] + 0.08 * rng.normal(size=(1200, 32)),
                        base[0] + 0.02 * rng.normal(size=(500, 32))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph = hnsw.build(v.astype(np.float32))
    q, p = graph.within(v.astype(np.float32), 0.98)
    truth = v @ v.T >= 0.98 + 1e-6
    got = np.zeros_like(truth)
    got[q, p] = True
    assert (got & truth).sum() / truth.sum() > 0.97
    assert (v @ v.T)[got].min() > 0.98 - 1e-5


def test_graphs_of_few_points():
    for n in (1, 2, 3, 30):
        v = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
        v /= np.linalg.norm(v, axis=1)[:, None]
        q, p = hnsw.build(v).within(v, 0.99)
        assert sorted(zip(q.tolist(), p.tolist(), strict=True)) == [(i, i) for i in range(n)]


def test_a_hot_shard_never_holds_all_pairs():
    """5.8 million pairs of 2,400 near copies: the arrays of ids alone were twice that at once."""
    import tracemalloc

    rng = np.random.default_rng(6)
    v = rng.normal(size=8) + 0.001 * rng.normal(size=(2400, 8))
    table = ed.pa.table({"family": ["x"] * len(v), "shard": [0] * len(v), "node": np.arange(len(v)),
                         "unit": [ed.unit(x.tolist()).tobytes() for x in v], "size": np.ones(len(v), np.int64)})
    batch = ed._graphs(table).append_column("other", ed.pa.nulls(1)).to_batches()[0]
    tracemalloc.start()
    out = list(ed._searched(0.98)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(x for b in out for x in b.column("weight").to_pylist()) == 2400 * 2399
    assert len(out[-1]) == 2399 and peak < 180e6


def as_shard(vectors):
    table = ed.pa.table({"family": ["x"] * len(vectors), "shard": [0] * len(vectors), "node": np.arange(len(vectors)),
                         "unit": [v.tobytes() for v in vectors], "size": np.ones(len(vectors), np.int64)})
    return ed.Shard(ed._graphs(table).to_pylist()[0])


def test_sparse_links_between_shards():
    """Five of 2,000 vectors have a partner in the other shard; the first sixteenth of the queries has none."""
    rng = np.random.default_rng(8)
    one, two = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.normal(size=(2, 2000, 32)))
    partners = np.array([1, 401, 803, 1205, 1999])
    v = two[partners] + 0.01 * rng.normal(size=(5, 32))
    one[[7, 70, 700, 1400, 1998]] = v / np.linalg.norm(v, axis=1)[:, None]
    a, b = as_shard(one), as_shard(two)
    assert not (partners % ed.AUDIT == 0).any()
    assert a.audit(b, 0.98, ed.BEAM, 0.02)[1] == 5
    found = {(int(x), int(y)) for p, q in a.search(b, 0.98) for x, y in zip(p, q, strict=True)}
    assert found == {(7, 1), (70, 401), (700, 803), (1400, 1205), (1998, 1999)}


def test_audit_does_not_count_a_vector_as_its_own_pair():
    v = np.random.default_rng(9).normal(size=(500, 32))
    shard = as_shard(v / np.linalg.norm(v, axis=1)[:, None])
    assert shard.audit(shard, 0.98, ed.BEAM, 0.02) == (0, 0)


def test_graphs_are_stored_once_for_any_number_of_pairs_of_shards(spark):
    """18 shards have 153 pairs. Each graph lies in one folder, and rounds cover every pair once."""
    rng = np.random.default_rng(10)
    rows = [("x", s, 0, b"n" * 8, bytes(rng.bytes(1000)), b"s" * 8, [b"l"]) for s in range(18)] + [
        ("y", 0, 0, b"n" * 8, bytes(1000), b"s" * 8, [b"l"])]
    stored, rounds = ed._rounds(spark.createDataFrame(rows, ed.GRAPH), 4000)
    got = stored.select("family", "shard", "round").collect()
    assert sorted((r.family, r.shard) for r in got) == [("x", s) for s in range(18)]
    place = {r.shard: r["round"] for r in got}
    assert len(rounds) > 3 and all(last == rounds[-1][0] for _, last in rounds)
    assert all(place[a] <= place[b] for a in range(18) for b in range(a, 18))
