"""Whitening against plain numpy and whole-number sums."""

import numpy as np
import pytest

from passagework.llm.whitening import Centre, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, most=16, counts=False):
    """{vec_id: (n, deviation, explained, whitened)} and the distinct vectors."""
    kept = {i: tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for i, v in rows
            if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)}
    fit = list(kept.values()) if counts else sorted(set(kept.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, np.float64) - np.array(sums) / n
    values, axes = np.linalg.eigh(x.T @ x / n)
    values, axes = values[::-1], axes[:, ::-1]
    full = values.sum()
    many = min(most, int((values > 1e-12 * values[0]).sum()))
    out = {}
    for i, v in kept.items():
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        out[i] = n, deviation, values[:many] / full, (np.array(v) - np.array(sums) / n) @ axes[:, :many] / np.sqrt(values[:many])
    return out


def check(got, want):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert by.keys() == want.keys()
    signs = None
    for i, (n, deviation, explained, whitened) in want.items():
        rows = [by[i][c] for c in sorted(by[i])]
        assert sorted(by[i]) == list(range(1, len(whitened) + 1))
        assert {(r.n, int(r.deviation)) for r in rows} == {(n, deviation)}
        assert np.allclose([r.explained for r in rows], explained, rtol=1e-9)
        mine = np.array([r.whitened for r in rows])
        assert np.allclose(np.abs(mine), np.abs(whitened), atol=1e-7)
        if signs is None and (np.abs(whitened) > 1e-3).all():
            signs = np.sign(mine * whitened)
        if signs is not None:
            assert np.allclose(mine, signs * whitened, atol=1e-7)
    assert max(abs(r.identity_error) for r in got) < 1e-9


def sample(seed, n, dim, copies):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.3, (n, dim)) * np.linspace(1, 3, dim)
    v[: int(n * copies)] = v[0]
    return [(i, v[i].astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("copies,weights,k", [(0.0, "one", 4096), (0.4, "one", 2), (0.4, "count", 4096)])
def test_agrees_with_numpy(spark, copies, weights, k):
    rows = sample(1, 300, 20, copies)
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(5)
    check(whiten(table, weights=weights, k=k).collect(), brute(rows, counts=weights == "count"))


def test_odd_rows_are_left_out_and_columns_may_clash(spark):
    good = sample(2, 40, 5, 0.0)
    odd = [(100, None), (101, [0.1, None, 0.2, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, [])]
    table = spark.createDataFrame([(i, v, 0) for i, v in good + odd], SCHEMA)
    want = whiten(table).orderBy("vec_id", "component").collect()
    check(want, brute(good + odd))
    names = ["n", "x", "digest", "component", "whitened", "count", "one", "w", "deviation", "id"]
    clash = table.selectExpr("*", *(f"'?' as {name}" for name in names))
    got = whiten(clash).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component, r.deviation) for r in got] == [(r.vec_id, r.component, r.deviation) for r in want]


def test_repeated_and_null_ids_flat_and_empty_tables(spark):
    rows = [(None, [0.1, 0.2], 0), (1, [0.1, 0.2], 0), (1, [0.5, 0.1], 0), (2, [0.9, 0.9], None)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 8 and {r.n for r in got} == {3} and sum(r.vec_id is None for r in got) == 2
    assert whiten(spark.createDataFrame(rows[:2], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    # One direction has spread, the other has none.
    line = whiten(spark.createDataFrame([(i, [0.1 * i, 0.1 * i], 0) for i in range(9)], SCHEMA)).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_unlike_lengths_are_an_error(spark):
    with pytest.raises(ValueError, match="1 to 2 entries"):
        whiten(spark.createDataFrame([(1, [0.1], 0), (2, [0.1, 0.2], 0)], SCHEMA))


def test_large_sums_stay_exact():
    x = np.array([[2 ** 40, 5], [2 ** 40 + 3, 7], [2 ** 40 + 8, 2 ** 45]], np.int64)
    n, sums = 10 ** 7, [(2 ** 40 + 2) * 10 ** 7 + 3, 9 * 10 ** 7 + 1]
    want = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    assert Centre(n, sums).deviations(x) == want
