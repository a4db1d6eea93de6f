"""Moving windows against their recomputation; the sparse fit by components against the unsplit one; many series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesmith.operators import pairs as P


def spine(spark, x, first="2024-01-01"):
    rows = [(k, i, None if np.isnan(v) else float(v)) for k, vs in x.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "key string, i int, value double").select("key", F.date_add(F.lit(first), F.col("i")).alias("date"), "value")


@pytest.mark.parametrize("steps", [(7,), (1, 1, 30), (0, 12, 39)])
def test_a_moved_window_is_that_computed_anew(spark, steps):
    rng = np.random.default_rng(sum(steps))
    x = {k: rng.normal(size=120) for k in ("asset:A", "asset:B", "indicator:X")} | {"asset:FLAT": np.full(120, 0.25)}
    x["asset:A"][rng.random(120) < 0.2] = np.nan
    on = P.indexed(spine(spark, x)).cache()
    state, window = P.window_moments(on, [0, 1, 4], (0, 39)), (0, 39)
    for step in steps:
        new = (window[0] + step, window[1] + step)
        state, window = P.move_window(state, on, [0, 1, 4], window, new), new
    got = {(r["a"], r["b"], r["lag"]): (r["r"], r["n"]) for r in P.moment_correlations(state, 20).collect()}
    again = {(r["a"], r["b"], r["lag"]): (r["r"], r["n"]) for r in P.moment_correlations(P.window_moments(on, [0, 1, 4], window), 20).collect()}
    assert set(got) == set(again) and all(got[k] == pytest.approx(again[k], abs=1e-9) for k in again) and len(got) > 5
    part = {k: v[window[0] : window[1] + 1] for k, v in x.items()}
    for (a, b, lag), (r, n) in got.items():
        u, v = part[a][lag:], part[b][: 40 - lag]
        both = ~np.isnan(u + v)
        assert n == both.sum() and r == pytest.approx(np.corrcoef(u[both], v[both])[0, 1])
    with pytest.raises(ValueError, match="forward"):
        P.move_window(state, on, [0], (10, 20), (5, 25))


def test_components_are_those_of_each_threshold(spark):
    rng = np.random.default_rng(1)
    names = [f"k{i:02d}" for i in range(30)]
    s = np.abs(rng.normal(size=(30, 30)))
    s = (s + s.T) / 2
    rows = [(names[i], names[j], float(s[i, j]) * (-1) ** i) for i in range(30) for j in range(i, 30)]
    cov = spark.createDataFrame(rows, "a string, b string, c double").repartition(5)
    alphas = [0.5, 1.2, 1.6, 2.0, 9.0]
    got = {(r["step"], r["key"]): r["block"] for r in P.covariance_blocks(cov, alphas).collect()}
    for step, alpha in enumerate(alphas):
        of = list(range(30))
        for _ in of:
            of = [min(of[j] for j in range(30) if i == j or s[i, j] > alpha) for i in range(30)]
        assert [got[step, k] for k in names] == [names[i] for i in of]
    assert len(got) == 150


def test_the_fit_by_components_is_the_unsplit_one(spark):
    """Two groups of series without a link between them: the same pairs and values as one fit of all, and no task holds both groups at larger penalties."""
    rng, size = np.random.default_rng(2), 400
    base = rng.normal(size=(2, size))
    x = {f"asset:{g}{i}": 0.7 * base[g] + rng.normal(size=size) for g in (0, 1) for i in range(4)}
    df = spine(spark, x).cache()
    got = {(r["a"], r["b"]): r["partial_r"] for r in P.partial_correlations(df, 9).collect()}
    names = sorted(x)
    data = np.array([x[k] for k in names])
    s = np.cov(data, bias=True)
    top = np.abs(s[np.triu_indices(8, 1)]).max()
    grid, best = np.logspace(np.log10(0.01 * top), np.log10(top), 9), None
    for alpha in grid:
        theta = P.graphical_lasso(s, float(alpha))
        edges = (np.abs(theta[np.triu_indices(8, 1)]) > 1e-10).sum()
        ebic = -size * (np.linalg.slogdet(theta)[1] - np.trace(s @ theta)) + edges * np.log(size) + 0.4 * edges * np.log(8)
        if best is None or ebic < best[0]:
            best = ebic, theta
    theta = best[1]
    want = {(names[i], names[j]): -theta[i, j] / np.sqrt(theta[i, i] * theta[j, j]) for i in range(8) for j in range(i + 1, 8) if theta[i, j] != 0}
    assert {k for k, v in want.items() if abs(v) > 1e-3} == {k for k, v in got.items() if abs(v) > 1e-3} and len(want) >= 12
    assert all(got[k] == pytest.approx(v, abs=2e-3) for k, v in want.items() if k in got)
    blocks = P.covariance_blocks(P.covariances(P.listwise(df)), grid.tolist())
    sizes = {r["step"]: r["n"] for r in blocks.groupBy("step", "block").count().groupBy("step").agg(F.max("count").alias("n")).collect()}
    assert sizes[0] == 8 and sizes[7] <= 4 and sizes[8] <= 4


def test_two_thousand_series(spark):
    """Blocks follow the number of series: the planted pair is found among two million."""
    rng = np.random.default_rng(7)
    data = rng.normal(size=(2000, 60))
    data[1999] = data[3] + 0.1 * rng.normal(size=60)
    rows = spark.range(2000 * 60, numPartitions=8).select(F.concat(F.lit("asset:"), F.lpad(F.floor(F.col("id") / 60).cast("string"), 4, "0")).alias("key"), (F.col("id") % 60).cast("int").alias("i"))
    values = spark.createDataFrame([(f"asset:{k:04d}", v.tolist()) for k, v in enumerate(data)], "key string, v array<double>")
    df = rows.join(values, "key").select("key", F.date_add(F.lit("2024-01-01"), F.col("i")).alias("date"), F.element_at("v", F.col("i") + 1).alias("value"))
    got = P.pair_statistics(df, [0], [0], least_r=0.9, tests=True).collect()
    assert [(r["a"], r["b"]) for r in got] == [("asset:0003", "asset:1999")] and got[0]["r"] == pytest.approx(np.corrcoef(data[3], data[1999])[0, 1])
    ranks = np.argsort(np.argsort(data[[3, 1999]], axis=1), axis=1)
    assert got[0]["rho"] == pytest.approx(np.corrcoef(ranks)[0, 1]) and got[0]["rho_n"] == 60
