import math

import pytest
from pyspark.sql import functions as F

from tidesmith.operators import graph as G
from tidesmith.operators import pairs as P
from tidesmith.operators import series as S
from tidesmith.operators import text as X


def series(spark, key, values):
    rows = [(key, f"2024-01-{i + 1:02d}", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, date string, value double").withColumn("date", F.to_date("date"))


def values(df):
    return [r["value"] for r in df.orderBy("key", "date").collect()]


def test_log_return_of_doubling(spark):
    assert values(S.transform(series(spark, "asset:A", [100.0, 200.0, 0.0, 5.0]))) == [pytest.approx(math.log(2)), None, None]


def test_indicator_is_differenced(spark):
    assert values(S.transform(series(spark, "indicator:X", [1.0, 3.0, 2.0]))) == [2.0, -1.0]


def test_zscore_of_constant_is_null(spark):
    assert values(S.zscore(series(spark, "asset:A", [42.0] * 5))) == [None] * 5


def test_winsorize_takes_nearest_rank(spark):
    got = values(S.winsorize(series(spark, "asset:A", [float(i) for i in range(28)]), 0.1, 0.9))
    assert min(got) == 3.0 and max(got) == 24.0


def test_forward_fill_over_union_of_dates(spark):
    df = series(spark, "asset:A", [1.0, 2.0, 3.0]).union(series(spark, "asset:B", [7.0]))
    assert values(S.forward_fill(df)) == [1.0, 2.0, 3.0, 7.0, 7.0, 7.0]


def test_p_values(spark):
    p = P.two_sided_p([2.0, -2.0, 0.0, 1.0, 40.0, 1e-9, 2.0, 1.0], [10, 10, 10, 1, 3000, 5, 0, 2])
    assert p[:4] == pytest.approx([0.0734, 0.0734, 1.0, 0.5], abs=1e-4) and p[4] == pytest.approx(0, abs=1e-200) and p[5] == pytest.approx(1)
    assert math.isnan(p[6]) and p[7] == pytest.approx(0.42265, abs=1e-5)
    t = [0.3, 5.0, 1.7, 2.0]
    assert list(P.two_sided_p(t, 47)) == [float(P.two_sided_p(x, 47)) for x in t]  # whatever stands beside it
    rows = spark.createDataFrame([(1, 1.0, 2), (2, None, 9), (3, 0.0, 3)], "k int, t double, n int")
    assert {r["k"]: r["p"] for r in P.p_values(rows).collect()} == {1: None, 2: None, 3: 1.0}


def plain_adjusted(p):
    order, m = sorted(range(len(p)), key=lambda i: p[i]), len(p)
    out, low = [0.0] * m, 1.0
    for place in range(m, 0, -1):
        i = order[place - 1]
        low = min(low, p[i] * m / place)
        out[i] = low
    return out


def test_false_discovery_is_that_of_a_plain_loop(spark):
    import random

    r = random.Random(2)
    p = [r.random() ** 8 for _ in range(300)] + [r.random() for _ in range(300)] + [0.0, 0.0, 1.0, 1.0, 0.25, 0.25, 1 / 1024, 1e-300]
    df = spark.createDataFrame(list(enumerate(p)) + [(9999, None)], "k int, p double")
    got = {r["k"]: r["adjusted_p"] for r in P.false_discovery(df, 1.0).collect()}
    assert [got[i] for i in range(len(p))] == pytest.approx(plain_adjusted(p)) and len(got) == len(p)
    assert P.false_discovery(df.limit(0)).count() == 0
    few = {r["k"] for r in P.false_discovery(df, 0.1).collect()}
    assert few == {i for i, a in enumerate(plain_adjusted(p)) if a <= 0.1}


def test_leader_is_b(spark):
    a = series(spark, "asset:A", [1.0, 5.0, 2.0, 8.0])
    b = a.withColumn("key", F.lit("asset:B")).withColumn("date", F.date_add("date", 1))
    rows = P.lagged(a.union(b), [1]).where("a = 'asset:B' and b = 'asset:A'").collect()
    assert all(r["x"] == r["y"] for r in rows) and len(rows) == 4


def test_glasso_meets_its_conditions():
    """At the optimum cov - w is the penalty times a sign where the precision is not zero, at most the penalty elsewhere, and zero on the diagonal."""
    import numpy as np

    rng = np.random.default_rng(1)
    z = rng.normal(size=300)
    x = np.stack([z, z + 0.3 * rng.normal(size=300), z + 0.3 * rng.normal(size=300), *rng.normal(size=(5, 300))])
    cov = np.cov(x, ddof=0)
    for alpha in (0.02, 0.1, 0.4):
        theta = P.graphical_lasso(cov, alpha, tol=1e-8)
        gap, off = np.linalg.inv(theta) - cov, ~np.eye(len(cov), dtype=bool)
        assert np.abs(np.diag(gap)).max() < 1e-5 and np.abs(gap[off]).max() < alpha + 1e-5
        on = off & (theta != 0)
        assert np.abs(gap[on] - alpha * np.sign(theta[on])).max(initial=0) < 1e-5 and (theta[off] == 0).any()
    theta = P.graphical_lasso(cov, 0.05)
    assert abs(theta[1, 2]) < min(abs(theta[0, 1]), abs(theta[0, 2]))


def test_partial_correlations_leave_out_what_is_empty(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=(120, 3))
    x[:, 2] += x[:, 0]
    rows = [(k, i, float(x[i, j])) for j, k in enumerate("abc") for i in range(120) if (j, i) != (1, 7)] + [("none", i, None) for i in range(120)] + [("b", 7, None)]
    got = P.partial_correlations(spark.createDataFrame(rows, "key string, date int, value double")).collect()
    assert {r["n"] for r in got} == {119} and max(got, key=lambda r: abs(r["partial_r"]))["b"] == "c"
    assert P.partial_correlations(spark.createDataFrame([], "key string, date int, value double")).count() == 0


def test_bootstrap_is_that_of_numpy(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(20, 2))
    rows = [("p", i, *map(float, x[i])) for i in range(20)] + [("q", i, 1.0 * i, 2.0 * i) for i in range(5)]
    got = {r["a"]: r for r in P.bootstrap(spark.createDataFrame(rows[::-1], "a string, idx int, x double, y double"), ["a"]).collect()}
    r = [np.corrcoef(*x[at].argsort(0).argsort(0).T)[0, 1] for at in np.random.default_rng(42).integers(0, 20, (1000, 20))]
    assert [got["p"]["low"], got["p"]["high"]] == pytest.approx(list(np.percentile(r, [2.5, 97.5])))
    assert got["p"]["n"] == 20 and (got["q"]["n"], got["q"]["low"], got["q"]["high"], got["q"]["excludes_zero"]) == (5, None, None, False)


def test_bootstrap_has_every_monthly_pair(spark):
    from tidesmith.plans.catalogue import QUERIES

    pairs = lambda name: {(r["a"], r["b"], r["n"]) for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    assert pairs("bootstrap_ci") == pairs("monthly_join")


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_pair_statistics_are_those_of_numpy(spark, blocks):
    """Gaps, a constant, a short series and a following one; blocks change nothing."""
    import numpy as np

    rng, size = np.random.default_rng(6), 90
    x = {k: rng.normal(size=size) for k in ("asset:A", "asset:B", "indicator:X", "asset:C", "asset:S")}
    x["asset:B"][5:20] = np.nan
    x["asset:C"][:] = 3.0
    x["asset:S"][: size - 25] = np.nan
    x["asset:A"][2:] += 4 * x["indicator:X"][:-2]
    rows = [(k, i, None if np.isnan(v) else float(v)) for k, vs in x.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "key string, date int, value double")
    rows = P.pair_statistics(df, [0, 1], [0, 1, 2], least_n=20, tests=True, blocks=blocks).collect()
    got = {(r["a"], r["b"], r["lag"]): r for r in rows}
    assert len(got) == len(rows)
    want = {}
    for a in x:
        for b in x:
            for lag in (0, 1, 2):
                if a == b or (lag == 0 and a > b) or (lag == 2 and "indicator:X" not in (a, b)):
                    continue
                u, v = x[a][lag:], x[b][: size - lag]
                on = ~np.isnan(u + v)
                if on.sum() >= 20 and u[on].std() > 0 and v[on].std() > 0:
                    want[a, b, lag] = np.corrcoef(u[on], v[on])[0, 1], on.sum()
    assert set(got) == set(want) and all(got[k]["r"] == pytest.approx(r) and got[k]["n"] == n for k, (r, n) in want.items())
    half = [np.corrcoef(x["asset:A"][p][2:], x["indicator:X"][p][:-2])[0, 1] for p in (slice(0, 45), slice(45, None))]
    assert [got["asset:A", "indicator:X", 2][c] for c in ("r1", "r2")] == pytest.approx(half)
    whole = {(r["a"], r["b"], r["lag"]): r["n"] for r in P.pair_statistics(df, [0, 1], [0, 1, 2], least_n=20, complete=True, min_obs=60, blocks=blocks).collect()}
    assert set(whole.values()) == {size - 2 - 17} and not any("asset:S" in k or "asset:C" in k for k in whole)
    assert P.pair_statistics(df.limit(0)).count() == 0


def test_daily_run_finds_the_planted_leader(spark):
    """A follows X by two days; of two series of one group none is linked; noise is not."""
    import numpy as np

    from tidesmith.operators import pipelines

    rng, size = np.random.default_rng(8), 300
    x = {k: rng.normal(size=size) for k in ("asset:A", "asset:N", "asset:G", "asset:H", "indicator:X", "asset:LATE", "asset:MKT")}
    x["asset:H"] = x["asset:G"] + 0.1 * rng.normal(size=size)
    x["asset:A"][3:] = 0.02 * x["indicator:X"][1:-2] + 0.003 * rng.normal(size=size - 3)
    walk = {k: 100 * np.exp(0.01 * np.cumsum(v)) if k != "asset:A" else 100 * np.exp(np.cumsum(v)) for k, v in x.items() if k.startswith("asset:")}
    walk["indicator:X"] = np.cumsum(x["indicator:X"])
    rows = [(k, i, float(v)) for k, vs in walk.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "key string, i int, value double").select("key", F.date_add(F.lit("2024-01-01"), F.col("i")).alias("date"), "value")
    few = lambda kind, *r: spark.createDataFrame(list(r), kind)
    kinds = few("key string, category string", *((k, "equity") for k in walk))
    rules = pipelines.Rules(few("key string, grp string", ("asset:G", "g"), ("asset:H", "g")), kinds, few("lo string, hi string"))
    sectors = few("key string, sector_key string")
    found = pipelines.daily(df, 252, few("id string", ("LATE",)), "asset:MKT", sectors, rules)
    got = found.candidates.collect()
    assert {(r["a"], r["b"], r["lag"], r["direction"], r["tier"], r["method"]) for r in got} == {("asset:A", "indicator:X", 2, "positive", "strong", "pearson")}
    assert got[0]["n"] > 150 and got[0]["stability"] > 0.7 and got[0]["p"] < 1e-6 and found.total.first()["n"] == 15
    none = pipelines.daily(df, 252, few("id string", ("LATE",)), "asset:MKT", sectors, rules._replace(blocked=few("lo string, hi string", ("equity", "equity"))))
    assert none.candidates.count() == 0
    # stored over an earlier run's edges
    old = spark.createDataFrame([("asset:A", "indicator:X", 1, "pearson", 252, "candidate", None), ("asset:A", "indicator:X", 2, "pearson", 63, "candidate", None), ("asset:A", "indicator:X", 2, "pearson", 252, "rejected", "likely_spurious")], "a string, b string, lag int, method string, window_days int, status string, verdict string")
    old = old.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("r", "double"), ("p", "double"), ("n", "long"), ("strength", "double"), ("direction", "string"), ("tier", "string"))))
    edges, audit = pipelines.store(old, found, few("key string", ("asset:A",), ("indicator:X",)), 252, F.lit("2024-10-26").cast("date"), "pearson")
    kept = {(r["lag"], r["window_days"]): (r["status"], r["verdict"], r["r"]) for r in edges.collect()}
    assert kept == {(2, 63): ("candidate", None, None), (2, 252): ("rejected", "likely_spurious", got[0]["r"])}
    assert tuple(audit.select("total_pairs", "above", "surviving", "stored", "cleared").first()) == (15, audit.first()["above"], 1, 1, 1)
    gone, audit = pipelines.store(edges, found, few("key string", ("asset:A",)), 252, F.current_date(), "pearson")
    assert gone.count() == 2 and audit.first()["stored"] == 0


def test_monthly_run_finds_what_is_planted(spark):
    """A follows X in the same month for ten years; an indicator outside the set, and years before, take no part."""
    import numpy as np

    from tidesmith.operators import pipelines

    rng, months = np.random.default_rng(3), 150
    x = {k: rng.normal(size=months) for k in ("X", "Y", "OUT", "A", "N")}
    x["A"][-121:] = 0.05 * x["X"][-121:] + 0.01 * rng.normal(size=121)
    x["OUT"] = x["X"].copy()
    walk = {"asset:A": 100 * np.exp(np.cumsum(x["A"] * 0.3)), "asset:N": 100 * np.exp(np.cumsum(x["N"] * 0.02)), **{f"indicator:{k}": np.cumsum(x[k]) for k in ("X", "Y", "OUT")}}
    rows = [(k, i, float(v)) for k, vs in walk.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "key string, i int, value double").select("key", F.add_months(F.lit("2012-01-15").cast("date"), F.col("i")).alias("date"), "value")
    few = lambda kind, *r: spark.createDataFrame(list(r), kind)
    kinds = few("key string, category string", *((k, k.split(":")[0]) for k in walk))
    rules = pipelines.Rules(few("key string, grp string"), kinds, few("lo string, hi string"))
    found = pipelines.monthly(df, few("id string", ("X",), ("Y",)), rules)
    got = found.candidates.collect()
    assert [(r["a"], r["b"], r["method"], r["window_days"], r["stability"], r["flags"]) for r in got] == [("asset:A", "indicator:X", "spearman", 3650, "stable", "")]
    assert got[0]["n"] == 120 and got[0]["r"] > 0.9 and got[0]["p"] < 1e-6 and found.total.first()["n"] == 4
    none = pipelines.monthly(df, few("id string", ("X",)), rules._replace(blocked=few("lo string, hi string", ("asset", "indicator"))))
    assert none.candidates.count() == 0 and none.above.count() == 0


def test_partial_run(spark):
    """Two links planted: one between series of a group goes, one stays; series that are not daily take no part, and two series are too few for a pass."""
    import numpy as np

    from tidesmith.operators import pipelines

    rng, size = np.random.default_rng(5), 260
    x = {k: rng.normal(size=size) for k in ("A", "B", "C", "D", "E", "LATE")}
    x["B"] += x["A"]
    x["D"] += x["C"]
    x["LATE"] = x["E"].copy()
    walk = {f"asset:{k}": 100 * np.exp(0.01 * np.cumsum(v)) for k, v in x.items()}
    rows = [(k, i, float(v)) for k, vs in walk.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "key string, i int, value double").select("key", F.date_add(F.lit("2024-01-01"), F.col("i")).alias("date"), "value")
    few = lambda kind, *r: spark.createDataFrame(list(r), kind)
    kinds = few("key string, category string", *((k, "equity") for k in walk))
    rules = pipelines.Rules(few("key string, grp string", ("asset:C", "g"), ("asset:D", "g")), kinds, few("lo string, hi string"))
    late = few("id string", ("LATE",))
    found = pipelines.partial(df, 252, late, few("id string"), few("id string", ("A",), ("B",), ("C",)), rules)
    got = found.candidates.collect()
    assert [(r["a"], r["b"], r["status"], r["p"], r["lag"]) for r in got] == [("asset:A", "asset:B", "candidate", 0.0, 0)] and got[0]["r"] > 0.4
    assert found.total.first()["n"] == 10 + 1
    open_ = pipelines.partial(df, 252, late, few("id string"), few("id string"), rules._replace(groups=few("key string, grp string")))
    assert {(r["a"], r["b"]) for r in open_.candidates.collect()} == {("asset:A", "asset:B"), ("asset:C", "asset:D")}


def test_market_and_sector_are_taken_out(spark):
    """Of four series: one with its sector, one whose sector has no series, one without a sector in the map, and one with too few rows."""
    import numpy as np

    rng, n = np.random.default_rng(6), 80
    x = {"asset:MKT": rng.normal(size=n), "asset:SEC": rng.normal(size=n)}
    x |= {"asset:A": 2 * x["asset:MKT"] - x["asset:SEC"] + 0.1 * rng.normal(size=n), "asset:B": 1 + x["asset:MKT"] + 0.1 * rng.normal(size=n), "asset:C": rng.normal(size=n), "asset:D": rng.normal(size=n)}
    x["asset:D"][25:] = np.nan
    x["asset:A"][7] = np.nan
    df = spark.createDataFrame([(k, i, None if np.isnan(v) else float(v)) for k, vs in x.items() for i, v in enumerate(vs)], "key string, date int, value double")
    sectors = spark.createDataFrame([("asset:A", "asset:SEC"), ("asset:B", "asset:GONE"), ("asset:D", None)], "key string, sector_key string")
    got = {}
    for r in S.beta_residual(df, "asset:MKT", sectors).orderBy("date").collect():
        got.setdefault(r["key"], []).append(np.nan if r["value"] is None else r["value"])
    for key, columns in (("asset:A", ["asset:MKT", "asset:SEC"]), ("asset:B", ["asset:MKT"])):
        on = ~np.isnan(x[key])
        m = np.column_stack([np.ones(n), *(x[c] for c in columns)])
        want = x[key] - m @ np.linalg.lstsq(m[on], x[key][on], rcond=None)[0]
        assert np.allclose(got[key], want, equal_nan=True)
    assert all(np.allclose(got[k], x[k], equal_nan=True) for k in ("asset:MKT", "asset:SEC", "asset:C", "asset:D"))
    same = S.beta_residual(df, "asset:NONE", sectors)
    assert sorted(map(str, same.collect())) == sorted(map(str, df.collect()))


def test_prices_that_are_missing_take_no_part(spark, tmp_path):
    from tidesmith.sources.market import market_long

    d, nan = str(tmp_path), float("nan")
    for name, rows, kinds in [
        ("supplier", [(1, 7)], "s_suppkey long, s_nationkey long"), ("nation", [(7, 2)], "n_nationkey long, n_regionkey long"),
        ("lineitem", [(1, 10.0, "2024-01-02"), (1, nan, "2024-01-02"), (1, None, "2024-01-02"), (1, 20.0, "2024-01-02"), (1, nan, "2024-01-03")], "l_suppkey long, l_extendedprice double, l_shipdate string"),
        ("orders", [("1-URGENT", nan, "2024-01-02"), ("1-URGENT", 5.0, "2024-01-02")], "o_orderpriority string, o_totalprice double, o_orderdate string"),
    ]:
        spark.createDataFrame(rows, kinds).write.parquet(f"{d}/{name}.parquet")
    got = {(r["key"], r["date"].day): r["value"] for r in market_long(spark, d).collect()}
    assert got == {("asset:N7", 2): 15.0, ("asset:R2", 2): 15.0, ("asset:MKT", 2): 15.0, ("indicator:1-URGENT", 2): 5.0, **{(k, 3): None for k in ("asset:N7", "asset:R2", "asset:MKT")}}


def test_volatile_series_change_by_percent(spark):
    from tidesmith.operators import pipelines

    both = series(spark, "asset:^VIX", [10.0, 15.0, 12.0]).union(series(spark, "asset:SPY", [10.0, 15.0, 12.0]))
    assert values(S.transform(both, pipelines.VOLATILE)) == [pytest.approx(v) for v in (math.log(1.5), math.log(0.8), 0.5, -0.2)]


def test_monthly_stability_and_flags(spark):
    rows = [("steady", i, float(i), float(i)) for i in range(24)] + [("turns", i, float(i), float(min(i, 24 - i))) for i in range(24)] + [("few", i, float(i), float(-i)) for i in range(8)] + [("flat", i, 1.0, float(i)) for i in range(20)]
    got = {r["a"]: (r["sign_ok"], r["tercile_ok"], r["magnitude_ok"]) for r in P.monthly_stability(spark.createDataFrame([(a, "x", *r) for a, *r in rows], "a string, b string, idx int, x double, y double")).collect()}
    assert got == {"steady": (True, True, True), "turns": (False, False, got["turns"][2]), "few": (True, True, True), "flat": (False, False, False)}


def test_two_sided_p_equals_its_finite_series():
    """Whole degrees of freedom have a sum of finitely many terms in the angle atan(t / sqrt(df))."""

    def series_of(t, df):
        o = math.atan(abs(t) / math.sqrt(df))
        term, total = (1.0, 0.0) if df % 2 == 0 else (math.cos(o), o)
        for j in range(df // 2 if df % 2 == 0 else (df - 1) // 2):
            total += term * (math.sin(o) if df % 2 else 1.0)
            term *= math.cos(o) ** 2 * ((2 * j + 1) / (2 * j + 2) if df % 2 == 0 else (2 * j + 2) / (2 * j + 3))
        return 1 - (total * math.sin(o) if df % 2 == 0 else 2 / math.pi * total)

    for df in (*range(1, 61), 251, 1000):
        for t in (0.0, 0.3, -1.0, 2.0, 3.5):
            assert float(P.two_sided_p(t, df)) == pytest.approx(series_of(t, df), abs=1e-11)


def test_flagged_pairs_stay(spark):
    from tidesmith.operators import pipelines

    rows = [("a", True, True, True), ("b", False, True, False), ("c", None, True, True)]
    judged = spark.createDataFrame(rows, "a string, excludes_zero boolean, tercile_ok boolean, magnitude_ok boolean")
    got = {r["a"]: (r["flags"], r["stability"]) for r in pipelines.flagged(judged).collect()}
    assert got == {"a": ([], "stable"), "b": (["bootstrap_ci_includes_zero", "magnitude_unstable"], "under_review"), "c": ([], "stable")}
    assert [r["stability"] for r in pipelines.flagged(judged.select("a")).collect()] == ["stable"] * 3


def test_a_month_that_is_skipped_leaves_two_gaps(spark):
    df = spark.createDataFrame([("indicator:X", "2024-01-31", 1.0), ("indicator:X", "2024-03-31", 4.0), ("indicator:Y", "2024-02-15", 1.0), ("indicator:X", "2024-04-30", 6.0)], "key string, date string, value double").withColumn("date", F.to_date("date"))
    got = {(r["key"][-1], r["date"].month): r["value"] for r in S.monthly_changes(df).collect()}
    assert got == {("X", 2): None, ("X", 3): None, ("X", 4): 2.0, ("Y", 2): None, ("Y", 3): None, ("Y", 4): None}


def test_duplicate_keys_are_refused(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    assert G.insert_new(old, spark.createDataFrame([(2, "b")], "k int, v string"), ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        G.insert_new(old, spark.createDataFrame([(1, "b")], "k int, v string"), ["k"]).collect()


def test_partial_edges_are_replaced_by_five_columns(spark):
    kinds = "a string, b string, lag int, method string, window_days int, r double, status string, verdict string"
    old = spark.createDataFrame([("x", "y", 0, "partial", 63, 0.2, "candidate", None), ("x", "z", 0, "partial", 63, 0.3, "active", "plausible"), ("x", "y", 0, "pearson", 63, 0.4, "candidate", None), ("x", "y", 0, "partial", 252, 0.5, "candidate", None)], kinds)
    new = spark.createDataFrame([("x", "w", 0, "partial", 63, 0.9, "candidate")], kinds.rsplit(",", 1)[0])
    got = {(r["b"], r["method"], r["window_days"], r["r"]) for r in G.replace_partial(old, new, 63).collect()}
    assert got == {("z", "partial", 63, 0.3), ("y", "pearson", 63, 0.4), ("y", "partial", 252, 0.5), ("w", "partial", 63, 0.9)}


def test_five_verdicts(spark):
    """What each verdict makes of an edge, whether it is looked at again, and what an audit counts."""
    want = {
        "confirmed_plausible": ("candidate", False, False), "likely_plausible": ("candidate", True, False), "uncertain": ("pending_verification", True, True),
        "likely_spurious": ("rejected", True, False), "confirmed_spurious": ("rejected", False, False), "other": ("pending_verification", False, False), None: ("pending_verification", False, False),
    }
    rows = spark.createDataFrame([(v,) for v in want], "verdict string")
    v = F.col("verdict")
    got = {r[0]: tuple(r)[1:] for r in rows.select(v, G.verdict_status(v), G.needs_review(v, F.lit(0.64)), G.needs_review(v, F.lit(0.65))).collect()}
    assert got == want
    run = G.run_record(rows.withColumn("method", F.lit(None).cast("string")), "r", F.current_timestamp(), F.current_timestamp())
    assert tuple(run[0].select("total_pairs", "promoted", "rejected", "uncertain").first()) == (7, 2, 2, 1)
    assert {r["method"] for r in run[1].collect()} == {"partial"}
    counts = sorted(map(tuple, G.verdict_counts(rows).collect()))
    assert [c[:3] for c in counts] == [(i, x, 1) for i, x in enumerate(G.VERDICTS)] and counts[0][3] == pytest.approx(100 / 7)
    assert [c[2:] for c in G.verdict_counts(rows.limit(0)).collect()] == [(0, 0.0)] * 5


def test_verdicts_are_written_by_four_columns(spark):
    """An edge of another method or window keeps its status; a result without confidence takes away the old one."""
    kinds = "a string, b string, method string, window_days int, status string, verdict string, confidence double"
    edges = spark.createDataFrame([("x", "y", "partial", 63, "pending_verification", None, 0.3), ("x", "y", "partial", 252, "pending_verification", None, 0.3), ("x", "y", "pearson", 63, "candidate", None, None)], kinds)
    results = spark.createDataFrame([("x", "y", "partial", 63, "likely_spurious", None), ("z", "y", "partial", 63, "uncertain", 0.5)], "a string, b string, method string, window_days int, verdict string, confidence double")
    got = {(r["method"], r["window_days"]): tuple(r)[4:] for r in G.write_verdicts(edges, results).collect()}
    assert got == {("partial", 63): ("rejected", "likely_spurious", None), ("partial", 252): ("pending_verification", None, 0.3), ("pearson", 63): ("candidate", None, None)}


def test_admission_by_age_and_url(spark):
    rows = [("f", 1, "u1", "2024-01-05"), ("f", 2, "u2", "2023-01-01"), ("f", 3, "u3", "when?"), ("f", 4, "u1", "2024-01-05"), ("f", 5, "", None), ("g", 1, "known", None)]
    articles = spark.createDataFrame(rows, "feed string, pos int, url string, published string")
    got = X.admit(articles, spark.createDataFrame([("known",)], "url string"), 20, F.to_timestamp(F.lit("2024-01-01"))).collect()
    assert sorted((r["url"], r["pos"]) for r in got) == [("u1", 1), ("u3", 3)]


def test_names_of_several_words(spark):
    texts = spark.createDataFrame([(1, "Shares of A.T.&T. Corp. rose"), (2, "at t corp"), (3, None), (4, "")], "doc_id int, text string")
    names = spark.createDataFrame([("A.T.&T. Corp",), ("Corp",), ("...",)], "name string")
    assert sorted(tuple(r) for r in X.mentions(texts, names).collect()) == [(1, "A.T.&T. Corp"), (1, "Corp"), (2, "Corp")]


def test_lagged_links_of_market_series(spark):
    from tidesmith.plans.catalogue import QUERIES

    d = "/root/testdata/sf0.001"
    got = QUERIES["p_value_two_sided"](spark, d).collect()
    keys = {r["key"] for r in QUERIES["min_obs_filter"](spark, d).collect()}
    assert {r["a"] for r in got} >= keys and {r["lag"] for r in got} == {0, 1, 2, 3, 5, 10, 21, 63} and min(r["n"] for r in got) >= 30
    assert {r["a"] for r in QUERIES["market_covariance_matrix"](spark, d).collect()} >= keys


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "k int, v double, u string")
    new = spark.createDataFrame([(2, 9.0, "x"), (3, 3.0, "y")], "k int, v double, u string")
    once = G.upsert(old, new, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == [(1, 1.0, "a"), (2, 9.0, "b"), (3, 3.0, "y")]
    assert sorted(map(tuple, G.upsert(once, new, ["k"], ["v"]).collect())) == sorted(map(tuple, once.collect()))


def test_candidates_of_every_kind_of_fault(spark):
    from tidesmith.operators import validate

    good = ("asset:x", "indicator:y:z", 0, -0.8, 0.01, 5, "pearson", 63)
    change = lambda i, v: (*good[:i], v, *good[i + 1 :])
    bad = [change(*c) for c in ((1, "asset:X"), (3, 1.5), (3, None), (4, -0.1), (2, -1), (5, 0), (7, 0), (6, "kendall"), (0, "bond:x"), (0, "asset:"), (1, None))]
    df = spark.createDataFrame([good, *bad], "a string, b string, lag int, r double, p double, n int, method string, window_days int")
    built, rejected = validate.candidates(df)
    assert [(r["a"], r["b"], r["strength"], r["direction"], r["tier"]) for r in built.collect()] == [("asset:X", "indicator:Y:Z", 0.8, "negative", "strong")] and rejected.count() == len(bad)


def test_html(spark):
    df = spark.createDataFrame([("<![CDATA[<b>a</b>]]>  &lt;i&gt; &amp;lt;",)], "h string")
    assert df.select(X.strip_html(F.col("h")).alias("t")).head()["t"] == "a <i> &lt;"


def test_character_references_as_the_standard_library_decodes_them(spark):
    import html
    import random

    r = random.Random(7)
    parts = ["&", "&amp", "&amp;", "&copy", "&copyright", "&notit;", "&notin;", "&nosuch;", "&#39;", "&#x27", "&#8217;", "&#128;", "&#0;", "&#xD800;", "&#x110000;", "&#99999999999999999999999;", "&#11;", "&#xFFFE;", "&#x1F600;", "&CounterClockwiseContourIntegral;", "&Tab;", "&#", "&#x;", ";", "a", " ", "é", "&lt;", "lt;"]
    texts = ["", "plain", *parts, *("".join(r.choices(parts, k=r.randint(1, 9))) for _ in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    got = dict(df.select("i", X.decode_references(F.col("t"))).collect())
    assert got.pop(-1) is None
    assert {i: got[i] for i, t in enumerate(texts) if got[i] != html.unescape(t)} == {}


def test_dates_of_feeds(spark):
    stamp = 1774276200  # 2026-03-23 14:30:00 UTC
    forms = ["Mon, 23 Mar 2026 14:30:00 GMT", "23 Mar 2026 14:30 +0000", "Mon, 23 Mar 2026 16:30:00 +0200", "2026-03-23T14:30:00Z", " 2026-03-23T10:30:00-04:00 ", "Monday, 23 Mar 26 14:30:00 GMT"]
    none = ["", " ", None, "yesterday", "Mon, 99 Mar 2026 14:30:00 GMT"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(forms + none)], "i int, t string")
    got = dict(df.select("i", F.unix_seconds(X.published(F.col("t"), F.timestamp_seconds(F.lit(5))))).collect())
    assert [got[i] for i in range(len(forms + none))] == [stamp] * len(forms) + [5] * len(none)


def test_dates_by_their_shapes_as_by_all_forms(spark):
    """Only forms of a text's shape are tried: the same times as by all forms one after another, for odd and for spoilt dates too; no form at all for plain words."""
    import random
    import re

    r = random.Random(5)
    good = [f"{d} {m} {y}{t}{z}" for d in ("1", "07", "023", "31") for m in ("Mar", "FEB", "March") for y in ("2026", "26", "0026", "+12026", "126") for t in ("", " 14:30:05", " 14:30", " 4:30") for z in ("", " +0200", " GMT", " Europe/Berlin", " UTC+01:00", " EST", " Z")]
    good += ["2026/3/23", "2026/03/23 10:00", "26/3/23", "2026-03-23T14:30:00Z", "23  Mar 2026", "23 Mar 2026 ", "1 Mar 2026\n", "some day in 1996", "words"]
    spoilt = [t[:i] + r.choice(["", " ", "0", "x", ":", "-"]) + t[i + r.randrange(2) :] for t in r.choices(good, k=600) for i in [r.randrange(len(t))]]
    df = spark.createDataFrame([(t,) for t in good + spoilt], "t string")
    bare = F.regexp_replace(F.btrim("t"), r"^[A-Za-z]{3,9},?\s+(?=[0-9])", "")
    every = F.coalesce(F.try_to_timestamp(bare), *(F.try_to_timestamp(bare, F.lit(form)) for form in X.DATES), F.timestamp_seconds(F.lit(5)))
    rows = df.select("t", F.unix_micros(X.published(F.col("t"), F.timestamp_seconds(F.lit(5)))).alias("got"), F.unix_micros(every).alias("want")).collect()
    assert [tuple(x) for x in rows if x["got"] != x["want"]] == [] and len({x["want"] for x in rows}) > 30
    assert not any(re.search(shape, t) for shape in X.DATES.values() for t in ("some day in 1996", "nobody knows", "Monday"))


def test_oracle_covers_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_a_run_that_fails_stops_no_other(spark):
    from tidesmith.operators import pipelines

    done, failed = pipelines.run_all({"bad": lambda: spark.range(1).select(F.raise_error(F.lit("broken"))), "good": lambda: spark.range(3), "worse": lambda: 1 / 0})
    assert set(failed) == {"bad", "worse"} and "ZeroDivisionError" in failed["worse"] and done["good"].count() == 3
