"""The discovery runs: daily with lags, monthly, partial in two passes; each from long series to candidates."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesmith.operators import gates, graph, pairs, series, validate
from tidesmith.sources.kept import keep

#: Least |r| of daily and monthly pairs, share of a window's days that a series needs, least rows, share of false discoveries.
STRENGTH, SHARE, LEAST_OBS, ALPHA = 0.4, 0.75, 15, 0.10
#: Windows of fewer days are not split in halves. The tag of monthly candidates.
LEAST_SPLIT, MONTHLY_DAYS = 42, 3650
#: Floor and active tier of partial correlations, and series that a pass needs.
PARTIAL_FLOOR, PARTIAL_ACTIVE, LEAST_SERIES = 0.10, 0.15, 3
#: Years that a monthly run looks back.
MONTHLY_YEARS = 10
# Series of volatility, which change by percent.
VOLATILE = ("asset:^VIX", "asset:^VVIX", "asset:^MOVE", "asset:^GVZ", "asset:^OVX")
# Why a monthly pair is under review.
REASONS = {"bootstrap_ci_includes_zero": "excludes_zero", "sign_inconsistent": "sign_ok", "tercile_inconsistent": "tercile_ok", "magnitude_unstable": "magnitude_ok"}


class Rules(NamedTuple):
    """What runs know of series: groups (key, grp) of redundant ones, categories (key, category), blocked pairs of categories (lo, hi), volatile keys."""

    groups: DataFrame
    categories: DataFrame
    blocked: DataFrame
    volatile: tuple[str, ...] = VOLATILE


class Found(NamedTuple):
    """A run's candidates, and for its audit: one row `n` of all pairs that were tested, pairs above the threshold, pairs that survived all tests."""

    candidates: DataFrame
    total: DataFrame
    above: DataFrame
    surviving: DataFrame


def frame(df: DataFrame, window: int, volatile: tuple[str, ...] = VOLATILE) -> DataFrame:
    """The window's series on their common spine, filled forward, of enough values, as scaled and clipped changes."""
    filled = series.forward_fill(series.window_of(df, window))
    enough = series.min_observations(filled, 0.0, max(LEAST_OBS, int(window * SHARE)))
    return series.winsorize(series.zscore(series.transform(enough, volatile)))


def _pairs_of(frame_: DataFrame) -> DataFrame:
    """(n): the number of unordered pairs of the series of a frame."""
    return frame_.agg(F.count_distinct("key").alias("k")).select(F.floor(F.col("k") * (F.col("k") - 1) / 2).alias("n"))


def daily_pairs(frame_: DataFrame, window: int, groups: DataFrame, categories: DataFrame, blocked: DataFrame) -> DataFrame:
    """(a, b, lag, r, n, rho, rho_n, r1, r2) of pairs that are strong on complete dates, neither redundant nor implausible, and whose rank correlation, where it has rows enough, agrees."""
    found = pairs.pair_statistics(frame_, least_n=30, least_r=STRENGTH, complete=True, min_obs=max(LEAST_OBS, int(window * SHARE)), tests=True)
    found = gates.plausible(gates.not_redundant(found, groups), categories, blocked)
    return found.where((F.col("rho_n") < 20) | F.col("rho").isNull() | (F.abs("rho") >= STRENGTH))


def tested(found: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Pairs with p and adjusted_p that survive the false discovery rate."""
    return pairs.false_discovery(pairs.p_values(found.withColumn("t", pairs.t_statistic(F.col("r"), F.col("n")))), alpha)


def _candidates(found: DataFrame, method: str, window: int) -> DataFrame:
    named = found.withColumns({"method": F.lit(method), "window_days": F.lit(window)})
    named = named if "status" in named.columns else named.withColumn("status", F.lit("candidate"))
    return validate.candidates(named)[0]


_DAILY = ["a", "b", "lag", "r", "p", "n", "method", "window_days", "strength", "direction", "tier", "status", "stability"]


def daily(df: DataFrame, window: int, excluded: DataFrame, market: str, sectors: DataFrame, rules: Rules) -> Found:
    """One window of days: changes without market and sector, pairs at all lags, false discovery rate, both halves.

    excluded: (id) of series that are not daily. Empty input, or fewer than two series, gives no candidates.
    """
    scaled = keep(frame(series.without(df, excluded), window, rules.volatile))
    rest = keep(series.beta_residual(scaled, market, sectors))
    above = keep(daily_pairs(rest, window, rules.groups, rules.categories, rules.blocked))
    kept = tested(above)
    if window >= LEAST_SPLIT:
        kept = kept.where((F.abs("r1") >= STRENGTH) & (F.abs("r2") >= STRENGTH)).withColumn("stability", F.least(F.abs("r1"), F.abs("r2")))
    else:
        kept = kept.withColumn("stability", F.lit(None).cast("double"))
    kept = keep(kept)
    built = keep(_candidates(kept.drop("p").withColumnRenamed("adjusted_p", "p"), "pearson", window).select(*_DAILY))
    return Found(built, _pairs_of(rest), above, kept)


def flagged(judged: DataFrame) -> DataFrame:
    """judged with flags, the reasons of the checks that failed, and stability: stable ones and those under review stay together.

    Checks are the boolean columns of REASONS; those that judged lacks are not asked, and a null is no failure.
    """
    own = [F.when(~F.col(c), F.lit(name)) for name, c in REASONS.items() if c in judged.columns]
    flags = F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")
    return judged.withColumn("flags", flags).withColumn("stability", F.when(F.size("flags") == 0, "stable").otherwise("under_review"))


def month_strong(changes: DataFrame, rules: Rules, least: int = 10, strength: float = STRENGTH) -> tuple[DataFrame, DataFrame]:
    """(rows of all pairs of months, strong and plausible pairs (a, b, lag, r, n) of at least so many months), by rank correlation."""
    rows = keep(month_pairs(changes))
    rho = pairs.spearman(rows, ["a", "b"]).withColumnRenamed("rho", "r").where((F.col("n") >= least) & F.col("r").isNotNull())
    return rows, keep(gates.strong(gates.plausible(rho, rules.categories, rules.blocked), strength).withColumn("lag", F.lit(0)))


def month_pairs(changes: DataFrame) -> DataFrame:
    """(a, b, idx, x, y): assets and indicators in the months that both spines have, where neither misses a value; idx counts months."""
    on = changes.withColumn("idx", F.year("date") * 12 + F.month("date"))
    left = on.where("key like 'asset:%' and value is not null").select("idx", F.col("key").alias("a"), F.col("value").alias("x"))
    return left.join(on.where("key like 'indicator:%' and value is not null").select("idx", F.col("key").alias("b"), F.col("value").alias("y")), "idx")


def monthly_input(df: DataFrame, indicators: DataFrame, years: int = MONTHLY_YEARS) -> DataFrame:
    """All assets and the named indicators (id), of the years up to the last date of all, that day of the first year included."""
    last = df.agg(F.max("date")).scalar()
    recent = df.where(F.col("date") >= F.add_months(last, -12 * years))
    named = recent.join(indicators.select(F.concat(F.lit("indicator:"), "id").alias("key")).distinct(), "key", "left_semi")
    return recent.where("key like 'asset:%'").unionByName(named)


def monthly(df: DataFrame, indicators: DataFrame, rules: Rules, least: int = 10) -> Found:
    """Assets against the indicators (id) of the monthly set, month by month over ten years, by rank correlation.

    Unstable pairs stay, under review and with their reasons.
    """
    changes = keep(series.monthly_changes(keep(monthly_input(df, indicators))))
    rows, above = month_strong(changes, rules, least)
    kept = keep(tested(above))
    some = rows.join(kept.select("a", "b"), ["a", "b"], "left_semi")
    checks = pairs.monthly_stability(some).drop("n", "rho").join(pairs.bootstrap(some, ["a", "b"]).select("a", "b", "excludes_zero"), ["a", "b"])
    judged = flagged(kept.join(checks, ["a", "b"]))
    built = _candidates(judged.drop("p").withColumnRenamed("adjusted_p", "p"), "spearman", MONTHLY_DAYS)
    kinds = F.col("key").startswith("asset:")
    total = changes.select("key").distinct().agg((F.count_if(kinds) * F.count_if(~kinds)).alias("n"))
    return Found(keep(built.select(*_DAILY, F.array_join("flags", ",").alias("flags"))), total, above, kept)


def partial(df: DataFrame, window: int, excluded: DataFrame, micro_without: DataFrame, macro_without: DataFrame, rules: Rules) -> Found:
    """Sparse partial correlations: a pass without indices and sectors, one without their members, the stronger of both for each pair.

    excluded: (id) of series that are not daily; *_without: (id) that a pass leaves out. Redundant pairs go in each pass, implausible ones
    after both. A pass of fewer than three series finds nothing. No false discovery rate: the penalty is chosen by extended BIC, so p is 0.
    """
    changes = keep(frame(series.without(df, excluded), window, rules.volatile))

    def one(names: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = series.without(changes, names)
        enough = own.agg(F.count_distinct("key")).scalar() >= LEAST_SERIES
        found = gates.strong(pairs.partial_correlations(own.where(enough)).withColumnRenamed("partial_r", "r"), PARTIAL_FLOOR)
        return gates.not_redundant(found, rules.groups), _pairs_of(own)

    (micro, n_micro), (macro, n_macro) = one(micro_without), one(macro_without)
    merged = keep(gates.plausible(gates.strongest(micro, macro), rules.categories, rules.blocked))
    named = merged.withColumns({"lag": F.lit(0), "p": F.lit(0.0), "status": gates.tier_status(F.col("r"), PARTIAL_ACTIVE)})
    built = _candidates(named, "partial", window).select(*_DAILY[:-1])
    return Found(keep(built), n_micro.unionByName(n_macro).agg(F.sum("n").alias("n")), merged, merged)


#: What an edge of a candidate holds, beside the verdict that a verification gives it.
EDGE = "a string, b string, lag int, method string, window_days int, r double, p double, n long, strength double, direction string, tier string, status string, verdict string"


def no_edges(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], EDGE)


def store(edges: DataFrame, found: Found, nodes: DataFrame, window: int, end: Column, method: str) -> tuple[DataFrame, DataFrame]:
    """(edges after a run, its audit row): its candidates between known nodes (key) take the place of those of earlier runs of the window.

    What goes: edges of the window without a verdict that are candidates or, in a partial run, partial ones that are candidates or wait. What
    comes meets what stays by ends, lag, method and window: values are replaced, but an edge with a verdict keeps its status. The audit row counts the
    pairs tested, above the threshold, surviving and stored, and the edges cleared.
    """
    mine = (F.col("window_days") == window) & F.col("verdict").isNull()
    mine &= (F.col("method") == "partial") & F.col("status").isin("candidate", "pending_verification") if method == "partial" else F.col("status") == "candidate"
    mine = F.coalesce(mine, F.lit(False))
    known = nodes.select("key").distinct()
    new = found.candidates
    for end_ in ("a", "b"):
        new = new.join(known.withColumnRenamed("key", end_), end_, "left_semi")
    own = [c for c in edges.columns if c not in (*graph.CANDIDATE, "verdict")]
    new = keep(new.select(*graph.CANDIDATE, F.struct(*own).alias("_new")))
    both = edges.where(~mine).join(new, graph.CANDIDATE, "full")
    came = F.col("_new").isNotNull()
    value = {c: F.when(came, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in own}
    value["status"] = F.when(came & F.col("verdict").isNull(), F.col("_new.status")).otherwise(F.col("status"))
    after = keep(both.select(*(value.get(c, F.col(c)).alias(c) for c in edges.columns)))
    n = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0))).scalar().cast("long")
    audit = {"total_pairs": n(found.total, "n"), "above": n(found.above, F.lit(1)), "surviving": n(found.surviving, F.lit(1)), "stored": n(new, F.lit(1)), "cleared": n(edges.where(mine), F.lit(1))}
    row = edges.sparkSession.range(1).select(F.lit(method).alias("method"), F.lit(window).alias("window_days"), end.alias("window_end"), *(x.alias(c) for c, x in audit.items()))
    return after, keep(row)


def run_windows(
    df: DataFrame, edges: DataFrame, nodes: DataFrame, windows: list[int], not_daily: DataFrame, monthly_set: DataFrame, market: str, sectors: DataFrame,
    passes: tuple[DataFrame, DataFrame], rules: Rules,
) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(edges, audit rows, errors by step) of a whole round: a daily run for each window, a monthly run, a partial run for each window.

    Each run's candidates are stored before the next one begins. A run that fails is reported by name, and the edges stay as they were.
    """
    end = df.agg(F.max("date")).scalar()
    steps: dict[str, tuple[str, int, Callable[[], Found]]] = {f"daily {w}": ("pearson", w, lambda w=w: daily(df, w, not_daily, market, sectors, rules)) for w in windows}
    steps["monthly"] = ("spearman", MONTHLY_DAYS, lambda: monthly(df, monthly_set, rules))
    steps |= {f"partial {w}": ("partial", w, lambda w=w: partial(df, w, not_daily, *passes, rules)) for w in windows}
    rows, failed = None, {}
    for name, (method, window, step) in steps.items():
        try:
            after, row = store(edges, step(), nodes, window, end, method)
        except Exception as error:  # noqa: BLE001  whatever it is, it is reported by name
            failed[name] = f"{type(error).__name__}: {error}"
            continue
        edges, rows = after, row if rows is None else rows.unionByName(row)
    none = "method string, window_days int, window_end date, total_pairs long, above long, surviving long, stored long, cleared long"
    return edges, df.sparkSession.createDataFrame([], none) if rows is None else rows, failed


def run_all(steps: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(results by name, errors by name) of runs one after another: each is carried out and kept, and one that fails stops no other."""
    done, failed = {}, {}
    for name, step in steps.items():
        try:
            done[name] = keep(step())
        except Exception as error:  # noqa: BLE001  whatever it is, it is reported by name
            failed[name] = f"{type(error).__name__}: {error}"
    return done, failed
