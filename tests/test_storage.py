"""Tables in partitions, and states kept by url: what is touched, what a failure leaves, what a restart goes on from."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidesmith.operators import graph as G
from tidesmith.sources import layout
from tidesmith.streaming import news as N

KINDS = "k long, at timestamp, value double, unit string"


def facts(spark, rows):
    return spark.createDataFrame([(k, datetime(2026, m, 1), v, u) for k, m, v, u in rows], KINDS)


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/part=*/*.parquet")}


def rows(spark, path, schema):
    return sorted((r["k"], r["at"].month, r["value"], r["unit"]) for r in layout.read(spark, path, schema).collect())


def test_an_upsert_rewrites_its_own_partitions(spark, tmp_path):
    path, month = f"{tmp_path}/t", layout.by_month("at")
    old = facts(spark, [(k, m, 1.0, "old") for k in range(5) for m in range(1, 7)])
    layout.create(old, path, month)
    before = files(path)
    assert len(before) == 6
    new = facts(spark, [(2, 3, 9.0, "new"), (7, 3, 8.0, "new"), (7, 9, 7.0, "new")])
    assert layout.upsert_rows(path, new, old.schema, month, ["k", "at"], ["value"]) == ["2026-03", "2026-09"]
    after = files(path)
    assert {f.split("/")[0] for f in before ^ after} == {"part=2026-03", "part=2026-09"}
    want = sorted([x for x in ((k, m, 1.0, "old") for k in range(5) for m in range(1, 7)) if x[:2] != (2, 3)] + [(2, 3, 9.0, "old"), (7, 3, 8.0, "new"), (7, 9, 7.0, "new")])
    assert rows(spark, path, old.schema) == want
    layout.upsert_rows(path, new, old.schema, month, ["k", "at"], ["value"])
    assert rows(spark, path, old.schema) == want
    assert layout.upsert_rows(path, new.limit(0), old.schema, month, ["k", "at"], ["value"]) == []
    assert layout.read(spark, path, old.schema).where("part = '2026-03'").inputFiles() != []


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path, rule = f"{tmp_path}/t", layout.by_hash("k", parts=4)
    old = facts(spark, [(k, 1, 1.0, "old") for k in range(20)])
    layout.create(old, path, rule)
    before = files(path)
    broken = facts(spark, [(3, 1, 2.0, "new"), (50, 1, 2.0, "new")]).withColumn("value", F.when(F.col("k") == 50, F.raise_error(F.lit("no such value"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no such value"):
        layout.upsert_rows(path, broken, old.schema, rule, ["k", "at"], ["value"])
    with pytest.raises(Exception, match="duplicate key"):
        layout.rewrite(path, facts(spark, [(3, 1, 2.0, "new")]), old.schema, rule, lambda there, came: G.insert_new(there, came, ["k", "at"]))
    assert files(path) == before and len(rows(spark, path, old.schema)) == 20


def test_null_keys_have_a_partition(spark, tmp_path):
    path, rule = f"{tmp_path}/t", F.col("unit")
    old = facts(spark, [(1, 1, 1.0, None), (2, 1, 1.0, "x")])
    layout.create(old, path, rule)
    assert layout.upsert_rows(path, facts(spark, [(3, 1, 5.0, None)]), old.schema, rule, ["k", "at"], ["value"]) == ["none"]
    assert [r[0] for r in sorted(rows(spark, path, old.schema), key=lambda r: r[0])] == [1, 2, 3]


def test_a_stream_merges_by_partition(spark, tmp_path):
    path, rule = f"{tmp_path}/t", layout.by_hash("k", parts=8)
    run = lambda: N.upsert_available(N.read_stream(spark, f"{tmp_path}/in", like), path, f"{tmp_path}/s", rule, ["k", "at"], ["value"], ["value"])
    like = facts(spark, [(k, 1, 1.0, "old") for k in range(40)])
    like.write.mode("append").parquet(f"{tmp_path}/in")
    assert run().count() == 40
    before = files(path)
    facts(spark, [(5, 1, 2.0, "new"), (5, 1, 3.0, "newer")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {r["k"]: (r["value"], r["unit"]) for r in run().collect()}
    assert got[5] == (3.0, "old") and sum(v == (1.0, "old") for v in got.values()) == 39
    assert len({f.split("/")[0] for f in before ^ files(path)}) == 1
    assert run().count() == 40


START = datetime(2026, 3, 1)


def send(spark, path, articles=(), outcomes=()):
    day = lambda n: START + timedelta(days=n)
    a = N.article_events(spark.createDataFrame([(u, s, day(n)) for u, s, n in articles], "url string, summary string, at timestamp"))
    o = N.outcome_events(spark.createDataFrame([(u, ok, day(n)) for u, ok, n in outcomes], "url string, ok boolean, at timestamp"))
    events = a.unionByName(o)
    events.coalesce(1).write.mode("append").parquet(f"{path}/in")
    N.run_available(N.article_states(N.read_stream(spark, f"{path}/in", events)), f"{path}/steps", f"{path}/state")
    return {r["url"]: r["status"] for r in N.latest_states(spark.read.parquet(f"{path}/steps")).collect()}


def test_states_of_articles(spark, tmp_path):
    """Each run is a restart from the checkpoint: what is settled stays, what came early waits, and nothing is emitted twice."""
    path = str(tmp_path)
    got = send(spark, path, [("a", "text", 0), ("b", " ", 0), ("c", "text", 0)], [("d", True, 0), ("b", True, 1)])
    assert got == {"a": "raw", "b": "skipped_no_summary", "c": "raw"}
    got = send(spark, path, [("d", "text", 2), ("a", "text again", 2)], [("a", True, 1), ("a", False, 2), ("c", False, 2)])
    assert got == {"a": "mentions_done", "b": "skipped_no_summary", "c": "mentions_failed", "d": "mentions_done"}
    assert send(spark, path, [], [("a", False, 3), ("c", True, 3), ("d", False, 3), ("b", False, 3)]) == got
    steps = sorted((r["url"], r["step"], r["status"]) for r in spark.read.parquet(f"{path}/steps").collect())
    assert steps == [("a", 1, "raw"), ("a", 2, "mentions_done"), ("b", 1, "skipped_no_summary"), ("c", 1, "raw"), ("c", 2, "mentions_failed"), ("d", 1, "raw"), ("d", 2, "mentions_done")]


def test_states_are_dropped_in_time(spark, tmp_path):
    """Long after its last event a url is forgotten: it begins anew."""
    path = str(tmp_path)
    send(spark, path, [("a", "text", 0)], [("a", True, 0)])
    send(spark, path, [("z", "text", 60)])
    send(spark, path, [("z2", "text", 61)])
    assert send(spark, path, [("a", "text", 62)])["z"] == "raw"
    steps = [(r["step"], r["status"]) for r in spark.read.parquet(f"{path}/steps").where("url = 'a'").collect()]
    assert sorted(steps) == [(1, "mentions_done"), (1, "raw"), (2, "mentions_done")] or sorted(steps) == [(1, "raw"), (1, "raw"), (2, "mentions_done")]


def test_many_articles_share_a_state(spark, tmp_path):
    """Random events of sixty urls in four buckets, run by run, against a plain loop over each url; no row of state for each url."""
    r, path, plain = random.Random(3), str(tmp_path), {}
    for run in range(3):
        rows = [(f"u{r.randrange(60)}", START + timedelta(hours=24 * run + r.randrange(20), seconds=i), *r.choice([(None, True), (None, False), (True, None), (False, None)])) for i in range(80)]
        events = spark.createDataFrame(rows, "url string, at timestamp, ok boolean, readable boolean")
        events.coalesce(1).write.mode("append").parquet(f"{path}/in")
        N.run_available(N.article_states(N.read_stream(spark, f"{path}/in", events), buckets=4), f"{path}/steps", f"{path}/state")
        for url, _, ok, readable in sorted(rows, key=lambda x: x[1]):
            first, outcome = plain.get(url, (None, None))
            plain[url] = (readable if first is None else first, ok if outcome is None and first is not False else outcome)
    want = {(u, 1, "raw" if a else "skipped_no_summary") for u, (a, _) in plain.items() if a is not None} | {(u, 2, "mentions_done" if ok else "mentions_failed") for u, (a, ok) in plain.items() if a and ok is not None}
    got = [(x["url"], x["step"], x["status"]) for x in spark.read.parquet(f"{path}/steps").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert spark.read.format("statestore").load(f"{path}/state").count() <= 4
