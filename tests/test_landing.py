"""What has landed: answers, wide tables, seeds; quantiles by counting. Broken rows are parted and stop no other."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidesmith.operators import landed as L
from tidesmith.operators import seeding
from tidesmith.operators import series as S
from tidesmith.sources import layout, wide


def answer(verdict="likely_plausible", confidence=0.9, **more):
    return json.dumps({"mechanism": "m", "alternative_explanations": "x, \"y\"\nz", "verdict": verdict, "confidence": confidence, "reasoning": "r", "relationship_category": "None"} | more)


def edges(spark, names):
    return spark.createDataFrame([(a, "z", "partial", 63, 0.2) for a in names], "a string, b string, method string, window_days int, correlation double")


def landed(spark, rows):
    return spark.createDataFrame([(a, "z", "partial", 63, r) for a, r in rows.items()], "a string, b string, method string, window_days int, response string")


def test_answers_and_errors(spark):
    rows = {
        "ok": answer("Confirmed_Plausible", 1.7), "low": answer(confidence=-3), "text": answer(confidence="0.25"), "null": None, "cut": answer()[:-5], "list": "[1]", "word": "yes", "empty": "",
        "verdict": answer("perhaps"), "confidence": answer(confidence="high"), "category": answer(relationship_category="friends"), "field": json.dumps({"verdict": "uncertain"}), "more": answer(extra={"a": 1}),
    }
    good, bad = L.read_answers(landed(spark, rows))
    assert {r["a"]: (r["verdict"], r["confidence"], r["relationship_category"]) for r in good.collect()} == {
        "ok": ("confirmed_plausible", 1.0, "none"), "low": ("likely_plausible", 0.0, "none"), "text": ("likely_plausible", 0.25, "none"), "more": ("likely_plausible", 0.9, "none"),
    }
    assert {r["a"]: r["error"] for r in bad.collect()} == {"null": "missing", "cut": "broken", "list": "broken", "word": "broken", "empty": "broken", "verdict": "verdict", "confidence": "confidence", "category": "relationship_category", "field": "mechanism"}


def test_a_second_pass_overrides_where_it_succeeds(spark):
    first = {"sure": answer("confirmed_spurious", 0.1), "unsure": answer("uncertain", 0.9), "weak": answer("likely_plausible", 0.6), "strong": answer("likely_spurious", 0.65), "broken": "{", "alone": answer("uncertain"), "other": answer()}
    second = {"sure": answer("uncertain"), "unsure": answer("confirmed_plausible", 0.8), "weak": "{", "strong": answer("uncertain"), "broken": answer()}
    results, errors = L.verify(edges(spark, [k for k in first if k != "other"] + ["silent"]), landed(spark, first), landed(spark, second))
    assert {r["a"]: (r["verdict"], r["pass"]) for r in results.collect()} == {"sure": ("confirmed_spurious", 1), "unsure": ("confirmed_plausible", 2), "weak": ("likely_plausible", 1), "strong": ("likely_spurious", 1), "alone": ("uncertain", 1)}
    assert sorted((r["a"], r["error"], r["pass"]) for r in errors.collect()) == [("broken", "broken", 1), ("weak", "broken", 2)]


def test_a_whole_round(spark):
    """The strongest edges that wait are judged; a broken answer, a weaker edge and a settled one stay as they are; nothing that waits gives zeros."""
    rows = [("a", "z", "partial", 63, 0.9, "pending_verification", None, None), ("b", "z", "partial", 63, -0.8, "pending_verification", None, None), ("c", "z", "partial", 63, 0.1, "pending_verification", None, None), ("d", "z", "partial", 63, 0.99, "candidate", None, 0.5), ("e", "z", "partial", 63, 0.7, "pending_verification", None, None)]
    edges = spark.createDataFrame(rows, "a string, b string, method string, window_days int, r double, status string, verdict string, confidence double")
    nodes = spark.createDataFrame([(i, i.upper(), "Asset") for i in "abcde"] + [("z", "Z", "Indicator")], "id string, name string, label string")
    answers = landed(spark, {k: answer("likely_spurious", 0.8) for k in "acd"} | {"b": answer("uncertain"), "e": "{"})
    at = lambda s: F.lit(s).cast("timestamp")
    after, results, audit, errors = L.round_of(edges, nodes, answers, landed(spark, {"b": answer("confirmed_plausible", 1)}), "r1", at("2026-01-01 00:00:00"), at("2026-01-01 00:01:30"), most=3)
    assert {x["a"]: (x["status"], x["verdict"], x["confidence"]) for x in after.collect()} == {
        "a": ("rejected", "likely_spurious", 0.8), "b": ("candidate", "confirmed_plausible", 1.0), "c": ("pending_verification", None, None), "d": ("candidate", None, 0.5), "e": ("pending_verification", None, None),
    }
    assert {(x["a"], x["a_name"], x["b_type"]) for x in results.collect()} == {("a", "A", "indicator"), ("b", "B", "indicator")}
    assert tuple(audit.select("run_id", "duration_seconds", "total_pairs", "promoted", "rejected", "uncertain").first()) == ("r1", 90, 2, 1, 1, 0)
    assert [(x["a"], x["error"]) for x in errors.collect()] == [("e", "broken")]
    none = L.round_of(edges.where("status = 'candidate'"), nodes, answers, answers, "r2", at("2026-01-01 00:00:00"), at("2026-01-01 00:00:00"))
    assert none[2].first()["total_pairs"] == 0 and none[0].count() == 1


def test_an_audit_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'says "so", and\nmore', 0.5, "lost")], "entity_a_id string, mechanism string, confidence double, other string")
    for _ in range(2):
        L.write_audit(rows, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert back.columns == L.AUDIT and [(r["entity_a_id"], r["mechanism"], r["confidence"], r["verdict"]) for r in back.collect()] == [("a", 'says "so", and\nmore', "0.5", None)]


def test_wide_prices(spark):
    rows = [("2024-01-02", "10.00005", "5.9", None, "7", "abc", "1", "1"), ("2024-01-03", "10.00015", "NaN", "NaN", "8", "2.5", "Infinity", "2"), ("2024-01-04", "-1.5", "-2.7", None, None, None, None, "3")]
    table = spark.createDataFrame(rows, "date string, `Close:A` string, `Volume:A` string, `Close:B` string, `Volume:B` string, `Close:C:X` string, `Volume:C:X` string, `Open:A` string")
    tickers = spark.createDataFrame([("A",), ("B",), ("C:X",), ("GONE",), ("A",)], "ticker string")
    points, counts = wide.price_points(table, tickers)
    assert {r["ticker"]: (r["ok"], r["stored"], r["failed"]) for r in counts.collect()} == {"A": (True, 5, 0), "B": (False, 0, 0), "C:X": (True, 2, 2), "GONE": (False, 0, 0)}
    got = sorted((r["entity_id"], r["metric"], r["timestamp"], str(r["value"]), r["unit"]) for r in points.collect())
    assert got == [
        ("A", "close_price", "2024-01-02", "10.0000", "USD"), ("A", "close_price", "2024-01-03", "10.0002", "USD"), ("A", "close_price", "2024-01-04", "-1.5000", "USD"), ("A", "volume", "2024-01-02", "5.0000", "shares"),
        ("A", "volume", "2024-01-04", "-2.0000", "shares"), ("C:X", "close_price", "2024-01-03", "2.5000", "USD"), ("C:X", "volume", "2024-01-02", "1.0000", "shares"),
    ]
    last = {r["ticker"]: (r["ok"], r["stored"]) for r in wide.price_points(table, tickers, latest_only=True)[1].collect()}
    assert last == {"A": (True, 2), "B": (False, 0), "C:X": (False, 0), "GONE": (False, 0)}


def test_there_and_back(spark):
    points = spark.createDataFrame([("d1", "Close", "A", 1.5), ("d1", "Volume", "A", 3.0), ("d2", "Close", "B:1", 2.25)], "date string, metric string, ticker string, value double")
    back = wide.to_long(wide.to_wide(points, ["A", "B:1"])).where("value is not null")
    assert sorted((r["date"], r["metric"], r["ticker"], float(r["value"])) for r in back.collect()) == sorted(map(tuple, points.collect()))


def test_one_bad_entity_stops_a_seed(spark, tmp_path):
    kinds = "label string, id string, name string, description string, metadata map<string,string>"
    entities = lambda *rows: spark.createDataFrame(list(rows), kinds)
    good = [("Company", "A", "Alpha", "first", {"size": "1", "name": "no"}), ("Company", "B", "Beta", "", None), ("Sector", "S", "Some", "", {})]
    rels = spark.createDataFrame([("A", "BELONGS_TO", "S", {"w": "1"}), ("A", "BELONGS_TO", "NONE", {}), ("B", "bad kind", "S", {})], "from_id string, rel_type string, to_id string, props map<string,string>")
    n, e, rule = f"{tmp_path}/n", f"{tmp_path}/e", (layout.by_hash("label", "id", parts=4), layout.by_hash("from_id", parts=4))
    node_kinds = "label string, id string, props map<string,string>"
    layout.create(spark.createDataFrame([("Company", "A", {"size": "0", "old": "x"})], node_kinds), n, rule[0])
    layout.create(spark.createDataFrame([], rels.schema), e, rule[1])
    nodes = lambda: {r["id"]: r["props"] for r in spark.read.parquet(n).collect()}
    with pytest.raises(ValueError, match="2 entities are not valid.*C"):
        seeding.seed(entities(*good, ("Planet", "C", "x", "", {}), ("Company", None, "x", "", {})), rels, ["Company", "Sector"], n, e, *rule)
    assert nodes() == {"A": {"size": "0", "old": "x"}}
    assert seeding.seed(entities(*good), rels, ["Company", "Sector"], n, e, *rule) == (3, 1)
    assert nodes() == {"A": {"size": "1", "old": "x", "id": "A", "name": "Alpha", "description": "first"}, "B": {"id": "B", "name": "Beta", "description": ""}, "S": {"id": "S", "name": "Some", "description": ""}}
    assert [(r["from_id"], r["to_id"], r["props"]) for r in spark.read.parquet(e).collect()] == [("A", "S", {"w": "1"})]


@pytest.mark.parametrize("few", [1, 5, 10_000])
def test_quantiles_by_counting(spark, few):
    r = random.Random(few)
    rows = {"even": [r.random() for _ in range(3000)], "ties": [float(r.choice([1, 1, 1, 2, 9])) for _ in range(500)], "steep": [10.0 ** r.randint(-300, 300) * r.choice([-1, 1]) for _ in range(800)], "one": [4.0], "flat": [2.0] * 50, "none": [None]}
    df = spark.createDataFrame([(k, i, v) for k, vs in rows.items() for i, v in enumerate(vs)] + [("even", 9999, None)], "key string, i int, value double").repartition(6)
    qs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    got = {(x["key"], x["q"]): x["value"] for x in S.exact_quantiles(df, qs, few).collect()}
    place = lambda n, q: int((n - 1) * q + 0.5)
    assert got == {(k, q): sorted(v)[place(len(v), q)] for k, v in rows.items() if k != "none" for q in qs}
    dated = df.withColumn("date", F.date_add(F.lit("2000-01-01"), F.col("i")))
    same = [sorted(map(tuple, f(dated, 0.05, 0.9).collect()), key=str) for f in (S.winsorize, lambda d, a, b: S.winsorize_long(d, a, b, few))]
    assert same[0] == same[1]


def test_the_chain_of_rules_after_extraction(spark):
    """Each rule drops its own row; articles do not lend each other entities; a short article keeps its entities alone."""
    from tidesmith.operators import text as X

    body = "Acme Motors sold copper to Globex near Springfield " + "word " * 50
    articles = spark.createDataFrame([(1, body), (2, "Acme Motors sold Globex"), (3, None), (4, body)], "doc_id long, text string")
    entities = [(1, 1, "acme motors", "company", "Acme Motors Inc"), (1, 2, "Globex", " COMPANY", "Globex"), (1, 3, "globex", "Company", " GLOBEX "), (1, 4, "gone", "Company", "Initech Bank"), (1, 5, "copper", "commodity", "Copper"), (1, 6, "Acme", "planet", "Acme"),
                (2, 1, "Acme", "Company", "Acme Motors Inc"), (2, 2, "Globex", "Company", "Globex"), (3, 1, "x", "Company", "X"), (4, 1, "nothing", "Company", "Springfield Holdings")]
    rels = [(1, 1, "acme motors inc", "Globex", "competes with", 0.9), (1, 2, "Acme Motors Inc", "globex ", "COMPETES_WITH", 0.95), (1, 3, "Acme Motors Inc", "Copper", "supplies to", 0.9), (1, 4, "Acme Motors Inc", "Copper", "DEPENDS_ON", 0.7),
            (1, 5, "Initech Bank", "Globex", "OWNS", 0.9), (1, 6, "Globex", "Copper", "OWNS", 0.69), (2, 1, "Acme Motors Inc", "Globex", "OWNS", 0.9), (4, 1, "Springfield Holdings", "Globex", "OWNS", 0.9)]
    kept, found = X.extraction(articles, spark.createDataFrame(entities, "doc_id long, pos int, span string, entity_type string, name string"), spark.createDataFrame(rels, "doc_id long, pos int, subject string, object string, relationship_type string, confidence double"), ["Company", "Commodity"])
    assert sorted((r["doc_id"], r["pos"], r["entity_type"]) for r in kept.collect()) == [(1, 1, "Company"), (1, 2, "Company"), (1, 5, "Commodity"), (2, 1, "Company"), (2, 2, "Company"), (4, 1, "Company")]
    assert sorted((r["doc_id"], r["pos"], r["relationship_type"]) for r in found.collect()) == [(1, 1, "COMPETES_WITH"), (1, 4, "DEPENDS_ON")]


def test_an_answer_is_read_once_for_each_pass(spark):
    """The first pass twice, for its own answers and for those looked at again, the second once; not once for each condition on a part of an answer."""
    rows = {"a": answer("uncertain"), "b": answer(), "c": "{", "d": None}
    results, errors = L.verify(edges(spark, list(rows)), landed(spark, rows), landed(spark, {"a": answer("confirmed_plausible")}))
    assert {r["a"]: (r["verdict"], r["pass"]) for r in results.collect()} == {"a": ("confirmed_plausible", 2), "b": ("likely_plausible", 1)} and errors.count() == 2
    for df in (results, errors):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 3
