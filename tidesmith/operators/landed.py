"""Answers of a remote judge as they landed, one JSON text a row: read row by row, broken ones parted, a second pass over the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesmith.operators import graph, validate
from tidesmith.sources.kept import keep

# What kinds a judged relationship may be of, and the columns of an audit file.
CATEGORIES = ["sector_peer", "supply_chain", "macro_sensitivity", "competition", "risk_factor", "etf_composition", "none"]
AUDIT = ["entity_a_id", "entity_a_name", "entity_b_id", "entity_b_name", "correlation", "direction", "window_days", "observation_count", "method", "verdict", "confidence", "mechanism", "alternative_explanations", "reasoning", "relationship_category"]

FIELDS = ["mechanism", "alternative_explanations", "verdict", "confidence", "reasoning", "relationship_category"]
KEY = ["a", "b", "method", "window_days"]


def read_answers(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, errors) of landed (KEY, response): every row is in one of them, and a broken row stops no other.

    An answer has all fields: verdict and category in lower case and of the known ones, confidence a number, between 0 and 1 after clamping. errors: the
    row and why: missing (null), broken (no JSON object), or the first field that is wrong.
    """
    kinds = ", ".join(f"{c} string" for c in FIELDS) + ", _corrupt_record string"
    # one row for each, so that no condition on the parts of an answer reads its text anew
    read = landed.withColumn("_r", F.explode(F.array(F.from_json("response", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))))
    r = {c: F.col(f"_r.{c}") for c in FIELDS}
    value = r | {"verdict": F.lower(r["verdict"]), "relationship_category": F.lower(r["relationship_category"]), "confidence": F.nanvl(r["confidence"].try_cast("double"), F.lit(None).cast("double"))}
    wrong = {c: value[c].isNull() for c in FIELDS}
    wrong["verdict"] |= ~value["verdict"].isin(graph.VERDICTS)
    wrong["relationship_category"] |= ~value["relationship_category"].isin(CATEGORIES)
    none = F.col("response").isNull()
    broken = F.col("_r._corrupt_record").isNotNull() | F.col("_r").isNull() | ~F.coalesce(F.btrim("response").startswith("{"), F.lit(False))
    error = F.when(none, "missing").when(broken, "broken")
    for c in FIELDS:
        error = error.when(wrong[c], c)
    value["confidence"] = validate.clamp(value["confidence"])
    judged = read.withColumn("error", error)
    good = judged.where("error is null").select(*KEY, *(value[c].alias(c) for c in FIELDS))
    return good, judged.where("error is not null").select(*KEY, "response", "error")


def verify(edges: DataFrame, first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of edges (KEY, ...) by the answers of two passes, landed as (KEY, response), once for each edge.

    An edge without a good first answer has no result. The second pass counts for borderline first answers alone (see graph.needs_review), and only
    where its own answer is good: else the first one stays. errors: (KEY, response, error, pass); second answers that nobody asked for are no errors.
    """
    one, bad_one = read_answers(first.join(edges.select(*KEY), KEY, "left_semi"))
    asked = one.where(graph.needs_review(F.col("verdict"), F.col("confidence"))).select(*KEY)
    two, bad_two = read_answers(second.join(asked, KEY, "left_semi"))
    over = two.select(*KEY, F.struct(*FIELDS).alias("_over"))
    both = one.join(over, KEY, "left")
    has = F.col("_over").isNotNull()
    values = both.select(*KEY, *(F.when(has, F.col(f"_over.{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS), F.when(has, 2).otherwise(1).alias("pass"))
    return edges.join(values, KEY), bad_one.withColumn("pass", F.lit(1)).unionByName(bad_two.withColumn("pass", F.lit(2)))


def round_of(
    edges: DataFrame, nodes: DataFrame, first: DataFrame, second: DataFrame, run: str, started: Column, finished: Column, most: int = 200
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges after it, results, audit row, errors) of a whole verification round.

    The strongest `most` edges that wait (see graph.pending; nodes: id, name, label) are judged by both passes; those with a result get its verdict and values, all
    others stay as they are. The audit row counts the results by verdict. Nothing waits: no results, and an audit row of zeros.
    """
    batch = keep(graph.pending(edges, nodes, most))
    results, errors = verify(batch.select(*(c for c in batch.columns if c not in FIELDS)), first, second)
    results = keep(results)
    audit, _ = graph.run_record(results, run, started, finished)
    return graph.write_verdicts(edges, results), results, audit, errors


def write_audit(results: DataFrame, path: str) -> None:
    """The results as one CSV file with a header of fixed columns; what results lack is empty, and what they have besides is left out.

    A run verifies a bounded batch (see graph.pending), so one file holds it. A file that is there is replaced.
    """
    column = lambda c: F.col(c) if c in results.columns else F.lit(None)
    rows = results.select(*(column(c).cast("string").alias(c) for c in AUDIT))
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
