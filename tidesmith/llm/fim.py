"""Fill-in-the-middle: texts cut into units, and the units between two drawn cuts moved to the end, as arrays of whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesmith.llm.common import portions, table

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Percent of texts that are transformed, and percent of those in the form that puts the suffix first.
RATE, SUFFIX_FIRST, SEED = 100, 50, 7


def drawn(doc_id: Column, seed: int, groups: int) -> Column:
    """The first groups of eight hexadecimal digits of sha256 of `seed:doc_id`, as numbers; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(groups)))


def _units(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(units of all texts one after another, the text that each belongs to, the number of units of each text).

    A unit is a line with its line feed, or what follows the last one.
    """
    lines = pc.split_pattern(text, "\n")
    parents, flat = pc.list_parent_indices(lines).to_numpy(), pc.list_flatten(lines)
    last = np.ones(len(flat), bool)
    last[:-1] = parents[1:] != parents[:-1]
    ended = pc.if_else(pa.array(last), flat, pc.binary_join_element_wise(flat, "\n", ""))
    some = ~last | pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    parents = parents[some]
    return ended.filter(pa.array(some)), parents, np.bincount(parents, minlength=len(text))


def _joined(units: pa.Array, parents: np.ndarray, keep: np.ndarray, n: int) -> pa.Array:
    """The kept units of each of n texts, joined."""
    offsets = np.searchsorted(parents[keep], np.arange(n + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), units.filter(pa.array(keep))), "")


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of docs (doc_id, text, ...), row by row.

    n units; the prefix ends after the smaller and the middle after the larger of two cuts drawn from doc_id. Forms: psm, spm, and plain
    (the text itself) for empty texts, texts that contain a mark, and all but `rate` percent. Null text is empty; rows of one
    doc_id get the same draws, rows of null doc_id those of an empty id. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            text = pc.fill_null(part.column("text"), "")
            h = pc.list_flatten(part.column("h")).to_numpy().reshape(-1, 4)
            units, parents, n = _units(text)
            cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            first = np.cumsum(n) - n
            ordinal = np.arange(len(parents)) - first[parents]
            low, high = cuts[parents, 0], cuts[parents, 1]
            prefix, middle, suffix = (_joined(units, parents, keep, len(text)) for keep in (ordinal < low, (ordinal >= low) & (ordinal < high), ordinal >= high))
            marked = np.zeros(len(text), bool)
            for mark in MARKS:
                marked |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
            plain = pa.array(marked | (n == 0) | (h[:, 2] % 100 >= rate))
            form = pc.if_else(plain, "plain", pc.if_else(pa.array(h[:, 3] % 100 < suffix_first), "spm", "psm"))
            psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
            spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
            output = pc.if_else(plain, text, pc.if_else(pc.equal(form, "spm"), spm, psm))
            chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), form, *chars, output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = docs.select("doc_id", "text", drawn(F.col("doc_id"), seed, 4).alias("h"))
    return own.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """rows (..., form, output) and text, the text before: from the output and its form alone. Null output is empty text; a form without its marks raises."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "output"):
            output, form = pc.fill_null(part.column("output"), ""), part.column("form")
            body = pc.utf8_slice_codeunits(output, len(PREFIX))
            texts = output
            for kind, first_mark, mark in (("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX)):
                on = pc.fill_null(pc.equal(form, kind), False)
                if not pc.all(pc.or_(pc.invert(on), pc.starts_with(output, first_mark))).as_py():
                    raise ValueError(f"an output of form {kind} does not begin with {first_mark}")
                # only rows of this form are cut; the marks part what they join, as no piece contains one
                two = pc.split_pattern(pc.if_else(on, body, mark), mark, max_splits=1)
                rest = pc.split_pattern(pc.if_else(on, pc.list_element(two, 1), MIDDLE), MIDDLE, max_splits=1)
                one, other, middle = pc.list_element(two, 0), pc.list_element(rest, 0), pc.list_element(rest, 1)
                prefix, suffix = (one, other) if kind == "psm" else (other, one)
                texts = pc.if_else(on, pc.binary_join_element_wise(prefix, middle, suffix, ""), texts)
            yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "text"])

    return rows.mapInArrow(run, f"{kinds}, text string")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("text").alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, e'[^\n]*\n|[^\n]+') AS u, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:lo], ''), '') AS pre, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS mid, coalesce(array_to_string(u[hi + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
