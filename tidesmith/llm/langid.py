"""Language identification by compression: the language whose zstandard dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidesmith.llm.common import slices, table
from tidesmith.llm.sample import remainder

#: Bound of the training sample: documents of a language, bytes of its dictionary, and characters of the stretch taken of one document.
PER_LANG, DICT_BYTES, STRETCH = 400, 112_640, 1000
#: Bytes of text compressed at a time, so that a dictionary counts at the end of a long text as at its start.
BLOCK, LEVEL = 4096, 6
#: Texts of so many bytes at most are encoded with each of so many parts of the dictionary.
SHORT, PARTS = 200, 8
#: Texts are rejected where the second smallest is less than this share larger than the smallest, and no more than so many bytes.
MARGIN, MARGIN_BYTES = 0.004, 0.125
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The whole text as dictionaries and coders see it: lower case, everything between words one space."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def dictionaries(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, raw content): stretches of each language's documents of the smallest hashes, up to DICT_BYTES.

    docs: (doc_id, text, lang); rows with a null in any of them, and texts without a letter, take no part. Of equal texts one is
    taken. The stretch of a text of more than STRETCH characters begins at a place chosen by a hash, so that no part of texts (a
    header, say) stands out. Stretches come in the order of hashes until the dictionary is full: about 112 of STRETCH bytes. Sorted by lang.
    """
    own = docs.where("doc_id is not null and lang is not null").where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    hashed = own.select("doc_id", "lang", F.xxhash64("text").alias("h"))
    # salted, so that no task meets more than PER_LANG of each task before it, and the last one no more than PER_LANG of each salt
    one = hashed.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id")).withColumn("salt", F.pmod("h", F.lit(64)))
    for by in (["lang", "salt"], ["lang"]):
        one = one.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id", "h"))).where(F.col("rank") <= PER_LANG)
    ids = one.select("doc_id", "lang", "h", "rank")
    # rows are bounded by PER_LANG for each language, bytes by STRETCH for each row
    start = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.lit(1), F.length("text") - STRETCH + 1)).cast("int") + 1
    texts_ = own.select("doc_id", "lang", F.xxhash64("text").alias("h"), F.substring("text", start, F.lit(STRETCH)).alias("text"))
    chosen = texts_.join(F.broadcast(ids), ["doc_id", "lang", "h"]).select("lang", "rank", "text").distinct().collect()
    texts: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["rank"], r["text"])):
        texts.setdefault(r["lang"], []).append(letters(r["text"]))
    return [(lang, b" ".join(t)[:DICT_BYTES]) for lang, t in sorted(texts.items())]


def _coder(raw: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Coders:
    def __init__(self, dicts: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in dicts]
        self.whole = [[_coder(raw)] for _, raw in dicts]
        self.parts = [[_coder(raw[i * len(raw) // PARTS : (i + 1) * len(raw) // PARTS]) for i in range(PARTS)] for _, raw in dicts]

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text under each language's dictionary.

        A short text, whose size under one dictionary is too coarse, is encoded with each part of it, and the mean is taken.
        """
        raw = letters(text)
        coders = self.parts if len(raw) <= SHORT else self.whole
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return np.array([sum(len(c.compress(b)) for b in blocks for c in own) / len(own) for own in coders], float)


def _predict(dicts: list[tuple[str, bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(dicts)
        for part in slices(batches):
            langs, scores, rejected = [], [], []
            for text in part.column("text").to_pylist():
                if not text or not coders.langs or not any(map(str.isalpha, text)):
                    langs.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                sizes = coders.sizes(text)
                best = int(np.argmin(sizes))  # a tie goes to the language that sorts first
                second = float(np.partition(sizes, 1)[1]) if len(sizes) > 1 else np.inf
                gap = second - sizes[best]
                langs.append(coders.langs[best])
                scores.append(float(1 - np.exp(-0.7 * gap)) if np.isfinite(gap) else 1.0)
                rejected.append(bool(gap < MARGIN_BYTES or gap < MARGIN * sizes[best]))
            at = [i for i, n in enumerate(part.schema.names)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in at), pa.array(langs), pa.array(scores, pa.float64()), pa.array(rejected)], [*part.schema.names, "lang_pred", "lang_score", "rejected"]
            )

    return run


def identify(docs: DataFrame, dicts: list[tuple[str, bytes]]) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1, from the margin in bytes) and rejected; columns of those names are replaced.

    Null and empty texts, and texts without a letter, are `und`, score 0, rejected; so is every text where no language was
    learned. Rows are judged one by one: repeated rows, null ids and further columns change nothing. The dictionaries take
    DICT_BYTES for each language.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "lang_score", "rejected")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_predict(dicts), schema + ", lang_pred string, lang_score double, rejected boolean")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dicts = dictionaries(docs.where(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), dicts)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected")
