"""Random rows, repeated rows, null ids, ties, long texts and empty tables, against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import brute_classes, docs, words
from tidesmith.llm import linededup, neardup, packing, sample, suffixdedup

KINDS = "doc_id long, text string"


def some_rows(spark, rows):
    return spark.createDataFrame(rows, KINDS).withColumns({"drop": F.lit("x"), "n": F.lit(1)}).repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_lines_of_random_texts(spark, seed):
    """Lines shared between few documents, with case and blanks, repeated rows, null ids, null texts, ids that come twice with other texts."""
    r = random.Random(seed)
    pool = ["Shared line number one", "  shared LINE number one\t", "another line of some length", "short", "", " \r", "ünïcode line of length ÄÖ", "ÜNÏCODE line of length ÄÖ", "exactly10c"]
    text = lambda: r.choice([None, "", "\n".join(r.choice(pool + [f"own line {r.randint(0, 30)} of it"]) for _ in range(r.randint(1, 9)))])
    rows = [(r.choice([None, *range(25)]) if r.random() < 0.3 else i, text()) for i in range(60)]
    rows += r.sample(rows, 5)
    key = lambda line: re.sub(r"[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                holders.setdefault(key(line), set()).add(i)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = linededup.drop_repeated_lines(some_rows(spark, rows)).select("doc_id", "kept_text", "n_lines", "n_dropped")
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("seed", range(2))
def test_classes_of_random_texts(spark, seed):
    """Groups of near and of exact copies, chains whose ends are not alike, and texts alone, against all pairs."""
    r, texts = random.Random(seed), []
    for g in range(8):
        own = words(r.randint(30, 120), 100 * seed + g).split()
        for _ in range(r.randint(1, 6)):
            at = r.randrange(len(own))
            own = own if r.random() < 0.2 else [*own[:at], f"z{r.randint(0, 9)}", *own[at + 1 :]]
            texts.append(" ".join(own))
    texts += [words(3, 1), words(3, 1), words(4, 2), "", None]
    r.shuffle(texts)
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_classes_of_odd_rows(spark):
    """Repeated rows, null ids, an id with two texts, and very long copies."""
    long = words(20_000, 5)
    rows = [(1, words(60, 1)), (1, words(60, 1)), (2, words(60, 1)), (None, words(60, 1)), (None, None), (7, long), (9, long + " end"), (9, long + " end"), (4, words(50, 8)), (4, None)]
    got = Counter(map(tuple, neardup.near_duplicates(some_rows(spark, rows)).collect()))
    assert got == Counter({(1, 1): 2, (2, 1): 1, (None, None): 2, (7, 7): 1, (9, 7): 2, (4, 4): 2})


def test_repeated_bytes_of_odd_rows(spark):
    """Equal rows count as one document, rows of null id are neither matched nor cut, and a text over several strides is cut to the last byte."""
    unit, long = words(40, 3), words(120_000, 4)
    rows = [(1, unit), (1, unit), (None, unit), (2, "x" + unit), (3, None), (4, long), (5, long[7:] + "tail"), (6, unit[:99]), (7, "é" + unit[:60] + unit[:60])]
    got = Counter((x["doc_id"], bytes(x["kept"]).decode()) for x in suffixdedup.drop_repeated_bytes(some_rows(spark, rows)).collect())
    assert got == Counter({(1, unit): 2, (None, unit): 1, (2, "x"): 1, (3, ""): 1, (4, long): 1, (5, "tail"): 1, (6, unit[:99]): 1, (7, "é" + unit[:60] * 2): 1})
    assert suffixdedup.drop_repeated_bytes(some_rows(spark, rows).limit(0)).count() == 0


def packed_well(rows, context):
    at = {}
    for x in sorted(rows, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == at.get(x["sequence_id"], 0)
        at[x["sequence_id"]] = x["offset"] + x["length"]
    return max(at.values(), default=0) <= context


def test_packing_of_odd_rows(spark):
    """Many pieces of one length, repeated rows and null ids: each row is packed as often as it stands."""
    rows = [(i, "one two three") for i in range(40)] + [(5, "one two three")] * 3 + [(None, "alone"), (None, None), (50, ""), (60, words(500, 1))]
    path = packing.default_tokenizer()
    got = packing.pack(some_rows(spark, rows), path, context=64).collect()
    assert packed_well(got, 64)
    ends = Counter(x["doc_id"] for x in got if x["piece"] == 0)
    assert ends == Counter(i for i, _ in rows)
    long = sorted((x["piece"], x["start"], x["length"]) for x in got if x["doc_id"] == 60)
    assert [x[0] for x in long] == list(range(len(long))) and all(x[1] == 64 * x[0] for x in long) and {x[2] for x in long[:-1]} == {64}
    assert len({x["sequence_id"] for x in got}) <= -(-sum(x["length"] for x in got) // 64) + 1
    assert packing.pack(some_rows(spark, rows).limit(0), path).count() == 0


def test_the_packing_stage(spark, tmp_path):
    """The last stage over documents of the table's columns, and over none."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string"
    df = spark.createDataFrame([(1, "a b c", "aa", "s", 5, "x"), (1, "a b c", "aa", "s", 5, "x"), (None, "d", None, None, None, None), (2, None, "aa", "s", 0, "y")], kinds)
    got = corpus_pipeline.packed(spark, df, str(tmp_path)).collect()
    assert packed_well(got, packing.CONTEXT) and Counter(x["doc_id"] for x in got) == Counter([1, 1, None, 2]) and {x["sequence_id"] for x in got} == {0}
    assert corpus_pipeline.packed(spark, df.limit(0), str(tmp_path)).count() == 0


def test_a_sample_is_bounded_by_documents(spark):
    """A document that stands a thousand times is one row of a training sample."""
    texts = some_rows(spark, [(1, f"text {i % 7}") for i in range(1000)] + [(2, None), (3, "c")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1)], "doc_id long, toxic int")
    ids = sample.labelled_ids(labels, "toxic", 1_000_000, -1, 10)
    got = sorted((x["doc_id"], x["y"], x["text"]) for x in sample.sample_texts(texts, ids).collect())
    assert [x[:2] for x in got] == [(1, 1), (2, 0), (3, 1)] and got[1][2] is None and got[0][2].startswith("text ")
    assert np.isfinite([x[1] for x in got]).all()
