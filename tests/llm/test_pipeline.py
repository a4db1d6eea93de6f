"""Each stage of the pipeline against a plain version, with nulls, empty and long texts, repeated rows and columns whose names clash."""

import random

import pytest

import corpus_pipeline as P
from tidesmith.llm.common import keep, words

KINDS = "doc_id long, text string, lang string, source string, n_chars long, drop string, rejected boolean, kept_text string, row int, lang_pred string"


def prose(n, letters, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def docs(spark, texts):
    lang = lambda t: "zz" if t and set(t) & set("xyzw") else "aa"
    return spark.createDataFrame([(i, t, lang(t), "s", 1, "d", True, "k", 7, "p") for i, t in texts], KINDS)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def sf(spark, tmp_path):
    spark.createDataFrame([(1, prose(14, "abcdefgh", 77)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_language(spark, sf):
    texts = [(i, prose(60, "abcdefgh" if i % 2 else "stuvwxyz", i)) for i in range(40)]
    odd = [(50, None), (51, ""), (52, "12 !"), (3, texts[3][1]), (None, texts[5][1]), (60, prose(9000, "abcdefgh", 60))]
    rows = docs(spark, texts + odd)
    want = [x for x in plain(rows) if x[0] not in (50, 51, 52)]
    assert plain(P.language(spark, rows, sf)) == want and P.language(spark, rows, sf).columns == rows.columns
    assert P.language(spark, rows.limit(0), sf).count() == 0


def test_lines(spark, sf):
    texts = [(1, "first shared line\nown"), (2, " FIRST shared line \nother"), (3, "first shared line"), (4, None), (5, ""), (2, "first shared line\nthird"), (None, "first shared line"), (6, "x\n" * 5000)]
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in P.lines(spark, docs(spark, texts), sf).collect()}
    assert got == {(1, texts[0][1], 21), (2, "other", 5), (2, "third", 5), (4, "", 0), (5, "", 0), (None, "first shared line", 17), (6, "x\n" * 5000, 10000)}
    row = [r for r in P.lines(spark, docs(spark, texts), sf).collect() if r["doc_id"] == 1][0]
    assert tuple(row)[3:4] + tuple(row)[5:] == ("s", "d", True, "k", 7, "p")
    assert P.lines(spark, docs(spark, []), sf).count() == 0


def test_near(spark, sf):
    base = prose(100, "abcdefgh", 1).split()
    copy = " ".join(base[:50] + ["q"] + base[51:])
    texts = [(1, " ".join(base)), (2, copy), (3, prose(80, "abcdefgh", 3)), (3, prose(80, "abcdefgh", 3)), (4, None), (5, ""), (None, " ".join(base)), (None, None)]
    rows = docs(spark, texts)
    got = plain(P.near(spark, rows, sf).select("doc_id", "text", "drop"))
    assert got == sorted([(1, texts[0][1], "d"), (3, texts[2][1], "d"), (4, None, "d"), (5, "", "d"), (None, texts[0][1], "d"), (None, None, "d")], key=str)
    assert P.near(spark, rows.limit(0), sf).count() == 0


def test_decontaminated(spark, sf):
    item = prose(14, "abcdefgh", 77)
    texts = [(1, f"x {item} y"), (2, "x y z"), (2, "x y z"), (3, None), (None, item), (4, prose(5000, "stuv", 4) + " " + item)]
    got = plain(P.decontaminated(spark, docs(spark, texts), sf))
    assert got == plain(docs(spark, [texts[i] for i in (1, 2, 3, 4)])) and P.decontaminated(spark, docs(spark, []), sf).count() == 0


def test_run_is_its_stages(spark, sf):
    """All stages on one small table: the rest of a plain reading of the contract, packed."""
    clean = [(i, prose(70, "abcdefgh" if i % 2 else "stuvwxyz", i)) for i in range(30)]
    item = prose(14, "abcdefgh", 77)
    texts = clean + [(100, clean[1][1]), (101, prose(20, "abcdefgh", 101) + " " + item + " " + prose(20, "abcdefgh", 102)), (102, None), (103, "12")]
    docs(spark, texts).write.parquet(f"{sf}/documents.parquet")
    out = keep(P.run(spark, sf))
    assert {r["doc_id"] for r in out.collect()} == {i for i, _ in clean}
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    assert len(words(clean[0][1])) == 70
