"""Resampling, fill-in-the-middle and byte-pair encoding against plain versions: nulls, empty and long texts, ties, repeated rows, further columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesmith.llm import bpe, fim, resample
from tidesmith.llm.packing import default_tokenizer

DOCS = "doc_id long, text string, score string, rank int, h string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS).repartition(3)


def texts_of(n, seed, letters="abcdefgh", most=60):
    r = random.Random(seed)
    return [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, most))) for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def groups(doc_id):
    x = sha(f"7:{'' if doc_id is None else doc_id}")
    return [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]


# --- resampling ------------------------------------------------------------------------------------------------------------


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2) for i in range(len(w) - k + 1)], len(w)


def plain_resample(rows, target):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for count, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for b in features(x)[0]:
                count[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (t.size + int(s.sum())) / ((s[b] + 1) * (int(t.sum()) + 10000)))) for b in range(10000)]
    out = []
    for i, x in rows:
        f, n = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((groups(i)[0] + 0.5) / 4294967296))), n, None])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], (1 << 63) - 1 if r[0] is None else r[0], r[1]))
    for rank, r in enumerate(able[: 25 * len(able) // 100]):
        r[5] = rank + 1
    return sorted(((r[0], r[1], r[2], r[3], r[5]) for r in out), key=str)


def test_resample(spark):
    rows = list(enumerate(texts_of(150, 1))) + [(500, None), (501, ""), (502, "Ünï A B! é—x " * 20), (503, "a b " * 30000), (3, "again ab " * 15), (None, "ab cd " * 12), (None, None)]
    target = [*texts_of(20, 2, "aceg"), None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs(spark, rows), items).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, target)
    assert resample.resample(docs(spark, []), items).count() == 0
    assert sorted(map(tuple, resample.resample(docs(spark, rows), items.limit(0)).select(*got.columns).collect()), key=str) == plain_resample(rows, [])


@pytest.mark.parametrize("seed", range(4))
def test_draw_with_ties(spark, seed):
    """Few scores and ids that repeat: the cut goes through ties of score, and through copies of one id."""
    r = random.Random(seed)
    rows = [(r.choice([None, *range(30)]), r.random() < 0.8, r.randint(-2, 2), i) for i in range(120)]
    k = r.randint(1, 60)
    got = resample.draw(spark.createDataFrame(rows, "doc_id long, eligible boolean, score long, n long"), k)
    able = sorted((x for x in rows if x[1]), key=lambda x: (-x[2], (1 << 63) - 1 if x[0] is None else x[0], x[3]))
    want = {x[3]: i + 1 for i, x in enumerate(able[:k])}
    assert {x["n"]: x["rank"] for x in got.collect() if x["rank"]} == want and got.count() == len(rows)


def test_bisection_counts_little():
    """Jobs grow with the logarithm of the range; thresholds at either end are found."""
    values = sorted(random.Random(5).choices(range(-(10**15), 10**15), k=500))
    for wanted in (1, 2, 250, 499, 500):
        jobs = []
        count = lambda at: jobs.append(at) or [sum(v <= x for v in values) for x in at]
        assert resample.bisect(count, values[0], values[-1], wanted) == values[wanted - 1]
        assert len(jobs) <= 14 and all(len(x) <= resample.PROBES for x in jobs)


# --- fill in the middle ----------------------------------------------------------------------------------------------------


def plain_fim(i, text):
    text = text or ""
    units, (a, b, c, d) = re.findall(r"[^\n]*\n|[^\n]+", text), groups(i)
    n = len(units)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return (i, n, "plain", None, None, text, text)
    form = "spm" if d % 100 < 50 else "psm"
    return (i, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text)


def test_fill_in_middle(spark):
    r = random.Random(3)
    piece = lambda: "".join(r.choice(["a", "é", "\n", "\n", "<", "S>", "<M", ">", "<P", "🙂", " ", "\r"]) for _ in range(r.randint(0, 25)))
    rows = [(i, piece()) for i in range(300)] + [(400, None), (401, ""), (402, "\n"), (403, "one"), (404, "x<P>y\nz"), (405, "line\n" * 40000), (7, "copy\nof\nseven"), (None, "no\nid\n"), (None, None), (406, "\n\n\n"), (-8, "minus\neight")]
    done = fim.restore(fim.fill_in_middle(docs(spark, rows)))
    got = sorted(map(tuple, done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text").collect()), key=str)
    assert got == sorted((plain_fim(*x) for x in rows), key=str)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(docs(spark, []))).count() == 0


def test_fill_in_middle_rates(spark):
    rows = [(i, f"a{i}\nb\nc") for i in range(400)]
    got = fim.fill_in_middle(docs(spark, rows), rate=40, suffix_first=100).groupBy("form").count().collect()
    forms = {x["form"]: x["count"] for x in got}
    assert forms == {"plain": sum(groups(i)[2] % 100 >= 40 for i, _ in rows), "spm": sum(groups(i)[2] % 100 < 40 for i, _ in rows)}


def test_restore_rejects_what_has_no_marks(spark):
    with pytest.raises(Exception, match="does not begin"):
        fim.restore(spark.createDataFrame([("psm", "no marks")], "form string, output string")).collect()


# --- byte-pair encoding ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def odd_texts(library):
    r, vocab = random.Random(1), sorted(library.get_vocab())
    parts = ["a", "b", "e", "th", "in", "ing", " ", "'", "é", "́", "x", "1", "22", "!", "!!", "<|endoftext|>", "<|", "中", "Σ", "\n", "\t", "ß", "'s", "'LL", "½", "ª", "_"]
    out = ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(800)]
    out += ["".join(r.choice(vocab).replace("</w>", "") for _ in range(r.randint(1, 6))) for _ in range(800)]
    any_char = lambda: chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0x36F), r.randint(0x370, 0xD7FF), r.randint(0x10000, 0x1FFFF), 32]))
    out += ["".join(any_char() for _ in range(r.randint(1, 30))) for _ in range(800)]
    return out + [" ", "\u0085a b c", "İ ΑΣ ǅ", "\0 \0<|endoftext|>", "a" * 3000, "ab" * 40, "</w>", "x" * 63 + " " + "y" * 65]


def test_encode_and_decode(spark, library):
    texts = [None, "", *odd_texts(library), "word " * 30000]
    rows = [*enumerate(texts), (3, "Hello again"), (None, "no id"), (None, None)]
    path = default_tokenizer()
    done = bpe.decode(bpe.encode(docs(spark, rows), path), path)
    got = sorted(((x["doc_id"], x["ids"], x["text"]) for x in done.collect()), key=str)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert got == sorted(((i, x, library.decode(x, skip_special_tokens=False)) for (i, _), x in zip(rows, ids)), key=str)
    assert bpe.decode(bpe.encode(docs(spark, []), path), path).count() == 0


def test_unknown_ids_are_passed_over(spark, library):
    rows = spark.createDataFrame([(1, [3306, None, 99999, -1, 1002]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {x["doc_id"]: x["text"] for x in bpe.decode(rows, default_tokenizer()).collect()}
    assert got == {1: library.decode([3306, 1002]), 2: "", 3: ""}


def test_proposal_is_checked_not_trusted(library):
    """Each word is either certain as proposed or merged; both paths and both ways of merging agree with the library."""
    e = bpe.Encoder(default_tokenizer())
    words = sorted({w for t in odd_texts(library) for w in re.findall("[a-z]+", t.lower())} | {"".join(random.Random(i).choices("etaoinshr", k=9)) for i in range(2000)})
    found, merged = e.merges.encode([w.encode() for w in words])
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert found == want and 0 < merged < len(words)
    for w, x in zip(words, want):
        start = [*map(e.merges.bytes_.__getitem__, w.encode()[:-1]), e.merges.bytes_[256 + w.encode()[-1]]]
        assert e.merges._merge_short(start[:]) == e.merges._merge_long(start[:]) == x
        proposed = np.array(e.merges.propose(w.encode()))
        assert bool(e.merges.compatible(proposed[:-1], proposed[1:]).all()) == (proposed.tolist() == x)


def test_other_forms_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="form"):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_queries(spark, tmp_path):
    """The registered queries: digests of what the operators give."""
    from tokenizers import Tokenizer

    rows = [(1, "One two\nthree"), (2, None), (20, "x " * 30 + "\n<S>")]
    docs(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    library = Tokenizer.from_file(default_tokenizer())
    got = {x["doc_id"]: tuple(x)[1:] for x in bpe.op13(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = sorted(map(tuple, fim.op12(spark, str(tmp_path)).collect()))
    assert got == sorted((*x[:5], sha(x[5]), sha(x[6])) for x in (plain_fim(*r) for r in rows))
    got = resample.op11(spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(rows, ["two three"])


def test_cut_counts_are_bounded(spark):
    """What a task sends to sum up features is at most one row a bucket."""
    rows = docs(spark, list(enumerate(texts_of(300, 9))))
    assert resample.bucket_counts(rows, buckets=50).count() <= 50
    assert rows.select(F.lit(1)).count() == 300
