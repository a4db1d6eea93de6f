"""Each operator against a plain version, on few rows with nulls, empty and long texts, ties, copies and further columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidesmith.llm import decontaminate, langid, linededup, neardup, packing, pii, quality, suffixdedup, topk, toxicity

DOCS = "doc_id long, text string, score string, drop int"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "x", 1) for i, t in enumerate(texts)], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_line_dedup(spark):
    texts = ["A shared line here\nown one", None, "", " a SHARED line here \nx\nA shared line here", "short\nshort", "own one\n" * 3]
    rows = docs(spark, texts).union(spark.createDataFrame([(None, "a shared line here", "x", 1)], DOCS))
    got = {r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_dropped"]) for r in linededup.drop_repeated_lines(rows).collect()}
    assert got[0] == (texts[0], 2, 0) and got[1] == ("", 1, 0) and got[2] == ("", 1, 0)
    assert got[3] == ("x", 3, 2) and got[4] == ("short\nshort", 2, 0) and got[None][0] == "a shared line here"
    assert linededup.drop_repeated_lines(docs(spark, texts).limit(0)).count() == 0


def test_minimal_perfect_hash_is_a_bijection():
    rng = np.random.default_rng(0)
    h1, h2 = rng.integers(-(2**62), 2**62, (2, 5000))
    h1[:50] = 7  # equal first hashes are told apart by the second
    assert sorted(linededup.mph_build(h1, h2)[1]) == list(range(5000))
    index = linededup.Index(*linededup.Index.make(h1, h2, np.arange(5000) + 2, np.arange(5000)))
    n, owner = index.probe(h1, h2)
    assert (n == np.arange(5000) + 2).all() and (owner == np.arange(5000)).all()
    assert (index.probe(h1 + 1, h2 + 1)[0] == 0).all()


def brute_classes(texts):
    of, df = neardup._Hashes(), np.zeros(1 << neardup.IDF_BITS)
    for t in texts:
        df[np.unique(neardup._word_hashes(t, of) >> np.uint64(64 - neardup.IDF_BITS))] += 1
    idf = (np.log((1 + len(texts)) / (1 + df)) + 0.1).astype(np.float32)
    s = [neardup.weighted_shingles(t, idf, of) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if len(s[i][0]) and neardup.weighted_jaccard(s[i], s[j]) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_near_duplicates(spark):
    base = words(120, 1).split()
    copies = [" ".join(base[:k] + ["zz"] + base[k + 1 :]) for k in (5, 40, 80, 110)]
    texts = [" ".join(base), *copies, words(60, 2), words(60, 2), None, "", "!!!", "one two", "One, two"]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    assert neardup.near_duplicates(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 256, 50])
def test_a_pair_in_one_wide_bucket_is_linked(spark, monkeypatch, block):
    """Two near copies meet in one bucket only, with 600 other texts, and far apart in the order of the sketches."""
    monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    rng, n = np.random.default_rng(5), 600
    sketches = rng.integers(0, 256, (n, 6, 8), dtype=np.uint8)
    sketches[400] = sketches[300]
    sketches[:, :, 7] = np.arange(n)[:, None] * 7 % 200 + 28 & 255
    sketches[300, :, 7], sketches[400, :, 7] = 200, 60
    base = words(80, 900).split()
    text = {300: " ".join(base), 400: " ".join(base[:-1])}
    bands = lambda i: [100 * i + k + 1000 if k != 3 else 1 for k in range(neardup.BANDS)]
    rows = [(i, text.get(i) or words(20, i), bands(i), s) for i, s in enumerate(sketches.reshape(n, 48).view("<i8").tolist())]
    df = spark.createDataFrame(rows, "doc_id long, text string, bands array<long>, sketch array<long>")
    buckets = df.select(F.lit(1).cast("long").alias("bucket"), "doc_id", "bands", "sketch")
    roots = neardup.classes(buckets, df.select("doc_id", "text"), np.ones(1 << neardup.IDF_BITS, np.float32))
    assert {r["doc_id"]: r["root"] for r in roots.collect()} == {i: 300 if i == 400 else i for i in range(n)}


def test_decontamination(spark):
    item = words(14, 5)
    texts = [f"x {item} y", " ".join(item.split()[:10]) + " end", " ".join(item.split()[:9]), None, "", "short Item"]
    tests = spark.createDataFrame([(1, item), (2, "short item"), (3, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs(spark, texts), tests, distance=9).collect()}
    assert (got[0]["starts"], got[0]["ends"], got[0]["items"]) == ([1], [15], ["1"])
    assert (got[1]["starts"], got[1]["ends"]) == ([0], [10]) and got[2]["starts"] == [] and got[3]["n_words"] == 0
    assert got[5]["items"] == ["2"] and got[0]["near_items"] == ["1"]


def plain_contamination(texts, items, size, distance):
    tokens = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, w[k : k + size]) for i, t in items for w in [tokens(t)] for k in range(max(1, len(w) - size + 1) if w else 0)]
    out = []
    for t in texts:
        w = tokens(t)
        hit, found, near = set(), set(), set()
        for i, x in windows:
            for at in range(len(w)):
                if w[at : at + len(x)] == x:
                    hit.update(range(at, at + len(x)))
                    found.add(i)
                if w[at] == x[0] and set(x) <= set(w[max(0, at - distance) : at + distance + 1]):
                    near.add(i)
        out.append((len(w), hit, sorted(str(i) for i in found - {None}), sorted(str(i) for i in near - {None})))
    return out


@pytest.mark.parametrize("limits", [{}, {"BLOCK_BYTES": 60, "SHARD_TOKENS": 50}])
def test_contamination_is_that_of_a_plain_search(spark, monkeypatch, limits):
    """Repeated rows, null ids, frequent words and long texts; small limits give the same rows."""
    for name, value in limits.items():
        monkeypatch.setattr(decontaminate, name, value)
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("a b c dd É Ff g,h i".split()) for _ in range(n))
    items = [(i, text(r.randint(1, 7))) for i in range(8)] + [(None, "c dd c"), (9, None), (10, ""), (3, "g b")]
    texts = [text(r.randint(0, 40)) for _ in range(40)] + [None, "", text(3000)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 1), (5, "a b c", "x", 1), (None, texts[7], "x", 1), (None, texts[7], "x", 1)]
    tests = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words int")
    got = sorted((str(x["doc_id"]), x["n_words"], sorted(p for a, b in zip(x["starts"], x["ends"]) for p in range(a, b)), x["items"], x["near_items"]) for x in decontaminate.contamination(spark.createDataFrame(rows, DOCS), tests, 4, 6).collect())
    want = plain_contamination([x[1] for x in rows], items, 4, 6)
    assert got == sorted((str(x[0]), n, sorted(hit), a, b) for x, (n, hit, a, b) in zip(rows, want))
    assert decontaminate.contamination(spark.createDataFrame(rows[:9], DOCS), tests.limit(0)).where("size(starts) > 0").count() == 0
    assert decontaminate.contamination(spark.createDataFrame([], DOCS), tests).count() == 0


@pytest.mark.parametrize("bucket,stride", [(10**6, 1 << 22), (20, 1 << 22), (10**6, 37)])
def test_suffix_dedup(spark, monkeypatch, bucket, stride):
    monkeypatch.setattr(suffixdedup, "_STRIDE", stride)
    a, b = words(60, 7), words(80, 8)
    texts = [a, f"{b} {a[20:180]} {b}", a, None, "", "ab" * 150, words(30, 9) + a[50:151], "é" * 120, a[:99]]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        want[i] = (bytes(x for x, y in zip(raw, gone) if not y), len(re.findall(b"\1+", bytes(gone))))
    out = suffixdedup.drop_repeated_bytes(docs(spark, texts), bucket).collect()
    assert {r["doc_id"]: (bytes(r["kept"]), r["n_spans"]) for r in out} == want


def test_language(spark):
    dicts = [("aa", b"badge fed head cafe abed deaf " * 40), ("zz", b"xyst tuvw wxyz yzst vuts " * 40)]
    got = [tuple(r) for r in langid.identify(docs(spark, ["badge fed head cafe", "xyst tuvw wxyz", None, "", "12 34"]), dicts).select("lang_pred", "rejected").collect()]
    assert got == [("aa", False), ("zz", False), ("und", True), ("und", True), ("und", True)]


def test_what_counts_as_a_letter(spark):
    """Numbers that are no digits (halves, powers, Roman ones, circled ones) are no letters; one letter of any script is."""
    dicts = langid.dictionaries(spark.createDataFrame([(i, words(30, i), "aa") for i in range(9)], "doc_id long, text string, lang string"))
    odd = ["½", "²³ 12", "Ⅷ", "①", "_ 5 -", None, "", "½ a", "ª", "中"]
    got = [r["lang_pred"] for r in langid.identify(docs(spark, odd), dicts).orderBy("doc_id").collect()]
    assert got == ["und"] * 7 + ["aa"] * 3


def test_classifiers(spark):
    texts = [words(40, i) + (". you moron. " if i % 3 == 0 else ". ") + words(20, i + 500) for i in range(120)]
    rows, labels = docs(spark, texts), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, y int")
    extra = docs(spark, [words(30, 900) + ". Moron you!", words(30, 901), None, ""], 1000)
    model = toxicity.fit(rows, labels)
    got = {r["doc_id"]: r for r in toxicity.toxicity(extra, model).collect()}
    assert got[1000]["score"] > 0.7 > got[1001]["score"] and got[1002]["score"] == got[1003]["score"] == 0.0
    assert "Moron" in extra.collect()[0]["text"][got[1000]["offending"][0]["start"] : got[1000]["offending"][0]["end"]]
    score = {r["doc_id"]: r["score"] for r in quality.quality(extra, quality.fit(rows, labels)).collect()}
    assert score[1000] > score[1001] and score[1002] == score[1003]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    texts = [words(n, n) for n in (3, 30, 200, 90, 60, 60, 60)] + [None, "", "Naïve <|endoftext|> Σ ΑΣ it's 12 ½!", "日本 語"]
    rows = packing.pack(docs(spark, texts), path, context=128, with_ids=True).collect()
    t, made = Tokenizer.from_file(path), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        made.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert made == {i: (t.encode(x, add_special_tokens=False).ids if x else []) + [1] for i, x in enumerate(texts)}
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 128 and len(at) <= sum(at.values()) // 128 + 2


def test_personal_data(spark):
    texts = ["éa.b@c.de.f_x@y.zz 1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111-1111 1111 and +1 (212) 555-0100.", None, "", "12 " * 6000 + "+1", *(f"password={hashlib.md5(bytes([i])).hexdigest()[:18]} z" for i in range(30)), "password=Abc123xyz9"]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(spark, texts)).collect()}
    span = lambda i, k: [(m["start"], m["end"]) for m in got[i][k]]
    assert span(0, "email") == [(1, 11), (11, 18)] and span(0, "ip") == [(19, 26), (27, 34)]
    assert span(1, "card") == [(0, 19)] and span(1, "phone") == [(24, 41)] and span(2, "email") == span(3, "ip") == []
    assert span(35, "learned") == [(9, 19)]


def base_of(text):
    """The contract's patterns and checks, one by one."""
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(x):
        twice = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(x))]
        return sum(twice) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(r, text or "") if ok(m[0])] for k, (r, ok) in kinds.items()}


def test_base_spans_are_those_of_the_patterns(spark):
    r = random.Random(9)
    atoms = ["0", "00", "1", "25", "255", "256", "010", "4111", "1111", ".", ".", "-", " ", "+", "@", "a", "é", "b.c", "(", ")", "%", "12345678901234567"]
    texts = ["10.0.0.1 127.0.0.1 0.0.0.0 000.1.02.255 256.1.1.1", None, "", "10.0.0.1 " * 3000, *("".join(r.choice(atoms) for _ in range(r.randint(1, 40))) for _ in range(3000))]
    for row in pii.base_spans(docs(spark, texts)).collect():
        assert {k: [(m["start"], m["end"]) for m in row[k]] for k in pii.KINDS} == base_of(row["text"]), row["text"]


def test_many_matches_in_one_text(spark):
    """Places of very many matches are right to the last one; work grows with them and not with their square."""
    n = 32_000
    text = "".join(f"é{i % 7} 10.0.{i % 256}.{i % 5} " for i in range(n)) + "pass: Qx7-441a end"
    row = pii.personal_data(docs(spark, [text])).collect()[0]
    want = [(m.start(), m.end()) for m in re.finditer(r"10\.0\.[0-9]+\.[0-9]+", text)]
    assert [(m["start"], m["end"]) for m in row["ip"]] == want and len(want) == n


def plain_bootstrap(found):
    """learned of pii.bootstrap by plain loops: found is (doc_id, start, end, text, seed, base, pattern)."""
    edges = {}
    for _, _, _, text, seed, _, pattern in found:
        if pattern:
            edges[pattern, text] = edges.get((pattern, text), False) or seed

    def shape(text):
        runs = re.sub(r"\b(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]+\b", "\u0001", text)
        return re.sub("[0-9]+", "0", re.sub("[A-Za-z]+", "a", runs)).replace("\u0001", "x")

    known = {shape(t) for (_, t), seed in edges.items() if seed}
    texts = {t for _, t in edges}
    seeds = {t for (_, t), seed in edges.items() if seed}
    belief = {t: float(t in seeds) for t in texts}
    for _ in range(pii.ROUNDS):
        conf = {}
        for p in {p for p, _ in edges}:
            own = [t for q, t in edges if q == p and shape(t) in known]
            total = sum(belief[t] for t in own)
            if total >= pii.LEAST_SEEDS and total >= pii.LEAST_PATTERN * len(own):
                conf[p] = min(total / (len(own) + 1), 0.999)
        belief = {t: 1.0 if t in seeds else 1 - np.prod([1 - conf.get(p, 0.0) for p, u in edges if u == t]) for t in texts}
    good = {t for t in texts if belief[t] >= (pii.LEAST_INSTANCE if shape(t) in known else pii.LEAST_STRANGE)}
    return {(d, s, e) for d, s, e, text, seed, base, pattern in found if not base and (seed or (pattern and text in good))}


@pytest.mark.parametrize("seed", range(2))
def test_bootstrap_against_plain_loops(spark, seed):
    """Planted forms that no seed has, under labels that seeds share, are found; those under labels of ordinary numbers are not."""
    r = random.Random(seed)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(20)) + "a1"
    odd = lambda: f"Zq{r.randint(100, 999)}-{r.choice('KLMN')}{r.randint(10, 99)}w"
    texts = [f"words here token={key()} and more" for _ in range(60)] + [f"also token={odd()} here" for _ in range(4)] + [f"row id: {r.randint(10**6, 10**7)} of v{r.randint(1, 9)}.{r.randint(10000, 99999)}" for _ in range(40)]
    rows = docs(spark, texts).select("doc_id", "text").withColumn("doc", F.xxhash64("doc_id", "text"))
    found = pii.candidates(pii.base_spans(rows))
    got = {tuple(x) for x in pii.bootstrap(found).select("doc_id", "start", "end").collect()}
    assert got == plain_bootstrap([tuple(x) for x in found.select("doc_id", "start", "end", "text", "seed", "base", "pattern").collect()])
    planted = {i for i in range(60, 64)}
    assert planted <= {d for d, _, _ in got} and not {d for d, _, _ in got} & set(range(64, 104))


def test_long_and_strange_identifiers(spark):
    texts = [*(f"password={hashlib.md5(bytes([i])).hexdigest()[:18]} z" for i in range(60)), "password=Abc-123xyz.", f"password={'k9' * 60}", "token " + "9" * 90]
    rows = docs(spark, texts).union(docs(spark, texts[-3:-2])).union(spark.createDataFrame([(None, texts[-3], "x", 1)], DOCS))
    got = [(r["doc_id"], [(m["start"], m["end"]) for m in r["learned"]]) for r in pii.personal_data(rows).where("doc_id is null or doc_id >= 60 or doc_id = 0").collect()]
    assert sorted(got, key=str) == sorted([(60, [(9, 19)]), (61, [(9, 129)]), (62, []), (None, [(9, 19)]), (0, [(9, 27)]), (0, [(9, 19)])], key=str)
    assert pii.personal_data(rows.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"LEAF": 7, "SHARD_ROWS": 90, "BLOCK_ROWS": 5, "PILOT": 1}])
def test_top_k(spark, monkeypatch, limits):
    """Against all products, with nulls, other lengths, ties, repeated rows and repeated queries; small limits give the same rows."""
    for name, value in limits.items():
        monkeypatch.setattr(topk, name, value)
    r = random.Random(3)
    rows = [(i, [r.randint(-300, 300) for _ in range(8)]) for i in range(600)] + [(700, [1] * 8), (701, [1] * 8), (702, [5, 6])]
    rows += [rows[50], rows[50], rows[51], (100, [9999] * 8)]
    table = spark.createDataFrame([(i, [x / 256 for x in v], "x") for i, v in rows] + [(800, None, "x"), (801, [float("nan")], "x"), (None, [1.0] * 8, "x")], "id long, v array<double>, dim string")
    df = topk.integers(table, "id", "v")
    got = {}
    for x in topk.top_k(df, df.where("id % 50 = 0"), 5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    want = {}
    for q in {q for q, _ in rows if q % 50 == 0}:
        v = min(v for i, v in rows if i == q)
        all_ = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(all_[:5])]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert topk.top_k(df.limit(0), df.where("id % 50 = 0"), 5).count() == 0 == topk.top_k(df, df.limit(0), 5).count()
