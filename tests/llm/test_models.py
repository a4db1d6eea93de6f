"""The learned operators against plain loops: scores, the optimum of the hinge loss, and documents that were held out."""

import math
import random

import numpy as np
import xxhash
import zstandard

from tidesmith.llm import langid, quality, toxicity

DOCS = "doc_id long, text string, score string, drop int"
ODD = [None, "", "...", "12 34", "a", "Ünder. ÜNDER!\n\nunder under", "no stop " * 3000, "x" * 70_000, "One. " * 400]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) + rng.choice(["", "", ".", "!\n"]) for _ in range(n))


def labelled(spark, rng, n=160):
    texts = [prose(rng, 40) + (" you moron. " if i % 3 == 0 else ". ") + prose(rng, 20) for i in range(n)]
    return docs(spark, texts), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, y int")


def test_toxicity_is_a_plain_noisy_or(spark):
    rng = random.Random(3)
    weights, bias = toxicity.fit(*labelled(spark, rng))
    texts = [*ODD, *(prose(rng, rng.randint(1, 300)) + rng.choice(["", " Moron. moron?"]) for _ in range(60))]
    texts.append(texts[-1])
    rows = docs(spark, texts, [*range(len(texts) - 3), None, len(texts), len(texts)])

    def plain(text):
        clean, spans = 1.0, []
        for a, b, _ in toxicity.sentences(text):
            words, word = set(), ""
            for c in text[a:b] + " ":
                if c.isalpha():
                    word += c
                elif word:
                    words.add(word.lower())
                    word = ""
            hashed = [f"w{w}" for w in words] + [f"{n}{w[:n]}" for w in words for n in (4, 5, 6) if len(w) > n]
            z = bias + math.fsum(weights[xxhash.xxh32_intdigest(h) >> 14] for h in hashed)
            p = 1 / (1 + math.exp(-max(-30, min(30, z))))
            clean *= 1 - p
            if p >= 0.5:
                spans.append((a, b))
        return 1 - clean, spans

    got = {r["doc_id"]: r for r in toxicity.toxicity(rows, (weights, bias)).collect()}
    by_id = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert toxicity.toxicity(rows, (weights, bias)).count() == len(texts)
    for i, text in by_id.items():
        score, spans = plain(text)
        assert abs(got[i]["score"] - score) < 1e-9 and [(s["start"], s["end"]) for s in got[i]["offending"]] == spans
    assert any(r["offending"] for r in got.values())
    assert toxicity.toxicity(rows.limit(0), (weights, bias)).count() == 0


def test_sentences_cover_all_letters_once():
    rng = random.Random(4)
    for text in [*ODD, *(prose(rng, 200) for _ in range(20))]:
        last = 0
        for a, b, _ in toxicity.sentences(text):
            assert last <= a < b <= len(text) and not any(c.isalpha() for c in text[last:a])
            last = b
        assert not any(c.isalpha() for c in (text or "")[last:])


def test_quality_is_a_plain_loop_over_its_model(spark):
    rng = random.Random(5)
    model = quality.fit(*labelled(spark, rng))
    (w, ratio), bias, scale, shift = model
    texts = [*ODD, *(prose(rng, rng.randint(1, 300)) + rng.choice(["", " MORON moron 12 !!"]) for _ in range(60))]
    texts.append(texts[-1])
    rows = docs(spark, texts, [*range(len(texts) - 3), None, len(texts), len(texts)])

    def slot(*values):
        x = len(values) * 0x51ED270B
        for v in values:
            x = ((x ^ v) * 0x9E3779B97F4A7C15) % 2**64
            x ^= x >> 29
        return (x * 0xD6E8FEB86659FD93) % 2**64 >> 46

    def plain(text):
        tokens = quality._TOKEN.findall(text or "")
        word = [xxhash.xxh32_intdigest(t.lower()) for t in tokens]
        shape = [7 if i and word[i] == word[i - 1] else quality._shape(t) for i, t in enumerate(tokens)]
        grams = {slot(a) for a in word} | {slot(a, b) for a, b in zip(word, word[1:])}
        for n in range(3):
            grams |= {slot(97 + n, *shape[i : i + n + 1]) for i in range(len(shape) - n)}
        margin = math.fsum(w[g] * ratio[g] for g in grams) / max(1e-9, math.sqrt(math.fsum(ratio[g] ** 2 for g in grams))) + bias
        return 1 / (1 + math.exp(-max(-30, min(30, scale * margin + shift))))

    got = {r["doc_id"]: r["score"] for r in quality.quality(rows, model).collect()}
    for r in rows.collect():
        assert abs(got[r["doc_id"]] - plain(r["text"])) < 1e-9
    assert got[0] == got[1] and quality.quality(rows, model).count() == len(texts)
    assert quality.quality(rows.limit(0), model).count() == 0


def test_dual_descent_reaches_the_optimum():
    """No step away from the result, nor a long plain subgradient descent, makes the hinge loss smaller."""
    rng = np.random.default_rng(1)
    n, d = 60, 12
    rows = [np.sort(rng.choice(d, 5, replace=False)) for _ in range(n)]
    values = [rng.normal(size=5) for _ in range(n)]
    x = np.zeros((n, d))
    for i in range(n):
        x[i, rows[i]] = values[i]
    y = np.where(x @ rng.normal(size=d) + rng.normal(size=n) > 0, 1.0, -1.0)
    c = np.where(y > 0, 0.7, 1.3)

    def loss(w, b):
        return (w @ w + b * b) / 2 + (c * np.maximum(0, 1 - y * (x @ w + b))).sum()

    w, b = quality._dual_descent(rows, values, y, c, 2000, 7)
    assert not w[d:].any()
    w = w[:d]
    best = loss(w, b)
    for size in (1e-3, 1e-2, 0.1, 1.0):
        for _ in range(50):
            assert loss(w + size * rng.normal(size=d), b + size * rng.normal()) > best - 1e-2 * size
    u, v, least = np.zeros(d), 0.0, np.inf
    for t in range(1, 20_000):
        on = c * y * (y * (x @ u + v) < 1)
        u, v = u - (u - on @ x) / t, v - (v - on.sum()) / t
        least = min(least, loss(u, v))
    assert best < least + 0.01 * abs(least)


def test_language_is_the_smallest_of_plain_encodings(spark):
    rng = random.Random(6)
    alphabets = {"aa": "abcdefgh", "bb": "abcdefzy", "cc": "klmnopqr"}
    train = [(i, prose(rng, rng.randint(5, 400), alphabets[lang]), lang) for i, lang in enumerate(rng.choice(list(alphabets)) for _ in range(90))]
    rows = spark.createDataFrame([*train, train[0], (None, "klm", "aa"), (500, None, "aa"), (501, "lmn", None), (502, "12", "bb")], "doc_id long, text string, lang string")
    dicts = langid.dictionaries(rows)
    assert dicts == langid.dictionaries(rows.repartition(5)) and [lang for lang, _ in dicts] == sorted(alphabets)
    for lang, raw in dicts:
        own = [t for _, t, of in train if of == lang]
        # every text gives one stretch of its own, the whole of it where it is short
        assert len(raw) <= langid.DICT_BYTES and all(langid.letters(t) in raw for t in own if len(t) <= langid.STRETCH)
        assert raw.count(b" ") >= sum(min(len(t), langid.STRETCH) for t in own) // 10

    def size(raw, text):
        out = 0
        for i in range(0, len(text), 4096):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out += len(zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False).compress(text[i : i + 4096]))
        return out

    texts = [*ODD, *(prose(rng, rng.randint(1, 2000), rng.choice(list(alphabets.values()))) for _ in range(40))]
    texts.append(texts[-1])
    asked = docs(spark, texts, [*range(len(texts) - 3), None, len(texts), len(texts)])
    got = langid.identify(asked, dicts).collect()
    assert len(got) == len(texts)
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["rejected"]) == ("und", True)
            continue
        text = langid.letters(r["text"])
        cut = lambda raw: [raw[i * len(raw) // 8 : (i + 1) * len(raw) // 8] for i in range(8)] if len(text) <= 200 else [raw]
        sizes = [np.mean([size(part, text) for part in cut(raw)]) for _, raw in dicts]
        assert r["lang_pred"] == dicts[int(np.argmin(sizes))][0]
        gap = sorted(sizes)[1] - min(sizes)
        assert r["rejected"] == (gap < langid.MARGIN_BYTES or gap < langid.MARGIN * min(sizes)) and 0 <= r["lang_score"] <= 1
    assert langid.identify(asked.limit(0), dicts).count() == 0 and langid.identify(asked, []).where("lang_pred = 'und'").count() == len(texts)


def test_held_out_documents_are_told_apart(spark):
    rng = random.Random(8)
    alphabets = {"aa": "abcdefgh", "bb": "abcdefzy", "cc": "klmnopqr"}
    # languages of 300 words each: in random letters there is nothing that a dictionary could spell shorter
    vocabulary = {lang: prose(rng, 300, letters).split() for lang, letters in alphabets.items()}
    made = [(i, " ".join(rng.choices(vocabulary[lang], k=rng.randint(20, 200))), lang) for i, lang in enumerate(rng.choice(list(alphabets)) for _ in range(240))]
    rows = spark.createDataFrame(made, "doc_id long, text string, lang string")
    found = langid.identify(rows.where("doc_id >= 120"), langid.dictionaries(rows.where("doc_id < 120"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
    texts, y = labelled(spark, rng, 300)
    seen, late = y.where("doc_id < 200"), {r["doc_id"]: r["y"] for r in y.where("doc_id >= 200").collect()}
    for scored in (toxicity.toxicity(texts, toxicity.fit(texts, seen)), quality.quality(texts, quality.fit(texts, seen))):
        score = {r["doc_id"]: r["score"] for r in scored.collect()}
        pairs = [(score[i], score[j]) for i in late for j in late if late[i] and not late[j]]
        assert sum(a > b for a, b in pairs) >= 0.95 * len(pairs)
