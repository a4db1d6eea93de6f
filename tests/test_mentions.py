"""Names in texts: all matches and the leftmost longest ones against plain loops, for one automaton and for several."""

import random
import re

import pyarrow as pa
import pytest

from tidesmith.operators import text as X

TEXTS = "doc_id long, text string"


def plain(texts, names, longest):
    out = []
    for doc, text in texts:
        own = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[a-zA-ZéÉ0-9]+", text or "")]
        hits = []
        for name in names:
            words = re.findall(r"[a-zé0-9]+", (name or "").lower())
            hits += [(i, len(words), name) for i in range(len(own) - len(words) + 1) if words and [w for _, _, w in own[i : i + len(words)]] == words]
        if longest:
            kept, free = set(), 0
            for i, k, _ in sorted(hits, key=lambda h: (h[0], -h[1])):
                if i >= free:
                    kept.add((i, k))
                    free = i + k
            hits = [h for h in hits if h[:2] in kept]
        out += [(doc, name, i, k, own[i][0], own[i + k - 1][1]) for i, k, name in hits]
    return sorted(set(out))


@pytest.mark.parametrize("most", [1 << 20, 12])
@pytest.mark.parametrize("longest", [False, True])
def test_spans(spark, most, longest):
    r = random.Random(4)
    word = lambda: r.choice(["a", "B", "ab", "é", "7", "Abc"])
    texts = [(i, "".join(word() + r.choice([" ", ". ", "\n", "-", " & "]) for _ in range(r.randint(0, 25)))) for i in range(60)] + [(70, None), (71, ""), (72, " !! "), (5, "b Ab a b ab 7")]
    names = [" ".join(word() for _ in range(r.randint(1, 4))) for _ in range(12)] + ["a & b", "A. B", "", None, "!!", "a b ab é 7 abc a b ab é"]
    df = spark.createDataFrame([(n,) for n in names + names[:2]], "name string")
    got = X.mention_spans(spark.createDataFrame(texts, TEXTS), df, longest, most)
    assert sorted(set(map(tuple, got.collect()))) == plain(texts, names, longest)
    assert {tuple(x) for x in X.mentions(spark.createDataFrame(texts, TEXTS), df, most).collect()} == {x[:2] for x in plain(texts, names, False)}


def test_long_names_and_odd_letters(spark):
    """No bound on the words of a name; places are those of the text even where lower case is longer; parts of words never match."""
    long = " ".join(f"w{i}" for i in range(40))
    texts = spark.createDataFrame([(1, f"x İİ {long.upper()}, İstanbul Bank; bankers"), (2, "bank")], TEXTS)
    names = spark.createDataFrame([(long,), ("bank",)], "name string")
    got = sorted((r["doc_id"], r["words"], r["start"], r["end"]) for r in X.mention_spans(texts, names).collect())
    text = texts.first()["text"]
    assert got == [(1, 1, text.index("Bank"), text.index("Bank") + 4), (1, 40, 5, 5 + len(long)), (2, 1, 0, 4)]
    assert X.mention_spans(texts, names.limit(0)).count() == 0 and X.mentions(texts.limit(0), names).count() == 0


@pytest.mark.parametrize("spans", [False, True])
def test_matches_are_handed_on_in_pieces(monkeypatch, spans):
    """However many matches a batch of texts has, a task holds no more than a bound and those of one text; keys of any type stay as they are, null too."""
    monkeypatch.setattr(X, "GATHERED", 50)
    keys = pa.array([None if i == 7 else {"doc_id": i, "hash": -i} for i in range(400)], pa.struct([("doc_id", pa.int64()), ("hash", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([keys, pa.array([None if i == 9 else "a b, a" for i in range(400)])], ["doc_id", "text"])
    pieces = list(X._search(["a", "b", "a b"], False, spans)(iter([batch])))
    each = 4 if spans else 3
    assert max(p.num_rows for p in pieces) < 50 + each and sum(p.num_rows for p in pieces) == 399 * each
    assert [k for p in pieces for k in p.column("doc_id").to_pylist()] == [k for i, k in enumerate(keys.to_pylist()) if i != 9 for _ in range(each)]
