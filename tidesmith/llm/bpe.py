"""Byte-pair encoding by speculation: the longest tokens are proposed, adjacent pairs are verified, failing words alone are merged."""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesmith.llm.common import portions, table, worker_cache
from tidesmith.llm.packing import _PLAIN, default_tokenizer

#: Pieces of text whose ids a worker keeps in each of two generations, and the longest one that it keeps.
KEPT, LONGEST_KEPT = 160_000, 32
#: Bytes of text whose words a worker holds at a time.
PORTION = 2 << 20
#: Longer words are merged by a heap.
_SHORT = 64
_NEVER = 1 << 40
#: Words of texts of plain characters (see packing), as the file cuts them.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|(?:[^\\w\\s]|_)+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Merges:
    """The merges of a vocabulary as arrays over token ids, and the two checks that make a proposal certain.

    A token is made by one merge of rank[t] out of left[t] and right[t]; single bytes have rank -1. Tokens of single bytes are 512: each
    byte inside a word, and each one that ends it.
    """

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], end: str):
        letters = byte_letters()
        self.size = max(vocab.values()) + 1
        self.bytes_ = [vocab[c] for c in letters] + [vocab[c + end] for c in letters]
        self.rank, self.left, self.right = np.full(self.size, -1), np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        spelt: list[tuple[bytes, bool] | None] = [None] * self.size
        for i, t in enumerate(self.bytes_):
            spelt[t] = (bytes([i % 256]), i >= 256)
        rows = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        made: set[int] = set()
        sure = np.ones(self.size, bool)
        for rank, (a, b, t) in enumerate(rows.tolist()):
            # a token of two merges, or made before its parts, is beyond the checks: words with it are merged
            sure[t] &= t not in made and self.rank[a] < rank and self.rank[b] < rank and spelt[a] is not None and spelt[b] is not None
            made.add(t)
            self.rank[t], self.left[t], self.right[t] = rank, a, b
            if spelt[a] and spelt[b]:
                spelt[t] = (spelt[a][0] + spelt[b][0], spelt[b][1])
        key = rows[:, 0] * self.size + rows[:, 1]
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order
        self.pairs, self.made = {(a, b): rank for rank, (a, b, _) in enumerate(rows.tolist())}, rows[:, 2].tolist()
        self.inside = {s[0]: t for t, s in enumerate(spelt) if s and not s[1]}
        self.final = {s[0]: t for t, s in enumerate(spelt) if s and s[1]}
        self.longest = max(map(len, self.inside))
        t = rows[:, 2]
        sure[t] &= self.compatible(rows[:, 0], rows[:, 1], 2 * self.rank[t])
        for a, b, t in rows.tolist():
            sure[t] &= sure[a] and sure[b]
        self.sure = sure

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging in order of ranks leaves the border between tokens a and b alone, for arrays of neighbours.

        Backwards in time: of the two tokens at the border the one made later is undone, and what then stands at the border must not be
        a merge that comes before that. Of merges of one rank the left one comes first, so a border loses ties on its right side only.
        """
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        until = np.full(len(a), 2 * _NEVER) if limit is None else limit.copy()
        x, y = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            bad = 2 * self.pair_rank(x, y) < until
            ok[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[on], x[on], y[on], rx[on], ry[on]
            undo = rx > ry
            until = np.where(undo, 2 * rx, 2 * ry + 1)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def propose(self, word: bytes) -> list[int]:
        """The longest token that the rest of the word begins with, again and again."""
        inside, final, n, out, i = self.inside, self.final, len(word), [], 0
        while True:
            t = final.get(word[i:])
            if t is not None:
                out.append(t)
                return out
            for k in range(min(n - 1, i + self.longest), i, -1):
                t = inside.get(word[i:k])
                if t is not None:
                    out.append(t)
                    i = k
                    break

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word by the merges themselves: always the lowest rank, of equal ones the leftmost."""
        ids = [*map(self.bytes_.__getitem__, word[:-1]), self.bytes_[256 + word[-1]]]
        return self._merge_long(ids) if len(ids) > _SHORT else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, made = self.pairs.get, self.made
        ranks = [get(p, _NEVER) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < _NEVER:
            i = ranks.index(low)
            ids[i] = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap, for words of any length."""
        n, made = len(ids), self.made
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        get = self.pairs.get
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (rank := get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (rank, p, ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def encode(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """(ids of each word, how many of them had to be merged): all words are proposed, all their borders checked at once."""
        found = [self.propose(w) for w in words]
        flat = np.fromiter((t for f in found for t in f), np.int64)
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        bad = np.zeros(len(found), bool)
        bad[owner[~self.sure[flat]]] = True
        meet = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(flat[meet] * self.size + flat[meet + 1], return_inverse=True)
        bad[owner[meet[~self.compatible(pairs // self.size, pairs % self.size)[where]]]] = True
        for i in np.flatnonzero(bad).tolist():
            found[i] = self.merge(words[i])
        return found, int(bad.sum())


class Encoder:
    """ids of whole texts, as little-endian 32-bit bytes. Texts are normalised and cut into words as the file says; words are then encoded by Merges.

    Only files of one form are taken, others raise ValueError: byte-level BPE with marked word ends, white space dropped, special tokens that
    stand for themselves in the raw text, no decoder.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        form = json.loads(self.library.to_str())
        model, added = form["model"], form["added_tokens"]
        steps = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        split = [(x["type"], x.get("behavior"), x.get("use_regex")) for x in (form["pre_tokenizer"] or {}).get("pretokenizers", [])]
        plain = not any(model[x] for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        alone = all(not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"]) for x in added)
        if not (plain and alone and model["end_of_word_suffix"] and form["decoder"] is None and steps == ["NFC", "Replace", "Lowercase"] and split == [("Split", "Removed", None), ("ByteLevel", None, False)]):
            raise ValueError(f"{path} is not a tokenizer of the form that is encoded here")
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = {x["content"]: x["id"] for x in added}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words = self.merged = 0

    def _chunks(self, text: str) -> list[str]:
        """Pieces between blanks of the normalised text; special tokens are pieces of their own, behind a NUL."""
        if self.marks and "<|" in text:
            return [c for i, part in enumerate(self.marks.split(text)) for c in (["\0" + part] if i % 2 else self._chunks_of(part))]
        return self._chunks_of(text)

    def _chunks_of(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            return text.lower().split()
        return [c for c in self.library.normalizer.normalize_str(text).split(" ") if c]

    def _learn(self, new: list[str]) -> None:
        cut, distinct = [], {}
        for chunk in new:
            if chunk[0] == "\0" and chunk[1:] in self.special:
                cut.append(None)
                continue
            raw = _WORD.findall(chunk) if _PLAIN.fullmatch(chunk) else [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
            words = [w.encode() for w in raw]
            cut.append(words)
            for w in words:
                distinct[w] = None
        found, merged = self.merges.encode(list(distinct))
        self.words, self.merged = self.words + len(distinct), self.merged + merged
        raw = {w: struct.pack(f"<{len(ids)}I", *ids) for w, ids in zip(distinct, found)}
        for chunk, words in zip(new, cut):
            self.seen[chunk] = struct.pack("<I", self.special[chunk[1:]]) if words is None else raw[words[0]] if len(words) == 1 else b"".join(map(raw.__getitem__, words))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        chunks = [self._chunks(t) if t else [] for t in texts]
        new = set().union(*chunks).difference(self.seen)
        again = new.intersection(self.older)  # what was met in the last generation lives on in this one
        self.seen.update(zip(again, map(self.older.__getitem__, again)))
        new -= again
        if new:
            self._learn(list(new))
        of = self.seen.__getitem__
        out = [b"".join(map(of, c)) for c in chunks]
        for chunk in new:
            if len(chunk) > LONGEST_KEPT:
                del self.seen[chunk]
        if len(self.seen) > KEPT:
            self.seen, self.older = {}, self.seen
        return out


def spellings(path: str) -> pa.Array:
    """The tokens of a file in the order of their ids, special ones too; null where an id has none."""
    with open(path, encoding="utf-8") as file:
        form = json.load(file)
    if form["decoder"] is not None:
        raise ValueError(f"{path} has a decoder, which is not carried out here")
    every = form["model"]["vocab"] | {x["content"]: x["id"] for x in form["added_tokens"]}
    tokens: list[str | None] = [None] * (max(every.values()) + 1)
    for t, i in every.items():
        tokens[i] = t
    return pa.array(tokens, pa.string())


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    kept = worker_cache("encoders")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>) of docs (doc_id, text, ...), row by row: nothing moves.

    Null and empty text, and text of white space alone, have no ids. Rows of null doc_id and repeated rows are encoded like any other;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        for part in portions(batches, "text", PORTION):
            raw = ids_of(part.column("text").to_pylist())
            offsets = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids array<int>): tokens as the vocabulary spells them, special ones too, joined by blanks.

    Ids that no token has, and nulls, are passed over; no ids, or null, give empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = spellings(tokenizer)
        for part in portions(batches, "ids", PORTION):
            ids = part.column("ids")
            parents, flat = pc.list_parent_indices(ids), pc.list_flatten(ids)
            known = pc.and_(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), pc.is_valid(flat))
            parents, flat = parents.filter(known), tokens.take(flat.filter(known))
            parents, flat = parents.filter(flat.is_valid()), flat.drop_null()
            offsets = np.searchsorted(parents.to_numpy(), np.arange(len(ids) + 1)).astype(np.int32)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat), " ")
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), ids, text], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_tokenizer()
    done = decode(encode(table(spark, sf_dir, "documents"), path), path)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))
