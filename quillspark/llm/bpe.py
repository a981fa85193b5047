"""Byte-level BPE by batched numpy merge rounds.

Texts are cut at white space into chunks whose tokens don't depend on their
neighbours; each distinct chunk of a batch is split by the pre-tokenizer's
pattern into words, and the distinct new words are merged together: their
symbols lie in one flat array, each round looks up every adjacent pair by
binary search over the sorted pair keys, and joins, in every word, the pairs
of that word's lowest rank. A pair's product only takes part in pairs of
higher rank, so joining all places of one rank at once gives the sequential
result.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ranges, slices, texts

#: The pre-tokenizer's pattern, a fixed value of the public byte-level scheme,
#: with white space spelt as a property: ``\s`` also takes U+001C to U+001F here.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
TOP = np.int64(1 << 40)
CHUNKS = r" ?\S+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class Store:
    """Runs of ids by number, in arrays that double when they are full."""

    def __init__(self):
        self.flat, self.len, self.at = np.zeros(1 << 16, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.count = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = self._room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        end = self.count + len(sizes)
        self.len, self.at = self._room(self.len, end), self._room(self.at, end)
        self.len[self.count : end] = sizes
        self.at[self.count : end] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = self.used + len(ids), end

    def take(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs ``k`` one after another, and their number in each."""
        n = self.len[k]
        return self.flat[ranges(self.at[k], n)], n


class Bpe:
    """Encoder and decoder for one tokenizer file (its JSON text)."""

    def __init__(self, spec: str, most: int = 300_000):
        import regex

        t = json.loads(spec)
        vocab, merges = t["model"]["vocab"], t["model"]["merges"]
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.special = {a["content"]: a["id"] for a in t.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        table = [b""] * self.size
        for s, i in [*vocab.items(), *self.special.items()]:
            table[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        self.byte_len = np.array([len(x) for x in table], np.int64)
        self.byte_at = np.cumsum(self.byte_len) - self.byte_len
        self.byte_flat = np.frombuffer(b"".join(table), np.uint8)
        self.first = np.array([vocab[c] for c in chars], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in merges]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.new = key[order], order.astype(np.int64), new
        self.pieces = regex.compile(PIECES).findall
        self.chunks = re.compile(CHUNKS).findall
        self.odd = re.compile("[\x1c-\x1f]").search
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.most = most
        self._reset()

    def _reset(self) -> None:
        #: Words and chunks by number, and their ids one after another.
        self.words: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.word_ids, self.chunk_ids = Store(), Store()
        for text, i in self.special.items():
            self.known[text] = len(self.known)
            self.chunk_ids.add(np.array([i]), np.array([1]))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.size + right
        i = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[i] == pair, self.rank[i], TOP)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and their number in each; all are merged in the same rounds."""
        size = np.array([len(w) for w in words], np.int64)
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        out_sym, out_word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # rank[i] is that of the pair at i and i + 1; none at a word's last symbol
        rank = np.append(self.ranks(sym[:-1], sym[1:]), TOP)
        rank[np.cumsum(size)[size > 0] - 1] = TOP
        while len(sym):
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            each = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(sym))))
            live = each < TOP
            if not live.all():  # words with no pair left are done
                out_sym.append(sym[~live]), out_word.append(word[~live])
                sym, word, rank, each = sym[live], word[live], rank[live], each[live]
                if not len(sym):
                    break
            hit = rank == each
            # of overlapping places of one pair, every other one from the left
            n = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(np.append(True, ~hit[:-1]), n, 0))
            at = np.flatnonzero(hit & ((n - run) % 2 == 0))
            sym[at] = self.new[rank[at]]
            # only pairs beside a product have a new rank
            dirty = np.zeros(len(sym), bool)
            dirty[at] = True
            dirty[np.maximum(at - 1, 0)] = True
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank, dirty = sym[keep], word[keep], rank[keep], dirty[keep]
            i = np.flatnonzero(dirty)
            j = np.minimum(i + 1, len(sym) - 1)
            rank[i] = np.where((i < j) & (word[i] == word[j]), self.ranks(sym[i], sym[j]), TOP)
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _split(self, chunk: str) -> list[str]:
        """The words of one chunk; most are letters, with a space before them or not."""
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():
            return [chunk]
        return self.pieces(chunk)

    def _learn(self, chunks: set[str]) -> None:
        chunks = list(chunks)
        cut = [self._split(c) for c in chunks]
        fresh = [w for w in dict.fromkeys(w for c in cut for w in c) if w not in self.words]
        for x, y in slices([len(w) for w in fresh], 2_000_000):
            n = len(self.words)
            self.words.update(zip(fresh[x:y], range(n, n + y - x)))
            self.word_ids.add(*self.merge([w.encode() for w in fresh[x:y]]))
        sizes = np.array([len(c) for c in cut], np.int64)
        get = self.words.__getitem__
        k = np.fromiter((i for c in cut for i in map(get, c)), np.int64, int(sizes.sum()))
        ids, n = self.word_ids.take(k)
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.chunk_ids.add(ids, np.add.reduceat(n, np.cumsum(sizes) - sizes) if len(n) else n)

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.most:
            self._reset()
        cut = []
        for text in batch:
            parts = self.split(text) if self.split else [text]
            got: list[str] = []
            for p in parts:
                if p in self.special:
                    got.append(p)
                elif p:
                    got.extend(self.pieces(p) if self.odd(p) else self.chunks(p))
            cut.append(got)
        fresh = set().union(*cut) - self.known.keys()
        if fresh:
            self._learn(fresh)
        n = np.array([len(c) for c in cut], np.int64)
        get = self.known.__getitem__
        k = np.fromiter(map(get, chain.from_iterable(cut)), np.int64, int(n.sum()))
        ids, each = self.chunk_ids.take(k)
        sizes = np.concatenate([[0], np.cumsum(each)])[np.cumsum(n)]
        return [ids[a:b] for a, b in zip([0, *sizes.tolist()], sizes.tolist())]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.byte_flat[ranges(self.byte_at[ids], self.byte_len[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _round_trip(spec: str, with_ids: bool, with_text: bool):
    def run(batches):
        bpe = Bpe(spec)
        for b in batches:
            keys, raw = b.column(0), b.column(1)
            for x, y in slices(pa.compute.binary_length(raw).to_pylist(), 1_500_000):
                n, sha, back, all_ids, all_text = [], [], [], [], []
                for ids in bpe.encode_batch(raw.slice(x, y - x).to_pylist()):
                    n.append(len(ids))
                    sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text = bpe.decode(ids)
                    back.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                    if with_text:
                        all_text.append(text)
                cols = [keys.slice(x, y - x), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.list_(pa.int32()))), names.append("ids")
                if with_text:
                    cols.append(pa.array(all_text, pa.string())), names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs``;
    on request also the ids and the decoded text.

    Special tokens' strings in a text become their ids. A null text counts as
    empty and has no tokens. Rows stay as they are, repeated or not; ids may be null
    or repeat; an empty table gives none; extra columns are not read, whatever their names.
    ``path`` is read on the driver; its content goes with the tasks.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text
    return docs.select("doc_id", texts().alias("text")).mapInArrow(_round_trip(spec, with_ids, with_text), schema)
