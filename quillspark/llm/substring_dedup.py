"""Removal of repeated byte strings, by suffix arrays over candidate contexts.

A string of ``length`` bytes has a content-defined anchor: the place of the
least ``GRAM``-byte hash in it. Equal strings have equal anchors at equal
offsets, so only contexts with the same anchor hash can share one; a
context is the stretch of all strings that one anchor stands for.

1. Each document gives its contexts: anchor hash, digest, place. Contexts whose
   anchor hash occurs once are done.
2. Contexts with one digest are copies; they are repeated as a whole, and one
   of them stands for all.
3. Distinct contexts with one anchor hash meet in a shard, at most
   ``per_shard`` of them (larger groups are dealt over several shards).
   A shard's suffix array comes from Larsson-Sadakane refinement, its common
   prefixes from Kasai's recurrence run over all contexts side by side. Suffixes
   with a common prefix of ``length`` or more are repeats if they lie at
   two places or more of the input.
4. Of dealt groups, the shards' sorted distinct strings (as digests) are merged
   by binary search, to find repeats across shards.
5. Marked ranges go back to the documents.

Only contexts that differ from all others of their anchor travel as text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, mix64, odd_multipliers, ranges, slices, texts

GRAM, SEED = 128, 20_240_307
#: Shared stretches of more words are reported, however few bytes they have.
WORDS = 50
RANGES = "array<struct<start:int,n:int>>"


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each ``gram``-byte string (a power of two), by doubling."""
    h = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(SEED))[data]
    mult, m, k = odd_multipliers(32, SEED), 1, 0
    while m < gram:
        h = h[:-m] * mult[k] + h[m:]
        m, k = 2 * m, k + 1
    return mix64(h)


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive keys: block prefixes against block suffixes."""
    n = len(keys) - w + 1
    pad = np.full(-len(keys) % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([keys, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(doc, start, n, rel, hash): runs of ``n`` string starts with one anchor, which
    lies ``rel`` bytes after the first. ``data`` holds the documents one after another."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    ok = size >= length
    if not ok.any():
        return none
    h = gram_hashes(data, gram)
    keys = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    at = (window_minima(keys, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    n_starts = np.where(ok, size - length + 1, 0)
    starts = ranges(begin, n_starts)
    doc = np.repeat(np.arange(len(size)), n_starts)
    a = at[starts]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])))
    n = np.diff(np.append(first, len(starts)))
    s = starts[first]
    return doc[first], s - begin[doc[first]], n, a[first] - s, h[a[first]]


def _contexts(length: int, gram: int):
    def run(batches):
        for b in batches:
            ids, tags, raw = b.column(0), b.column(1), b.column(2).cast(pa.binary())
            for x, y in slices(pa.compute.binary_length(raw).to_pylist(), 1_200_000):
                docs = raw.slice(x, y - x).to_pylist()
                parts = [docs] if sum(map(len, docs)) < 1 << 23 else None
                if parts is None:  # one very long text: in pieces that share all strings at their borders
                    (t,) = docs
                    step = 1 << 22
                    offs = list(range(0, max(1, len(t) - length + 1), step))
                    found = [anchors(np.frombuffer(t[o : o + step + length - 1], np.uint8), np.array([0]), np.array([len(t[o : o + step + length - 1])]), length, gram) for o in offs]
                    doc, start, n, rel, h = (np.concatenate(c) for c in zip(*[(f[0], f[1] + o, f[2], f[3], f[4]) for f, o in zip(found, offs)]))
                else:
                    size = np.array([len(t) for t in docs], np.int64)
                    doc, start, n, rel, h = anchors(np.frombuffer(b"".join(docs), np.uint8), np.cumsum(size) - size, size, length, gram)
                digest = [
                    hashlib.blake2b(docs[d][s : s + k + length - 1], digest_size=16, salt=r.to_bytes(4, "little")).digest()
                    for d, s, k, r in zip(doc.tolist(), start.tolist(), n.tolist(), rel.tolist())
                ]
                d = pa.array(doc + x)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(d), tags.take(d), pa.array(h.view(np.int64)), pa.array(digest, pa.binary()), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["doc_id", "tag", "h", "c", "start", "n"],
                )

    return run


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffixes' starts in order.

    Larsson-Sadakane: the first round sorts by eight bytes; each further one
    doubles the compared length, and sorts only groups that are still tied by
    the ranks that lie ``h`` bytes on.
    """
    n = len(data)
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word |= pad[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    sa = np.argsort(word)
    w = word[sa]
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    del w, word, pad
    rank = np.full(n + 1, -1, np.int64)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
    # a suffix shorter than eight bytes differs from one that goes on with zero bytes
    h = 8 if not (data[max(0, n - 8) :] == 0).any() else 1
    if h == 1:
        sa = np.argsort(data, kind="stable")
        w = data[sa]
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
    while True:
        place = rank[sa]
        size = np.diff(np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), n))
        idx = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(idx):
            break
        suffix = sa[idx]
        key = rank[suffix] * (n + 1) + rank[np.minimum(suffix + h, n)] + 1
        order = np.argsort(key)
        sa[idx] = suffix = suffix[order]
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        rank[suffix] = np.repeat(idx[new], np.diff(np.append(np.flatnonzero(new), len(idx))))
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Of each place in the suffix array, the common prefix with the place before, up to ``most``.

    Kasai: walking a stretch from left to right, the value falls by one at
    most. All stretches (begin, size) are walked side by side.
    """
    n = len(data)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    text = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word |= text[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, np.int32)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    h = np.zeros(len(begin), np.int64)
    for t in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -t))  # sizes fall: the first ones are longer than t
        i = begin[:live] + t
        p = place[i]
        j = sa[np.maximum(p - 1, 0)]
        g = np.maximum(h[:live] - 1, 0)
        todo = np.flatnonzero((p > 0) & (g < most))
        g[p == 0] = 0
        while len(todo):
            a, b = i[todo] + g[todo], j[todo] + g[todo]
            inside = np.maximum(a, b) < n
            x = word[np.minimum(a, n - 1)] ^ word[np.minimum(b, n - 1)]
            # bytes that agree from here on: the lowest set bit's byte, eight if none
            low = x & (~x + np.uint64(1))
            step = np.where(x == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
            step = np.where(inside, np.minimum(step, n - np.maximum(a, b)), 0)
            g[todo] += step
            todo = todo[(step == 8) & (g[todo] < most)]
        h[:live] = np.minimum(g, most)
        out[p] = h[:live]
    return out


def shared_passages(data: np.ndarray, sa: np.ndarray, lcp: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, words: int) -> np.ndarray:
    """Whether each context has a common stretch of over ``words`` words with a neighbour in the suffix array of another document."""
    near = np.flatnonzero(lcp >= 2 * words)
    near = near[near > 0]
    a, b = sa[near - 1], sa[near]
    of_a, of_b = np.searchsorted(begin, a, "right") - 1, np.searchsorted(begin, b, "right") - 1
    n = np.minimum(lcp[near], np.minimum(begin[of_a] + size[of_a] - a, begin[of_b] + size[of_b] - b))
    blank = np.concatenate([[0], np.cumsum((data == 32) | (data - np.uint8(9) < 5))])
    ok = (doc[of_a] != doc[of_b]) & (blank[b + n] - blank[b] >= words)
    out = np.zeros(len(begin), bool)
    out[of_a[ok]] = out[of_b[ok]] = True
    return out


def shard_repeats(texts_: list[bytes], counts: np.ndarray, copies: np.ndarray, where: np.ndarray, length: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(repeated, class, starts) over all string starts of the contexts, in order; and of each context, whether it has a shared passage.

    Context i has ``counts[i]`` starts, stands for ``copies[i]`` places, and
    its first start has the absolute number ``where[i]``: its document's number in the upper half.
    """
    size = np.array([len(t) for t in texts_], np.int64)
    data = np.frombuffer(b"".join(texts_), np.uint8)
    begin = np.cumsum(size) - size
    sa = suffix_array(data)
    lcp = common_prefixes(data, sa, begin, size, length)
    passage = shared_passages(data, sa, lcp, begin, size, where >> 32, words)
    cls_of = np.empty(len(data), np.int64)
    cls_of[sa] = np.cumsum(lcp < length)
    starts = ranges(begin, counts)
    cls = np.unique(cls_of[starts], return_inverse=True)[1]
    absolute = ranges(where, counts)
    many = np.zeros(cls.max() + 1 if len(cls) else 0, bool)
    many[cls[np.repeat(copies, counts) > 1]] = True
    lo, hi = np.full(len(many), np.iinfo(np.int64).max), np.full(len(many), -1)
    np.minimum.at(lo, cls, absolute)
    np.maximum.at(hi, cls, absolute)
    many |= lo < hi
    return many[cls], cls, starts, passage


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]


def _cut_out(length: int):
    """The text of each context asked for."""

    def run(batches):
        for b in batches:
            for x, y in slices(pa.compute.binary_length(b.column("text").cast(pa.binary())).to_pylist(), 4_000_000):
                rows = {k: [] for k in ("h", "c", "salt", "salts", "copies", "n", "doc", "start", "ctx")}
                for i in range(x, y):
                    text = b.column("text")[i].as_py().encode()
                    doc = hashlib.blake2b(repr((b.column("doc_id")[i].as_py(), b.column("tag")[i].as_py())).encode(), digest_size=8).digest()
                    for w in b.column("want")[i].as_py():
                        for k in ("h", "c", "salt", "salts", "copies", "n", "start"):
                            rows[k].append(w[k])
                        rows["doc"].append(int.from_bytes(doc, "little", signed=True))
                        rows["ctx"].append(text[w["start"] : w["start"] + w["n"] + length - 1])
                kinds = {"h": pa.int64(), "c": pa.binary(), "salt": pa.int32(), "salts": pa.int32(), "copies": pa.int64(), "n": pa.int32(), "doc": pa.int64(), "start": pa.int32(), "ctx": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(rows[k], kinds[k]) for k in rows], list(rows))

    return run


def _sharded(length: int, most_bytes: int = 1_000_000):
    """Repeats within each shard of contexts; the input comes sorted by (h, salt)."""

    def solve(rows: list[dict]):
        counts = np.array([r["n"] for r in rows], np.int64)
        copies = np.array([r["copies"] for r in rows], np.int64)
        docs = {d: k for k, d in enumerate(dict.fromkeys(r["doc"] for r in rows))}
        where = np.array([docs[r["doc"]] * (1 << 32) + r["start"] for r in rows], np.int64)
        seen, cls, _, passage = shard_repeats([r["ctx"] for r in rows], counts, copies, where, length)
        ends = np.cumsum(counts)
        out_h, out_c, out_r, out_d, out_o, out_p = [], [], [], [], [], []
        sent: set[int] = set()
        for k, r in enumerate(rows):
            a, b = int(ends[k] - counts[k]), int(ends[k])
            runs = _runs(seen[a:b])
            if runs or passage[k]:
                out_h.append(r["h"]), out_c.append(r["c"]), out_r.append(runs), out_d.append(None), out_o.append(None), out_p.append(bool(passage[k]))
            if r["salts"] > 1:  # one digest of each distinct string, for the merge across shards
                for o in range(b - a):
                    q = int(cls[a + o])
                    if q not in sent:
                        sent.add(q)
                        out_h.append(r["h"]), out_c.append(r["c"]), out_r.append(None), out_o.append(-1 if seen[a + o] else o), out_p.append(None)
                        out_d.append(hashlib.blake2b(r["ctx"][o : o + length], digest_size=16).digest())
        return pa.RecordBatch.from_arrays(
            [pa.array(out_h, pa.int64()), pa.array(out_c, pa.binary()), pa.array(out_r, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))), pa.array(out_d, pa.binary()), pa.array(out_o, pa.int32()), pa.array(out_p, pa.bool_())],
            ["h", "c", "runs", "d", "o", "p"],
        )

    def run(batches):
        held, size, key = [], 0, None
        for b in batches:
            for r in b.to_pylist():
                if size > most_bytes and (r["h"], r["salt"]) != key:
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["ctx"])
                key = (r["h"], r["salt"])
        if held:
            yield solve(held)

    return run


def _merged(batches):
    """Strings of several shards: the input comes sorted by digest; a binary search
    over the digests finds each one's first and last place."""

    def pairs(h, c, d, o):
        d = np.array(d, "S32")
        many = np.searchsorted(d, d, "right") - np.searchsorted(d, d, "left") > 1
        k = np.flatnonzero(many & (np.array(o) >= 0)).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([h[i] for i in k], pa.int64()), pa.array([c[i] for i in k], pa.binary()), pa.array([[{"start": o[i], "n": 1}] for i in k], pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))],
            ["h", "c", "runs"],
        )

    h, c, d, o = [], [], [], []
    for b in batches:
        for acc, name in ((h, "h"), (c, "c"), (d, "hex"), (o, "o")):
            acc.extend(b.column(name).to_pylist())
        last = next((i for i in range(len(d) - 1, -1, -1) if d[i] != d[-1]), -1) + 1  # the last digest may go on
        if last:
            yield pairs(h[:last], c[:last], d[:last], o[:last])
            h, c, d, o = h[last:], c[last:], d[last:], o[last:]
    if d:
        yield pairs(h, c, d, o)


def _removed(length: int):
    def run(batches):
        for b in batches:
            ids, raw, marks = b.column(0), b.column(1).cast(pa.binary()), b.column(2)
            for x, y in slices(pa.compute.binary_length(raw).to_pylist(), 8_000_000):
                n_bytes, n_removed, n_spans, kept, spans, left = [], [], [], [], [], []
                for text, runs in zip(raw.slice(x, y - x).to_pylist(), marks.slice(x, y - x).to_pylist()):
                    out: list[list[int]] = []
                    for a, z in sorted((r["start"], r["start"] + r["n"] + length - 1) for r in runs or ()):
                        if out and a <= out[-1][1]:
                            out[-1][1] = max(out[-1][1], z)
                        else:
                            out.append([a, z])
                    rest = b"".join(text[a:z] for a, z in zip([0, *(z for _, z in out)], [*(a for a, _ in out), len(text)])) if out else text
                    n_bytes.append(len(text)), n_removed.append(len(text) - len(rest)), n_spans.append(len(out)), kept.append(hashlib.sha256(rest).hexdigest())
                    left.append(rest.decode("utf-8", "replace"))
                    spans.append([{"start": a, "end": z} for a, z in out])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(x, y - x), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(left, pa.string()), b.column(3).slice(x, y - x)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text", "shares_passage"],
                )

    return run


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, per_shard: int = 2048) -> DataFrame:
    """For each row of ``docs``: n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges), text (what is left), shares_passage.

    Texts are UTF-8 bytes, null as empty. A byte goes if a ``length``-byte
    string over it starts at another place too, in this row or another one;
    repeated rows are places of their own, so they remove each other. A null
    doc_id is a key like any other. An empty table gives none. Where a cut splits a
    character, ``text`` has U+FFFD for what is left of it; the digest is of the bytes.
    Extra columns are not read, whatever their names.

    shares_passage is a by-product and removes nothing: the suffix arrays have shown a stretch of
    over ``WORDS`` words that another row's text has too, though it may be shorter than ``length``
    bytes. It sees only stretches about anchors that both texts have, so it misses some.
    """
    own = docs.select("doc_id", texts().alias("text"))
    own = own.withColumn("tag", F.md5(F.col("text").cast("binary")))
    found = cut(own.select("doc_id", "tag", "text").mapInArrow(_contexts(length, gram), "doc_id long, tag string, h long, c binary, start int, n int"), "contexts")
    # written, so that the join below is one of two shuffles, whose hot partitions Spark splits
    twice = cut(found.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("h"), "twice")
    cand = cut(found.join(twice, "h"), "candidates")
    ctx = cut(cand.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "tag", "start", "n")).alias("at")), "distinct")
    groups = cut(ctx.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("fewest")).where((F.col("kinds") > 1) & (F.col("fewest") == 1)), "groups")
    salts = F.ceil(F.col("kinds") / per_shard).cast("int")
    asked = ctx.join(groups, "h").withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int"))
    asked = asked.select("at.doc_id", "at.tag", F.struct("h", "c", "salt", "salts", "copies", "at.start", "at.n").alias("w"))
    asked = asked.groupBy("doc_id", "tag").agg(F.collect_list("w").alias("want"))
    asked = asked.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "want")
    # repeated rows would send a context twice
    text = own.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t"))).select("doc_id", "tag", "text", "want")
    shipped = text.mapInArrow(_cut_out(length), "h long, c binary, salt int, salts int, copies long, n int, doc long, start int, ctx binary")
    shards = shipped.repartition("h", "salt").sortWithinPartitions("h", "salt")
    solved = cut(shards.mapInArrow(_sharded(length), f"h long, c binary, runs {RANGES}, d binary, o int, p boolean"), "shards")
    strings = solved.where(F.col("d").isNotNull()).select("h", "c", F.hex("d").alias("hex"), "o")
    strings = strings.repartition("hex").sortWithinPartitions("hex")
    crossed = strings.mapInArrow(_merged, f"h long, c binary, runs {RANGES}")
    whole = ctx.where(F.col("copies") > 1).select("h", "c", F.array(F.struct(F.lit(0).alias("start"), F.col("at.n").alias("n"))).alias("runs"))
    single = ctx.where(F.col("copies") == 1).select("h", "c")
    no = F.lit(False).alias("p")
    part = solved.where(F.col("runs").isNotNull()).select("h", "c", "runs", "p").unionByName(crossed.select("*", no)).join(single, ["h", "c"])
    marks = whole.select("*", no).unionByName(part)
    placed = cand.select("doc_id", "tag", "h", "c", F.col("start").alias("s")).join(marks, ["h", "c"])
    moved = F.transform("runs", lambda r: F.struct((r["start"] + F.col("s")).cast("int").alias("start"), r["n"].alias("n")))
    by_doc = placed.select("doc_id", "tag", moved.alias("runs"), "p").groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.max("p").alias("p"))
    by_doc = cut(by_doc.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "runs", "p"), "marks")
    discard(found, twice, cand, ctx, groups, solved)
    out = own.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    return out.select("doc_id", "text", "runs", F.coalesce("p", F.lit(False)).alias("p")).mapInArrow(_removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, text string, shares_passage boolean")
