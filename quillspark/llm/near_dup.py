"""Near-duplicate documents by HyperMinHash.

1. Each row's distinct five-word shingles are hashed to 64 bits. The low bits
   of a hash pick one of ``registers`` buckets; of the least remaining value
   in a bucket, the register keeps the count of leading zeros and
   ``MANTISSA`` bits after the first one. An empty bucket takes the register
   of another one, by a walk fixed for each bucket, so short texts
   fill all bands.
2. Rows with the same shingle set (128-bit digest) form a class; classes take
   the place of rows in all that follows, so thousands of copies cost no pairs.
3. ``bands`` bands of ``rows`` registers each. In each bucket of a band, every
   class is a candidate with the bucket's least class. The collision-corrected
   Jaccard estimate drops hopeless candidates; it counts equal registers
   in their last ``KEPT`` mantissa bits, packed in longs, so it is a few integer
   operations inside the join. Of the others, the best for each class is
   verified on full shingle sets.
4. Buckets whose classes are not yet in one component give the pairs across
   components, in passes by falling estimate: what the first ones link, the later
   ones need not compare. A bucket's largest component
   meets only the bucket's other classes, never itself, so a family of linked
   copies costs its size times the number of strangers in its buckets. Each pair
   leaves the join once, at the first band it shares, and only with a sufficient
   estimate. Few values fill all registers of short texts, and chance agreement
   strays: up to ``short`` shingles the last pass has a lower floor, up to ``tiny``
   none. Pairs within a component cannot change the result and are not verified.
5. Verification deals pairs into cells by the hash of one or both sides. A cell gets the
   text of each of its classes once, however many pairs it is in, so a family of N
   texts just under the threshold, whose pairs all have to be verified, moves
   about N times the square root of the number of cells, not two texts a pair.
   All links found together give the components.

What stays quadratic is the number of estimates between unlinked classes of
one bucket: no filter can tell texts at a similarity of 0.74 from those at 0.75.

A pair at a similarity of 0.75 is in no common band with a probability of
(1 - 0.75**5) ** 50 = 1.3e-6. Its estimate has a standard deviation of 0.025 for
20 shingles in the union, 0.020 for 64 and 128, 0.019 for 256 and 512, 0.016 for
1024 (simulated, 1,500 pairs each). By a Gaussian it falls under the floor that
holds for it with a probability of 4e-6 or so at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, cut, discard, mix64, odd_multipliers, slices, texts
from .graph import components

SHINGLE, SEED, MANTISSA, KEPT = 5, 20_240_229, 10, 2
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_sets(batch: list[bytes], words: WordHash) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs of bytes that are not ASCII white space, A-Z lower-cased.
    A text of fewer than five words has one shingle: all of them.
    """
    mult = odd_multipliers(SHINGLE, SEED)
    get, out = words.__getitem__, []
    for text in batch:
        ws = text.translate(LOWER).split()
        n = len(ws)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(get, ws), np.uint64, n)
        if n < SHINGLE:
            h = (h * mult[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)
        else:
            s = h[: n - SHINGLE + 1] * mult[0]
            for k in range(1, SHINGLE):
                s += h[k : n - SHINGLE + 1 + k] * mult[k]
            h = s
        out.append(np.unique(mix64(h)))
    return out


def sketch(hashes: np.ndarray, registers: int, walk: np.ndarray) -> np.ndarray:
    """The uint16 registers of one non-empty set."""
    bits = np.uint64(registers.bit_length() - 1)
    bucket = (hashes & np.uint64(registers - 1)).astype(np.int64)
    least = np.full(registers, np.iinfo(np.uint64).max, np.uint64)
    least[bucket[::-1]] = hashes[::-1] >> bits  # ascending: the last write to a bucket is its least
    full = np.zeros(registers, bool)
    full[bucket] = True
    # leading zeros by the exponent of the value, exact below 2**53: shift the rest away first
    value = np.maximum(least >> np.uint64(3), np.uint64(1))
    width = 64 - int(bits) - 3
    top = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    zeros = np.minimum(width - top, 63)
    rest = np.where(top > MANTISSA + 1, value >> np.maximum(top - MANTISSA - 1, 0).astype(np.uint64), value << np.maximum(MANTISSA + 1 - top, 0).astype(np.uint64))
    reg = ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (rest & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)
    empty = np.flatnonzero(~full)
    for step in walk:  # the first full bucket on each empty bucket's walk
        if not len(empty):
            break
        to = step[empty]
        got = full[to]
        reg[empty[got]] = reg[to[got]]
        empty = empty[~got]
    return reg


def walks(registers: int) -> np.ndarray:
    """Column i is a fixed random order of all buckets, for bucket i."""
    rng = np.random.default_rng(SEED)
    return np.ascontiguousarray(np.argsort(rng.random((registers, registers)), axis=1).T)


def packed(reg: np.ndarray) -> np.ndarray:
    """The last two mantissa bits of each register, 32 registers to a long."""
    two = (reg & np.uint16(3)).astype(np.uint64).reshape(-1, 32)
    return (two << (2 * np.arange(32, dtype=np.uint64))).sum(1, dtype=np.uint64).view(np.int64)


def estimated(a: str, b: str, longs: int) -> Column:
    """Jaccard estimate of two arrays of packed registers: the share of equal
    fields, less the quarter in which unequal minima agree by chance."""
    same = F.lit(0)
    for i in range(longs):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        off = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        same = same + 32 - F.bit_count(off)
    chance = 2.0**-KEPT
    return (same / F.lit(32.0 * longs) - chance) / (1 - chance)


def _sketched(registers: int, bands: int, rows: int):
    def run(batches):
        import hashlib

        words, walk = WordHash(), walks(registers)
        rng = np.random.default_rng(SEED + 1)
        take = np.stack([rng.choice(registers, rows, replace=False) for _ in range(bands)])
        mult = odd_multipliers(rows, SEED + 2)
        salt = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(SEED))
        for b in batches:
            ids, rows_, texts_ = b.column(0), b.column(1), b.column(2).cast(pa.binary())
            sizes = pa.compute.binary_length(texts_).to_pylist()
            for x, y in slices(sizes, 4_000_000):
                sets = shingle_sets(texts_.slice(x, y - x).to_pylist(), words)
                n, digest, bits, band = [], [], [], []
                for s in sets:
                    n.append(len(s))
                    if not len(s):
                        digest.append(None), bits.append(None), band.append(None)
                        continue
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    r = sketch(s, registers, walk)
                    bits.append(packed(r))
                    band.append(mix64((r[take].astype(np.uint64) * mult).sum(1, dtype=np.uint64) ^ salt).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(x, y - x), rows_.slice(x, y - x), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(band, pa.list_(pa.int64()))],
                    ["doc_id", "row", "n_shingles", "digest", "bits", "bands"],
                )

    return run


def _verified(percent: int):
    """Keeps the pairs whose full shingle sets are similar. The input comes sorted by cell, texts before pairs."""

    def run(batches):
        words = WordHash()
        cell, sets, good = None, {}, []

        def links(pairs: dict):
            for a, others in pairs.items():
                s = sets[a]
                n = np.array([len(sets[b]) for b in others])
                for x, y in slices(n.tolist(), 2_000_000):
                    every = np.concatenate([sets[b] for b in others[x:y]])
                    same = s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every
                    both = np.add.reduceat(same, np.cumsum(n[x:y]) - n[x:y], dtype=np.int64)
                    ok = 100 * both >= percent * (len(s) + n[x:y] - both)
                    good.extend((a, others[x + i]) for i in np.flatnonzero(ok).tolist())

        for batch in batches:
            good.clear()
            pairs: dict = {}
            for x in range(0, batch.num_rows, 256):
                part = batch.slice(x, 256)
                columns = [part.column(k).to_pylist() for k in ("cell", "a", "b", "text")]
                for at, a, b, text in zip(*columns):
                    if at != cell:
                        links(pairs)
                        pairs, sets, cell = {}, {}, at
                    if text is not None:
                        (sets[a],) = shingle_sets([text.encode()], words)
                    else:
                        pairs.setdefault(a, []).append(b)
            links(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.binary()), pa.array([g[1] for g in good], pa.binary())], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    registers: int = 1024,
    bands: int = 50,
    rows: int = 5,
    passes: tuple[float, ...] = (0.76, 0.72, 0.677),
    tiny: int = 32,
    short: int = 900,
    short_floor: float = 0.65,
    cell_shingles: int = 2_000_000,
    row: str | None = None,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    component_id is the least doc_id of the rows reachable by links. A row
    without words has no shingles and is its own component. Repeated rows
    share a component and a verdict. A null doc_id gets the least id of its
    component, null if none has one. An empty table gives none. Extra columns are
    not read, whatever their names. Where ``row`` names a column of longs that tells apart the
    rows of one id by their text at least, it is returned too, with first: whether
    this is the row of its component that has the least doc_id, and of these the least
    ``row`` (nulls come last). Rows equal in both, and rows without words, are all first.
    """
    longs, floor = registers // 32, passes[-1]
    # rows with one id and one text stand for each other
    own = docs.select("doc_id", (F.col(row) if row else F.xxhash64(texts())).alias("row"), texts().alias("text"))
    sk = cut(
        own.mapInArrow(_sketched(registers, bands, rows), "doc_id long, row long, n_shingles long, digest binary, bits array<long>, bands array<long>"),
        "sketch",
    )
    some = sk.where(F.col("digest").isNotNull())
    first = lambda c: F.first(c).alias(c)  # noqa: E731  the same in all rows of a class
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = cut(some.groupBy("digest").agg(F.min(key).alias("rep"), F.max("n_shingles").alias("n"), first("bits"), first("bands")), "classes")
    keyed = classes.select("digest", F.explode("bands").alias("key"))
    shared = cut(
        keyed.groupBy("key").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where(F.col("least") < F.col("most")).select("key", "least"),
        "buckets",
    )
    members = cut(keyed.join(shared, "key").select("key", "digest", "least"), "members")
    discard(shared)
    # the text of one row of each class that shares a bucket
    asked = cut(members.select("digest").distinct().join(classes.select("digest", "rep"), "digest").select("digest", F.col("rep.doc_id").alias("d"), F.col("rep.row").alias("r")), "asked")
    # the sides of these joins grow with the input; a broadcast at small sizes would only hide that
    found = own.join(asked.hint("merge"), (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))
    whole = cut(found.groupBy("digest").agg(F.first("text").alias("text")), "texts")
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    side = lambda x: classes.select(F.col("digest").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links. Their number follows from the estimate; texts come only for them.

        size is the pair's number of shingles, so a cell's sets have ``cell_shingles`` or so at most.
        Few pairs a class are dealt by one side, so that most texts travel once; many by both.
        """
        pairs = cut(pairs.select("a", "b", "size"), "pairs")
        count, total, firsts, seconds = pairs.agg(F.count(F.lit(1)), F.sum("size"), F.approx_count_distinct("a"), F.approx_count_distinct("b")).first()
        cells = max(1, math.ceil((total or 0) / cell_shingles))
        n = math.ceil(math.sqrt(cells))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        cell = part("a", cells) if firsts + count <= (firsts + seconds) * n else part("a", n) * n + part("b", n)
        placed = pairs.select(cell.alias("cell"), "a", "b")
        need = placed.select("cell", F.col("a").alias("digest")).unionByName(placed.select("cell", F.col("b").alias("digest"))).distinct()
        # written, so that both sides of the join are plain shuffles
        need = cut(need, "need")
        sent = need.hint("merge").join(whole, "digest").select("cell", F.col("digest").alias("a"), F.lit(None).cast("binary").alias("b"), "text")
        sent = sent.unionByName(placed.withColumn("text", F.lit(None).cast("string")))
        sent = sent.repartition("cell").sortWithinPartitions("cell", F.col("text").isNull())
        links = cut(sent.mapInArrow(_verified(percent), "a binary, b binary"), "verified")
        discard(pairs, need)
        return links

    stars = members.where(F.col("digest") != F.col("least")).select(F.col("digest").alias("a"), F.col("least").alias("b")).distinct()
    stars = stars.join(side("a"), "a").join(side("b"), "b").where(sized).withColumn("j", estimated("bitsa", "bitsb", longs)).where(F.col("j") >= floor)
    best = stars.groupBy("a").agg(F.max_by(F.struct("b", (F.col("na") + F.col("nb")).alias("size")), F.struct("j", "b")).alias("to"))
    links = verify(best.select("a", "to.b", "to.size"))
    parts = [links]
    comp = components(links)

    for last, least in zip((2.0, *passes), passes):
        placed = members.join(comp, F.col("digest") == F.col("v"), "left").select("key", "digest", F.coalesce("c", "digest").alias("c"))
        placed = cut(placed, "placed")
        sizes = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("big"), F.count(F.lit(1)).alias("comps"))
        split = cut(sizes.where(F.col("comps") > 1).select("key", "big"), "split")  # so that Spark can split a hot bucket's partition in the join
        left = cut(placed.join(split, "key").join(classes, "digest"), "left")
        half = lambda x, of: of.select("key", *(F.col(c).alias(f"{c}{x}") for c in ("digest", "c", "n", "big", "bits", "bands")))
        both = half("a", left.where(F.col("c") != F.col("big"))).join(half("b", left), "key").withColumn("j", estimated("bitsa", "bitsb", longs))
        # the first band in which both have the same bucket
        meet = F.get("bandsa", F.array_position(F.zip_with("bandsa", "bandsb", lambda x, y: x == y), F.lit(True)).cast("int") - 1)
        enough = F.col("j") >= least
        if least == floor:
            enough |= (F.least("na", "nb") <= tiny) | ((F.least("na", "nb") <= short) & (F.col("j") >= short_floor))
        # pairs of greater estimates have been verified; classes of the bucket's largest component stand on one side only
        apart = (F.col("ca") < F.col("cb")) | (F.col("cb") == F.col("bigb"))
        across = both.where(apart & sized & enough & (F.col("j") < last) & (meet == F.col("key")))
        # a pair whose sides trade places from one band to the next still leaves once
        more = verify(across.select(F.least("digesta", "digestb").alias("a"), F.greatest("digesta", "digestb").alias("b"), (F.col("na") + F.col("nb")).alias("size")))
        discard(placed, split, left)
        if more.isEmpty():
            continue
        parts.append(more)
        links = links.unionByName(more)
        discard(comp)
        comp = components(links)

    of = cut(classes.join(comp, F.col("digest") == F.col("v"), "left").select("digest", "rep", F.coalesce("c", "digest").alias("c")), "placed")
    # written, so that Spark can split a hot component's partition in the join
    least_id = cut(of.groupBy("c").agg(F.min("rep").alias("first")), "least")
    to = cut(of.join(least_id, "c").select(F.col("digest").alias("of"), "first"), "of")
    out = sk.select("doc_id", "row", "n_shingles", "digest").join(to, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "row", (F.col("digest").isNull() | F.col("first").eqNullSafe(key)).alias("first"))
    out = cut(out if row else out.drop("row", "first"), "components")
    discard(sk, to, classes, members, asked, whole, comp, of, least_id, *parts)
    return out.withColumnRenamed("row", row) if row else out
