"""Benchmark decontamination by a stored positional inverted index.

The index is distributed by document and written to the shared folder once: for
each run of texts of about ``RUN`` bytes, the sorted hashes of all its terms, and
each term's postings (positions in the run, documents ``GAP`` positions apart).
Test sets of any size are matched against it block by block, without reading the
texts again. A test window is looked up from its rarest term in a run: the
candidates are that term's positions less its offset in the window, and each
further term, by rising frequency, keeps the candidates that its own postings hold
at the adjusted offset, by binary search. The same intersection with a slack gives
proximity matches. No postings are shuffled, whatever the frequency of a word.

Only the test terms travel. Items are cut into pieces of at most ``PIECE`` words
(with the overlap that windows need) and dealt into blocks of about ``block``
characters, so a block's windows (up to one a word, 40 bytes each) fit the
driver whatever the number or length of items. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_ROWS, WordHash, cut, discard, ranges, slices, texts

#: Bytes of text in a run of the index, positions between its documents, words in a piece of an item.
RUN, GAP, PIECE = 1_000_000, 64, 20_000
#: Bytes: A-Z to a-z, all other ASCII but 0-9 and a-z to a space; the rest stays.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class TestSet:
    """The distinct windows of a block of test items, as rows of term numbers."""

    __test__ = False

    def __init__(self, items: list[tuple], width: int):
        words, rows, owners = WordHash(), [np.zeros((0, width), np.uint64)], [np.zeros(0, np.int64)]
        lengths = [np.zeros(0, np.int64)]
        self.ids = sorted({i for i, _ in items}, key=lambda x: (x is None, x))
        number = {x: k for k, x in enumerate(self.ids)}
        for item_id, text in items:
            ws = words_of((text or "").encode())
            if not ws:
                continue
            h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
            if len(h) < width:
                rows.append(np.concatenate([h, np.zeros(width - len(h), np.uint64)])[None]), lengths.append(np.array([len(h)]))
            else:
                rows.append(np.lib.stride_tricks.sliding_window_view(h, width)), lengths.append(np.full(len(h) - width + 1, width))
            owners.append(np.full(len(rows[-1]), number[item_id]))
        flat, length = np.concatenate(rows), np.concatenate(lengths)
        inside = np.arange(width) < length[:, None]
        self.width, self.terms = width, np.unique(flat[inside])
        term = np.where(inside, np.searchsorted(self.terms, flat), -1).astype(np.int32)
        self.windows, of = np.unique(term, axis=0, return_inverse=True)
        self.lengths = (self.windows >= 0).sum(1)
        # the items of window w are owner[begin[w] : begin[w + 1]]
        both = np.unique(np.stack([of.ravel(), np.concatenate(owners)], 1), axis=0)
        self.owner, self.begin = both[:, 1], np.searchsorted(both[:, 0], np.arange(len(self.windows) + 1))

    def items(self, windows: np.ndarray) -> list:
        """The sorted ids of the items that hold any of ``windows``."""
        n = self.begin[windows + 1] - self.begin[windows]
        return [self.ids[k] for k in np.unique(self.owner[ranges(self.begin[windows], n)]).tolist()]


def build_index(hashes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, begins, postings) of a run of tokens: sorted distinct hashes, where each one's list begins, its places in order."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
    return sorted_[first], np.append(first, len(sorted_)), place[order]


def postings_of(wanted: np.ndarray, terms: np.ndarray, begins: np.ndarray, postings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The postings of the terms ``wanted`` one after another, and where each one's list begins."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(len(wanted) + 1, np.int64)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    n = np.where(terms[at] == wanted, begins[at + 1] - begins[at], 0)
    return postings[ranges(begins[at], n)].astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def intersect(test: TestSet, postings: np.ndarray, begins: np.ndarray, span: int, slack: int = 0, most: int = 2_000_000):
    """(window, start) of each match. With a slack, each term may stand that far from its place, counted from the start."""
    if not len(test.windows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.diff(begins)
    keys = np.repeat(np.arange(len(counts)), counts) * span + postings  # ascending: by term, then position
    df = np.where(test.windows >= 0, counts[test.windows], np.iinfo(np.int64).max)
    order = np.argsort(df, axis=1, kind="stable")
    rarest = np.take_along_axis(test.windows, order[:, :1], 1)[:, 0]
    n = np.where(df.min(1) > 0, counts[rarest], 0)
    found_w, found_s = [], []
    live = np.flatnonzero(n)
    for x, y in slices(n[live].tolist(), most // (2 * slack + 1)):
        w = live[x:y]
        m = n[w]
        win = np.repeat(w, m)
        start = postings[ranges(begins[rarest[w]], m)] - np.repeat(order[w, 0], m)
        if slack:
            win, start = np.repeat(win, 2 * slack + 1), (start[:, None] + np.arange(-slack, slack + 1)).ravel()
        ok = start >= -slack
        win, start = win[ok], start[ok]
        for k in range(1, test.width):
            if not len(win):
                break
            off = order[win, k]
            term = test.windows[win, off]
            want = term * span + start + off
            i = np.searchsorted(keys, want - slack)
            hit = keys[np.minimum(i, len(keys) - 1)] if len(keys) else want - slack - 1
            ok = (term < 0) | ((i < len(keys)) & (hit <= want + slack))
            win, start = win[ok], start[ok]
        found_w.append(win)
        found_s.append(start)
    return (np.concatenate(found_w), np.concatenate(found_s)) if found_w else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _indexed(run_bytes: int):
    def run(batches):
        words = WordHash()
        for b in batches:
            ids, raw = b.column(0), b.column(1).cast(pa.binary())
            for x, y in slices(pa.compute.binary_length(raw).to_pylist(), run_bytes):
                hashes, tags = [], []
                for t in raw.slice(x, y - x).to_pylist():
                    ws = words_of(t)
                    tags.append(hashlib.md5(t).hexdigest())
                    hashes.append(np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws)))
                size = np.array([len(h) for h in hashes], np.int64)
                base = np.cumsum(size + GAP) - size - GAP
                terms, begins, postings = build_index(np.concatenate(hashes), ranges(base, size))
                one = (uuid.uuid4().hex, ids.slice(x, y - x).to_pylist(), tags, size, terms.tobytes(), begins.astype(np.int64).tobytes(), postings.astype(np.int64 if base[-1] + size[-1] >> 31 else np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, (pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()))], ["run", "doc_ids", "tags", "sizes", "terms", "begins", "postings"])

    return run


def build_postings(docs: DataFrame, run_bytes: int = RUN) -> DataFrame:
    """The stored index of ``docs``: a row for each run of texts, with an id of its own."""
    d = docs.select("doc_id", texts().alias("text"))
    index = cut(d.mapInArrow(_indexed(run_bytes), "run string, doc_ids array<bigint>, tags array<string>, sizes array<bigint>, terms binary, begins binary, postings binary"), "postings", LONG_ROWS)
    return index


def _spans(pairs) -> list[dict]:
    """Sorted (start, end) joined where they touch."""
    out: list[dict] = []
    for a, z in pairs:
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], z)
        else:
            out.append({"start": a, "end": z})
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
KINDS = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), SPANS, pa.int64(), pa.list_(pa.int64()))
NAMES = ("run", "place", "doc_id", "tag", "n_words", "n_hit", "items", "spans", "n_near", "near_items")
SCHEMA = "run string, place int, doc_id long, tag string, n_words long, n_hit long, items array<bigint>, spans array<struct<start:bigint,end:bigint>>, n_near long, near_items array<bigint>"


def _matched(test: TestSet, slack: int, all_rows: bool):
    """One row for each document of a run; of those without a match only if ``all_rows``."""

    def by_doc(doc: np.ndarray) -> dict[int, np.ndarray]:
        order = np.argsort(doc, kind="stable")
        at = np.flatnonzero(np.append(True, doc[order][1:] != doc[order][:-1])) if len(doc) else np.zeros(0, np.int64)
        return {int(doc[order[a]]): order[a:z] for a, z in zip(at, np.append(at[1:], len(doc)))}

    def of_run(run, ids, tags, sizes, terms, begins, postings):
        sizes = np.array(sizes, np.int64)
        base = np.cumsum(sizes + GAP) - sizes - GAP
        end = int(base[-1] + sizes[-1])
        lists, starts = postings_of(test.terms, np.frombuffer(terms, np.uint64), np.frombuffer(begins, np.int64), np.frombuffer(postings, np.int64 if end >> 31 else np.int32))
        span = end + 2 * GAP + 2 * slack
        win, start = intersect(test, lists, starts, span)
        doc = np.searchsorted(base, start, "right") - 1
        exact, near = by_doc(doc), {}
        if slack:
            w2, s2 = intersect(test, lists, starts, span, slack)
            d2 = np.searchsorted(base, s2 + slack, "right") - 1
            both = np.setdiff1d(d2 * len(test.windows) + w2, doc * len(test.windows) + win)
            d2, w2 = both // len(test.windows), both % len(test.windows)
            near = by_doc(d2)
        for k, (doc_id, tag, n) in enumerate(zip(ids, tags, sizes.tolist())):
            if not (all_rows or k in exact or k in near):
                continue
            e, m = exact.get(k), near.get(k)
            at = sorted(set(zip((start[e] - base[k]).tolist(), (start[e] - base[k] + test.lengths[win[e]]).tolist()))) if e is not None else []
            spans = _spans(at)
            items = test.items(np.unique(win[e])) if e is not None else []
            yield run, k, doc_id, tag, n, sum(s["end"] - s["start"] for s in spans), items, spans, len(m) if m is not None else 0, test.items(w2[m]) if m is not None else []

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                found = list(of_run(*(b.column(c)[i].as_py() for c in ("run", "doc_ids", "tags", "sizes", "terms", "begins", "postings"))))
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], kind) for j, kind in enumerate(KINDS)], list(NAMES))

    return run


def item_blocks(benchmark: DataFrame, width: int, block: int):
    """How many blocks of about ``block`` characters the test set takes, and a function that reads one.

    Items are cut into pieces of ``PIECE`` windows, and the pieces dealt by a hash
    into as many blocks as their characters ask for; a block is read only when its turn comes.
    """
    folded = F.translate(texts(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.select("item_id", words.alias("w")).where(F.size("w") > 0)
    begin = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)), F.lit(PIECE))
    pieces = items.select("item_id", F.explode(F.transform(begin, lambda i: F.array_join(F.slice("w", i + 1, PIECE + width - 1), " "))).alias("text"))
    pieces = cut(pieces, "items")
    size = pieces.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block))

    def of(k: int) -> list[tuple]:
        part = pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else pieces
        return [(r.item_id, r.text) for r in part.toLocalIterator()]

    return blocks, of


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slack: int = 0, block: int = 2_000_000, run_bytes: int = RUN) -> DataFrame:
    """For each row of ``docs``: tag (md5 of the text), n_words, n_hit, items, spans (word offsets, merged), n_near, near_items.

    n_near counts the windows with a proximity match (a start from which each of the
    terms stands at most ``slack`` from where it should) but no exact one in the row,
    near_items lists their items; 0 and empty without ``slack``. Null and empty texts have no words. Items without
    words match nothing; repeated items count once by item_id; a null item_id counts
    as an item but is left out of id lists. An empty table of documents gives
    none, an empty test set no hits. The results of several blocks are merged row by
    row, so repeated rows, ids that repeat with other texts and null ids each keep their
    own result. A window that items of two blocks share counts in n_near for each.
    Extra columns are not read, whatever their names.
    """
    if width + slack > GAP:
        raise ValueError(f"windows and slack of more than {GAP} words")
    index = build_postings(docs, run_bytes)
    blocks, of = item_blocks(benchmark, width, block)
    columns = NAMES[2:]
    if blocks == 1:
        found = cut(index.mapInArrow(_matched(TestSet(of(0), width), slack, True), SCHEMA).select(*columns), "contamination")
        discard(index)
        return found
    every, parts = None, []
    for k in range(blocks):
        # the first block speaks for rows without a match
        parts.append(cut(index.mapInArrow(_matched(TestSet(of(k), width), slack, k == 0), SCHEMA), "block"))
        every = parts[-1] if every is None else every.unionByName(parts[-1])
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    # at most one row of each block for a row
    row = every.groupBy("run", "place").agg(
        F.max("doc_id").alias("doc_id"), F.max("tag").alias("tag"), F.max("n_words").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), joined("items"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.sum("n_near").alias("n_near"), joined("near_items")
    )
    found = cut(row.mapInArrow(_merged, SCHEMA).select(*columns), "contamination")
    discard(index, *parts)
    return found


def _merged(batches):
    """Joins the sorted spans that touch, and counts the words under them."""
    for b in batches:
        spans = [_spans((s["start"], s["end"]) for s in row) for row in b.column("spans").to_pylist()]
        hits = [sum(s["end"] - s["start"] for s in out) for out in spans]
        new = {"n_hit": pa.array(hits, pa.int64()), "spans": pa.array(spans, SPANS)}
        yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in NAMES], list(NAMES))
