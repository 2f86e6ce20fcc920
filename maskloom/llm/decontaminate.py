"""Benchmark decontamination by edit distance.

Documents and items become words (letters and digits, A-Z lower-cased). The CGK random walk turns a
sequence of words into a sequence of symbols: at each step the current word is written, and a random
bit that depends on step and word says whether to move on. Two sequences a few edits apart fall back
into step, so their walks agree at most places: edit distance becomes Hamming distance. Sampling
``K`` places gives a key; enough repetitions, over several independent walks, reach the target
recall. A walk spans some five words; an item is indexed from each of its words, so that edits it allows
cannot hit all of its walks, and every word of every document starts a window that is walked and looked
up. Each hit is confirmed by the exact edit distance, in words, between the item and the best-matching
passage around the window.

Items travel to the tasks in slices of bounded size; more items mean more passes over the documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.store import hinted, keep
from maskloom.llm.text import NOT_PLAIN, byte_view, hash_words, lower_ascii, mix, slices, word_bounds

LEAST_WORDS = 8       # shorter items say nothing about a document
MOST_EDITS = 0.2      # edit distance in words, as a share of the item's words
WALKS = 2
K = 4                 # places sampled for a key
AGREE = 0.65          # share of agreeing places assumed of walks at the largest distance
RECALL = 0.99
STEPS = 8             # length of walks
SPAN = 3              # different words that a key of an item holds at least
SLICE_CHARS = 2 << 20  # characters of items that one pass holds
BLOCK = 4096


def repetitions(recall: float = RECALL, agree: float = AGREE, k: int = K) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agree ** k))


class Walks:
    """What every step of every walk adds to which key."""

    def __init__(self):
        rng = np.random.default_rng(7)
        odd = iter(mix(np.arange(1, 10_000, dtype=np.uint64)) | np.uint64(1))
        each = -(-repetitions() // WALKS)
        self.count = each * WALKS
        self.adds = [[[] for _ in range(STEPS)] for _ in range(WALKS)]
        for slot in range(self.count):
            for step in np.sort(rng.choice(STEPS, K, replace=False)):
                self.adds[slot // each][step].append((slot, next(odd)))

    def keys(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Keys of the windows at ``starts``, one row per key; ``h`` goes on for a walk after the last."""
        keys, part = np.zeros((self.count, len(starts)), np.uint64), np.empty(len(starts), np.uint64)
        for walk in range(WALKS):
            bits = mix(h ^ np.uint64(0x5851F42D4C957F2D * (walk + 1) % 2**64))
            cur = starts.copy()
            for step in range(STEPS):
                if self.adds[walk][step]:
                    word = h[cur]
                    for slot, factor in self.adds[walk][step]:
                        np.multiply(word, factor, out=part)
                        keys[slot] += part
                cur += ((bits[cur] >> np.uint64(step)) & np.uint64(1)).view(np.int64)
        return keys

    def spans(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many different places of ``h`` each of those keys is made of."""
        seen, last = np.zeros((self.count, len(starts)), np.int8), np.full((self.count, len(starts)), -1)
        for walk in range(WALKS):
            bits = mix(h ^ np.uint64(0x5851F42D4C957F2D * (walk + 1) % 2**64))
            cur = starts.copy()
            for step in range(STEPS):
                for slot, _ in self.adds[walk][step]:
                    seen[slot] += cur != last[slot]
                    last[slot] = cur
                cur += ((bits[cur] >> np.uint64(step)) & np.uint64(1)).view(np.int64)
        return seen


def passage_distance(item: list, passage: list, most: int) -> tuple[int, int] | None:
    """Smallest edit distance between ``item`` and a run of ``passage``, and where that ends.

    Bit-parallel (Myers 1999) on whole integers; None if it exceeds ``most``.
    """
    m = len(item)
    peq: dict = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for at, c in enumerate(passage):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Table:
    """Places in items by key: sorted arrays with a bitmap in front."""

    def __init__(self, keys: np.ndarray, place: np.ndarray, at: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.place, self.at = keys[order], place[order].astype(np.int32), at[order].astype(np.int32)
        self.shift = np.uint64(64 - min(26, max(20, len(keys).bit_length() + 4)))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[self.keys >> self.shift] = True

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where ``keys`` has a known key, and the item and the place in it, for every such pair."""
        where = np.flatnonzero(self.bitmap[keys >> self.shift])
        hit = keys[where]
        first = np.searchsorted(self.keys, hit, "left")
        count = np.searchsorted(self.keys, hit, "right") - first
        which = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(where, count), self.place[which].astype(np.int64), self.at[which].astype(np.int64)


class Index:
    """Keys of one slice of the items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, starts, places, ats, parts, n = [], [], [], [], [], 0
        for item_id, text in items:
            data, bounds = byte_view(pa.array([text]))
            data = lower_ascii(data)
            start, end, _ = word_bounds(data, bounds, NOT_PLAIN)
            if len(start) < LEAST_WORDS:
                continue
            h = hash_words(data, start, end)
            at = np.arange(len(h) - SPAN + 1)
            starts.append(n + at)
            places.append(np.full(len(at), len(self.items)))
            ats.append(at)
            parts += [h, np.zeros(STEPS, np.uint64)]
            n += len(h) + STEPS
            self.items.append((item_id, h, np.unique(h)))
        self.walks, self.table = Walks(), None
        if starts:
            h, start = np.concatenate(parts), np.concatenate(starts)
            slot, which = np.nonzero(self.walks.spans(h, start) >= SPAN)  # the others are too common
            self.table = Table(self.walks.keys(h, start)[slot, which], np.concatenate(places)[which], np.concatenate(ats)[which])

    def candidates(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """``row, start, item`` of the passages to compare, without repeats: where the item would start
        if no word were missing or added, by every key in common. That may be before the row."""
        n, got = len(h), []
        if not n or self.table is None:
            return np.zeros((0, 3), np.int64)
        padded = np.concatenate((h, np.zeros(STEPS, np.uint64)))
        before = int(self.table.at.max())
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            for keys in self.walks.keys(padded[lo:hi + STEPS], np.arange(hi - lo)):
                where, place, at = self.table.look(keys)
                if len(where):
                    where += lo
                    got.append((row[where] * (n + before) + where - at + before) * len(self.items) + place)
        if not got:
            return np.zeros((0, 3), np.int64)
        start, place = np.divmod(np.unique(np.concatenate(got)), len(self.items))
        r, start = np.divmod(start, n + before)
        return np.column_stack((r, start - before, place))

    def likely(self, h: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The candidates around which enough words are words of the item; the others are too far away
        for sure, as every word of the item but those edited stands there."""
        keep = np.zeros(len(found), bool)
        order = np.argsort(found[:, 2], kind="stable")
        cuts = np.flatnonzero(np.diff(found[order, 2], prepend=-1))
        for part in np.split(order, cuts[1:]) if len(order) else ():
            _, words, vocabulary = self.items[found[part[0], 2]]
            edits = int(MOST_EDITS * len(words))
            window = np.arange(-edits - 1, len(words) + edits + 1)
            for lo in range(0, len(part), 20_000):
                some = part[lo:lo + 20_000]
                near = h[np.clip(found[some, 1][:, None] + window, 0, len(h) - 1)]
                at = np.minimum(np.searchsorted(vocabulary, near), len(vocabulary) - 1)
                keep[some] = (vocabulary[at] == near).sum(1) >= len(words) - edits
        return found[keep]


HIT = "item_id: bigint, start: int, end: int, distance: int"


def _hits(batch: pa.RecordBatch, index: Index) -> list[list[dict]]:
    """Confirmed passages of each row: item, code points of the words around it, edit distance."""
    data, bounds = byte_view(batch.column("text"))
    low = lower_ascii(data)
    start, end, row = word_bounds(low, bounds, NOT_PLAIN)
    h = hash_words(low, start, end)
    first = np.searchsorted(row, np.arange(batch.num_rows + 1))
    out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    last: dict[tuple, int] = {}
    found, lead = index.likely(h, index.candidates(h, row)), None
    for r, begin, place in found.tolist():
        item_id, words, _ = index.items[place]
        edits = int(MOST_EDITS * len(words))
        done = last.get((r, place), first[r])
        if begin + edits < done:  # starts inside a passage that was found
            continue
        lo, hi = max(begin - edits - 1, done), min(begin + len(words) + edits + 1, first[r + 1])
        best = passage_distance(words.tolist(), h[lo:hi].tolist(), edits) if hi > lo else None
        if best is None:
            continue
        stop = lo + best[1]  # the passage ends here and is about as long as the item
        lo = max(lo, stop - len(words))
        last[r, place] = stop
        if lead is None:  # code points before each byte
            lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        out[r].append({"item_id": item_id, "start": int(lead[start[lo]] - lead[bounds[r]]),
                       "end": int(lead[end[stop - 1]] - lead[bounds[r]]), "distance": best[0]})
    return out


def _item_slices(benchmark: DataFrame) -> list[DataFrame]:
    """The items in parts of about ``SLICE_CHARS`` characters."""
    items = keep(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
                 .filter("item_id is not null and text is not null").distinct(), "items")
    n = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // SLICE_CHARS)
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def hits(docs: DataFrame, benchmark: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry`` and ``hits``, one row per row of ``docs``; with several slices of items, one row for
    all rows with equal ``carry``."""
    rows = docs.select(*carry, "text")
    names = [c for c in rows.columns if c != "text"]
    schema = rows.drop("text").withColumn("hits", F.array().cast(f"array<struct<{HIT}>>")).schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))
    passes = []
    for part in _item_slices(benchmark):
        index = Index([(r["item_id"], r["text"]) for r in part.toArrow().to_pylist()])
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches, sent=sent):
            for batch in slices(batches, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(_hits(batch, sent.value), kind)],
                                                 [*names, "hits"])

        passes.append(rows.mapInArrow(find, schema))
    if not passes:
        return rows.drop("text").withColumn("hits", F.array().cast(f"array<struct<{HIT}>>"))
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    if len(passes) > 1:
        out = out.groupBy(*names).agg(F.flatten(F.collect_list("hits")).alias("hits"))  # a row per slice
    return out


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_hits, item_ids, hits`` per row of ``docs``.

    Null and empty texts, and items that are null, empty or shorter than ``LEAST_WORDS`` words, hit
    nothing; repeated rows and items count once each. An empty table gives no rows, an empty benchmark
    no hits. Only ``doc_id, text`` and ``item_id, text`` are read. With more than one slice of items
    the hits of a row are put together, so rows that repeat an id and its text become one.
    """
    found = hits(docs, benchmark, [F.col("doc_id"), F.xxhash64("doc_id", "text").alias("_key")])
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_hits"),
                        F.sort_array(F.array_distinct("hits.item_id")).alias("item_ids"), "hits")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns."""
    key = lambda: F.xxhash64("doc_id", "text")
    bad = keep(hits(docs, benchmark, [key().alias("_key")]).filter(F.size("hits") > 0).select("_key").distinct(), "leaks")
    names = docs.columns
    return docs.select(F.struct("*").alias("_row"), key().alias("_key")).join(hinted(bad), "_key", "left_anti").select(
        *[F.col("_row")[n].alias(n) for n in names])
