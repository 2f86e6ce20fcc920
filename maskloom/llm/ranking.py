"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time scoring.

One pass over the documents keeps, for each document, its length and how often it holds each term that
some item asks for. Collection statistics are aggregates over that table. A task then inverts its
documents, a bounded segment at a time, and ranks every item against the segment:

* term at a time: the short lists of the item are summed into accumulators, sorted by document;
* document at a time: these accumulators are one more iterator next to the long lists, with their
  largest sum as its bound. Iterators whose bounds together stay under the k-th best score so far
  bring up no documents; documents of the others are completed list by list, largest bound first, by
  skipping to them, and given up as soon as the bounds left cannot lift them to that score.

A task sends its k best documents of each item; one ranking per item over these few rows ends the job.
Skipping is exact: results are those of scoring every document.

Defined cases: a null text, or one without terms, has no terms and counts in no statistic; an item
without terms has no rows. Repeated rows, of documents or of items, are rows of their own. Equal scores
rank by ``doc_id``, null ids first. Texts of any length are read whole, in slices of rows; one long text
is a slice by itself. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.store import keep
from maskloom.llm.text import NOT_PLAIN, byte_view, hash_words, lower_ascii, slices, word_bounds

SLICE_BYTES = 16 << 20      # text of the items that are ranked in one pass over the documents
SEGMENT = 2_000_000         # postings that a task inverts at once
WINDOW = 2048               # documents of a segment that are scored between two looks at the k-th best
SHORT_SHARE = 0.5           # short lists: the shortest ones, with this many postings per document together

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
NULL_ID = np.iinfo(np.int64).min


def _terms_of(text: str | None) -> dict[bytes, int]:
    data, bounds = byte_view(pa.array([text], pa.string()))
    data = lower_ascii(data)
    start, end, _ = word_bounds(data, bounds, NOT_PLAIN)
    out: dict[bytes, int] = {}
    for s, e in zip(start, end):
        term = data[s:e].tobytes()
        out[term] = out.get(term, 0) + 1
    return out


class Queries:
    """Items of one slice: rows ``(row, item_id, term numbers, repeats)`` and the terms by their hash."""

    def __init__(self, rows):
        counted = [(r.item, r.item_id, _terms_of(r.text)) for r in rows]
        terms = sorted({t for *_, c in counted for t in c})
        lengths = np.array([len(t) for t in terms], np.int64)
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum(lengths)
        hashes = hash_words(data, ends - lengths, ends)
        order = np.argsort(hashes)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two query terms share a 64-bit hash")
        number = {terms[j]: i for i, j in enumerate(order)}
        self.hashes, self.lengths, self.starts, self.data = hashes[order], lengths[order], (ends - lengths)[order], data
        self.items = [(row, item_id, np.array([number[t] for t in c], np.int64), np.array([*c.values()], np.int64))
                      for row, item_id, c in counted if c]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and the number of each of these; equal bytes, not only equal hashes."""
        h = hash_words(data, start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == h) & (self.lengths[at] == end - start))
        at, size = at[hit], (end - start)[hit]
        before = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        other = data[np.repeat(start[hit] - before, size) + step] != self.data[np.repeat(self.starts[at] - before, size) + step]
        if other.any():
            same = np.ones(len(hit), bool)
            same[np.searchsorted(before, np.flatnonzero(other), "right") - 1] = False
            hit, at = hit[same], at[same]
        return hit, at


def postings(docs: DataFrame, queries: Queries) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term: its length, and its terms that items use."""
    sent = docs.sparkSession.sparkContext.broadcast(queries)

    def count(batches):
        q = sent.value
        for batch in slices(batches, "text"):
            data, bounds = byte_view(batch.column("text"))
            data = lower_ascii(data)
            start, end, row = word_bounds(data, bounds, NOT_PLAIN)
            rows = batch.num_rows
            n = np.bincount(row, minlength=rows)
            hit, term = q.find(data, start, end)
            both, tf = np.unique(row[hit] * len(q.hashes) + term, return_counts=True)
            of, term = np.divmod(both, len(q.hashes))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (term, tf)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, POSTINGS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Best:
    """The k best (score, document) pairs so far, and the least score that may still enter."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, doc: np.ndarray, score: np.ndarray) -> None:
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        order = np.lexsort((doc, -score))[:self.k]
        self.score, self.doc = score[order], doc[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


class Segment:
    """Inverted lists of some documents; documents are numbered by ascending id."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 weights: np.ndarray, total_docs: int, total_terms: int):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        exact = n.astype(object) if 75 * int(n.max()) * total_docs >= 2**63 else n  # past 64 bits: Python's integers
        m = (100 - 75 + (75 * exact * total_docs) // total_terms).astype(np.int64)
        doc = np.repeat(place, counts)
        gain = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, counts)))
        by = np.lexsort((doc, terms))
        self.doc, self.gain = doc[by], gain[by]
        self.bounds = np.searchsorted(terms[by], np.arange(len(weights) + 1))

    def rank(self, terms: np.ndarray, repeats: np.ndarray, best: _Best) -> None:
        first, last = self.bounds[terms], self.bounds[terms + 1]
        by_length = np.argsort(last - first, kind="stable")
        lists = [(self.doc[first[i]:last[i]], self.gain[first[i]:last[i]] * repeats[i]) for i in by_length if first[i] < last[i]]
        lists = [x for x in lists if x[1].any()]
        if not lists:
            return
        held = np.cumsum([len(x[0]) for x in lists])
        short = int(np.searchsorted(held, max(1, int(SHORT_SHARE * len(self.ids))), "right"))
        iterators = lists[short:]
        if short:
            doc, gain = (np.concatenate(x) for x in zip(*lists[:short]))
            order = np.argsort(doc, kind="stable")
            doc, gain = doc[order], gain[order]
            new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            doc, gain = doc[new], np.add.reduceat(gain, new)
            iterators.append((doc, gain))
            if len(gain) >= best.k:  # that many documents score at least this much
                best.least = max(best.least, int(np.partition(gain, -best.k)[-best.k]))
        iterators.sort(key=lambda x: int(x[1].max()))
        reach = np.cumsum([int(x[1].max()) for x in iterators])

        lo = 0
        while lo < len(self.ids):
            leading = int(np.searchsorted(reach, best.least))  # iterators before this one cannot reach it together
            if leading == len(iterators):
                return
            # Skip to the next document of a leading iterator.
            ahead = [int(np.searchsorted(d, lo)) for d, _ in iterators[leading:]]
            nexts = [int(d[i]) for (d, _), i in zip(iterators[leading:], ahead) if i < len(d)]
            if not nexts:
                return
            lo = min(nexts)
            hi = min(lo + WINDOW, len(self.ids))
            score = np.zeros(hi - lo, np.int64)
            for (d, g), i in zip(iterators[leading:], ahead):
                j = int(np.searchsorted(d, hi))
                score[d[i:j] - lo] += g[i:j]
            docs = np.flatnonzero(score)
            score = score[docs]
            docs = docs + lo
            for i in range(leading - 1, -1, -1):
                may = score + reach[i] >= best.least
                docs, score = docs[may], score[may]
                if not len(docs):
                    break
                d, g = iterators[i]
                at = np.minimum(np.searchsorted(d, docs), len(d) - 1)
                score += np.where(d[at] == docs, g[at], 0)
            may = score >= best.least
            if may.any():
                best.add(self.ids[docs[may]], score[may])
            lo = hi


def best_of_parts(held: DataFrame, queries: Queries, weights: np.ndarray, total_docs: int, total_terms: int, k: int) -> DataFrame:
    """``item, item_id, doc_id, score``: the k best documents of each item among those of each task."""
    sent = held.sparkSession.sparkContext.broadcast((queries.items, weights))

    def rank(batches):
        items, w = sent.value
        best = [_Best(k) for _ in items]
        parts, size = [], 0

        def flush():
            ids, n, counts, terms, tfs = (np.concatenate(x) for x in zip(*parts))
            segment = Segment(ids, n, counts, terms, tfs, w, total_docs, total_terms)
            for (_, _, t, r), b in zip(items, best):
                segment.rank(t, r, b)
            parts.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
            terms, tfs = batch.column("terms"), batch.column("tfs")
            counts = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs)]
            parts.append((ids, batch.column("n").to_numpy(zero_copy_only=False), counts, *flat))
            size += len(flat[0])
            if size >= SEGMENT:
                flush()
                size = 0
        if parts:
            flush()
        found = [(row, item_id, d, s) for (row, item_id, *_), b in zip(items, best) for d, s in zip(b.doc, b.score)]
        for i in range(0, len(found), 10_000):
            row, item_id, d, s = zip(*found[i:i + 10_000])
            d = np.array(d, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(item_id, pa.int64()), pa.array(d, mask=d == NULL_ID), pa.array(s, pa.int64())],
                ["item", "item_id", "doc_id", "score"])

    return held.mapInArrow(rank, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item, score above 0.

    Items travel to tasks in slices of ``SLICE_BYTES`` of text, a pass over the documents each; a
    document's postings, its statistics and its scores don't depend on the slice it is looked at with.
    """
    numbered = keep(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text"), "items")
    volume = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-volume // SLICE_BYTES))
    found = None
    for i in range(n):
        part = numbered if n == 1 else numbered.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        queries = Queries(part.collect())  # at most about one slice of text
        if not queries.items:
            continue
        held = keep(postings(docs, queries), "postings")
        total_docs, total_terms = held.agg(F.count("*"), F.sum("n")).first()
        df = held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row per query term
        weights = np.zeros(len(queries.hashes), np.int64)
        for r in df:
            weights[r["term"]] = weight(total_docs, r["count"])
        some = best_of_parts(held, queries, weights, total_docs or 0, total_terms or 0, k)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return numbered.select("item_id", F.lit(0).alias("rank"), F.col("item").alias("doc_id"), F.col("item").alias("score")).filter("false")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def sql_twin(k: int = 10) -> str:
    """DuckDB SQL of ``search``: every document scored for every item."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {split} AS ts FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, unnest({split}) AS t FROM benchmark),
r AS MATERIALIZED (SELECT i, any_value(item_id) AS item_id, t, count(*) AS r FROM q GROUP BY i, t),
s AS (SELECT count(*)::BIGINT AS n, sum(len(ts))::BIGINT AS l FROM w WHERE len(ts) > 0),
e AS (SELECT d, unnest(ts) AS t FROM w),
p AS MATERIALIZED (SELECT d, t, count(*) AS tf FROM e SEMI JOIN r USING (t) GROUP BY d, t),
f AS (SELECT t, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t),
m AS (SELECT d, doc_id, 100 - 75 + (75 * len(ts) * n) // l AS m FROM w, s WHERE len(ts) > 0),
c AS (SELECT r.i, any_value(r.item_id) AS item_id, p.d, any_value(m.doc_id) AS doc_id,
  sum(r.r * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score
  FROM r JOIN p USING (t) JOIN f USING (t) JOIN m USING (d) GROUP BY r.i, p.d)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY rank <= {k}"""
