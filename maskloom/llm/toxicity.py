"""Toxicity by class-conditional Kneser-Ney models of words.

Two word models, of texts labelled toxic and ordinary. A word's probability after another comes from
the class's discounted bigram counts, backed off to the class's discounted word counts, backed off to the
continuation counts (after how many different words was it seen, in either class) that the classes share.
Discounts of pairs depend on the count, as in the modified form: pairs that are rare in both classes give
all of their counts to the backoff, whose weight is what discounts take of all counts. Rare words are one
word of the vocabulary.
The probabilities of each class sum to 1. The
log-likelihood ratio of a text is normalised by length: over the whole text, and over its most toxic runs
of ``WINDOWS`` words. A logistic fit turns both into a score.

The fit sees rows that a first model doesn't count; the model that scores counts all labelled rows
outside the held-out fold. There is one count per word and bigram; words are told
apart by hashes of 64 bits. The model is a table of log-likelihood ratios, of bigrams and of words, as
large as the corpus makes it. It lies in sorted files of bounded size, and tasks look their words up in
one file after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.store import filesystem, hinted, keep
from maskloom.llm.text import NOT_PLAIN, _worker_cache, byte_view, hash_words, lower_ascii, mix, slices, word_bounds

DISCOUNT = 0.75                 # taken from the count of each class and given to the backoff
RARE = 3                        # pairs up to this count in both classes together give it all; words up to it are one word
WINDOWS = (4, 16)               # lengths of the runs of words whose top ratio counts
FOLDS, HELD_OUT = 4, 2          # fold: crc32 of the id's text, modulo FOLDS
PARTS, CALIBRATION = 8, 3       # of the part that calibrates, modulo PARTS; the model for the fit doesn't count it
FIT_ROWS = 20_000               # labelled rows of the calibration part that the logistic fit reads
THRESHOLD = 0.3
FLUSH = 2_000_000               # words counted or looked up together inside a task
FILES, FILE_ROWS = 8, 2_000_000  # least number of the model's files, most rows of one
CACHE_ROWS = 6_000_000          # rows of the model that a worker holds


def fold(of: int = FOLDS):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows of a batch, one after the other, and the row of each."""
    data, bounds = byte_view(batch.column("text"))
    data = lower_ascii(data)
    start, end, row = word_bounds(data, bounds, NOT_PLAIN)
    return hash_words(data, start, end).view(np.int64), row


def _contexts(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of the word before each word; 0 at the start of a text."""
    before = np.concatenate(([0], words[:-1])) if len(words) else words
    first = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    return np.where(first, 0, before)


def _pair_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    v, w = before.astype(np.int64).view(np.uint64), words.astype(np.int64).view(np.uint64)
    return mix(mix(v) * np.uint64(0x9E3779B97F4A7C15) + w).view(np.int64)


def count_pairs(labelled: DataFrame) -> DataFrame:
    """``v, w, t, o, ct, co``: how often word ``w`` follows ``v`` in toxic and ordinary texts, and in
    those that are ``apart``."""
    def count(batches):
        held, n = [], 0

        def flush():
            v, w, toxic, apart = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((w, v))  # rows of a context follow each other, so what is sent compresses
            v, w, toxic, apart = (x[order] for x in (v, w, toxic, apart))
            first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
            both = np.diff(np.append(first, len(v)))
            t, ct, both_apart = (np.add.reduceat(x.astype(np.int64), first) for x in (toxic, toxic & apart, apart))
            columns = dict(v=v[first], w=w[first], t=t, o=both - t, ct=ct, co=both_apart - ct)
            for i in range(0, len(first), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 200_000]) for x in columns.values()], list(columns))

        for batch in slices(batches, "text"):
            w, row = _words(batch)
            flags = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int8)[row] for c in ("toxic", "apart"))
            held.append((_contexts(w, row), w, *flags))
            n += len(w)
            if n >= FLUSH:
                yield from flush()
                n = 0
        if n:
            yield from flush()

    pairs = labelled.select("text", "toxic", "apart").mapInArrow(count, "v long, w long, t long, o long, ct long, co long")
    return pairs.groupBy("v", "w").agg(*[F.sum(c).alias(c) for c in ("t", "o", "ct", "co")]).sortWithinPartitions("v")


def kept(of: str | None = None):
    """What discounts leave of a count in one class, or in both."""
    if of is None:
        return kept("t") + kept("o")
    often = F.col("t") + F.col("o") > RARE
    return F.when(often, F.greatest(F.col(of) - DISCOUNT, F.lit(0.0))).otherwise(0.0)


def word_model(pairs: DataFrame) -> tuple[DataFrame, float]:
    """``w, p_t, p_o``: P(w) in each class, and the log-likelihood ratio of a rare word.

    All rare words are one word of the vocabulary, so the probabilities of the rows and of that word sum
    to 1. A class's discounted counts back off to the continuation counts that the classes share.
    """
    words = keep(pairs.groupBy("w").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count("*").alias("cont")), "words")
    rare = F.col("t") + F.col("o") <= RARE
    sums = words.groupBy(rare.alias("rare")).agg(
        *[F.sum(c).alias(c) for c in ("t", "o", "cont")], *[F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in ("t", "o")]).collect()
    one = next((r for r in sums if r.rare), {"t": 0, "o": 0, "cont": 0})
    total = {c: sum(r[c] for r in sums) for c in ("t", "o", "cont")}
    kinds = {c: sum(1 if r.rare else r[f"kinds_{c}"] for r in sums if r[c]) for c in ("t", "o")}

    def p(of: str, count, cont, larger):
        n = max(1, total[of])
        return larger(count - DISCOUNT) / n + DISCOUNT * kinds[of] / n * cont / max(1, total["cont"])

    if not total["t"] or not total["o"]:  # one class tells nothing
        return words.limit(0).select("w", F.lit(1.0).alias("p_t"), F.lit(1.0).alias("p_o")), 0.0
    known = words.filter(~rare).select("w", *[p(c, F.col(c), F.col("cont"), lambda x: F.greatest(x, F.lit(0.0))).alias(f"p_{c}") for c in ("t", "o")])
    p_t, p_o = (p(c, one[c], one["cont"], lambda x: max(x, 0.0)) for c in ("t", "o"))
    return keep(known, "word_model"), float(np.log(p_t / p_o)) if p_t and p_o else 0.0


def context_model(pairs: DataFrame) -> DataFrame:
    """``v, k_t, k_o, rest``: what is kept of the pairs after ``v`` in each class, and the weight of their
    backoff, the share of the counts after ``v`` that the discount takes.

    Contexts with kept pairs in one class only are not there: their weight is 1 in both classes.
    """
    both = F.sum(F.col("t") + F.col("o"))
    return pairs.groupBy("v").agg(F.sum(kept("t")).alias("k_t"), F.sum(kept("o")).alias("k_o"),
                                  (1 - F.sum(kept()) / both).alias("rest")).filter("k_t > 0 and k_o > 0")


def pair_probability(of: str):
    """P(w | v) in a class: the kept share of the pair, then the word's own probability."""
    return (1 - F.col("rest")) * kept(of) / F.col(f"k_{of}") + F.col("rest") * F.col(f"p_{of}")


def ratios(pairs: DataFrame) -> tuple[DataFrame, float]:
    """``key, llr``: log of P(word | word before, toxic) / P(word | word before, ordinary) by the key of
    a bigram, and the same of the word alone by its hash.

    A pair of which nothing is kept has the backoff alone, whose weight is the same in both classes, so
    its ratio is the word's and it needs no row. Returns the ratio of rare words as well.
    """
    llr = lambda x, y: F.log(x / y).cast("float").alias("llr")
    (words, unknown), after = word_model(pairs), keep(context_model(pairs), "contexts")
    of_pairs = (pairs.filter(kept() > 0).join(hinted(after), "v").join(hinted(words), "w")
                .select("v", "w", llr(pair_probability("t"), pair_probability("o"))))
    # The same hash as in tasks, so that pairs meet the keys that scoring looks up.
    return of_pairs.mapInArrow(_with_key, "key long, llr float").unionByName(
        words.select(F.col("w").alias("key"), llr(F.col("p_t"), F.col("p_o")))), unknown


def _with_key(batches):
    for b in batches:
        key = _pair_key(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("v", "w")))
        yield pa.RecordBatch.from_arrays([pa.array(key), b.column("llr")], ["key", "llr"])


class Model:
    """The written ratios: files that are sorted by key, and the first and last key of each."""

    def __init__(self, files: list[tuple[str, int, int]], unknown: float):
        self.files, self.unknown = files, unknown

    def _load(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        cache = _worker_cache("toxicity", dict)
        if path not in cache:
            files, at = filesystem(path)
            with files.open_input_file(at) as f:
                table = pq.read_table(f)
            found = tuple(table.column(c).to_numpy() for c in ("key", "llr"))
            if sum(len(x[0]) for x in cache.values()) + len(found[0]) > CACHE_ROWS:
                cache.clear()
            cache[path] = found
        return cache[path]

    def _look(self, keys: np.ndarray) -> np.ndarray:
        """Ratios by key, NaN where there is none."""
        keys, back = np.unique(keys, return_inverse=True)
        out = np.full(len(keys), np.nan, np.float32)
        for path, first, last in self.files:
            i, j = np.searchsorted(keys, first, "left"), np.searchsorted(keys, last, "right")
            if i < j:
                known, llr = self._load(path)
                at = np.minimum(np.searchsorted(known, keys[i:j]), len(known) - 1)
                hit = known[at] == keys[i:j]
                out[i:j][hit] = llr[at[hit]]
        return out[back]

    def llr(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log of P(word | word before, toxic) / P(word | word before, ordinary)."""
        pair, word = self._look(_pair_key(before, words)), self._look(words)
        return np.where(np.isnan(pair), np.where(np.isnan(word), np.float32(self.unknown), word), pair)


def train(labelled: DataFrame) -> Model:
    """Model of ``text, toxic`` rows."""
    return written(keep(count_pairs(labelled.withColumn("apart", F.lit(False))), "pairs"))


def written(pairs: DataFrame) -> Model:
    """Model of counted pairs; the driver learns sums, row counts and the bounds of files."""
    rows, unknown = ratios(pairs)
    n = max(FILES, -(-pairs.filter(kept() > 0).count() // FILE_ROWS))
    # Keys are hashes, so equal shares of their range hold equal shares of the rows.
    part = F.floor((F.col("key").cast("double") + 2.0**63) / 2.0**64 * n).cast("int")
    model = keep(rows.repartitionById(n, part).sortWithinPartitions("key"), "model")
    files = model.groupBy(F.input_file_name().alias("f")).agg(F.min("key").alias("a"), F.max("key").alias("b")).collect()
    return Model(sorted(((r.f, r.a, r.b) for r in files), key=lambda x: x[1]), unknown)


def features(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n, mean, top_short, top_long``: words, and normalised ratios of the whole text and of
    its top windows; a text shorter than a window counts as padded by neutral words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        held, words = [], 0

        def flush():
            ratios = sent.value.llr(*(np.concatenate(x) for x in list(zip(*held))[:2]))
            run = np.concatenate(([0.0], np.cumsum(ratios, dtype=np.float64)))
            ids, n = pa.chunked_array([x[2] for x in held]).combine_chunks(), np.concatenate([x[3] for x in held])
            last = np.cumsum(n)
            mean, top = np.zeros(len(n)), np.zeros((len(WINDOWS), len(n)))
            for i in np.flatnonzero(n):
                own = run[last[i] - n[i]:last[i] + 1]
                mean[i] = (own[-1] - own[0]) / n[i]
                for j, size in enumerate(WINDOWS):
                    k = min(size, n[i])
                    top[j, i] = (own[k:] - own[:-k]).max() / size
            return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(mean), *map(pa.array, top)],
                                              ["doc_id", "n", "mean", "top_short", "top_long"])

        for batch in slices(batches, "text"):
            w, row = _words(batch)
            held.append((w, _contexts(w, row), batch.column("doc_id"), np.bincount(row, minlength=batch.num_rows)))
            words += len(w)
            if words >= FLUSH:
                yield flush()
                held, words = [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        score, "doc_id long, n long, mean double, top_short double, top_long double")


def _design(t: pa.Table) -> np.ndarray:
    n, mean, short, long = (t[c].to_numpy() for c in ("n", "mean", "top_short", "top_long"))
    return np.column_stack([np.ones(len(n)), short, long, mean * np.sqrt(n) / 10, np.log1p(n) / 10])


# Weights of a constant, the two top windows, the whole text and the length before any row is seen.
PRIOR = np.array([-5.0, 1.0, 4.0, 0.0, 0.0])


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, ridge: float = 2.0,
                 rounds: int = 50) -> np.ndarray:
    """Newton steps for a logistic model that a ridge pulls to ``prior``, so few rows move it little."""
    w = prior.copy()
    pull = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ (w - prior))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the features, one row per row of ``docs``.

    A label counts where its id, ``toxic`` value and fold allow; several labels of one id count as
    toxic if any is. Null and empty texts have neutral features and get a score like other texts; null
    ids are in no fold and not held out. Without labelled rows the prior weights are used. Repeated
    rows are scored alike, an empty table gives no rows. Only ``doc_id, text`` are read of ``docs``.
    """
    docs = docs.select("doc_id", "text")
    known = keep(labels.filter("doc_id is not null and toxic is not null").filter(fold() != HELD_OUT)
                 .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    few = hinted(known)
    apart = fold(PARTS) == CALIBRATION
    pairs = keep(count_pairs(docs.join(few, "doc_id").withColumn("apart", apart)), "pairs")
    first = written(pairs.select("v", "w", (F.col("t") - F.col("ct")).alias("t"), (F.col("o") - F.col("co")).alias("o")).filter("t + o > 0"))
    part = features(docs.join(few.filter(apart), "doc_id"), first)
    part = part.join(few, "doc_id").orderBy(F.xxhash64("doc_id")).limit(FIT_ROWS).toArrow()
    rows = features(docs, written(pairs))
    y = part["toxic"].to_numpy().astype(float)
    w = fit_logistic(_design(part), y) if len(y) else PRIOR
    terms = (F.lit(1.0), F.col("top_short"), F.col("top_long"), F.col("mean") * F.sqrt("n") / 10, F.log1p("n") / 10)
    z = sum((float(a) * x for a, x in zip(w, terms)), F.lit(0.0))
    d = rows.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)))))
    return d.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n", "mean", "top_short", "top_long")
