"""Languages of words in code-switched text, by a linear-chain conditional random field.

The label of each word is scored by its features (prefixes and suffixes, character n-grams, and what a
lexicon knows of it) and by learned transitions from the word before; forward-backward gives the
probability of every language for every word. A document's language is the one with the largest mean
probability over its words, and that mean is its score; stretches of one language are its runs.

The field is fitted on at most ``FIT_ROWS`` labelled rows of each language, drawn by hash among those of
at most ``FIT_CHARS`` characters. One half of them gives the lexicon, the other half the weights, so that
the weights learn how far a lexicon is to be trusted on words it was not made from. Half of the fitted
sequences are spliced from runs of different documents, which is where changes of language are learned.

Words are runs of ASCII letters and of all other characters outside ASCII, with ASCII and Latin-1
letters in lower case. Forward-backward is exact for texts of any length: stretches of ``BLOCK`` words
are multiplied into one matrix each, stretches are chained, and only then are words scored.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when
there is nothing to learn from. Ties go to the language that sorts first. Repeated rows are rows of
their own; a row without an id is never held out. Columns other than ``doc_id, text, lang`` are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.store import hinted, keep
from maskloom.llm.text import byte_view, hash_words, lower_ascii, mix, slices, word_bounds

FOLDS, HELD_OUT = 4, 2      # fold: crc32 of the id's text, modulo FOLDS
FIT_ROWS = 300              # labelled rows of a language that the fit reads
FIT_CHARS = 20_000          # longest text among them
SEQUENCE = 64               # words of a fitted sequence
EPOCHS, RATE, DECAY = 6, 0.5, 1e-6
SLOTS = 1 << 17             # hashed features of affixes and n-grams
BLOCK = 64                  # words multiplied into one matrix
CHUNK = 1 << 19             # words times languages that are worked on at once
LEAST_RATIO = -50.0         # log of the least share of a word's score that a language keeps

# Bytes that end a word: all of ASCII but letters.
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[:128] = True
NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def fold(of: int = FOLDS):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of, F.lit(-1))


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; every character keeps its bytes' number."""
    out = lower_ascii(data)
    if len(data) > 1:
        two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[two] += 0x20
    return out


class Words:
    """Words of the rows of a string column: their bytes' places, rows, and numbers among distinct ones."""

    def __init__(self, column):
        data, self.bounds = byte_view(column)
        self.data = lower(data)
        self.start, self.end, self.row = word_bounds(self.data, self.bounds, NOT_LETTER)
        hashes = hash_words(self.data, self.start, self.end)
        self.hashes, self.first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.per_row = np.bincount(self.row, minlength=len(self.bounds) - 1)


def features(words: Words, lexicon: "Lexicon") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word, slot, value`` of the features of the distinct words; a word's n-grams weigh as its root of their number.

    Slots below ``lexicon.slots`` say what the lexicon knows, the others are hashed.
    """
    s, e = words.start[words.first], words.end[words.first]
    n = e - s
    # Bytes of the distinct words with a mark before and after each.
    size = n + 2
    at = np.cumsum(size) - size
    word = np.repeat(np.arange(len(n)), size)
    inside = np.arange(int(size.sum())) - np.repeat(at, size)
    raw = np.full(len(word), 1, np.uint64)
    body = (inside > 0) & (inside <= np.repeat(n, size))
    raw[body] = words.data[np.repeat(s, size)[body] + inside[body] - 1]
    left = np.repeat(size, size) - inside  # bytes from here to the word's end, mark included
    out_word, out_slot, out_value = [np.arange(len(n))], [lexicon.slot(words.hashes)], [np.ones(len(n))]
    codes, code = [], np.zeros(len(raw), np.uint64)
    for k in range(5):
        shifted = np.zeros(len(raw), np.uint64)
        shifted[:len(raw) - k] = raw[k:]
        code = code | shifted << np.uint64(8 * k)
        codes.append(code)

    def emit(kind: int, places: np.ndarray, k: int, value) -> None:
        key = codes[k - 1][places] | np.uint64(kind << 48)
        out_word.append(word[places])
        out_slot.append(lexicon.slots + (mix(key * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SLOTS)).astype(np.int64))
        out_value.append(np.broadcast_to(np.asarray(value, np.float64), len(places)))

    for k in (2, 3, 4):
        places = np.flatnonzero(left >= k)
        share = 1.0 / np.sqrt(np.maximum(size - k + 1, 1))
        emit(k, places, k, share[word[places]])
        emit(10 + k, at[size > k], k + 1, 1.0)                # prefixes of k letters
        emit(20 + k, (at + size - k - 1)[size > k], k + 1, 1.0)  # suffixes
    return np.concatenate(out_word), np.concatenate(out_slot), np.concatenate(out_value)


class Lexicon:
    """Words by hash, each with a mark: its most frequent language, and how sure and how frequent that is."""

    GRADES = 4

    def __init__(self, hashes: np.ndarray, marks: np.ndarray, languages: int):
        self.hashes, self.marks, self.slots = hashes, marks, 1 + self.GRADES * languages

    @classmethod
    def count(cls, hashes: np.ndarray, labels: np.ndarray, languages: int) -> "Lexicon":
        known, which = np.unique(hashes, return_inverse=True)
        counts = np.bincount(which * languages + labels, minlength=len(known) * languages).reshape(-1, languages)
        total, best = counts.sum(axis=1), counts.argmax(axis=1)
        sure = counts.max(axis=1) >= 0.9 * total
        grade = np.where(sure, np.where(total >= 3, 0, 1), np.where(2 * counts.max(axis=1) > total, 2, 3))
        return cls(known, 1 + cls.GRADES * best + grade, languages)

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        """Feature of each word; 0 for words that are not here."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.marks[at], 0)


class Field:
    """Weights of features and transitions, for languages in sorted order."""

    def __init__(self, languages: list[str], lexicon: Lexicon, weights: np.ndarray, start: np.ndarray, change: np.ndarray):
        self.languages, self.lexicon, self.weights, self.start, self.change = languages, lexicon, weights, start, change

    def scores(self, words: Words) -> np.ndarray:
        """Score of every language for each distinct word."""
        word, slot, value = features(words, self.lexicon)
        return np.stack([np.bincount(word, self.weights[slot, y] * value, minlength=len(words.hashes))
                         for y in range(len(self.languages))], axis=1)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, hashes=self.lexicon.hashes, marks=self.lexicon.marks, weights=self.weights, start=self.start, change=self.change)
        return out.getvalue()

    @classmethod
    def load(cls, languages: list[str], data: bytes) -> "Field":
        x = np.load(io.BytesIO(data))
        return cls(languages, Lexicon(x["hashes"], x["marks"], len(languages)), x["weights"], x["start"], x["change"])


def _shares(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(axis=-1, keepdims=True), LEAST_RATIO))


def _scaled(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def posteriors(scores: np.ndarray, which: np.ndarray, per_row: np.ndarray, start: np.ndarray, change: np.ndarray):
    """Yield ``(lo, hi, probabilities)`` for words ``lo..hi``: forward-backward over each row's words.

    Word ``i`` has the scores ``scores[which[i]]``; rows follow each other with ``per_row`` words each.
    """
    size = len(start)
    share, first, step = _shares(scores), _shares(start), np.exp(change - change.max())
    rows = np.flatnonzero(per_row)
    n = per_row[rows]
    blocks = -(-n // BLOCK)
    total = int(blocks.sum())
    if not total:
        return
    head = np.cumsum(blocks) - blocks                       # first block of each row
    opens = np.zeros(total, bool)
    opens[head] = True
    place = np.arange(total) - np.repeat(head, blocks)      # block inside its row
    begin = np.repeat(np.cumsum(n) - n, blocks) + place * BLOCK
    length = np.minimum(np.repeat(n, blocks) - place * BLOCK, BLOCK)
    some = max(1, CHUNK // (size * BLOCK))

    def spread(i: int, j: int):
        t = np.arange(BLOCK)
        real = t < length[i:j, None]
        return share[which[np.minimum(begin[i:j, None] + t, len(which) - 1)]], real

    # A matrix per block: from the scores before it to those at its end.
    through = np.empty((total, size, size))
    for i in range(0, total, some):
        j = min(i + some, total)
        x, real = spread(i, j)
        m = np.where(opens[i:j, None, None], np.eye(size), step) * x[:, 0, None, :]
        for t in range(1, int(length[i:j].max())):
            m = np.where(real[:, t, None, None], _scaled(m @ step * x[:, t, None, :], (1, 2)), m)
        through[i:j] = m
    # Chain the blocks of each row, all rows at once.
    before, after = np.empty((total, size)), np.empty((total, size))
    before[head] = first
    tail = head + blocks - 1
    after[tail] = 1.0
    by_size = np.argsort(-blocks, kind="stable")
    head, tail, longest = head[by_size], tail[by_size], -blocks[by_size]
    for k in range(1, int(blocks.max())):
        live = int(np.searchsorted(longest, -k))            # rows with more than k blocks
        at = head[:live] + k
        before[at] = _scaled((before[at - 1, None, :] @ through[at - 1])[:, 0], 1)
        at = tail[:live] - k
        after[at] = _scaled((through[at + 1] @ after[at + 1, :, None])[:, :, 0], 1)
    # Words inside each block.
    for i in range(0, total, some):
        j = min(i + some, total)
        x, real = spread(i, j)
        most = int(length[i:j].max())
        forward = np.empty((most, j - i, size))
        a = np.where(opens[i:j, None], before[i:j], before[i:j] @ step) * x[:, 0]
        forward[0] = a
        for t in range(1, most):
            a = np.where(real[:, t, None], _scaled(a @ step * x[:, t], 1), a)
            forward[t] = a
        b = after[i:j]
        for t in range(most - 1, -1, -1):
            forward[t] *= b
            b = np.where(real[:, t, None], _scaled((b * x[:, t]) @ step.T, 1), b)
        p = _scaled(forward, 2).swapaxes(0, 1)[real[:, :most]]
        lo = int(begin[i])
        yield lo, lo + len(p), p


def _forward_backward(x: np.ndarray, first: np.ndarray, step: np.ndarray):
    """Word probabilities and expected transitions of equally long sequences ``x[sequence, place, language]``."""
    count, length, size = x.shape
    a, norm = np.empty_like(x), np.empty((count, length, 1))
    for t in range(length):
        v = (first if t == 0 else a[:, t - 1] @ step) * x[:, t]
        norm[:, t] = v.sum(axis=1, keepdims=True)
        a[:, t] = v / norm[:, t]
    b = np.ones((count, size))
    p, moves = np.empty_like(x), np.zeros((size, size))
    for t in range(length - 1, -1, -1):
        p[:, t] = a[:, t] * b
        if t:
            back = b * x[:, t] / norm[:, t]
            moves += step * (a[:, t - 1].T @ back)
            b = back @ step.T
    return p, moves


def fit(texts: pa.Array, labels: np.ndarray, languages: list[str], seed: int = 11) -> Field:
    """Field of labelled texts by stochastic gradients of the log-likelihood, with steps that shrink per weight."""
    rng, size = np.random.default_rng(seed), len(languages)
    words = Words(texts)
    of_lexicon = np.zeros(len(labels), bool)
    for y in range(size):
        mine = rng.permutation(np.flatnonzero(labels == y))
        of_lexicon[mine[:len(mine) // 2]] = True
    in_lexicon = of_lexicon[words.row]
    lexicon = Lexicon.count(words.hashes[words.which[in_lexicon]], labels[words.row[in_lexicon]], size)
    word, slot, value = features(words, lexicon)
    order = np.argsort(word, kind="stable")
    word, slot, value = word[order], slot[order], value[order]
    bounds = np.searchsorted(word, np.arange(len(words.hashes) + 1))

    # Sequences: documents as they are, and runs of 3 to 40 words of documents in random order.
    which, label = words.which[~in_lexicon], labels[words.row[~in_lexicon]]
    if len(which) < SEQUENCE:  # hardly anything to learn from: the lexicon's half as well
        which, label = words.which, labels[words.row]
    which, label = (np.resize(x, max(len(x), SEQUENCE)) if len(x) else x for x in (which, label))
    cuts = np.cumsum(rng.integers(3, 41, len(which) // 3 + 1))
    runs = np.split(np.arange(len(which)), cuts[cuts < len(which)])
    spliced = np.concatenate([runs[i] for i in rng.permutation(len(runs))])
    both = np.concatenate((np.arange(len(which)), spliced))
    both = both[:len(both) // SEQUENCE * SEQUENCE].reshape(-1, SEQUENCE)

    weights, start, change = np.zeros((lexicon.slots + SLOTS, size)), np.zeros(size), np.zeros((size, size))
    seen = [np.full_like(x, 1e-2) for x in (weights, start, change)]
    batch = 128
    for _ in range(EPOCHS):
        order = rng.permutation(len(both))
        for i in range(0, len(order), batch):
            at = both[order[i:i + batch]]
            known, inverse = np.unique(which[at], return_inverse=True)
            inverse = inverse.reshape(at.shape)
            sizes = bounds[known + 1] - bounds[known]
            take = np.repeat(bounds[known] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            f_word, f_slot, f_value = np.repeat(np.arange(len(known)), sizes), slot[take], value[take]
            scores = np.stack([np.bincount(f_word, weights[f_slot, y] * f_value, minlength=len(known)) for y in range(size)], axis=1)
            step = np.exp(change - change.max())
            p, moves = _forward_backward(_shares(scores)[inverse], _shares(start), step)
            y = label[at]
            slope = -p
            np.put_along_axis(slope, y[..., None], np.take_along_axis(slope, y[..., None], 2) + 1, 2)
            taken = np.zeros((size, size))
            np.add.at(taken, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            slots, place = np.unique(f_slot, return_inverse=True)
            of_word = np.stack([np.bincount(inverse.ravel(), slope[..., k].ravel(), minlength=len(known)) for k in range(size)], axis=1)
            g = np.stack([np.bincount(place, of_word[f_word, k] * f_value, minlength=len(slots)) for k in range(size)], axis=1) / len(at)
            g -= DECAY * weights[slots]
            seen[0][slots] += g * g
            weights[slots] += RATE * g / np.sqrt(seen[0][slots])
            for x, held, gx in ((start, seen[1], slope[:, 0].sum(axis=0) / len(at)), (change, seen[2], (taken - moves) / len(at))):
                held += gx * gx
                x += RATE * gx / np.sqrt(held)
    return Field(languages, lexicon, weights.astype(np.float32), start, change)


def train(docs: DataFrame) -> Field | None:
    """Field of the rows of ``doc_id, text, lang`` that are not held out; None without any."""
    known = docs.filter(F.col("lang").isNotNull() & (fold() != HELD_OUT) & F.col("text").rlike(r"\p{L}") & (F.length("text") <= FIT_CHARS))
    rows = known.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("draw"))
    counts = keep(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # Some more rows than needed pass by their draw alone; the first of them by draw stay.
    scale = F.pmod("draw", F.lit(1 << 40)) / float(1 << 40)
    few = rows.join(hinted(counts, 10_000), "lang").filter(scale * F.col("n") < 1.5 * FIT_ROWS + 50)
    order = Window.partitionBy("lang").orderBy("draw", "text")
    drawn = few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= FIT_ROWS).select("lang", "draw", "text")
    languages = sorted(r.lang for r in counts.select("lang").collect())
    if not languages:
        return None

    def run(batches):
        table = pa.Table.from_batches(list(batches)).sort_by([("draw", "ascending"), ("lang", "ascending"), ("text", "ascending")])
        labels = np.searchsorted(np.array(languages, object), np.array(table.column("lang").to_pylist(), object))
        field = fit(table.column("text").combine_chunks(), labels, languages)
        yield pa.RecordBatch.from_arrays([pa.array([field.dump()])], ["field"])

    return Field.load(languages, drawn.repartition(1).mapInArrow(run, "field binary").first().field)


LABELLED = "doc_id long, held_out boolean, lang_pred string, score double, runs array<struct<start:int,end:int,lang:string>>"


def label(docs: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, runs``: runs are stretches of words whose likeliest language
    is the same, by code points of the text, end exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        f = sent.value
        for batch in slices(batches, "text"):
            rows = batch.num_rows
            if f is None:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(["und"] * rows), pa.array(np.zeros(rows)),
                     pa.array([[]] * rows, RUNS)], NAMES)
                continue
            words = Words(batch.column("text"))
            size = len(f.languages)
            sums, best = np.zeros((rows, size)), np.empty(len(words.row), np.int64)
            scores = f.scores(words) if len(words.row) else np.zeros((0, size))
            for lo, hi, p in posteriors(scores, words.which, words.per_row, f.start, f.change):
                of = words.row[lo:hi]
                for y in range(size):
                    sums[:, y] += np.bincount(of, p[:, y], minlength=rows)
                best[lo:hi] = p.argmax(axis=1)
            means = sums / np.maximum(words.per_row, 1)[:, None]
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool) & (words.per_row > 0)
            top = means.argmax(axis=1)
            names = np.where(lettered, np.array([*f.languages, "und"], object)[top], "und")
            score = np.where(lettered, np.clip(means[np.arange(rows), top], 0, 1), 0.0)
            # Runs, from places in bytes to places in characters.
            opens = np.ones(len(best), bool)
            opens[1:] = (best[1:] != best[:-1]) | (words.row[1:] != words.row[:-1])
            opens &= lettered[words.row]
            first = np.flatnonzero(opens)
            lasts = np.ones(len(best), bool)
            lasts[:-1] = (best[1:] != best[:-1]) | (words.row[1:] != words.row[:-1])
            last = np.flatnonzero(lasts & lettered[words.row])
            chars = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
            base = chars[words.bounds[words.row[first]]]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(words.row[first], minlength=rows)))).astype(np.int32)
            runs = pa.StructArray.from_arrays(
                [pa.array((chars[words.start[first]] - base).astype(np.int32)), pa.array((chars[words.end[last]] - base).astype(np.int32)),
                 pa.array(np.array(f.languages, object)[best[first]], pa.string())], ["start", "end", "lang"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score),
                 pa.ListArray.from_arrays(pa.array(offsets), runs)], NAMES)

    given = docs.select(F.col("doc_id").cast("long"), (fold() == HELD_OUT).alias("held_out"), "text",
                        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return given.mapInArrow(run, LABELLED)


RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
NAMES = ["doc_id", "held_out", "lang_pred", "score", "runs"]


def identify(docs: DataFrame) -> DataFrame:
    """``label`` with the field that ``docs`` itself trains."""
    return label(docs, train(docs))
