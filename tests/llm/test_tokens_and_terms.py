"""Languages, alignment and ranking against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from maskloom.llm import alignment, languages, ranking
from maskloom.llm.text import _SHOWN

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- ranking ---

def ranked(docs, items, k=10):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(term(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 25 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in term(text) if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("segment,window", [(2_000_000, 2048), (500, 8)])
def test_ranking_scores_every_document(spark, monkeypatch, segment, window):
    monkeypatch.setattr(ranking, "SEGMENT", segment)
    monkeypatch.setattr(ranking, "WINDOW", window)
    d, b = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    want = ranked([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    got = sorted(tuple(r) for r in ranking.search(d.repartition(3), b).collect())
    assert got == want
    monkeypatch.setattr(ranking, "SLICE_BYTES", 2000)
    assert sorted(tuple(r) for r in ranking.search(d, b).collect()) == want


def test_segment_skips_and_is_exact():
    rng = np.random.default_rng(5)
    for trial in range(30):
        docs, terms = 400, 12
        counts, lists = np.zeros(docs, np.int64), []
        for d in range(docs):
            own = [t for t in range(terms) if rng.random() < (0.9 if t < 3 else 0.02 * t)]
            counts[d] = len(own)
            lists += own
        tfs = rng.integers(1, 4, len(lists))
        n = rng.integers(1, 50, docs)
        ids = rng.permutation(docs).astype(np.int64)
        weights = rng.integers(0, 3000, terms)
        segment = ranking.Segment(ids, n, counts, np.array(lists, np.int64), tfs, weights, docs, int(n.sum()))
        wanted, repeats = rng.choice(terms, 6, replace=False), rng.integers(1, 3, 6)
        best = ranking._Best(7)
        segment.rank(wanted, repeats, best)
        row, score = np.repeat(np.arange(docs), counts), np.zeros(docs, np.int64)
        for t, r in zip(wanted, repeats):
            at = np.array(lists) == t
            m = 25 + 75 * n[row[at]] * docs // int(n.sum())
            score[row[at]] += r * weights[t] * (10**9 * tfs[at] // (1000 * tfs[at] + 8 * m))
        want = sorted((-s, i) for s, i in zip(score, ids) if s > 0)[:7]
        assert [(-s, i) for s, i in zip(best.score, best.doc)] == want


# --- alignment ---

def aligned(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: x for x, c in _SHOWN.items()}
    held, docs_of = [], Counter()
    for doc, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            held.append((doc, 0, 0, 0, [], ""))
            continue
        end_a, end_b = ([*itertools.accumulate(map(len, p))] for p in (parts_a, parts_b))
        links, groups, i, j, x, y = [], [], 0, 0, 0, 0
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            same, earlier = end_a[i] == end_b[j], end_a[i] < end_b[j]
            i, j = i + (same or earlier), j + (same or not earlier)
            if same:
                groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
                x, y = i, j
        held.append((doc, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        docs_of.update(set(links))
    top = Counter()
    for (x, _), n in docs_of.items():
        top[x] = max(top[x], n)
    return sorted((d, n_a, n_b, g, len(links), sum(docs_of[p] == top[p[0]] for p in links), sum(docs_of[p] for p in links), h)
                  for d, n_a, n_b, g, links, h in held)


ODD = ["", "a", " a", "a ", "a\n\nb", "  a  b  ", "x　y", "▁a", "a\0b", "<s>a</s> <|endoftext|>", "<0x41>", "😀 é", None,
       "a;\r\nb\tc);\r\r\n\r x", "x \n word", "日本 é " * 60, "a \r b\r", " ;\r ", "the the the a the", "the"]


@pytest.mark.parametrize("container,links,known", [(1 << 13, 4_000_000, 300_000), (64, 300, 50)])
def test_alignment_counts_every_link(spark, monkeypatch, container, links, known):
    for name, value in (("CONTAINER", container), ("FLUSH_LINKS", links), ("KNOWN", known)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in alignment.align(d, A, B).collect()) == aligned(rows)


def test_long_text_in_runs(spark, monkeypatch):
    monkeypatch.setattr(alignment, "RUN", 7)
    rows = [(1, "some words\tfor a text; that is\r\nlonger than a run. " * 9), (2, "words")]
    assert sorted(tuple(r) for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()) == aligned(rows)


def test_planes_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 5, 600, 8000):
        rows = np.sort(rng.choice(alignment.CONTAINER, n, replace=False))
        times = rng.integers(1, 9, n)
        back, seen = np.zeros(alignment.CONTAINER, np.int64), np.zeros(alignment.CONTAINER, bool)
        for bit, of in alignment.unpack_planes(alignment.pack_planes(rows, times)):
            back[of] += 1 << bit
            seen[of] = True
        assert (np.flatnonzero(seen) == rows).all() and (back[rows] == times).all()


# --- languages ---

def by_enumeration(scores, start, change):
    size = len(start)
    p = np.zeros(scores.shape)
    for path in itertools.product(range(size), repeat=len(scores)):
        s = start[path[0]] + sum(change[a, b] for a, b in zip(path, path[1:])) + sum(scores[i, y] for i, y in enumerate(path))
        for i, y in enumerate(path):
            p[i, y] += math.exp(s)
    return p / p.sum(axis=1, keepdims=True)


def word_by_word(scores, start, change):
    a = [np.exp(start + scores[0])]
    for s in scores[1:]:
        v = a[-1] @ np.exp(change) * np.exp(s)
        a.append(v / v.sum())
    b, out = np.ones(len(start)), []
    for i in range(len(scores) - 1, -1, -1):
        out.append(a[i] * b / (a[i] * b).sum())
        b = np.exp(change) @ (b * np.exp(scores[i]))
        b = b / b.sum()
    return np.array(out[::-1])


@pytest.mark.parametrize("chunk", [1 << 19, 3 * 64 * 5])
def test_posteriors_are_exact(monkeypatch, chunk):
    monkeypatch.setattr(languages, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    size = 3
    scores, start, change = rng.normal(0, 1.5, (40, size)), rng.normal(size=size), rng.normal(0, 1, (size, size))
    per_row = np.array([1, 0, 5, 64, 65, 0, 1000, 7, 128, 3])
    which = rng.integers(0, 40, per_row.sum())
    got = np.full((len(which), size), np.nan)
    for lo, hi, p in languages.posteriors(scores, which, per_row, start, change):
        got[lo:hi] = p
    at = 0
    for n in per_row:
        if n:
            own = scores[which[at:at + n]]
            assert np.allclose(got[at:at + n], word_by_word(own, start, change), atol=1e-9)
            if n <= 7:
                assert np.allclose(got[at:at + n], by_enumeration(own, start, change), atol=1e-9)
        at += n


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(4)
    x, start, change = rng.normal(size=(6, 5, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    p, moves = languages._forward_backward(np.exp(x), np.exp(start), np.exp(change))
    want = np.array([word_by_word(s, start, change) for s in x])
    assert np.allclose(p, want)
    assert np.isclose(moves.sum(), 6 * 4) and np.allclose(moves.sum(axis=1), p[:, :-1].sum(axis=(0, 1)))


def test_held_out_accuracy_and_code_switching(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = languages.train(d)
    got = languages.label(d, field).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    # Halves of two held-out texts in one: the runs find the place, give or take some words.
    text = {r.lang: " ".join(r.text.split()[:30]) for r in d.filter("length(text) > 400").collect() if r.lang}
    mixed = [(i, text[a] + " " + text[b], a, b, len(text[a])) for i, (a, b) in enumerate(itertools.permutations(sorted(text), 2))]
    rows = languages.label(spark.createDataFrame([m[:2] for m in mixed], "doc_id long, text string"), field).collect()
    right = total = 0
    for r in rows:
        _, whole, a, b, cut = mixed[r.doc_id]
        assert all(whole[x.start:x.end] == whole[x.start:x.end].strip() for x in r.runs)
        for x in r.runs:
            for place in range(x.start, x.end):
                total += 1
                right += x.lang == (a if place < cut else b)
    assert right >= 0.9 * total


def test_words_keep_their_places():
    w = languages.Words(pa.array(["Ünder-Ça9x", None, "日本 ÉÀ"]))
    assert [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end)] == ["ünder", "ça", "x", "日本", "éà"]
    assert w.per_row.tolist() == [3, 0, 2]


def test_folds_match_the_contract(spark):
    import zlib
    d = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", (languages.fold() == 2).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in d.collect())
    assert d.filter(F.col("h")).count() > 0
