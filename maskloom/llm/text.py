"""Words and token ids of whole texts, in bounded memory inside tasks."""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space that ends a word (tab to carriage return, space).
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Bytes between plain words: all of ASCII but letters and digits.
NOT_PLAIN = np.ones(256, bool)
NOT_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_SLICE = 1 << 20  # bytes hashed at once
_P = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    home = _worker_cache("powers", dict)
    if len(home.get("up", ())) < n + 1:
        up = np.full(n + 1, _P, np.uint64)
        down = np.full(n + 1, pow(_P, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        home["up"], home["down"] = np.cumprod(up), np.cumprod(down)
    return home["up"][:n + 1], home["down"][:n + 1]


def _worker_cache(name: str, make):
    """A value that a reused Python worker keeps from task to task."""
    home = sys.modules.setdefault("_maskloom_worker_cache", types.ModuleType("_maskloom_worker_cache"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0]:bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def word_bounds(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a row's end always ends a word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, equal for equal bytes wherever they stand."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SLICE, "right")))
        lo, hi = start[i], end[j - 1]
        up, down = _powers(int(hi - lo))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data[lo:hi]] * up[:-1])))
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 0x41) & (data <= 0x5A)
    return np.where(upper, data + 0x20, data).astype(np.uint8)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text; one longer row stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(size)
        i = 0
        while i < n:
            done = run[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(run, done + most, "right")))
            yield batch.slice(i, j - i)
            i = j


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words; fewer words form one shingle, none form none."""
    n = len(words)
    if not n:
        return words
    m = min(n, k)
    acc = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + words[i:n - m + 1 + i])
    return acc


# Characters with the Unicode property White_Space.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# A space, Latin letters, then other printable ASCII but letters, digits and apostrophes.
_PLAIN = re.compile("( ?)([A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f\\u0131-\\u01c3\\u01cd-\\u024f]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


# Byte-level vocabularies write bytes as printable characters: these stand for themselves, the others
# follow from U+0100 on, in order.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(b) for b in _SELF} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SELF)))}

_PROBES = ("the", " The", "word.", " word,", " Élan", "straße", " ñandú.,", "AKIA", " idea!!", "x", " I", "ǅ", "ŉ")


class ChunkEncoder:
    """Token ids of texts, one encoding per distinct chunk.

    A chunk is a run of white space with the run of other characters after it. Neither vocabulary
    joins characters over a chunk's start, so the ids of a text are those of its chunks, one after
    the other. Encodings of recent chunks are kept, up to ``most`` of them.

    Most new chunks are a Latin word, perhaps after one space and before punctuation. Normalizing and
    splitting those is trivial, so they go straight to the vocabulary's merge model; probes decide
    whether a vocabulary takes the word with its space, as it is, or lower-cased without.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.model, self.shape, self.tails = self.tokenizer.model, None, {}
        for shape in ("as it is", "lower"):
            self.shape = shape
            self.known.clear()
            got = [self._word(p) for p in _PROBES]
            if sum(g is not None for g in got) > 8 and all(g is None or g == self._whole([p])[0] for p, g in zip(_PROBES, got)):
                break
        else:
            self.shape = None
        self.known.clear()

    @staticmethod
    def of(path: str) -> "ChunkEncoder":
        return _worker_cache("encoder:" + path, lambda: ChunkEncoder(path))

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _word(self, chunk: str) -> bytes | None:
        """Ids of a chunk that is a plain word; None if it is not. A word before punctuation is kept by itself."""
        found = _PLAIN(chunk)
        if not found:
            return None
        space, core, tail = found.groups()
        if tail:
            head = space + core
            ids = self.known.get(head) or self._word(head)
            if ids is None:
                return None
            self.known[head] = ids
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self._whole([tail])[0]
            return ids + self.tails[tail]
        if self.shape == "lower":
            core, space = core.lower(), ""
        if not core.isascii():
            if not core.isalpha() or not unicodedata.is_normalized("NFC", core):
                return None
            core = core.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.model.tokenize(_SHOWN[32] + core if space else core)]).tobytes()

    def _learn(self, chunks) -> dict[str, bytes]:
        """Encode what is not known yet; returns the chunks that are too long to keep."""
        wanted = dict.fromkeys(chunks)
        todo = [c for c in wanted if c not in self.known]
        if len(self.known) + len(todo) > self.most:
            self.known.clear()
            todo = list(wanted)
        rest, long = [], {}
        for c in todo:
            ids = self._word(c) if self.shape and len(c) <= 64 else None
            if ids is None:
                rest.append(c)
            else:
                self.known[c] = ids
        for i in range(0, len(rest), 20_000):
            some = rest[i:i + 20_000]
            for c, ids in zip(some, self._whole(some)):
                (self.known if len(c) <= 128 else long)[c] = ids
        return long

    def _joined(self, run: list[str], long: dict[str, bytes]) -> bytes:
        known = self.known
        if long:
            return b"".join([long[c] if c in long else known[c] for c in run])
        return b"".join(map(known.__getitem__, run))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        out: list[bytes] = []
        few: list[list[str]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            long = self._learn(chain.from_iterable(few))
            out.extend(self._joined(run, long) for run in few)
            few.clear()
            held = 0

        for text in texts:
            if text and len(text) >= 2_000_000:
                flush()
                found, parts = _CHUNK.finditer(text), []
                while run := [m[0] for m in islice(found, 200_000)]:
                    parts.append(self._joined(run, self._learn(run)))
                out.append(b"".join(parts))
                continue
            few.append(_CHUNK.findall(text) if text else [])
            held += len(text or "")
            if held > 4_000_000:
                flush()
        flush()
        return out
