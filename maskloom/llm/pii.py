"""Personal data replaced by keyed surrogates of the same kind and form.

Entities are found by pattern: e-mail and IP addresses, telephone, card, account and identity numbers,
and names after a title or a known given name. A mention's canonical value (case, spaces and
separators removed) decides its surrogate, so mentions of one entity stay mentions of one entity
wherever they stand; names are replaced word by word, by one surrogate whatever the word's role, so a
surname alone, before or after in the text too, still points to the same person. A surrogate keeps length
and separators of numbers, the validity of check digits of cards and accounts, the country code of
telephones, the top-level domain of addresses, the gender and script of names.

Numbers and addresses move along a keyed cycle through all values of their form: different values get
different surrogates, none its own, with nothing to check. Names are drawn, and those that two values share
or that equal a name found in the corpus are drawn again, by joins and aggregates over the table of
distinct names; only mentions travel, not texts. Names are found after titles and known given names only:
lists that a deployment extends (``TITLES``, ``GIVEN``).
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.store import hinted, keep
from maskloom.llm.text import slices

# Patterns of the kinds that stand for themselves, the more specific first.
PATTERNS = {
    "email": r"[\w.%+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?(?!\w)|(?<!\w)\+\d{1,3}[ .-]\(?\d{2,4}\)?[ .-]\d{5,8}(?!\w)|(?<!\w)\+\d{8,14}(?!\w)",
}
KINDS = (*PATTERNS, "name")

# Titles by gender (f, m, or u where the title does not say).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Lady": "f", "Dr": "u", "Prof": "u",
          "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f",
          "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f",
          "Г-н": "m", "Г-жа": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
# Given names that open a name, by gender.
GIVEN = {"f": "Anna Maria Julia Laura Sarah Emma Sophie Claire Marie Camille Petra Sabine Ursula Lucía Carmen Elena "
              "Isabel Mary Jennifer Linda Susan Elizabeth Margaret Patricia Jessica Karen Nancy Olga Ирина Анна Мария "
              "Елена Ольга Наталья Μαρία Ελένη",
         "m": "John James Robert Michael William David Richard Thomas Charles Daniel Peter Paul Hans Jürgen Klaus "
              "Wolfgang Stefan Pierre Jean Jacques François Antoine Carlos José Juan Miguel Javier Pablo Mark George "
              "Иван Сергей Дмитрий Алексей Владимир Γιώργος Νίκος"}
# Syllables and endings that names are built from, by script; endings by gender.
SYLLABLES = {"LATIN": "ba be bo da del do fa fen ga gor ha hel ka kel la len ma mer na nor pa per ra ros sa sel ta tor va vel".split(),
             "CYRILLIC": "ба бо ва ве га да до за ка ко ла ле ма ми на но па ро са та".split(),
             "CJK": "伟 芳 敏 静 丽 磊 军 洋 勇 艳 杰 娟 涛 明 超 秀 霞 平 刚 桂".split(),
             "ARABIC": "با تا دا را سا شا فا كا لا ما نا وا يا".split(),
             "GREEK": "βα γα δα ζα θα κα λα μα να πα ρα σα τα φα χα".split()}
ENDINGS = {"LATIN": {"f": "ina", "m": "ard", "u": "ey", "s": "sen"}, "CYRILLIC": {"f": "ина", "m": "ор", "u": "ан", "s": "ко"},
           "CJK": {"f": "娜", "m": "强", "u": "文", "s": "林"}, "ARABIC": {"f": "ة", "m": "د", "u": "ن", "s": "ي"},
           "GREEK": {"f": "ίνα", "m": "ος", "u": "ις", "s": "ίδης"}}

_FOUND = {k: re.compile(p) for k, p in PATTERNS.items()}
_WORD = r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*"
_OPENERS = [x for g in GIVEN.values() for w in g.split() for x in (w, w.upper())]
_TITLE = "|".join(map(re.escape, sorted({*TITLES, *map(str.upper, TITLES)}, key=len, reverse=True)))
_NAME = re.compile(rf"(?:(?<!\w)({_TITLE})\.? (?:(?:{_TITLE})\.? )*((?:{_WORD})(?: {_WORD}){{0,2}}))"
                   rf"|(?<!\w)((?:{'|'.join(_OPENERS)}) {_WORD})(?!\w)")
_GENDER = {w.lower(): g for g, words in GIVEN.items() for w in words.split()}
_HINTS = re.compile("|".join(map(re.escape, [*TITLES, *map(str.upper, TITLES), *_OPENERS])))


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN").split()[0]
    return name if name in SYLLABLES else "LATIN"


def _capital(word: str) -> bool:
    """Capital, or of a script without capitals."""
    return not word[:1].islower()


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, canonical`` of the entities of a text, in order and without overlap."""
    found = []
    at = "@" in text
    digits = any(c in text for c in "0123456789")
    for kind, pattern in _FOUND.items():
        if at if kind == "email" else digits:
            for m in pattern.finditer(text):
                start, end = m.span()
                value = m[0].lower() if kind in ("email", "iban") else m[0]
                value = value if kind in ("email", "ip") else re.sub(r"[^0-9a-z]", "", value)
                value = "+" + value if kind == "phone" and m[0][0] == "+" else value
                found.append((start, end, kind, value))
    if _HINTS.search(text):
        known: dict[str, str] = {}
        place = 0
        while m := _NAME.search(text, place):
            words, start = (m[2], m.start(2)) if m[2] else (m[3], m.start(3))
            place = start + 1
            title = TITLES.get(m[1], TITLES.get(m[1].title(), "u")) if m[1] else None
            parts = []
            for p in re.finditer(_WORD, words):
                if not _capital(p[0]):
                    break
                parts.append(p)
            if not parts or (title is None and len(parts) < 2):
                continue
            place = start + parts[-1].end()
            for i, p in enumerate(parts):
                given = i < len(parts) - 1 or (title is None and i == 0)
                sure = _GENDER.get(p[0].lower())
                sex = f"0{sure}" if sure else f"1{title}" if given and title in ("f", "m") else "2u" if given else "3s"
                value = f"{script_of(p[0])}:{p[0].lower()}"
                found.append((start + p.start(), start + p.end(), "name", f"{sex}:{value}"))
                known[p[0]] = min(f"{sex}:{value}", known.get(p[0], "9"))
        if known:  # names alone, before or after
            taken = {f[0] for f in found}
            alone = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?!\w)")
            found += [(m.start(), m.end(), "name", known[m[0]]) for m in alone.finditer(text) if m.start() not in taken]
    found.sort(key=lambda f: (f[0], -f[1], KINDS.index(f[2])))
    out, last = [], 0
    for f in found:
        if f[0] >= last:
            out.append(f)
            last = f[1]
    return out


class _Draw:
    """Keyed stream of small integers for one value and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed, self.count, self.left = (key, f"{kind}\0{value}\0{attempt}".encode()), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.seed[0], self.seed[1] + self.count.to_bytes(4, "big"), hashlib.sha256).digest()
            self.count += 1
        word, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return word % n


class Cycle:
    """A keyed order of the numbers below ``size`` in one cycle: ``after(x)`` is another number for every
    ``x`` (from two numbers on), different for different ``x``. A Feistel network walks outside values on.
    """

    ROUNDS = 4

    def __init__(self, key: bytes, name: str, size: int):
        self.size, self.key, self.name = size, key, name.encode()
        self.half = max(1, -(-(size - 1).bit_length() // 2))

    def _round(self, i: int, x: int) -> int:
        given = self.name + b"\0" + bytes([i]) + x.to_bytes((self.half + 7) // 8, "big")
        return int.from_bytes(hashlib.shake_128(self.key + b"\0" + given).digest((self.half + 7) // 8 + 8), "big") & ((1 << self.half) - 1)

    def _walk(self, x: int, back: bool) -> int:
        low = (1 << self.half) - 1
        while True:
            a, b = x >> self.half, x & low
            for i in (reversed(range(self.ROUNDS)) if back else range(self.ROUNDS)):
                a, b = (b ^ self._round(i, a), a) if back else (b, a ^ self._round(i, b))
            x = a << self.half | b
            if x < self.size:
                return x

    def after(self, x: int) -> int:
        return self._walk((self._walk(x, True) + 1) % self.size, False) if self.size > 1 else x


def _like(text: str, key: bytes, name: str, attempt: int = 0) -> str:
    """Another text with letters for letters and digits for digits; everything else stays. Different texts
    of one form get different ones; those with other letters than a to z may need another attempt."""
    form = "".join("9" if c.isdecimal() else "a" if c.isalpha() else c for c in text)
    x, size = 0, 1
    for c, f in zip(text, form):
        if f in "9a":
            base = 10 if f == "9" else 26
            x, size = x * base + (int(c) if f == "9" else (ord(c.lower()) - 97) % 26), size * base
    if not text.isascii():
        name += f"\0{text}\0{attempt}"
    x, out = Cycle(key, f"{name}\0{form}", size).after(x), []
    for f in reversed(form):
        if f in "9a":
            x, d = divmod(x, 10 if f == "9" else 26)
            out.append(str(d) if f == "9" else chr(97 + d))
        else:
            out.append(f)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    doubled = [int(c) * (1 + (i % 2)) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10


def iban_check(country: str, body: str) -> int:
    """The check digits that make an account number valid."""
    return 98 - int("".join(str(int(c, 36)) for c in (body + country).lower())) * 100 % 97


# Country codes of one and of two digits; the others have three.
CODES = {*"17", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 "
         "92 93 94 95 98".split()}


def country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in CODES), digits[:3])


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value.

    Values of one form and fixed part get different surrogates, none its own, so only what is drawn, names
    and addresses in other letters than a to z, is ever drawn again (``attempt``).
    """
    if kind == "email":
        local, _, domain = value.partition("@")
        names, _, top = domain.rpartition(".")
        return f"{_like(f'{local}@{names}', key, 'email ' + top, attempt)}.{top}"
    if kind == "ip":
        parts = value.split(".")
        fixed = 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] else 0
        free = [int(p) for p in parts[fixed:]]
        n = sum(p << 8 * i for i, p in enumerate(reversed(free)))
        n = Cycle(key, "ip " + ".".join(parts[:fixed]), 256 ** len(free)).after(n)
        return ".".join([*parts[:fixed], *(str(n >> 8 * i & 255) for i in reversed(range(len(free))))])
    if kind == "name":
        sex, script, word = value.split(":", 2)
        draw, parts = _Draw(key, kind, f"{script}:{word}", attempt), SYLLABLES[script]
        body = "".join(parts[draw.below(len(parts))] for _ in range(2 + min(attempt, 6)))
        return f"{sex}:{script}:{body}{ENDINGS[script][sex]}"
    if kind == "card":
        new = value[0] + _like(value[1:-1], key, f"card {value[0]}")
        right = lambda d: (10 - luhn(d + "0")) % 10
        return new + str((right(new) + int(value[-1]) - right(value[:-1])) % 10)
    if kind == "iban":
        country, check, body = value[:2], int(value[2:4]), value[4:]
        new = _like(body, key, f"iban {country}")
        if 2 <= check <= 98:  # as far from valid as before
            check = 2 + (iban_check(country, new) - 2 + check - iban_check(country, body)) % 97
        return f"{country}{check:02}{new}"
    keep_first = ("+" + country_code(value[1:])) if value[0] == "+" else ""
    return keep_first + _like(value[len(keep_first):], key, f"{kind} {keep_first}")


def _in_form(mention: str, kind: str, new: str) -> str:
    """A canonical surrogate in the form of the mention it replaces."""
    if kind == "name":
        word = new.split(":", 2)[2]
        return word.upper() if mention.isupper() and len(mention) > 1 else word.capitalize()
    if kind in ("email", "ip"):
        return new.upper() if kind == "email" and mention.isupper() else new
    fresh = iter((new.upper() if kind == "iban" and not mention.islower() else new).removeprefix("+"))
    return "".join(next(fresh) if c.isalnum() else c for c in mention)


MENTION = "_key long, start int, end int, kind string, value string, mention string"


def _scan(docs: DataFrame) -> DataFrame:
    """One row per mention; ``_key`` names the row's id and text."""
    def scan(batches):
        for batch in slices(batches, "text"):
            out = [(k, s, e, kind, v, t[s:e]) for k, t in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist())
                   if t for s, e, kind, v in mentions(t)]
            if out:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 ["_key", "start", "end", "kind", "value", "mention"])

    return keep(docs.select(_row_key().alias("_key"), "text").mapInArrow(scan, MENTION).distinct(), "mentions")


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _bare(value: str = "value", cut: int = 3) -> Column:
    """A name without its evidence (``0f:``) or gender (``f:``); other values as they are."""
    return F.when(F.col("kind") == "name", F.substring(value, cut + 1, 1 << 30)).otherwise(F.col(value))


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, bare, new`` for the distinct values of ``found``; ``bare`` is a name without its gender.

    No two values of a kind share a surrogate. Numbers and addresses get theirs from a keyed order of
    all values of their form, so that always holds and ends even where a corpus has every value of a
    form; names are drawn, and drawn again while two share one or one is a name of the corpus.
    """
    def draw(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("kind", "value", "attempt")]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("value"), b.column("attempt"),
                                              pa.array([surrogate(key, *x) for x in zip(*cols)], pa.string())],
                                             ["kind", "value", "attempt", "new"])

    schema = "kind string, value string, attempt int, new string"
    # A name's best evidence of gender comes first in order; mentions with other evidence share its surrogate.
    whole = keep(found.select("kind", "value", _bare().alias("bare")).distinct().groupBy("kind", "bare").agg(F.min("value").alias("value")), "values")
    values = whole.select("kind", F.when(F.col("kind") == "name", F.substring("value", 2, 1 << 30)).otherwise(F.col("value")).alias("value"))
    now = keep(values.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema), "surrogates")
    while True:
        real = values.filter("kind = 'name'").select("kind", F.col("value").alias("new"))
        owner = now.groupBy("kind", "new").agg(F.min("value").alias("value"), F.count("*").alias("n")).filter("n > 1")
        shared = now.join(owner.select("kind", "new", F.col("value").alias("first")), ["kind", "new"]).filter("value <> first")
        again = keep(shared.select("kind", "value").unionByName(now.join(real, ["kind", "new"], "left_semi").select("kind", "value")).distinct(), "again")
        if again.isEmpty():
            return now.select("kind", _bare("value", 2).alias("bare"), "new")
        redrawn = now.join(again, ["kind", "value"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        now = keep(now.join(again, ["kind", "value"], "left_anti").unionByName(redrawn.mapInArrow(draw, schema)), "surrogates")


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with every mention replaced, and ``replacements`` (start and end in the old text, kind,
    new text), in order.

    Null and empty texts stay as they are; repeated rows are replaced alike; rows with a null id are
    replaced like others; an empty table stays empty. All columns are kept; one of the name
    ``replacements`` is overwritten. ``n_chars``, where it is an integer column, follows the text.
    """
    found = _scan(docs)
    new = assign(found, key)

    def form(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("mention", "kind", "new")]
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("start"), b.column("end"), b.column("kind"),
                                              pa.array([_in_form(*x) for x in zip(*cols)], pa.string())],
                                             ["_key", "start", "end", "kind", "new"])

    placed = found.withColumn("bare", _bare()).join(hinted(new, 200_000), ["kind", "bare"]).mapInArrow(
        form, "_key long, start int, end int, kind string, new string")
    each = keep(placed.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "new"))).alias("_all")), "replacements")
    t = F.col("_row.text")
    pieces = F.transform("_all", lambda y, i: F.concat(
        F.substring(t, F.when(i == 0, 0).otherwise(F.col("_all")[i - 1]["end"]) + 1,
                    y["start"] - F.when(i == 0, 0).otherwise(F.col("_all")[i - 1]["end"])), y["new"]))
    rest = F.substring(t, F.element_at("_all", -1)["end"] + 1, F.length(t))
    text = F.when(F.col("_all").isNull(), t).otherwise(F.concat(F.array_join(pieces, ""), rest))
    d = docs.select(F.struct("*").alias("_row"), _row_key().alias("_key")).join(hinted(each, 100_000), "_key", "left").withColumn("_text", text)
    kind = dict(docs.dtypes)
    cols = [F.col("_text").alias(c) if c == "text" else F.length("_text").cast(kind[c]).alias(c)
            if c == "n_chars" and kind[c] in ("int", "bigint") else F.col("_row")[c].alias(c)
            for c in docs.columns if c != "replacements"]
    none = F.array().cast("array<struct<start:int,end:int,kind:string,new:string>>")
    return d.select(*cols, F.coalesce("_all", none).alias("replacements"))
