"""Secret scan: three base patterns, and character Markov models for strings no pattern names.

Two first-order models over characters, one of random strings and one of ordinary identifiers, give
a long token's log-likelihood ratio; tokens above a threshold become spans of kind ``markov``. The
samples are labelled by rule, over all texts: values that a base pattern found are random; words of
letters, ``_``, ``-`` and ``/`` outside base spans are ordinary. Their character pairs are counted,
partially before the shuffle, into a table bounded by the alphabet. Only DataFrame and SQL functions
are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.store import hinted, keep

# Base patterns, the order of kinds, and smallest lengths (of group 2 for assign).
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")
# Equal matches once those that fail are dropped, without listing every short run.
SEARCHED = PATTERNS | {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

WORD = r"[\p{L}\p{N}_+/-]{12,}"   # tokens that are sampled
SCORED = r"^[A-Za-z0-9_+/-]{16,}$"  # tokens that are scored, if they hold a letter and a digit
THRESHOLD = 12.0                    # log-likelihood ratio of the whole token
SMOOTHING = 0.5                     # added to every count of a single character
BACKOFF = 4.0                       # weight of single characters in the pairs of one first character
ALPHABET = 96                       # characters a model tells apart: ASCII and one for the rest
BLOCK = 256

SPAN = "array<struct<s:int,e:int,v:string>>"


def _spans(text: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters: ``s, e, v``.

    The pieces between matches and the matches alternate, so their lengths add up to places; sums
    over blocks keep this cheap for many matches.
    """
    t = F.col(text)
    parts = F.array(F.struct(
        F.split(t, pattern, -1).alias("p"),
        F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(t, F.lit(pattern), F.lit(group)).alias("g")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sized = F.transform(parts, lambda x: F.struct(
        x["m"].alias("m"), x["g"].alias("g"),
        F.transform(x["m"], lambda v, i: F.length(x["p"][i]) + F.length(v)).alias("n")))
    summed = F.transform(sized, lambda x: F.struct(
        x["m"].alias("m"), x["g"].alias("g"), x["n"].alias("n"),
        F.transform(F.sequence(F.lit(0), F.floor((F.size(x["n"]) - 1) / BLOCK).cast("int")),
                    lambda b: total(F.slice(x["n"], b * BLOCK + 1, F.lit(BLOCK)))).alias("b")))
    before = F.transform(summed, lambda x: F.struct(
        x["m"].alias("m"), x["g"].alias("g"), x["n"].alias("n"),
        F.transform(x["b"], lambda v, i: total(F.slice(x["b"], F.lit(1), i))).alias("b")))

    def place(x):
        def one(v, i):
            block = F.floor(i / BLOCK).cast("int")
            end = x["b"][block] + total(F.slice(x["n"], block * BLOCK + 1, i - block * BLOCK + 1))
            return F.struct((end - F.length(v)).alias("s"), end.alias("e"), x["g"][i].alias("v"))
        return F.transform(x["m"], one)

    spans = F.element_at(F.transform(before, place), 1)
    kept = F.filter(spans, lambda y: F.length(y["v"]) >= least)
    none = F.array().cast(SPAN)
    return F.when(t.rlike(pattern), kept).otherwise(none)


def _scan(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """One pass over the texts: base spans by kind and long tokens, all with places."""
    d = docs.select(*carry, F.coalesce("text", F.lit("")).alias("_t"))
    names = [c for c in d.columns if c != "_t"]
    base = {k: _spans("_t", SEARCHED[k], 1 if k == "assign" else 0, LEAST[k]) for k in LEAST}
    return d.select(*names, *[c.alias(k) for k, c in base.items()],
                    _spans("_t", WORD, 0, 0).alias("_words"),
                    F.monotonically_increasing_id().alias("_row"))


def _pairs(token: str) -> Column:
    """The character pairs of a token, as codes below ``ALPHABET``; codes of other characters are one."""
    code = lambda c: F.when(F.ascii(c).between(32, 126), F.ascii(c) - 32).otherwise(ALPHABET - 1)
    at = lambda i: code(F.substring(F.col(token), i, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: at(i) * ALPHABET + at(i + 1))


def train(samples: DataFrame) -> DataFrame:
    """``pair, llr`` from ``v, random`` rows: how much likelier the second character is if random."""
    counts = samples.filter(F.length("v") >= 2).select("random", F.explode(_pairs("v")).alias("pair")).groupBy("pair").agg(
        F.count(F.when(F.col("random"), 1)).alias("r"), F.count(F.when(~F.col("random"), 1)).alias("o"))
    grid = samples.sparkSession.range(ALPHABET * ALPHABET).select(F.col("id").cast("int").alias("pair"))
    full = grid.join(counts, "pair", "left").fillna(0, ["r", "o"]).withColumns(
        {"first": F.expr(f"pair div {ALPHABET}"), "second": F.col("pair") % ALPHABET})
    for by in ("first", "second"):
        full = full.join(full.groupBy(by).agg(F.sum("r").alias(f"r_{by}"), F.sum("o").alias(f"o_{by}")), by)
    all_ = full.agg(F.sum("r").alias("r"), F.sum("o").alias("o")).first()

    def log_p(c: str) -> Column:
        alone = (F.col(f"{c}_second") + SMOOTHING) / (all_[c] + SMOOTHING * ALPHABET)
        return F.log((F.col(c) + BACKOFF * alone) / (F.col(f"{c}_first") + BACKOFF))

    return keep(full.select("pair", (log_p("r") - log_p("o")).alias("llr")), "markov")


def scan(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry``, counts and ``found``, the sorted spans ``s, k, e`` (k: place in ``KINDS``)."""
    rows = keep(_scan(docs, carry), "scan")
    def ranked(kind: str, n: int) -> Column:
        return F.transform(kind, lambda y: F.struct(
            y["s"].alias("s"), F.lit(n).alias("k"), y["e"].alias("e"), y["v"].alias("v")))

    base = F.concat(*[ranked(k, n) for n, k in enumerate(LEAST)])
    rows = rows.withColumn("_base", F.sort_array(base))
    free = lambda w: ~F.exists("_base", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"]))
    words = rows.select("_row", F.explode(F.filter("_words", free)).alias("w")).select("_row", "w.*")
    ordinary = words.filter(F.col("v").rlike(r"^[\p{L}_/-]+$")).select("v", F.lit(False).alias("random"))
    random = rows.select(F.explode("_base.v").alias("v"), F.lit(True).alias("random"))
    model = hinted(train(ordinary.unionByName(random)), ALPHABET * ALPHABET)
    scored = words.filter(F.col("v").rlike(SCORED) & F.col("v").rlike("[A-Za-z]") & F.col("v").rlike("[0-9]"))
    llr = (scored.select("_row", "s", "e", F.explode(_pairs("v")).alias("pair")).join(model, "pair")
           .groupBy("_row", "s", "e").agg(F.sum("llr").alias("llr")).filter(F.col("llr") > THRESHOLD))
    more = llr.groupBy("_row").agg(F.collect_list(F.struct("s", F.lit(3).alias("k"), "e")).alias("_more"))  # one text's
    plain = F.transform("_base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e")))
    d = rows.drop("_words").join(more, "_row", "left").withColumn("_plain", plain)
    names = [c for c in d.columns if c not in ("_row", "_base", "_more", "_plain", *LEAST)]
    return d.select(*names, *[F.size(k).cast("long").alias(f"n_{k}") for k in LEAST], F.col("_plain").alias("_base"),
                    F.when(F.col("_more").isNull(), F.col("_plain")).otherwise(
                        F.sort_array(F.concat("_plain", "_more"))).alias("found"))


def _written(spans: str) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda y: F.concat_ws(
        ":", kind[y["k"]], y["s"].cast("string"), y["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, found``, one row per input row.

    Null and empty texts have no spans: ``spans`` is empty and ``base_sha256`` is that of the empty
    string. Rows with null ids and repeated rows are scanned like any other; an empty table gives no
    rows. Only ``doc_id`` and ``text`` are read.
    """
    d = scan(docs, [F.col("doc_id")])
    return d.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written("_base"), 256).alias("base_sha256"),
                    _written("found").alias("spans"), "found")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every text replaced by ``mark``, overlapping spans by one.

    ``n_chars``, where the table has it, follows the new text. All other columns and rows stay.
    """
    key = lambda: F.xxhash64("doc_id", "text")
    hits = keep(scan(docs, [key().alias("_key")]).filter(F.size("found") > 0).select("_key", "found")
                .dropDuplicates(["_key"]), "secrets")
    t = F.col("_row.text")
    step = lambda a, y: F.when(y["e"] <= a["at"], a).otherwise(F.struct(
        F.when(y["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(t, a["at"] + 1, y["s"] - a["at"]), F.lit(mark))).alias("out"),
        y["e"].alias("at")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    new = F.when(F.col("found").isNull(), t).otherwise(F.aggregate(
        "found", start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t)))))
    d = docs.select(F.struct("*").alias("_row"), key().alias("_key")).join(hinted(hits, 100_000), "_key", "left")
    d = d.withColumn("_new", new)
    kind = dict(docs.dtypes)
    return d.select(*[F.col("_new").alias(c) if c == "text" else F.length("_new").cast(kind[c]).alias(c)
                      if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns])
