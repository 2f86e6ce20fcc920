"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values: (verdict, host, path). A rule fits its host and all subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# One strict term rejects a url; SOFT_HITS distinct soft terms do.
STRICT = ("porn", "xxx", "viagra", "cialis", "cheap-pills", "spam-farm", "malware", "warez",
          "escort", "online-casino", "adult-video", "phishing", "keygen", "torrent-site")
SOFT = ("casino", "poker", "betting", "pills", "cheap", "spam", "farm", "adult", "sex", "nude",
        "dating", "replica", "jackpot", "payday", "loan", "crack", "torrent", "clickbait",
        "lottery", "pharmacy")
SOFT_HITS = 2


def host_of(url: Column) -> Column:
    rest = F.expr("substring(_u, instr(_u, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.translate(
        F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def term_hits(strict=STRICT, soft=SOFT):
    """Pandas UDF: distinct strict and soft terms of a lower-cased url that stand alone.

    A term stands alone when neither neighbour is a letter or digit (a-z, 0-9).
    """
    weights = {**{t: "soft" for t in soft}, **{t: "strict" for t in strict}}

    @F.pandas_udf("strict array<string>, soft array<string>")
    def hits(urls: pd.Series) -> pd.DataFrame:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in weights:
            machine.add_word(term, term)
        if weights:
            machine.make_automaton()
        inner = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        rows = []
        for url in urls:
            found: dict[str, set] = {"strict": set(), "soft": set()}
            if url and weights:
                for end, term in machine.iter(url):
                    start = end + 1 - len(term)
                    if not (start and url[start - 1] in inner) and not (end + 1 < len(url) and url[end + 1] in inner):
                        found[weights[term]].add(term)
            rows.append((sorted(found["strict"]), sorted(found["soft"])))
        return pd.DataFrame(rows, columns=["strict", "soft"])

    return hits


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS,
          page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, strict_terms, soft_terms``, one row per input row.

    The longest fitting rule decides; without one, the vocabulary does. A null url or one without
    ``://`` has an empty host and path and meets no rule; a null url is allowed. Repeated rows are
    judged alike. Extra columns of any name are left out.
    """
    d = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_u"))
    d = d.withColumn("host", F.coalesce(host_of(F.col("_u")), F.lit("")))
    d = d.withColumn("path", F.coalesce(F.when(F.instr("_u", "://") > 0, F.expr(
        r"regexp_extract(substring(_u, instr(_u, '://') + 3 + length(host)), '^[^?#]*', 0)")), F.lit("")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longest is tried first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    d = d.withColumn("_hits", term_hits(strict, soft)(F.translate("_u", UPPER, LOWER)))
    bad = (F.size("_hits.strict") > 0) | (F.size("_hits.soft") >= soft_hits)
    return d.select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
                    F.col("_hits.strict").alias("strict_terms"), F.col("_hits.soft").alias("soft_terms"))


def sql_twin() -> str:
    """The same verdicts in DuckDB: one bounded pattern per term."""
    alone = lambda t: rf"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    up = f"translate(%s, '{UPPER}', '{LOWER}')"
    rows = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fit(h, p)} THEN '{h}{p}'" for _, h, p in rows)
    verdict = " ".join(f"WHEN {fit(h, p)} THEN '{w}'" for w, h, p in rows)
    strict = " OR ".join(alone(t) for t in STRICT)
    soft = " + ".join(f"{alone(t)}::INT" for t in SOFT)
    return f"""
WITH a AS (SELECT page_id, url, coalesce({up % 'url'}, '') AS u, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, u, {up % 'h'} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {strict} OR ({soft}) >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict FROM c"""
