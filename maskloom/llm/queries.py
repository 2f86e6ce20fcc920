"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from maskloom.llm import (alignment, decontaminate, languages, near_dups, packing, pii, quality, ranking, secrets, token_files,
                          toxicity, urls, warc)
from maskloom.llm.store import shared_folder

SURROGATE_KEY = b"of this corpus release"  # a deployment passes its own

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return wrap


UPPER, LOWER = urls.UPPER, urls.LOWER

# Exact Jaccard of all pairs with a shingle in common, and reachability over the links.
NEAR_DUPS_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS v FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n k ON k.doc_id = y WHERE 100 * c >= 80 * (m.n + k.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, CASE WHEN l.x = r.b THEN l.y ELSE l.x END FROM r JOIN l ON r.b IN (l.x, l.y))
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2"""

# SHA-1 as 8 groups of 5 hexadecimal digits, each 4 characters of base 32.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = " || ".join(f"substr('{_ALPHABET}', (v[{g}] >> {s} & 31) + 1, 1)" for g in range(1, 9) for s in (15, 10, 5, 0))
WARC_SQL = f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
v AS (SELECT page_id, n, h, list_transform(range(0, 8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::INT) AS v FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS last FROM v)
SELECT page_id, n AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM m"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_cgk_decontamination")
def op1(spark, sf):
    return decontaminate.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op2_bottom_k_near_dups", sql=NEAR_DUPS_SQL)
def op2(spark, sf):
    return near_dups.groups(table(spark, sf, "documents"), words=2)


@query("op3_markov_secrets")
def op3(spark, sf):
    return secrets.find(table(spark, sf, "documents")).drop("found")


@query("op4_kneser_ney_toxicity")
def op4(spark, sf):
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op5_quality_outliers")
def op5(spark, sf):
    return quality.judge(table(spark, sf, "documents"))


@query("op6_url_vocabulary", sql=urls.sql_twin())
def op6(spark, sf):
    return urls.judge(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op7_warc_bundles", sql=WARC_SQL)
def op7(spark, sf):
    got = warc.archive(table(spark, sf, "pages"), shared_folder(spark, "warc"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_swap_packing")
def op8(spark, sf):
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_token_records")
def op9(spark, sf):
    return token_files.round_trip(table(spark, sf, "documents"), shared_folder(spark, "tokens"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_keyed_surrogates")
def op10(spark, sf):
    d = pii.replaced(table(spark, sf, "documents"), SURROGATE_KEY)
    return d.select("doc_id", "text", F.size("replacements").cast("long").alias("n_entities"), "replacements")


@query("op11_crf_languages")
def op11(spark, sf):
    return languages.identify(table(spark, sf, "documents")).drop("runs")


@query("op12_pair_bitmaps")
def op12(spark, sf):
    return alignment.align(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_hybrid_ranking", sql=ranking.sql_twin())
def op13(spark, sf):
    return ranking.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


query("pipeline", sql=corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
