"""Every operator and stage on nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from maskloom.llm import (alignment, decontaminate, languages, near_dups, packing, pii, quality, ranking, secrets, token_files,
                          toxicity, urls, warc)
from maskloom.llm.store import shared_folder

PROSE = " ".join(f"w{i % 97}x{i % 89}" for i in range(120))
LONG = " ".join(f"long{i}" for i in range(60_000))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
ROWS = [(1, PROSE, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, LONG, "en", None), (5, PROSE, "de", "b"),
        (None, PROSE + " end", "en", "a"), (1, PROSE, "en", "a"), (6, PROSE + f" {ITEM} tail", None, "b"),
        (7, 'x token = "0123456789abcdef0123" y@z.example.com', "en", "a"), (8, " \t\n\x0b ", "en", "a"), (9, "日本 é " * 60, "ja", "c")]
# Names that operators use inside, given to the table.
CLASHES = ("_row", "_key", "_t", "kept", "cell", "n", "node", "found", "hits", "distance", "size", "key", "value", "bad")


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (None, ITEM), (3, ""), (4, "the of"), (1, ITEM)], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (5, 1), (7, 1), (7, 0), (4, None), (None, 1), (9, 0)], "doc_id long, toxic int")


OPERATORS = {
    "decontaminate": lambda s, d, b, l: decontaminate.find(d, b),
    "near_dups": lambda s, d, b, l: near_dups.groups(d, 2),
    "secrets": lambda s, d, b, l: secrets.find(d),
    "toxicity": lambda s, d, b, l: toxicity.score(d, l),
    "quality": lambda s, d, b, l: quality.judge(d),
    "token_files": lambda s, d, b, l: token_files.round_trip(d, shared_folder(s, "t"), public_tokenizers.path("byte_bpe_50k.json"), tasks=3),
    "languages": lambda s, d, b, l: languages.identify(d),
    "alignment": lambda s, d, b, l: alignment.align(d, public_tokenizers.path("byte_bpe_50k.json"),
                                                    public_tokenizers.path("piece_bpe_32k.model")),
    "pii": lambda s, d, b, l: pii.replaced(d, b"k"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, docs, bench, labels, name):
    got = OPERATORS[name](spark, docs, bench, labels)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert len(set(got.columns)) == len(got.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, bench, labels, name):
    assert OPERATORS[name](spark, docs.limit(0), bench, labels).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns(spark, docs, bench, tmp_path, name, stage):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    ids = [r.doc_id for r in got.collect()]
    gone = {"quality_rules": {2, 3, 7, 8}, "near_dedup": {5}, "decontamination": {6}, "secret_scan": set()}[name]
    assert not gone & set(ids) and (None in ids)
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    if name == "near_dedup":  # a repeated id stays once
        assert ids.count(1) == 1 and {2, 3, 4, 7, 8, 9} <= set(ids)


def test_packing_edges(spark, docs):
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    assert [r.length for r in got if r.doc_id in (2, 3, 8)] == [1, 1, 1]
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_urls_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme cheap-pills"), (4, "HTTP://A.NET/x"), (5, "http://x.net"), (None, "https://m.Example.net/en/1?q"),
            (7, "http://h.org/fr/a#b/c"), (7, "http://h.org/fr/a#b/c"), (8, "http://cheapest-pillset.com"), (9, "http://shop.com/cheap/adult"),
            (10, "http://net/a"), (11, "http://u@b.example.com/de/?x/"), (12, "://?q")]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("_u", F.lit(1))
    got = {r.page_id: r for r in urls.judge(d).collect()}
    assert urls.judge(d).count() == len(rows) and urls.judge(d.limit(0)).count() == 0
    verdicts = {k: (got[k].rule, got[k].verdict) for k in got}
    assert verdicts[1] == verdicts[2] == (None, "allow") and verdicts[3] == (None, "block")
    assert verdicts[4] == ("net/", "block") and verdicts[5] == (None, "allow")  # an empty path does not start with a slash
    assert verdicts[None] == ("example.net/en/", "allow") and verdicts[7] == ("org/fr/", "allow")
    assert verdicts[8] == (None, "allow") and verdicts[9] == (None, "block") and verdicts[10] == ("net/", "block")
    assert (got[11].host, got[11].path, got[11].rule) == ("u@b.example.com", "/de/", "example.com/de/")
    assert (got[12].host, got[12].path) == ("", "")


def test_warc_edges(spark):
    rows = [(1, "http://a/\r\nx%", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"),
            (5, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 1000), (5, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 1000), (9, "u", "y" * 700_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(3)).withColumn("sha", F.lit(0))
    folder = shared_folder(spark, "warc")
    got = sorted(warc.archive(d, folder, tasks=2).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].refers_to == 2 and by[2].record_type == "response" and by[3].refers_to == 4 and by[None].refers_to is None
    assert by[1].url == "http://a/\r\nx%" and by[2].url is None and by[1].payload is None and bytes(by[2].payload) == "<p>é</p>".encode()
    assert by[3].payload_bytes == 0 and by[3].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert [r.record_type for r in got if r.page_id == 5] == ["response"] * 2
    one = warc.fetch(spark, folder, spark.createDataFrame([("urn:x-page:9",), ("urn:x-page:1",)], "record_id string")).collect()
    assert {r.page_id: r.payload_bytes for r in one} == {9: 700_000, 1: 9}
    assert warc.archive(d.limit(0), shared_folder(spark, "warc")).collect() == []


def test_ranking_edges(spark, docs, bench):
    got = ranking.search(docs, bench, k=3).collect()
    # Each item row with terms ranks on its own: item 1 twice, a null id, and one whose terms no document holds.
    assert [(r.rank, r.doc_id) for r in got if r.item_id == 1] == [(1, 6)] * 2
    assert [(r.rank, r.doc_id) for r in got if r.item_id is None] == [(1, 6)]
    assert {r.item_id for r in got} == {1, None}
    assert ranking.search(docs.limit(0), bench).collect() == [] and ranking.search(docs, bench.limit(0)).collect() == []
    assert ranking.search(docs.limit(0), bench.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    ties = spark.createDataFrame([(i, "same words") for i in (5, 3, None, 9, 3)] + [(10, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same same")], "item_id long, text string")
    assert [(r.rank, r.doc_id) for r in ranking.search(ties, items, 4).orderBy("rank").collect()] == [(1, None), (2, 3), (3, 3), (4, 5)]


def test_languages_edges(spark, docs):
    got = {r.doc_id: r for r in languages.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 and not got[i].runs for i in (2, 3, 8))
    assert got[9].lang_pred == "ja" and got[None].held_out is False
    nothing = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in languages.identify(nothing).collect()} == {("und", 0.0)}
