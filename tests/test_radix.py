import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from maskloom.operators import radix as R
from maskloom.operators import selection as S
from maskloom.operators.evaluation import average_ranks
from maskloom.operators.routing import MANUAL, uncertainty_rule


def test_bits_are_those_of_the_double(spark):
    random.seed(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 1.0, 2.0, 1 - 2 ** -53, 2 - 2 ** -52]
    values += [struct.unpack("<d", struct.pack("<Q", random.getrandbits(63)))[0] for _ in range(2000)]
    values += [2.0 ** e for e in range(-1074, 1024, 7)]
    values = [v for v in values if v == v and abs(v) != float("inf")]
    values += [-v for v in values]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", R.sortable_bits(F.col("v")).alias("b")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.b == (-bits if r.v < 0 else bits)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(R.sortable_bits(F.col("v"))).collect()
    assert odd[0] == odd[1] and odd[2][0] is None


def narrow(spark, n=6000):
    """Values inside 1e-6 of each other, a key that holds most rows, one value a third of them."""
    random.seed(5)
    rows = [("hot" if i % 10 else f"k{i % 30}", 0.7 if i % 3 == 0 else 0.7 + random.random() * 1e-6, i) for i in range(n)]
    rows += [("hot", None, n), (None, 0.7000001, n + 1), (None, 0.7000002, n + 2), ("none", None, n + 3)]
    return rows, spark.createDataFrame(rows, "k string, v double, i long")


def test_blocks_are_small_or_one_value(spark):
    _, d = narrow(spark)
    got = R.blocks(d, ["k"], "v", 100).groupBy("k", "_block").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    assert all(r.n <= 120 for r in got if r.lo != r.hi) and len(got) > 50
    spans = sorted((r.k, r["_block"], r.lo, r.hi) for r in got if r.k and r.lo is not None)
    assert all(a[0] != b[0] or a[3] < b[2] for a, b in zip(spans, spans[1:]))


def test_text_blocks_follow_the_text(spark):
    rows = [("x", f"scene/{'a' * (i % 4)}{i:05d}") for i in range(900)] + [("x", "scene/")] * 300
    got = R.blocks(spark.createDataFrame(rows, "k string, s string"), ["k"], "s", 50).groupBy("_block").agg(
        F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("_block").collect()
    assert all(r.n <= 50 or r.lo == r.hi for r in got)
    assert all(a.hi < b.lo for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("at", [0.0, 0.3, 0.5, 1.0])
def test_quantiles_equal_the_percentile(spark, at):
    _, d = narrow(spark)
    want = d.filter("v is not null").groupBy("k").agg(F.percentile("v", at).alias("q"), F.count("*").alias("n"))
    got = {r.k: (r.q, r.n) for r in R.quantile(d, ["k"], "v", at, "q", 100).collect()}
    want = {r.k: (r.q, r.n) for r in want.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k][0], abs=1e-15), want[k][1]) for k in want)
    assert R.quantile(d.limit(0), [], "v", at, "q").collect() == []


def test_median_without_keys(spark):
    rows, d = narrow(spark)
    assert R.quantile(d, [], "v", 0.5, "q", 100).first().q == pytest.approx(
        statistics.median(v for _, v, _ in rows if v is not None), abs=1e-15)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.9, 1.0])
def test_highest_share_equals_sorting(spark, share):
    rows, d = narrow(spark, 1500)
    got = {r.i for r in R.highest_share(d, ["k"], "v", "i", share, "top", 40).filter("top").collect()}
    want = set()
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {r[2] for r in mine[:round(len(mine) * share)]}
    assert got == want


def test_uncertainty_rule_keeps_every_row_and_column(spark):
    d = spark.createDataFrame([("a", i, 0.5, "x") for i in range(10)], "batch string, scene_id long, entropy double, note string")
    got = uncertainty_rule(d, "batch", 0.3)
    assert got.columns == ["batch", "scene_id", "entropy", "note", "action"]
    assert sorted(r.scene_id for r in got.filter(F.col("action") == MANUAL).collect()) == [0, 1, 2] and got.count() == 10


def test_average_ranks_inside_a_millionth(spark):
    rows, d = narrow(spark, 900)
    got = {(r.k, r.v): r.r for r in average_ranks(d.filter("v is not null"), ["k"], "v", "r").collect()}
    for k in {r[0] for r in rows}:
        mine = sorted(r[1] for r in rows if r[0] == k and r[1] is not None)
        for v in set(mine):
            assert got[k, v] == mine.index(v) + (mine.count(v) + 1) / 2


def brute_draw(scenes, key, k):
    import hashlib
    return sorted(scenes, key=lambda s: (int(hashlib.sha1(f"{key}:{s}".encode()).hexdigest(), 16) % (1 << 30), s))[:k]


def test_draws_equal_sorting_the_whole_pool(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(5000, None)]
    pool = spark.createDataFrame(rows, "scene_id long, session string")
    got = {}
    for r in S.candidate_batches(pool, 7, 5, 2).collect():
        got.setdefault(r.batch, []).append(r.scene_id)
    sessions = sorted({s for _, s in rows if s}, key=lambda s: (-sum(r[1] == s for r in rows), s))
    for b in range(5):
        scenes = [i for i, s in rows if b % 2 or s == sessions[b // 2]]
        assert sorted(got[b]) == sorted(brute_draw(scenes, f"2:{b}", 7))
    drawn = S.campaign_draw(pool, [3, 9], 4, 2, 3).collect()
    for seed in (3, 9):
        order = brute_draw([i for i, _ in rows], seed, 10)
        assert {(r.scene_id, r.batch) for r in drawn if r.seed == seed} == {
            (s, -1 if p < 4 else (p - 4) // 2) for p, s in enumerate(order)}
    assert S.campaign_draw(pool.limit(0), [3], 4, 2, 3).collect() == []
    assert S.campaign_draw(pool.limit(6), [3], 4, 2, 3).count() == 6


def test_draws_that_fall_short_are_read_again(spark, monkeypatch):
    pool = spark.range(2000).select(F.col("id").alias("scene_id"))
    want = sorted(map(tuple, S.campaign_draw(pool, [1, 2], 30, 10, 2).collect()))
    monkeypatch.setattr(S, "bound_of", lambda k, size: 1 << 20)
    assert sorted(map(tuple, S.campaign_draw(pool, [1, 2], 30, 10, 2).collect())) == want
