import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from maskloom.operators import routing as R
from maskloom.operators import selection as C
from maskloom.operators.evaluation import lovasz, spearman, training_progress


def steps(spark, queues):
    rows = [(q, t, s[0], s[1], s[2]) for q, ss in enumerate(queues) for t, s in enumerate(ss)]
    return spark.createDataFrame(rows, "queue_id long, t int, q double, manual_s double, ripu double")


def walk(queue, budget, review, choose):
    ret = 0.0
    for i, (q, c, r) in enumerate(queue):
        manual = budget > 0 and choose(i, budget)
        ret += 100 * (1.0 if manual else q)
        budget -= c if manual else review
    return ret


def test_hand_case(spark):
    s = steps(spark, [[(0.2, 12.0, 0.1), (0.9, 8.0, 0.2), (0.5, 30.0, 0.3)]])
    r = R.roll_out(R.queues(s, 10.0), {"auto": R.all_auto(), "first": R.first_come()}, F.lit(10.0), 10.0)
    got = {x["policy"]: x["ret"] for x in r.collect()}
    assert got["auto"] == pytest.approx(160) and got["first"] == pytest.approx(240)
    assert R.hindsight_optimum(s, F.lit(10.0), 10.0).first()["optimum"] == pytest.approx(240)


@pytest.mark.parametrize("review", [0.0, 2.0])
def test_optimum_is_exact_and_never_below_a_policy(spark, review):
    random.seed(11)
    qs = [[(random.random(), float(random.randint(2, 30)), random.random()) for _ in range(8)] for _ in range(20)]
    total = 0.3 * 8 * 12 + 0.7 * 8 * review
    s = steps(spark, qs)
    best = {r["queue_id"]: r["optimum"] for r in
            R.hindsight_optimum(s, F.lit(total), 12.0, review).collect()}

    def dp(q, t, b):
        if t == len(q):
            return 0.0
        v = 100 * q[t][0] + dp(q, t + 1, round(b - review, 6))
        return max(v, 100 + dp(q, t + 1, round(b - q[t][1], 6))) if b > 0 else v

    for i, q in enumerate(qs):
        brute = max(walk(q, total, review, lambda k, b, m=m: m[k]) for m in itertools.product((0, 1), repeat=8))
        assert best[i] == pytest.approx(dp(q, 0, total)) == pytest.approx(brute)
    rolled = R.roll_out(R.queues(s, 12.0), {"auto": R.all_auto(), "first": R.first_come(), "rank": R.score_rank(12.0, review),
                                            "tau": R.score_threshold(0.5)}, F.lit(total), 12.0, review)
    assert all(r["ret"] <= best[r["queue_id"]] + 1e-6 for r in rolled.collect())


def test_time_model_recovers_coefficients(spark):
    random.seed(2)
    rows = [(a := random.random(), b := random.random() * 5, 3 + 7 * a + 2 * b) for _ in range(60)]
    d = spark.createDataFrame(rows, ["a", "b", "y"])
    assert R.solve(R.gram(d, ["a", "b"], "y")) == pytest.approx([3, 7, 2], abs=1e-6)
    assert d.select(R.predicted_seconds(["a"], [-5.0, 0.0]).alias("s")).first()["s"] == 1.0


def captures(spark, n=300):
    random.seed(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("S1" if i % 3 else f"S{i % 5}", i, t0 + dt.timedelta(seconds=random.randint(0, 400000)),
             random.random(), random.random()) for i in range(n)]
    return spark.createDataFrame(rows, "session string, pos long, ts timestamp_ntz, f1 double, f2 double")


def test_gap_filter_equals_brute_force(spark):
    c = captures(spark)
    busy = c.filter("pos % 9 = 0")
    got = {r["pos"] for r in C.far_in_time(c.filter("pos % 9 <> 0"), busy, 3600).collect()}
    all_rows = c.collect()
    taken = [r for r in all_rows if r["pos"] % 9 == 0]
    want = {r["pos"] for r in all_rows if r["pos"] % 9 and all(
        abs((r["ts"] - b["ts"]).total_seconds()) >= 3600 for b in taken if b["session"] == r["session"])}
    assert got == want


def test_time_spread_picks_rounded_ranks(spark):
    got = C.time_spread(captures(spark), ["session"], 7, block_s=5000).groupBy("session").count().collect()
    assert all(r["count"] == 7 for r in got)


def test_farthest_points_keep_the_gap(spark):
    d = captures(spark).withColumns({"forced": F.lit(0), "quota": F.lit(6)})
    p = C.farthest_points(d, ["session"], ["f1", "f2"], gap_s=1800).join(d, ["session", "pos"])
    rows = p.collect()
    for a, b in itertools.combinations(rows, 2):
        if a["session"] == b["session"]:
            assert abs((a["ts"] - b["ts"]).total_seconds()) >= 1800


def test_forced_rows_come_first_and_count(spark):
    d = captures(spark, 60).withColumns({"forced": (F.col("pos") % 20 == 0).cast("int"), "quota": F.lit(5)})
    rows = C.farthest_points(d, ["session"], ["f1", "f2"]).join(d, ["session", "pos"]).orderBy("session", "rank").collect()
    for s, picks in itertools.groupby(rows, lambda r: r["session"]):
        picks = list(picks)
        assert [p["rank"] for p in picks] == list(range(1, len(picks) + 1)) and len(picks) <= 5
        flags = [p["forced"] for p in picks]
        assert flags == sorted(flags, reverse=True)


def test_proposals_follow_the_plan(spark):
    t0 = dt.datetime(2024, 1, 1)
    random.seed(11)
    rows = []
    for n, (s, size, step) in enumerate((("visit", 12, 1), ("node", 400, 20), ("old", 200, 20))):
        rows += [(s, 1000 * n + k, f"f{k}", t0 + dt.timedelta(minutes=step * k), "", s == "old" and k % 50 == 0,
                  random.random(), random.random()) for k in range(size)]
    f = spark.createDataFrame(rows, "session string, pos long, stem string, ts timestamp_ntz, placement string, labelled boolean, f1 double, f2 double")
    plan = spark.createDataFrame([(0, "test", "visit", 4), (1, "pool", "node", 4), (2, "reward", "old", 6), (3, "test", "node", 3)],
                                 "ord int, set string, session string, want int")
    got = C.propose(plan, f, f.limit(0).select("session", "ts"), ["f1", "f2"], ["node"]).collect()
    by = {}
    for r in got:
        by.setdefault((r["set"], r["session"]), []).append(r)
    assert len(by["test", "visit"]) == 6  # a visit keeps no gap
    for rows in by.values():
        assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    node = sorted(r["ts"] for k in (("pool", "node"), ("test", "node")) for r in by[k])
    assert all((b - a).total_seconds() >= 1800 for a, b in zip(node, node[1:]))  # the second set knows the first
    old = sorted(by["reward", "old"], key=lambda r: r["rank"])
    assert [r["relabel"] for r in old[:4]] == ["yes"] * 4 and {r["relabel"] for r in old[4:]} == {""}


def test_a_null_session_is_a_value(spark):
    c = spark.createDataFrame([(None, "a", True, 1), (None, "a", False, 1), ("s", "a", False, 1)], "session string, stem string, labelled boolean, batch int")
    assert sorted(r["labelled"] for r in C.share_label_flag(c).collect()) == [False, True, True]
    r = C.redundancy(c, c.filter("session = 's'")).collect()
    assert len(r) == 3 and {x["same_count"] for x in r if x["session"] is None} == {0}


def test_early_stop_counts_from_the_last_best(spark):
    h = spark.createDataFrame([("r", e, m) for e, m in enumerate([.1, .3, .2, .2, .4, .1, .1, .1])], ["run", "epoch", "miou"])
    p = {r["epoch"]: r for r in training_progress(h, ["run"], 3, block=3).collect()}
    assert [p[e]["stale"] for e in range(8)] == [0, 0, 1, 2, 0, 1, 2, 3]
    assert [p[e]["is_best"] for e in range(8)] == [True, True, False, False, True, False, False, False]


def test_spearman_with_ties(spark):
    d = spark.createDataFrame([("g", x, y) for x, y in ((.1, .2), (.2, .2), (.3, .5), (.4, .1))], ["g", "x", "y"])
    assert spearman(d, ["g"], "x", "y").first()["rho"] == pytest.approx(-0.31623, abs=1e-4)
    same = spearman(d.withColumn("y", F.col("x") * 2), ["g"], "x", "y").first()["rho"]
    assert same == pytest.approx(1.0)


def test_lovasz_matches_sorted_sum(spark):
    random.seed(8)
    rows = []
    for _ in range(40):
        a = random.randint(0, 10) / 10
        rows.append((random.randint(0, 1), [a, 1 - a]))
    got = lovasz(spark.createDataFrame(rows, "truth int, p array<double>"), 2, blocks=4).first()["lovasz"]
    total = []
    for c in (0, 1):
        e = sorted(((round(abs((t == c) - p[c]), 9), int(t == c)) for t, p in rows), reverse=True)
        g = sum(f for _, f in e)
        prev, loss, cf = 0.0, 0.0, 0
        for k, (err, f) in enumerate(e, 1):
            cf += f
            j = 1 - (g - cf) / (g + k - cf)
            loss += err * (j - prev)
            prev = j
        total.append(loss)
    assert got == pytest.approx(sum(total) / 2)


def test_forced_rows_need_no_rounds(spark, capsys):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("S", i, t0 + dt.timedelta(hours=i), float(i * 7 % 11), float(i % 5), int(i < 40), 42) for i in range(50)]
    d = spark.createDataFrame(rows, "session string, pos long, ts timestamp_ntz, f1 double, f2 double, forced int, quota int")
    p = C.farthest_points(d, ["session"], ["f1", "f2"])
    ranks = [r["pos"] for r in p.orderBy("rank").collect()]
    assert ranks[:40] == list(range(40)) and len(ranks) == 42
    p.explain("extended")
    # One window per pick that is left, as forced rows are picks already.
    assert capsys.readouterr().out.split("== Physical Plan ==")[0].count("max_by(") < 42


def test_every_frame_is_a_candidate(spark):
    """An odd frame is proposed wherever it lies, also between the ranks of an even spread of 60."""
    t0 = dt.datetime(2024, 1, 1)
    odd = min(set(range(200)) - {round(i * 199 / 59) for i in range(60)})
    rows = [("visit", k, f"f{k}", t0 + dt.timedelta(minutes=k), "", False, 9.0 if k == odd else k % 3 / 10, 0.0) for k in range(200)]
    f = spark.createDataFrame(rows, "session string, pos long, stem string, ts timestamp_ntz, placement string, labelled boolean, f1 double, f2 double")
    plan = spark.createDataFrame([(0, "pool", "visit", 2)], "ord int, set string, session string, want int")
    got = C.propose(plan, f, f.limit(0).select("session", "ts"), ["f1", "f2"], []).collect()
    assert len(got) == 3 and odd in {r["pos"] for r in got}


def test_picks_of_many_rounds_equal_brute_force(spark):
    random.seed(7)
    t0, want = dt.datetime(2024, 1, 1), 2 * C.PICKS_AT_ONCE + 3
    rows = [(s, i, t0 + dt.timedelta(minutes=random.randint(0, 9000)), random.randint(0, 40) / 10, random.random(),
             int(s == "b" and i % 40 == 0 or s == "c"), want) for s, n in (("a", 150), ("b", 90), ("c", want + 5)) for i in range(n)]
    d = spark.createDataFrame(rows, "session string, pos long, ts timestamp_ntz, f1 double, f2 double, forced int, quota int")
    got = {}
    for r in C.farthest_points(d, ["session"], ["f1", "f2"], gap_s=600).orderBy("session", "rank").collect():
        got.setdefault(r["session"], []).append((r["rank"], r["pos"]))
    for s in "abc":
        own = [r for r in rows if r[0] == s]
        mean = [sum(r[k] for r in own) / len(own) for k in (3, 4)]
        sd = [(sum((r[k] - m) ** 2 for r in own) / len(own)) ** 0.5 for k, m in zip((3, 4), mean)]
        z = {r[1]: [round((r[k] - m) / (v + 1e-9), 6) for k, m, v in zip((3, 4), mean, sd)] for r in own}
        at = {r[1]: r[2] for r in own}
        picks = [r[1] for r in sorted((r for r in own if r[5]), key=lambda r: (r[2], r[1]))]
        left = [r[1] for r in own if not r[5]]

        def far(p):
            return min(round(sum((x - y) ** 2 for x, y in zip(z[p], z[q])), 6) for q in picks) if picks else -round(sum(x * x for x in z[p]), 6)

        while len(picks) < want:
            free = [p for p in left if (not picks or far(p) > 0) and all(abs((at[p] - at[q]).total_seconds()) >= 600 for q in picks)]
            if not free:
                break
            picks.append(min(free, key=lambda p: (-far(p), at[p], p)))
        assert got[s] == list(enumerate(picks, 1))
