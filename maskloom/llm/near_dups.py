"""Near-duplicate groups by bottom-k sketches, inverted lists and exact Jaccard.

A document's sketch holds the ``K`` smallest hashes, under one hash function, of its distinct word
shingles. Documents with equal sets form a class, represented by the smallest id. Sketch values that
follow each other in hash order are indexed in runs of ``RUN``: of two sets with a Jaccard similarity
of 0.8, each of the smallest ``K`` values of their union is in both with that chance, and the chance
that no run of three is in both is below 5e-7 (it falls with the similarity; below 64 shingles of
union a run always exists when both sketches hold whole sets). Lists of common values alone, such as
shared passages make, are rare and short that way.

Short lists give all their pairs; of long ones a member joins one in ``THIN``, drawn by hash, and is
linked to the next there, so a large group of near copies costs a few pairs per member. Members of a
long list outside its largest component are then compared with a member of that. Estimates from the union's
sketch drop pairs far below the threshold; the rest are confirmed on full sets, first the best pair
of each document, then all that still join different components. A long list whose members then
still belong to several components is not cut short: its members are joined by an exact prefix
filter on their full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.graph import merged
from maskloom.llm.store import hinted, keep
from maskloom.llm.text import byte_view, hash_words, lower_ascii, mix, shingle_hashes, slices, word_bounds

K, RUN = 40, 3
SHORT = 16           # longest list that gives all its pairs
THIN = 10            # of this many long lists, a member is linked in one
BRIDGES = 2          # rounds of comparisons with the largest component of a list
FAR = 0.45           # estimate below which a pair is dropped: 5.5 standard deviations under 0.8
THRESHOLD = 80       # percent
SLICE = 1 << 20      # bytes of text that a task turns into sets at once


def _sets(batch: pa.RecordBatch, words: int):
    """Sorted distinct shingle hashes of each row."""
    data, bounds = byte_view(batch.column("text"))
    data = lower_ascii(data)
    start, end, row = word_bounds(data, bounds)
    hashes = hash_words(data, start, end)
    first = np.searchsorted(row, np.arange(batch.num_rows + 1))
    for i in range(batch.num_rows):
        yield np.unique(shingle_hashes(hashes[first[i]:first[i + 1]], words).view(np.int64))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, f1, f2, sketch``: size and 128-bit fingerprint of each set, and its sketch."""
    def sketch(batches):
        for batch in slices(batches, "text", SLICE):
            n, f1, f2, low = [], [], [], []
            for s in _sets(batch, words):
                n.append(len(s))
                f1.append(s.sum(dtype=np.int64))
                f2.append(mix(s.view(np.uint64)).sum(dtype=np.uint64).astype(np.int64))
                low.append(s[:K])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                 pa.array(low, pa.list_(pa.int64()))], ["doc_id", "n", "f1", "f2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sketch, "doc_id long, n long, f1 long, f2 long, sketch array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node, items``: the full set of each document in ``nodes``."""
    def pack(batches):
        for batch in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(_sets(batch, words)), pa.list_(pa.int64()))], ["node", "items"])

    some = docs.select(F.col("doc_id").cast("long"), "text").join(hinted(nodes.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    return keep(some.mapInArrow(pack, "node long, items array<long>"), "sets")


def _lists(reps: DataFrame) -> DataFrame:
    """``key, node, n, size``: inverted lists of runs of sketch values with two members or more.

    Sets of four and five shingles are indexed by runs of two as well: only those may lack a run of
    three in common. Smaller ones are linked only to equal sets.
    """
    keys = F.expr(f"""concat(
      case when size(sketch) >= {RUN} then transform(sequence(0, size(sketch) - {RUN}), i -> xxhash64(3, sketch[i], sketch[i + 1], sketch[i + 2]))
           else cast(array() as array<bigint>) end,
      case when n in (4, 5) then transform(sequence(0, size(sketch) - 2), i -> xxhash64(2, sketch[i], sketch[i + 1]))
           else cast(array() as array<bigint>) end)""")
    all_ = reps.select("node", "n", F.explode(keys).alias("key"))
    return keep(all_.withColumn("size", F.count("*").over(Window.partitionBy("key"))).filter("size > 1"), "lists")


def _sizes_fit(a: str, b: str):
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _neighbours(lists: DataFrame) -> DataFrame:
    """Candidate pairs: all of short lists, consecutive members of long ones."""
    w = Window.partitionBy("key").orderBy(F.xxhash64("key", "node"), "node")
    me = F.struct("node", "n")
    drawn = (F.col("size") <= SHORT) | (F.pmod(F.xxhash64("node", "key"), F.lit(THIN)) == 0)
    back = F.when(F.col("size") <= SHORT, F.array(*[F.lag(me, j).over(w) for j in range(1, SHORT)])).otherwise(
        F.array(F.lag(me, 1).over(w)))
    d = lists.filter(drawn).withColumn("_back", back).select("node", "n", F.explode("_back").alias("o")).filter("o is not null")
    return _ordered(d.filter(_sizes_fit("n", "o.n")).select(F.col("node").alias("x"), F.col("o.node").alias("y")))


def _bridges(long: DataFrame, seed: int) -> DataFrame:
    """Candidate pairs of long lists ``key, node, n, comp``: a member of each component with a member,
    drawn by ``seed``, of the list's largest."""
    own = long.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min_by(
        F.struct("node", "n"), F.xxhash64(F.lit(seed), "key", "node")).alias("m"))
    hub = own.groupBy("key").agg(F.max_by(F.struct("comp", "m"), F.struct("c", "comp")).alias("h"))
    d = own.join(hub, "key").filter((F.col("comp") != F.col("h.comp")) & _sizes_fit("m.n", "h.m.n"))
    return _ordered(d.select(F.col("m.node").alias("x"), F.col("h.m.node").alias("y")))


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``a, b, est``: pairs whose similarity, estimated from the union's sketch, is not far too low."""
    d = pairs
    for end in ("a", "b"):
        d = d.join(reps.select(F.col("node").alias(end), F.col("sketch").alias(f"s{end}")), end)
    d = d.withColumn("u", F.expr(f"slice(sort_array(array_union(sa, sb)), 1, {K})"))
    d = d.withColumn("est", F.expr("size(array_intersect(array_intersect(sa, sb), u)) / size(u)"))
    return d.filter(F.col("est") >= FAR).groupBy("a", "b").agg(F.max("est").alias("est"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets overlap enough."""
    d = pairs.select("a", "b")
    for end in ("a", "b"):
        d = d.join(sets.select(F.col("node").alias(end), F.col("items").alias(f"i{end}")), end)
    d = d.withColumn("both", F.size(F.array_intersect("ia", "ib")))
    enough = (F.col("both") > 0) & (F.col("both") * 100 >= (F.size("ia") + F.size("ib") - F.col("both")) * THRESHOLD)
    return keep(d.filter(enough).select("a", "b").distinct(), "links")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    d = pairs
    for end in ("a", "b"):
        d = d.join(labels.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}")), end, "left").withColumn(
            f"c{end}", F.coalesce(f"c{end}", end))
    return d.filter("ca <> cb").drop("ca", "cb")


def _prefix_pairs(hard: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Candidates among documents ``node, comp``, found exactly: of sets with enough overlap, the
    rarest fifth (and one) of the shingles of either holds one in common.

    Shingles are ranked by how many of these documents have them. A list gives the pairs between
    different components only, and of those the ones that could still reach the threshold if the
    shingle were their first in common.
    """
    sets = full_sets(docs, hard.select("node"), words)

    each = sets.select("node", F.size("items").cast("long").alias("n"), F.explode("items").alias("v"))
    often = keep(each.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    # A shingle that one document alone has joins nothing: it only takes up room in the prefix.
    ranked = each.join(often, "v", "left").withColumn("rank", F.row_number().over(
        Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "v")))
    first = ranked.filter((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * THRESHOLD / 100) + 1) & F.col("df").isNotNull())
    first = keep(first.select("v", "node", "n", "rank").join(hard, "node"), "prefix")
    x, y = (first.select("v", *[F.col(c).alias(c + e) for c in ("node", "n", "comp", "rank")]) for e in "xy")
    most = 1 + F.least(F.col("nx") - F.col("rankx"), F.col("ny") - F.col("ranky"))  # shingles in common
    reach = most * (100 + THRESHOLD) >= (F.col("nx") + F.col("ny")) * THRESHOLD
    return _ordered(x.join(y, "v").filter((F.col("nodex") < F.col("nodey")) & (F.col("compx") != F.col("compy"))
                                          & _sizes_fit("nx", "ny") & reach).select(F.col("nodex").alias("x"), F.col("nodey").alias("y")))


def groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; fewer than ``words`` words form one
    shingle. Null and empty texts have no shingles and are linked with nothing. Rows with a null id
    cannot be named: they are linked with nothing, have a null component and are kept. Rows that
    repeat an id are one document, linked if any of its texts is. An empty table gives no rows. Only
    ``doc_id`` and ``text`` are read.
    """
    rows = keep(sketches(docs, words), "sketches")
    filled = rows.filter("n > 0 and doc_id is not null")
    classes = keep(filled.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node")), "classes")
    heads = hinted(classes)
    reps = keep(filled.join(heads, ["f1", "f2", "n"]).filter("doc_id = node").select("node", "n", "sketch"), "reps")
    lists = _lists(reps)
    likely = keep(_estimated(_neighbours(lists), reps), "likely")
    sets = full_sets(docs, keep(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes"), words)
    best = keep(likely.select("a", "b", "est", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(
        F.max_by(F.struct("a", "b"), F.struct("est", "a", "b")).alias("e")).select("e.a", "e.b").distinct(), "best")
    named = filled.join(heads, ["f1", "f2", "n"]).select("doc_id", "node").distinct()
    twice = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z")
    same_id = named.join(twice, "doc_id").select("a", F.col("node").alias("b"))  # texts of one id
    labels = merged(None, _verified(best, sets).unionByName(same_id))
    rest = _apart(likely.select("a", "b").join(best, ["a", "b"], "left_anti"), labels)
    labels = merged(labels, _verified(rest, sets))

    def long_lists() -> DataFrame:
        return lists.filter(F.col("size") > SHORT).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    tried = likely.select("a", "b")
    for seed in range(BRIDGES):
        pairs = keep(_estimated(_bridges(long_lists(), seed).join(tried, ["a", "b"], "left_anti"), reps), "bridges")
        if pairs.isEmpty():
            break
        ends = keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
        labels = merged(labels, _verified(pairs, full_sets(docs, ends, words)))
        tried = tried.unionByName(pairs.select("a", "b"))
    long = long_lists()
    split = long.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    hard = keep(long.join(split, "key", "left_semi").select("node", "comp").distinct(), "hard")
    if not hard.isEmpty():
        more = keep(_estimated(_prefix_pairs(hard, docs, words).join(tried, ["a", "b"], "left_anti"), reps), "more")
        more_sets = full_sets(docs, keep(more.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes"), words)
        labels = merged(labels, _verified(more, more_sets))
    d = rows.select("doc_id", "n", "f1", "f2").join(heads, ["f1", "f2", "n"], "left")
    d = d.join(hinted(labels), "node", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node", "doc_id"))
    return d.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"),
                    F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` whose document is kept, one row for each id that is not null."""
    found = keep(groups(docs, words), "groups")
    gone = keep(found.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = docs.join(hinted(gone), "doc_id", "left_anti").select(*docs.columns)
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    return left.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.filter("doc_id is null"))
