"""Connected components by contraction, all of it as joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.store import keep


def relabelled(edges: DataFrame, labels: DataFrame, node: str, comp: str) -> DataFrame:
    """Edges ``a, b`` between components, loops and repeats left out."""
    at = labels.select(F.col(node).alias("_n"), F.col(comp).alias("_c"))
    for end in ("a", "b"):
        edges = edges.join(at, F.col(end) == F.col("_n"), "left").withColumn(
            end, F.coalesce("_c", end)).drop("_n", "_c")
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``node, comp`` with ``comp`` the smallest node reachable over ``edges`` and earlier labels.

    In each round every component points to its smallest neighbour, pointers are followed twice and
    edges are drawn anew between what is left; edges shrink by half or more in a round. Degrees enter
    only as partial minima, so a hub needs no room of its own.
    """
    spark = edges.sparkSession
    if labels is None:
        kind = edges.schema["a"].dataType.simpleString()
        labels = spark.createDataFrame([], f"node {kind}, comp {kind}")
    left = keep(relabelled(edges.select("a", "b"), labels, "node", "comp"), "edges")
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                             F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        up = keep(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "up")
        for _ in range(2):
            above = up.select(F.col("u").alias("p"), F.col("p").alias("_q"))
            up = keep(up.join(above, "p").select("u", F.col("_q").alias("p")), "up")
        old = labels.join(up.withColumnRenamed("u", "comp"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        new = up.join(labels.select(F.col("node").alias("u")), "u", "left_anti").select(F.col("u").alias("node"), F.col("p").alias("comp"))
        labels = keep(old.unionByName(new), "labels")
        left = keep(relabelled(left, up, "u", "p"), "edges")
    return labels
