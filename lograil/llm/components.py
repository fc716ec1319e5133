"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.shared import remove, written


def _least(pairs: DataFrame) -> DataFrame:
    """(node, near) pairs with low, the least node of the neighbourhood. Least values are aggregated before the join, so a hot node is only a skewed join."""
    low = pairs.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("low"))
    return pairs.join(low, "node")


def components(edges: DataFrame, a: str = "src", b: str = "dst", name: str = "components", most: int = 50) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node that it reaches.

    Self-loops are dropped, repeated edges count once, and rows with a null end are left out. Each round is written to the shared folder, and the round before is deleted.
    """
    spark = edges.sparkSession
    last = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), name)
    e = spark.read.schema("u long, v long").parquet(last)
    schema = e.schema
    for _ in range(most):
        both = e.select(F.col("u").alias("node"), F.col("v").alias("near")).union(e.select(F.col("v").alias("node"), F.col("u").alias("near")))
        e = _least(both).filter("near > node").select(F.col("near").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        down = e.select(F.col("u").alias("node"), F.col("v").alias("near"))
        small = _least(down)
        e = small.select(F.col("near").alias("u"), F.col("low").alias("v")).union(small.select(F.col("node").alias("u"), F.col("low").alias("v")))
        path = written(e.filter("u <> v").distinct(), name)
        remove(spark, last)  # the next round needs the new edges only
        last, e = path, spark.read.schema(schema).parquet(path)
        # Stars: every node is either a center or has one edge, to a center.
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    raise RuntimeError(f"components did not settle in {most} rounds")
