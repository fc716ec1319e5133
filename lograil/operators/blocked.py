"""Order-dependent operators in blocks of lines.

A window over a whole source would put a file on one core. Here each (source, block) is summed up first, a window runs over those summaries
(one row for each block), and what it carries joins the rows of the block, whose windows stay inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_LINES = 100_000


def _blocked(df: DataFrame, block_lines: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col("line_no") / block_lines).cast("long"))


def _inside(last: int = 0):
    return W.partitionBy("source", "_block").orderBy("line_no").rowsBetween(W.unboundedPreceding, last)


def _before():
    return W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)


def _carried(df: DataFrame, summary: Column, carry: Column) -> DataFrame:
    blocks = df.groupBy("source", "_block").agg(summary.alias("_sum")).withColumn("_carry", carry.over(_before())).drop("_sum")
    return df.join(blocks, ["source", "_block"])


def carry_last(df: DataFrame, value: Column, out: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """out: the last non-null value up to each line of its source."""
    d = _blocked(df.withColumn("_v", value), block_lines)
    d = _carried(d, F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("line_no"))), F.last("_sum", ignorenulls=True))
    return d.withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(_inside()), "_carry")).drop("_v", "_carry", "_block")


def running_max(df: DataFrame, value: Column, out: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """out: the greatest value up to each line of its source; null before the first."""
    d = _blocked(df.withColumn("_v", value), block_lines)
    d = _carried(d, F.max("_v"), F.max("_sum"))
    return d.withColumn(out, F.greatest(F.max("_v").over(_inside()), F.col("_carry"))).drop("_v", "_carry", "_block")


def previous(df: DataFrame, value: Column, out: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """out: the value of the line before, null included."""
    d = _blocked(df.withColumn("_v", F.struct(value.alias("x"))), block_lines)
    d = _carried(d, F.max_by("_v", "line_no"), F.last("_sum"))
    near = W.partitionBy("source", "_block").orderBy("line_no")
    return d.withColumn(out, F.coalesce(F.lag("_v").over(near), F.col("_carry"))["x"]).drop("_v", "_carry", "_block")


def running_sum(df: DataFrame, value: Column, out: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """out: the sum of the values of all lines before."""
    d = _blocked(df.withColumn("_v", value), block_lines)
    d = _carried(d, F.sum("_v"), F.sum("_sum"))
    return d.withColumn(out, F.coalesce("_carry", F.lit(0)) + F.coalesce(F.sum("_v").over(_inside(-1)), F.lit(0))).drop("_v", "_carry", "_block")
