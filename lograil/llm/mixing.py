"""Mixing sources to target weights by hash thresholds, without sorting documents.

A source of size S and target T takes each document floor(T / S) times, and once more where the document's hash lies below
a threshold, so that the extra words come near T - floor(T / S) * S. The threshold is found on a histogram of words by
(source, 12 leading hash bits); only the bucket that holds the boundary is looked at again, with the next 12 bits, until
it holds one hash. Thresholds are nested: a larger budget takes a superset of documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lograil.llm.common import materialize, n_words_of

BITS, LEVELS = 12, 5


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size) sums. One row for each source, however many documents it has.

    Sources by code point, null last, weigh weights, repeating. Targets are in proportion to the weights and sum to share of
    all sizes, but none exceeds most times its source: the excess is reshared among the others. Sources that are full
    are those with the least most * size / weight, so one running sum over the sources finds them.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_at", F.col("_cap") / F.col("_w"))
    before = W.orderBy("_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("_at", F.col("source").asc_nulls_last()).rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy()
    s = s.withColumn("_total", F.sum("source_size").over(every) * F.lit(float(share)))
    # The level at which this source would fill up, if all that fill up earlier are full.
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    level = -F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", (-F.col("_level")).alias("down")))).over(every)["down"]
    return s.withColumn("target", F.least(F.col("_cap"), F.col("_w") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken): size in words, times a document is taken, taken = size * times.

    A null text has size 0. The hash is taken from the id, so reruns agree, and rows that repeat an id (or have a null one) are taken
    together. A source without words has target 0 and is not taken. Other columns are ignored.
    """
    digest = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 15)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words_of(F.col(text_col)).alias("size"), F.conv(digest, 16, 10).cast("long").alias("_h"))
    base = materialize(base, "mix-sizes")
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0))
    targets = materialize(targets.withColumn("_budget", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-targets")
    # (source, _lo, _left): hashes below _lo are taken, _left words are still to take from _lo on.
    cut = targets.filter("source_size > 0").select(F.col("source").alias("_s"), F.lit(0).cast("long").alias("_lo"), F.col("_budget").alias("_left"))
    inside = base
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        width = 1 << shift
        bucket = F.expr(f"_h - _h % {width}L")
        hist = inside.groupBy("source", bucket.alias("_b")).agg(F.sum("size").alias("_words"), F.count_distinct("_h").alias("_docs"))
        hist = hist.join(cut, F.col("source").eqNullSafe(F.col("_s")))
        run = W.partitionBy("source").orderBy("_b")
        hist = hist.withColumn("_sum", F.sum("_words").over(run)).withColumn("_prev", F.col("_sum") - F.col("_words"))
        # The boundary bucket is the first whose running sum exceeds the budget; none if all fit.
        hit = hist.filter((F.col("_sum") > F.col("_left")) & (F.col("_prev") <= F.col("_left")))
        found = hit.select(F.col("source").alias("_s"), F.col("_b").alias("_lo"), (F.col("_left") - F.col("_prev")).alias("_left"), F.col("_words").alias("_at"), "_docs")
        cut = materialize(found, "mix-cut")
        if level == LEVELS - 1 or not cut.filter("_docs > 1").take(1):
            break
        inside = base.join(cut.select("_s", F.col("_lo").alias("_from")), F.col("source").eqNullSafe(F.col("_s")) & (F.expr(f"_h - _h % {width}L") == F.col("_from"))).select("doc_id", "source", "size", "_h")
        cut = cut.select("_s", "_lo", "_left")
    # What is left of the budget is less than the documents of the boundary; they are taken if that comes nearer.
    cut = cut.select("_s", F.when(F.col("_at") - F.col("_left") < F.col("_left"), F.col("_lo") + F.lit(width)).otherwise(F.col("_lo")).alias("_cut"))
    plan = targets.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").withColumnsRenamed({"source": "_src"}).drop("_s")
    out = base.join(plan, F.col("source").eqNullSafe(F.col("_src")))
    more = F.when(F.col("_cut").isNull(), F.col("_budget") > 0).otherwise(F.col("_h") < F.col("_cut")).cast("long")
    out = out.withColumn("times", F.when(F.col("source_size") > 0, F.col("_whole") + more).otherwise(F.lit(0)))
    out = out.withColumn("times", F.least("times", F.lit(int(most))).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))
