"""One final order of the lines of many live sources, batch by batch, in as many tasks as there are lines for."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.operators import records
from lograil.shared import delete, materialize

_LINES = "merge string, source string, line_no long, raw string, eff_us long"
_SOURCES = "merge string, source string, top long, heard long"
_GIVEN = "merge string, n long, last struct<us: long, source: string, line_no: long>"


class MergedView:
    """For live.deliver: takes batches of (source, line_no, raw, eff_us, and merge if there are groups) of live_effective_time and writes final lines below path/rows.

    A line is final once every source of its merge group is past its time, or has not been heard of for idle_ms. As times of a source never fall, that is a comparison with the least of the sources' last
    times. A batch adds its lines to those that wait, takes the final ones out, ranks them by range partitions, and numbers them behind those given out before: (merge, nth, source, line_no, raw, eff_us, late).
    late marks lines that come after others of a later place have been given out, such as those of a source that was idle. Lines before the first time of their source come first.

    What waits, the sources' times and the last line given out are tables for each batch number, so a batch that is repeated gives its rows once. Idle sources are looked at when a batch comes; union a `rate` stream
    with null sources for batches without lines. finish gives out what still waits.
    """

    def __init__(self, path: str, idle_ms: int = 500):
        self.path, self.idle_ms, self.last = path.rstrip("/"), idle_ms, -1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._step(batch.sparkSession, batch, batch_id, int(time.time() * 1000), False)

    def finish(self, spark: SparkSession) -> None:
        """Gives out all lines that wait. For when no further lines are expected."""
        self._step(spark, spark.createDataFrame([], _LINES), self.last + 1, int(time.time() * 1000), True)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows").drop("batch")

    def _read(self, spark: SparkSession, kind: str, batch_id: int, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{kind}/{batch_id}")
        except AnalysisException:  # the first batch
            return spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str, batch_id: int, schema: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}/{batch_id}")
        return df.sparkSession.read.schema(schema).parquet(f"{self.path}/{kind}/{batch_id}")

    def _step(self, spark: SparkSession, batch: DataFrame, k: int, now: int, all_final: bool) -> None:
        merge = F.col("merge").cast("string") if "merge" in batch.columns else F.lit("all")
        new = batch.filter("source is not null").select(merge.alias("merge"), F.col("source").cast("string").alias("source"), F.col("line_no").cast("long").alias("line_no"), "raw", F.col("eff_us").cast("long").alias("eff_us"))
        new = self._write(new, "arrived", k, _LINES)  # a stream's batch is read once
        heard = new.groupBy("merge", "source").agg(F.max("eff_us").alias("top")).withColumn("heard", F.lit(now))
        sources = self._read(spark, "sources", k - 1, _SOURCES).unionByName(heard).groupBy("merge", "source").agg(F.max("top").alias("top"), F.max("heard").alias("heard"))
        sources = self._write(sources, "sources", k, _SOURCES)
        active = F.lit(now) - F.col("heard") < self.idle_ms
        low = sources.groupBy("merge").agg(F.count_if(active).alias("active"), F.count_if(active & F.col("top").isNull()).alias("untimed"), F.min(F.when(active, F.col("top"))).alias("low"))
        # low, given and first have a row for each merge group; an exchange by group would put all lines of a group into one task.
        pool = self._read(spark, "waiting", k - 1, _LINES).unionByName(new).join(F.broadcast(low), "merge")
        final = (F.col("active") == 0) | ((F.col("untimed") == 0) & (F.col("eff_us").isNull() | (F.col("eff_us") < F.col("low"))))
        pool = pool.withColumn("final", final | F.lit(all_final)).drop("active", "untimed", "low")
        self._write(pool.filter("not final").drop("final"), "waiting", k, _LINES)
        given = self._read(spark, "given", k - 1, _GIVEN)
        place = F.struct(F.col("eff_us").alias("us"), "source", "line_no")
        out = pool.filter("final").drop("final").join(F.broadcast(given), "merge", "left").withColumn("late", F.coalesce(place < F.col("last"), F.lit(False))).withColumn("before", F.coalesce("n", F.lit(0))).drop("n", "last")
        out = records.ranked(out, F.col("merge"), F.col("eff_us").asc_nulls_first(), F.col("source"), F.col("line_no"), out="rank")
        first = out.groupBy("merge").agg((F.min("rank") - 1).alias("first"), F.count("*").alias("n"), F.max(place).alias("last"))
        first = materialize(first, "first")
        rows = out.join(F.broadcast(first.select("merge", "first")), "merge").select("merge", (F.col("before") + F.col("rank") - F.col("first")).alias("nth"), "source", "line_no", "raw", "eff_us", "late")
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={k}")
        given = given.unionByName(first.select("merge", "n", "last")).groupBy("merge").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        self._write(given, "given", k, _GIVEN)
        for kind in ("arrived", "waiting", "sources", "given"):  # the state before is kept for a repeated batch
            delete(spark, f"{self.path}/{kind}/{k - 2}")
        self.last = k
