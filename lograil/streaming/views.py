"""Tables that streams keep up to date, each batch under its own number, so that a batch that is repeated counts once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.operators import stats
from lograil.shared import delete


class ProfileView:
    """For live.deliver: statistics of all columns of the records so far, with distinct counts and quantiles from sketches and the most frequent values.

    Each batch's own state meets the state of the batch before, and both are tables of a few rows for each column. profile and frequent read the last ones.
    """

    def __init__(self, path: str, columns: Mapping[str, str], counters: int = stats.COUNTERS):
        self.path, self.columns, self.counters, self.last = path.rstrip("/"), dict(columns), counters, -1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # a stream's batch is read once
        try:
            for kind, state, merge in (("profile", stats.profile_state(batch, self.columns), stats.merged_states), ("frequent", stats.frequent_state(batch, self.columns, self.counters), lambda s: stats.merged_frequent(s, self.counters))):
                before = self._state(spark, kind, batch_id - 1)
                merge(state if before is None else before.unionByName(state)).write.mode("overwrite").parquet(f"{self.path}/{kind}/{batch_id}")
                delete(spark, f"{self.path}/{kind}/{batch_id - 2}")  # the one before is kept for a repeated batch
        finally:
            batch.unpersist()
        self.last = batch_id

    def _state(self, spark: SparkSession, kind: str, batch_id: int) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/{kind}/{batch_id}")
        except AnalysisException:  # the first batch
            return None

    def profile(self, spark: SparkSession) -> DataFrame:
        return stats.profile_of(self._state(spark, "profile", self.last))

    def frequent(self, spark: SparkSession, n: int = 10) -> DataFrame:
        """(name, value, at_least, at_most, nth): exact where both are equal, as for columns of at most `counters` values."""
        state = self._state(spark, "frequent", self.last)
        errors = state.filter("value is null").select("name", F.col("count").alias("error"))
        nth = F.row_number().over(stats.W.partitionBy("name").orderBy(F.desc("count"), "value"))
        out = state.filter("value is not null").withColumn("nth", nth).filter(F.col("nth") <= n).join(errors, "name")
        return out.select("name", "value", F.col("count").alias("at_least"), (F.col("count") + F.col("error")).alias("at_most"), "nth")


class BookmarkView:
    """For live.deliver: bookmarks of one stream, in a folder that several streams and people share.

    A batch writes what it found under its stream's name and its own number and reads nothing, so streams never wait for each other, and a repeated batch replaces its own rows only.
    bookmarks has each line once; a manual bookmark of a line is never changed by an automatic one.
    """

    def __init__(self, path: str, stream: str):
        self.path, self.stream = path.rstrip("/"), stream

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        found = batch.select(F.col("source").cast("string").alias("source"), F.col("line_no").cast("long").alias("line_no")).distinct()
        found.withColumn("automatic", F.lit(True)).write.mode("overwrite").parquet(f"{self.path}/automatic/stream={self.stream}/batch={batch_id}")


def add_manual(bookmarks: DataFrame, path: str) -> None:
    """Adds bookmarks (source, line_no) set by hand."""
    bookmarks.select(F.col("source").cast("string").alias("source"), F.col("line_no").cast("long").alias("line_no")).withColumn("automatic", F.lit(False)).write.mode("append").parquet(f"{path.rstrip('/')}/manual")


def bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, automatic) of all bookmarks below path, each line once."""
    every = spark.read.schema("source string, line_no long, automatic boolean").option("recursiveFileLookup", True).parquet(path)
    return every.groupBy("source", "line_no").agg(F.min("automatic").alias("automatic"))
