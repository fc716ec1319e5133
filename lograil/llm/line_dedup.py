"""Line deduplication with keep bitmaps, native.

Keys of long lines are hashed (two 64-bit hashes) and range-partitioned by (hash, document, text, position), which Spark does with sampled
splitters; a hash that a third of the lines share spreads over partitions. Each partition is summed to one row for each of
its hashes, the sums of a hash meet, and the verdict goes back to the rows of that hash by (partition, hash). What comes
out is one keep bitmap for each document that loses lines, as run lengths; the texts are not moved until they are rewritten.
Rows may share an id: a 64-bit digest of the text goes along with it, so each text loses its own lines only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lograil.llm.common import SPACES, ascii_lower, materialize


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line stripped of white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def text_digest(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, pos) of every line to drop (text: its text's digest): its key has min_chars code points, is found in min_docs documents, and a larger id holds it too."""
    spark = docs.sparkSession
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("text"), F.posexplode(F.transform(lines_of(F.col(text_col)), line_key)).alias("pos", "key"))
    lines = lines.filter(F.length("key") >= min_chars).select("id", "text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(parts, "h1", "h2", "id", "text", "pos").sortWithinPartitions("h1", "h2", "id", "text", "pos")
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "line-keys")
    # Documents of a key: rows of one id are neighbours, so a partition can share only its first id with those before.
    sums = ranged.groupBy("h1", "h2", "part", "id").agg(F.lit(1).alias("one")).groupBy("h1", "h2", "part").agg(F.count("*").alias("docs"), F.min("id").alias("low"), F.max("id").alias("top"))
    key = W.partitionBy("h1", "h2")
    again = (F.lag("top").over(key.orderBy("part")) == F.col("low")).cast("int")
    sums = sums.withColumn("docs", F.col("docs") - F.coalesce(again, F.lit(0)))
    sums = sums.withColumns({"all_docs": F.sum("docs").over(key), "last": F.max("top").over(key)}).filter(F.col("all_docs") >= min_docs).select("h1", "h2", "part", "last")
    return ranged.join(sums, ["h1", "h2", "part"]).filter("id < last").select("id", "text", "pos")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(id, text, drops, runs): the sorted dropped positions, and the bitmap as run lengths: kept, dropped, kept, ... lines, ending with a dropped run; all later lines are kept."""
    drops = dropped.groupBy("id", "text").agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    drops = drops.withColumn("_starts", F.filter("drops", lambda x, i: F.coalesce(F.get("drops", i - 1) < x - 1, F.lit(True))))
    drops = drops.withColumn("_ends", F.filter("drops", lambda x, i: F.coalesce(F.get("drops", i + 1) > x + 1, F.lit(True))))
    gaps = F.zip_with("_starts", F.slice(F.concat(F.array(F.lit(-1)), "_ends"), 1, F.size("_ends")), lambda a, b: a - b - 1)
    lengths = F.zip_with("_starts", "_ends", lambda a, b: b - a + 1)
    return drops.withColumn("runs", F.flatten(F.zip_with(gaps, lengths, lambda g, n: F.array(g, n)))).drop("_starts", "_ends")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped, keep_runs (null: all lines stay) and kept_text.

    Lines are split at \\n; a null or empty text is one empty line, and its kept_text is empty. A key of min_chars code points or more
    found in min_docs or more documents loses all its lines except in the largest id that holds it. Rows that repeat an id are one
    document for the count, and each loses the lines of its own text. Rows of a null id are kept as they are and not counted. All columns of docs are returned, but for columns of
    those four names, which are replaced. A text is never cut: a task holds its lines.
    """
    marks = keep_bitmaps(dropped_lines(docs, min_chars, min_docs, id_col, text_col)).withColumnsRenamed({"id": "mark_id", "text": "mark_text"})
    # The columns of docs stay in a struct until the end, so they may have any names.
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "keep_runs", "kept_text")]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = held.join(marks, (F.col("id") == F.col("mark_id")) & (text_digest(F.col("text")) == F.col("mark_text")), "left")
    text = F.col("text")
    bounds = F.zip_with(F.concat(F.array(F.lit(-1)), "drops"), F.concat("drops", F.array(F.size("lines"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rest = F.flatten(F.transform(bounds, lambda x: F.slice(F.col("lines"), x["a"] + 2, F.greatest(x["b"] - x["a"] - 1, F.lit(0)))))
    out = out.withColumn("n_lines", (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long"))
    out = out.withColumn("n_dropped", F.coalesce(F.size(F.filter("drops", lambda x: x < F.col("n_lines"))), F.lit(0)).cast("long"))
    out = out.withColumn("lines", F.when(F.col("drops").isNotNull(), F.split(text, "\n", -1)))
    return out.select("doc.*", "n_lines", "n_dropped", F.col("runs").alias("keep_runs"), F.when(F.col("drops").isNull(), text).otherwise(F.array_join(rest, "\n")).alias("kept_text"))
