"""A corpus pipeline of five stages: toxicity filter, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all documents of its predecessor and returns the columns of documents; the
last one returns packed pieces. run() writes each stage's documents as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.llm import line_dedup, mixing, near_dedup, packing, toxicity
from lograil.llm.common import materialize, numbered
from lograil.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Learned from labels of the folds that op6 learns from.

    Null and empty texts score 0 and stay; repeated rows and null ids are scored like any others; without labels of both classes the one there is decides (none: all stay). A text is
    scored in all its windows, however long. Other columns than those of documents are dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    net = toxicity.train(docs, labels.filter(toxicity.bucket("doc_id", 5) != 0))
    return toxicity.score(docs, net, out_col="_toxicity").filter(F.col("_toxicity") < 0.5).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in the last of them only; documents stay, even if their text is then empty.

    Null texts stay null. Rows of a null id stay as they are and do not count; rows that repeat an id are one document for the count. n_chars is counted anew; null for a null text.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumns({"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))}).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8.

    Texts without words (null, empty) are copies of nothing and stay, and so do rows of a null id. Rows that repeat an id are compared like any others; of equal rows one stays.
    """
    rows = numbered(docs.select(*COLUMNS), "near-texts")
    gone = near_dedup.near_rows(rows, shingle=5, percent=80).filter(~F.col("kept")).select(F.col("row").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, so sources come near their target weights.

    A null source is one of its own. Documents without words have size 0 and come as often as their hash says; those of a source without any words go. Rows that repeat an id and a source are
    taken alike; rows of a null id too.
    """
    docs = docs.select(*COLUMNS)
    times = mixing.mix(docs).filter("times > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "times").distinct()
    out = docs.join(times, docs["doc_id"].eqNullSafe(times["_id"]) & docs["source"].eqNullSafe(times["_source"]))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as possible. Every row of docs gives its pieces: null and empty texts one of the end id only; only longer texts than 2048 tokens are cut."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path()))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: The network and the tokenizer have no SQL; a test compares run() with a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
