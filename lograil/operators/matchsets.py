"""Sets of matching lines as bitmaps: a row (source, block, bits) for each block of 32,768 lines of a source that has a match.

Blocks are dealt out like any rows, so a set of billions of lines is spread over tasks. Bitmaps are mostly zeros, which the files and exchanges that hold them compress.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What joins two sets: lines of both, of either, of the first only.
OPERATIONS = {"and": np.bitwise_and, "or": np.bitwise_or, "minus": lambda a, b: a & ~b}
BLOCK_BYTES = 4096
#: Blocks of two sets that are unpacked at once: a task holds one batch as it came, and a few MB besides.
AT_ONCE = 256


def _block(line_no: Column) -> Column:
    return F.bitmap_bucket_number(line_no + 1)


def _bit(line_no: Column) -> Column:
    return F.bitmap_bit_position(line_no + 1)


def match_set(matches: DataFrame) -> DataFrame:
    """The set of matches (source, line_no); repeated lines count once. Bits are set in each task first, so a source of many matches sends a bitmap for each of its blocks and tasks."""
    return matches.groupBy("source", _block(F.col("line_no")).alias("block")).agg(F.bitmap_construct_agg(_bit(F.col("line_no"))).alias("bits"))


def combined(a: DataFrame, b: DataFrame, operation: str) -> DataFrame:
    """Lines that are in a and in b, in a or in b, or in a minus b. Blocks without lines are left out. Sources are never null."""
    both = a.join(b.withColumnRenamed("bits", "other"), ["source", "block"], {"and": "inner", "or": "full", "minus": "left"}[operation])
    op, schema = OPERATIONS[operation], both.drop("other").schema

    def run(batches):
        x, y = (np.zeros((AT_ONCE, BLOCK_BYTES), np.uint8) for _ in range(2))
        for batch in batches:
            for part in (batch.slice(at, AT_ONCE) for at in range(0, batch.num_rows, AT_ONCE)):
                n = part.num_rows
                for out, column in ((x, part.column("bits")), (y, part.column("other"))):
                    out[:n] = 0
                    for i, bits in enumerate(column):
                        if bits.is_valid:
                            got = np.frombuffer(bits.as_buffer(), np.uint8)
                            out[i, : len(got)] = got
                got = op(x[:n], y[:n])
                some = got.any(axis=1)
                kept = part.select(["source", "block"]).filter(pa.array(some))
                bits = pa.array([row.tobytes() for row in got[some]], pa.binary())
                yield pa.RecordBatch.from_arrays([*kept.columns, bits], ["source", "block", "bits"])

    return both.select("source", "block", "bits", "other").mapInArrow(run, schema)


def _byte(bits: Column, bit: Column) -> Column:
    """The byte that holds a bit, as a number."""
    return F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")


def contains(bits: Column, line_no: Column) -> Column:
    """Whether a block's bitmap holds a line of that block."""
    bit = _bit(line_no)
    return F.coalesce(F.expr("1") == F.call_function("shiftright", _byte(bits, bit), (bit % 8).cast("int")).bitwiseAND(F.lit(1)), F.lit(False))


def marked(lines: DataFrame, matches: DataFrame, out: str = "matched") -> DataFrame:
    """lines (source, line_no, ...) with out: whether the set has the line. Only bitmaps meet the lines, one for each block."""
    d = lines.withColumn("_block", _block(F.col("line_no")))
    m = matches.select(F.col("source").alias("_source"), F.col("block").alias("_of"), F.col("bits").alias("_bits"))
    d = d.join(m, (F.col("source") == F.col("_source")) & (F.col("_block") == F.col("_of")), "left")
    return d.withColumn(out, contains(F.col("_bits"), F.col("line_no"))).drop("_block", "_source", "_of", "_bits")


def restricted(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """The lines of a set."""
    return marked(lines, matches, "_in").filter("_in").drop("_in")


def excluded(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """The lines that are not in a set."""
    return marked(lines, matches, "_in").filter("not _in").drop("_in")


def counts(matches: DataFrame) -> DataFrame:
    """(source, n) of a set."""
    return matches.groupBy("source").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def ranks(asked: DataFrame, matches: DataFrame) -> DataFrame:
    """asked (source, line_no, ...) with rank: how many lines of the set are at the line or before it; total: how many its source has. Bitmaps of earlier blocks are counted once for each block."""
    by = W.partitionBy("source")
    m = matches.withColumn("_n", F.bitmap_count("bits"))
    m = m.select("source", F.col("block").alias("_of"), "bits", F.sum("_n").over(by.orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.lead("block").over(by.orderBy("block")).alias("_next"), F.sum("_n").over(by).alias("_total"))
    # The last block of the set that begins at the line or before it; a source's first block also answers for the lines before.
    m = m.withColumn("_from", F.when(F.col("_before").isNull(), F.lit(0)).otherwise(F.col("_of")))
    block, bit = _block(F.col("line_no")), _bit(F.col("line_no"))
    d = asked.join(m.withColumnRenamed("source", "_source"), (F.col("source") == F.col("_source")) & (block >= F.col("_from")) & (F.col("_next").isNull() | (block < F.col("_next"))), "left")
    whole = F.bitmap_count(F.substring("bits", F.lit(1), F.floor(bit / 8).cast("int")))
    part = F.bit_count(_byte(F.col("bits"), bit).bitwiseAND(F.call_function("shiftleft", F.lit(2), (bit % 8).cast("int")) - 1))
    inside = F.when(block == F.col("_of"), whole + part).when(block > F.col("_of"), F.bitmap_count("bits")).otherwise(0)
    return d.withColumns({"rank": F.coalesce(F.coalesce("_before", F.lit(0)) + inside, F.lit(0)), "total": F.coalesce("_total", F.lit(0))}).drop("_source", "_of", "bits", "_before", "_next", "_from", "_total")
