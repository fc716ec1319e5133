"""Multi-line records, context lines, and lines by time."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lograil.functions import kinds, times
from lograil.operators import blocked
from lograil.shared import materialize

# How a continuation line begins.
CONTINUATION = r'^(?:$|[ \t]|at |Caused by:|Suppressed:|Traceback \(most recent call last\)|File "|\.\.\. |\s+$)'
TIMESTAMP_START = r"^[\[(<]?\s*(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\w{3}/\d{4}|[A-Z][a-z]{2} [ \d]\d \d{2}:|\d{2}:\d{2}:\d{2}|\d{10,19}\b)"


def is_continuation(raw: Column) -> Column:
    return raw.rlike(CONTINUATION)


def record_start(raw: Column, accepted: Column | None = None, pattern: str | None = None) -> Column:
    """A line starts a record if its format accepts it, a pattern matches, or else it begins like a timestamped line and not like a continuation."""
    if accepted is not None:
        return F.coalesce(accepted, F.lit(False))
    return raw.rlike(pattern) if pattern else ~is_continuation(raw) & raw.rlike(TIMESTAMP_START)


def with_record(lines: DataFrame, start: Column, block_lines: int = blocked.BLOCK_LINES) -> DataFrame:
    """lines with rec_id, the line number of the record that each belongs to; null before the first record of a source."""
    return blocked.carry_last(lines, F.when(start, F.col("line_no")), "rec_id", block_lines)


def bodies(lines: DataFrame) -> DataFrame:
    """(source, rec_id, n_lines, body) of lines with rec_id."""
    out = lines.filter("rec_id is not null").groupBy("source", "rec_id").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("x"))
    return out.select("source", "rec_id", "n_lines", F.array_join(F.transform("x", lambda r: r["raw"]), "\n").alias("body"))


def with_context(lines: DataFrame, matched: Column, before: int = 0, after: int = 0) -> DataFrame:
    """Matching lines and those around them, with is_context; a match wins. Matches are spread to the line numbers they show, so no window is needed."""
    if not 0 <= before <= 200 or not 0 <= after <= 200:
        raise ValueError("0 to 200 lines of context")
    hits = lines.filter(F.coalesce(matched, F.lit(False))).select("source", F.col("line_no").alias("_at"))
    shown = hits.select("source", F.explode(F.sequence(F.col("_at") - before, F.col("_at") + after)).alias("line_no"), "_at")
    shown = shown.groupBy("source", "line_no").agg(F.min(F.col("line_no") != F.col("_at")).alias("is_context"))
    return lines.join(shown, ["source", "line_no"])


def effective_time(lines: DataFrame, ts: Column, block_lines: int = blocked.BLOCK_LINES) -> DataFrame:
    """lines with eff_ts: the greatest timestamp so far, so that no source goes back in time; null before the first."""
    return blocked.running_max(lines, ts, "eff_ts", block_lines)


def merged(lines: DataFrame, source_order: Column | None = None) -> DataFrame:
    """Lines with eff_ts of many sources in one order: time, then source, then line; lines before the first timestamp first."""
    return lines.orderBy(F.col("eff_ts").asc_nulls_first(), source_order if source_order is not None else F.col("source"), "line_no")


def first_at_or_after(lines: DataFrame, ts: Column, target: Column) -> DataFrame:
    """(source, line_no): the first line of each source at or after a time."""
    return lines.filter(ts >= target).groupBy("source").agg(F.min("line_no").alias("line_no"))


def gaps(lines: DataFrame, ts: Column, seconds: float = 5.0, block_lines: int = blocked.BLOCK_LINES) -> DataFrame:
    """Lines whose timestamp is at least so many seconds after that of the line before, with gap_us. A null on either side is no gap; 0 or less is off."""
    d = blocked.previous(lines.withColumn("_ts", ts), F.col("_ts"), "_prev", block_lines)
    d = d.withColumn("gap_us", F.unix_micros("_ts") - F.unix_micros("_prev"))
    return d.filter((F.col("gap_us") > 0) & (F.col("gap_us") >= seconds * 1e6) & F.lit(seconds > 0)).drop("_ts", "_prev")


def since_previous(lines: DataFrame, ts: Column, block_lines: int = blocked.BLOCK_LINES) -> DataFrame:
    """lines with delta_us since the line before."""
    d = blocked.previous(lines.withColumn("_ts", ts), F.col("_ts"), "_prev", block_lines)
    return d.withColumn("delta_us", F.unix_micros("_ts") - F.unix_micros("_prev")).drop("_ts", "_prev")


def neighbours(matches: DataFrame, at: int) -> DataFrame:
    """(source, next_line, previous_line, rank, total): around line `at`, wrapping around."""
    n = F.col("line_no")
    out = matches.groupBy("source").agg(F.min(F.when(n > at, n)).alias("a"), F.min("line_no").alias("lo"), F.max(F.when(n < at, n)).alias("b"), F.max("line_no").alias("hi"), F.count_if(n <= at).alias("rank"), F.count("*").alias("total"))
    return out.select("source", F.coalesce("a", "lo").alias("next_line"), F.coalesce("b", "hi").alias("previous_line"), "rank", "total")


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of each source, without a sort: line numbers are dense."""
    totals = lines.groupBy("source").agg(F.max("line_no").alias("_last"))
    return lines.join(totals, "source").filter(F.col("line_no") > F.col("_last") - n).drop("_last")


def percent_line(lines: DataFrame, percent: float) -> DataFrame:
    """(source, line_no) at a percentage of each source."""
    return lines.groupBy("source").agg((F.max("line_no") + 1).alias("n")).select("source", F.least(F.floor(F.lit(percent / 100) * F.col("n")), F.col("n") - 1).cast("long").alias("line_no"))


def slice_lines(lines: DataFrame, first: int, count: int) -> DataFrame:
    """count lines of each source from line first on."""
    return lines.filter(F.col("line_no").between(first, first + count - 1))


def go_to(lines: DataFrame, text: str, current: int = 0) -> DataFrame:
    """(source, line_no) of `120` (the line of that number, from 1), `+10` and `-5` (from line current on) or `50%`, at most the last line. Raises ValueError for anything else."""
    t = text.strip()
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*%", t):
        return percent_line(lines, min(float(m[1]), 100.0))
    if not re.fullmatch(r"[+-]?\d+", t):
        raise ValueError(f"no line: {text!r}; try 120, +10, -5 or 50%")
    at = current + int(t) if t[0] in "+-" else int(t) - 1
    return lines.groupBy("source").agg(F.greatest(F.lit(0), F.least(F.lit(at), F.max("line_no"))).cast("long").alias("line_no"))


def go_to_time(lines: DataFrame, ts: Column, text: str, now: str) -> DataFrame:
    """(source, line_no): the first line of each source at or after a time, `-15m` before its last, `+1h` after its first, or today's `10:15`."""
    kind, value = times.goto_target(text, now)
    if kind == "at":
        return first_at_or_after(lines, ts, F.lit(value).cast("timestamp"))
    us = F.unix_micros(ts)
    ends = lines.groupBy("source").agg((F.min(us) + int(value * 1e6) if kind == "start" else F.max(us) - int(value * 1e6)).alias("_us"))
    return lines.join(ends, "source").filter(us >= F.col("_us")).groupBy("source").agg(F.min("line_no").alias("line_no"))


def first_matches(lines: DataFrame, matched: Column, most: int) -> tuple[DataFrame, bool]:
    """The first most matching lines by source and line, and whether there are more."""
    hits = lines.filter(F.coalesce(matched, F.lit(False)))
    return hits.orderBy("source", "line_no").limit(most), hits.limit(most + 1).count() > most


def sort_key(c: Column, kind: str = "text", ts: Callable[[Column], Column] = times.cell_instant) -> Column:
    """What a cell sorts by: numbers by value or by unit, durations, sizes, instants (read by ts), severity; text by its first 64 characters, lower-cased, then as they are. Null if it has no value."""
    t = F.nullif(F.trim(c), F.lit(""))
    if kind == "number":
        v = F.coalesce(kinds.number(t), kinds.quantity(t)["scaled"])
        return F.when(F.abs(v) < float("inf"), v)
    if kind in ("duration", "bytes"):
        return {"duration": kinds.duration_ns, "bytes": kinds.size_bytes}[kind](t)
    if kind == "level":
        return kinds.level_rank(t)
    if kind == "timestamp":
        return ts(t)
    cut = F.substring(t, 1, 64)
    return F.when(t.isNotNull(), F.struct(F.lower(cut).alias("lower"), cut.alias("cut")))


def sorted_by(records: DataFrame, key: Column, descending: bool = False, max_rows: int | None = None) -> DataFrame:
    """By a typed key; nulls last either way, ties in file order. More than max_rows rows are refused with ValueError."""
    if max_rows is not None and records.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows to sort; narrow the filter")
    return records.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "source", "line_no")


def ranked(rows: DataFrame, *keys: Column, out: str = "nth") -> DataFrame:
    """rows with out, their number from 1 in the order of the keys, which must tell all rows apart.

    Rows are range-partitioned and sorted; a row's number is its place in its partition after the rows of all partitions before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    d = materialize(d, "ranked")
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = d.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    return d.join(F.broadcast(sums), "_part").withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def sorted_records(lines: DataFrame, key: Column, descending: bool = False) -> DataFrame:
    """Lines with rec_id by their record's key; continuation lines stay with their record, lines before the first record come last."""
    keys = lines.filter("rec_id = line_no").select("source", "rec_id", key.alias("_key"))
    out = lines.join(keys, ["source", "rec_id"], "left")
    k = F.col("_key").desc_nulls_last() if descending else F.col("_key").asc_nulls_last()
    return out.orderBy(F.col("rec_id").isNull(), k, "source", "rec_id", "line_no").drop("_key")
