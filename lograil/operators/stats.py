"""Column statistics, density and search across sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograil.functions import kinds
from lograil.shared import materialize


def distinct_key(c: Column, kind: str) -> Column:
    """What is counted as one value: a level's label, else the whole value."""
    return F.coalesce(kinds.level_label(c), c) if kind == "level" else c


QUANTILES = (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))
_PARSED = {"number": kinds.number, "duration": kinds.duration_ns, "bytes": kinds.size_bytes}


def typed_values(records: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """records with _c0, _v0, _c1, _v1, ...: each column as text (empty is null), and as a number if its kind is one. Columns that are numbers already are not read again."""
    new = {}
    for i, (name, kind) in enumerate(columns.items()):
        new[f"_c{i}"] = F.nullif(F.col(name).cast("string"), F.lit(""))
        if kind not in _PARSED:
            v = F.lit(None).cast("double")
        elif isinstance(records.schema[name].dataType, T.NumericType):
            x = F.col(name).cast("double") * (1e6 if kind == "duration" else 1.0)
            v = F.when(F.abs(x) < float("inf"), x)
        else:
            v = _PARSED[kind](F.col(name).cast("string"))
        new[f"_v{i}"] = v
    return records.withColumns(new)


def exact_percentiles(counts: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """(name, p50, p90, p99) by nearest rank of (name, r, v, n): n values v, or n values without v, in the order of r and v. A percentile that falls on a row without v is null.

    Rows are range-partitioned and ranked by the sums of the partitions before; no task holds more than one range.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(counts.repartitionByRange(parts, "name", "r", "v").withColumn("part", F.spark_partition_id()), "value-counts")
    before = W.partitionBy("name").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = counts.groupBy("name", "part").agg(F.sum("n").alias("sum"))
    sums = sums.withColumns({"before": F.coalesce(F.sum("sum").over(before), F.lit(0)), "total": F.sum("sum").over(W.partitionBy("name"))})
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.ceil(F.lit(p) * F.col("total")).alias("rank")) for q, p in quantiles])).alias("x")
    asked = sums.select("name", "part", "before", "sum", asked).select("name", "part", "before", "sum", "x.*").filter("rank > before and rank <= before + sum")
    inside = W.partitionBy("name", "q").orderBy("r", "v").rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = counts.join(F.broadcast(asked), ["name", "part"]).withColumn("upto", F.col("before") + F.sum("n").over(inside)).filter("upto >= rank")
    return hit.groupBy("name").agg(*[F.min_by(F.when(F.col("q") == q, F.col("v")), F.when(F.col("q") == q, F.struct("r", "v"))).alias(q) for q, _ in quantiles])


#: Sketches of percentiles are wrong by 1/ACCURACY of the rows at most; bounds are asked for twice as far from what is wanted.
ACCURACY = 10_000
_BOUNDS = [x for _, p in QUANTILES for x in (max(p - 2 / ACCURACY, 0.0), min(p + 2 / ACCURACY, 1.0))]


def _apart(bounds: Sequence[float]) -> list[list[float]]:
    """Intervals (low, high, low, high, ...) in order, those that touch put together."""
    out: list[list[float]] = []
    for lo, hi in sorted(zip(bounds[::2], bounds[1::2])):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def counted_between(v: Column, bounds: Sequence[float] | None) -> Column:
    """(r, v) by which values are counted: themselves inside the bounds of a percentile, only their number between them; without bounds each by itself."""
    if bounds is None:
        return F.when(v.isNotNull(), F.struct(F.lit(0).alias("r"), v.alias("v")))
    nothing, at = F.lit(None).cast("double"), None
    for i, (lo, hi) in enumerate(_apart(bounds)):
        for test, r, shown in ((v < lo, 2 * i, nothing), (v <= hi, 2 * i + 1, v)):
            at = (F if at is None else at).when(test, F.struct(F.lit(r).alias("r"), shown.alias("v")))
    return F.when(v.isNotNull(), at.otherwise(F.struct(F.lit(2 * i + 2).alias("r"), nothing.alias("v"))))


def profile(records: DataFrame, columns: Mapping[str, str], exact: bool = False, where: Column | None = None) -> DataFrame:
    """(name, kind, records, skipped, count, missing, numeric_count, min, max, mean, distinct_estimate, p50, p90, p99) of all columns in one scan of the records.

    columns maps names to kinds. Percentiles are nearest-rank over numbers, durations (ns) and sizes: from sketches, or exact. Exact ones take a second scan, in which only values between bounds from the
    sketches, a few in 10,000, are counted one by one, and others only as so many below or above. If records has is_record, other lines are skipped and only counted. where restricts the profile to
    records that a filter passes.
    """
    d = records.filter(where) if where is not None else records
    is_record = F.coalesce(F.col("is_record"), F.lit(False)) if "is_record" in d.columns else F.lit(True)
    d = typed_values(d.withColumn("_ok", is_record), columns)
    aggs = []
    for i, (name, kind) in enumerate(columns.items()):
        c, v = F.when(F.col("_ok"), F.col(f"_c{i}")), F.when(F.col("_ok"), F.col(f"_v{i}"))
        # One sketch for all: a NULL array where a column has no numbers.
        sketch = F.percentile_approx(v, _BOUNDS if exact else [p for _, p in QUANTILES], ACCURACY) if kind in _PARSED else F.lit(None).cast("array<double>")
        # Numbers are told apart as they are, without making text of them.
        key = F.when(F.col("_ok"), F.col(name)) if isinstance(records.schema[name].dataType, T.NumericType) else distinct_key(c, kind)
        aggs.append(F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.count_if("_ok").alias("records"), F.count_if(~F.col("_ok")).alias("skipped"), F.count(c).alias("count"), F.count_if(F.col("_ok") & F.col(f"_c{i}").isNull()).alias("missing"), F.count(v).alias("numeric_count"),
            F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.least(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(key.isNotNull(), F.xxhash64(key)), 12)), F.count(c)).alias("distinct_estimate"), sketch.alias("_sketch"),
        ))
    out = d.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    if not exact:
        return out.select("*", *[F.get("_sketch", F.lit(j)).alias(n) for j, (n, _) in enumerate(QUANTILES)]).drop("_sketch")
    out = materialize(out, "profile")
    bounds = {r["name"]: r["_sketch"] for r in out.filter("numeric_count > 0").select("name", "_sketch").collect()}  # a row for each column
    at = {name: i for i, name in enumerate(columns) if name in bounds}

    def percentiles(narrow: bool) -> DataFrame:
        cells = [F.struct(F.lit(name).alias("name"), counted_between(F.col(f"_v{i}"), bounds[name] if narrow else None).alias("x")) for name, i in at.items()]
        counts = d.filter("_ok").select(F.explode(F.array(*cells)).alias("c")).filter("c.x is not null").groupBy("c.name", "c.x.r", "c.x.v").agg(F.count("*").alias("n"))
        return materialize(exact_percentiles(counts), "percentiles")

    if not at:
        return out.drop("_sketch").withColumns({n: F.lit(None).cast("double") for n, _ in QUANTILES})
    found = percentiles(True)
    if not found.filter(" or ".join(f"{n} is null" for n, _ in QUANTILES)).isEmpty():
        found = percentiles(False)  # a sketch was further off than it should be
    return out.drop("_sketch").join(found, "name", "left")


def profile_state(records: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """What profile_of needs of a part of the records, one row for each column; states of parts merge by merged_states. Lines that are no records are only counted, as by profile."""
    is_record = F.coalesce(F.col("is_record"), F.lit(False)) if "is_record" in records.columns else F.lit(True)
    d = typed_values(records.withColumn("_ok", is_record), columns)
    aggs = []
    for i, (name, kind) in enumerate(columns.items()):
        c, v = F.when(F.col("_ok"), F.col(f"_c{i}")), F.when(F.col("_ok"), F.col(f"_v{i}"))
        aggs.append(F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.count_if("_ok").alias("records"), F.count_if(~F.col("_ok")).alias("skipped"), F.count(c).alias("count"), F.count_if(F.col("_ok") & F.col(f"_c{i}").isNull()).alias("missing"), F.count(v).alias("numeric_count"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"),
            F.hll_sketch_agg(distinct_key(c, kind), 12).alias("distinct_sketch"), F.kll_sketch_agg_double(v).alias("quantile_sketch"),
        ))
    return d.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def merged_states(states: DataFrame) -> DataFrame:
    """One state of each column from those of many parts."""
    sums = [F.sum(c).alias(c) for c in ("records", "skipped", "count", "missing", "numeric_count", "sum")]
    return states.groupBy("name", "kind").agg(*sums, F.min("min").alias("min"), F.max("max").alias("max"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def profile_of(state: DataFrame) -> DataFrame:
    """(name, kind, records, skipped, count, missing, numeric_count, min, max, mean, distinct_estimate, p50, p90, p99) of states."""
    q = [F.when(F.col("numeric_count") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(p))).alias(n) for n, p in QUANTILES]
    return state.select("name", "kind", "records", "skipped", "count", "missing", "numeric_count", "min", "max", (F.col("sum") / F.col("numeric_count")).alias("mean"), F.least(F.hll_sketch_estimate("distinct_sketch"), F.col("count")).alias("distinct_estimate"), *q)


def top_values(records: DataFrame, columns: Mapping[str, str], n: int = 10) -> DataFrame:
    """(name, value, count, nth): the most frequent values of each column, ties by value. Exact."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), distinct_key(F.nullif(F.col(c).cast("string"), F.lit("")), k).alias("value")) for c, k in columns.items()])).alias("x")
    counts = records.select(cells).select("x.*").filter("value is not null").groupBy("name", "value").count()
    nth = F.row_number().over(W.partitionBy("name").orderBy(F.desc("count"), "value"))
    return counts.withColumn("nth", nth).filter(F.col("nth") <= n).select("name", "value", "count", "nth")


#: Values that a column's state counts at most. A column of fewer distinct values is counted exactly.
COUNTERS = 1024
#: Rows and bytes that are counted at once.
_COUNTED_ROWS, _COUNTED_BYTES = 1 << 18, 1 << 24


def frequent_state(records: DataFrame, columns: Mapping[str, str], counters: int = COUNTERS) -> DataFrame:
    """The most frequent values of a part of the records (Misra and Gries, 1982; merged as by Agarwal et al., 2012): (name, value, count), at most `counters` rows for each column and task, and a row of a null
    value whose count is the error: a value is in the records at least as often as its counts say, and at most so many times more; so is any value without a row. States of parts merge by merged_frequent.

    Empty cells do not count. Levels count by their label.
    """
    names = list(columns)
    cells = records.select(*[distinct_key(F.nullif(F.col(c).cast("string"), F.lit("")), k).alias(f"c{i}") for i, (c, k) in enumerate(columns.items())])

    def run(batches):
        held: list[dict] = [{} for _ in names]
        errors = [0] * len(names)
        for t in _gathered(batches):
            for i, column in enumerate(t.columns):
                seen = column.drop_null().value_counts()
                for value, n in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist()):
                    held[i][value] = held[i].get(value, 0) + n
                if len(held[i]) > counters:
                    held[i], cut = _pruned(held[i], counters)
                    errors[i] += cut
        rows = [(n, v, c) for n, state, error in zip(names, held, errors) for v, c in (*state.items(), (None, error))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["name", "value", "count"])

    return cells.mapInArrow(run, "name string, value string, count long")


def _gathered(batches):
    """Tables of many batches: the more rows are counted at once, the fewer times a value comes up."""
    kept = []
    for b in batches:
        kept.append(b)
        if sum(x.num_rows for x in kept) >= _COUNTED_ROWS or sum(x.nbytes for x in kept) >= _COUNTED_BYTES:
            yield pa.Table.from_batches(kept)
            kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def _pruned(counts: dict[str, int], counters: int) -> tuple[dict[str, int], int]:
    """The largest counts less the first that is left out, and how much that took from each value at most."""
    cut = sorted(counts.values(), reverse=True)[counters]
    return {v: n - cut for v, n in counts.items() if n > cut}, cut


def merged_frequent(states: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One state of each column from those of many parts, with as many counters as one part has."""
    sums = materialize(states.groupBy("name", "value").agg(F.sum("count").alias("count")), "frequent-sums")  # so that states, which may be scans of all records, are made once
    nth = F.row_number().over(W.partitionBy("name").orderBy(F.col("value").isNull(), F.desc("count"), "value"))
    ranked = sums.filter("value is not null").withColumn("_nth", nth)
    cut = ranked.filter(F.col("_nth") == counters + 1).select("name", F.col("count").alias("_cut"))
    kept = ranked.filter(F.col("_nth") <= counters).join(cut, "name", "left").withColumn("count", F.col("count") - F.coalesce("_cut", F.lit(0))).filter("count > 0").select("name", "value", "count")
    errors = sums.filter("value is null").join(cut, "name", "left").select("name", "value", (F.col("count") + F.coalesce("_cut", F.lit(0))).alias("count"))
    return kept.unionByName(errors)


def frequent_values(records: DataFrame, columns: Mapping[str, str], n: int = 10, counters: int = COUNTERS, state: DataFrame | None = None) -> DataFrame:
    """(name, value, count, nth): as top_values, without a shuffle of all distinct values where few of them are frequent. Exact.

    A state of at most `counters` values for each column tells which values can be among the first n; those are counted in a second pass, unless the state has counted all values of the column. Columns for
    which it cannot tell, as their values are about equally frequent, are counted in full. state: that of the records, if there is one already.
    """
    state = materialize(merged_frequent(state if state is not None else frequent_state(records, columns, counters), counters), "frequent")
    errors = state.filter("value is null").select("name", F.col("count").alias("error"))
    nth = F.row_number().over(W.partitionBy("name").orderBy(F.desc("count"), "value"))
    least = state.filter("value is not null").withColumn("_nth", nth).groupBy("name").agg(F.min(F.when(F.col("_nth") == n, F.col("count"))).alias("least"), F.max("_nth").alias("values"))
    told = {r["name"]: (r["error"], r["least"] or 0) for r in errors.join(least, "name", "left").collect()}  # a row for each column
    counted = [c for c in columns if c in told and told[c][0] == 0]
    sure = {c: k for c, k in columns.items() if c in told and 0 < told[c][0] < told[c][1]}
    out = []
    if counted:
        out.append(state.filter(F.col("name").isin(*counted) & F.col("value").isNotNull()).withColumn("nth", nth).filter(F.col("nth") <= n).select("name", "value", "count", "nth"))
    if sure:
        lows = F.create_map(*[F.lit(x) for c in sure for x in (c, told[c][1] - told[c][0])])
        wanted = state.filter(F.col("name").isin(*sure) & F.col("value").isNotNull()).filter(F.col("count") >= F.element_at(lows, F.col("name"))).select("name", "value")
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), distinct_key(F.nullif(F.col(c).cast("string"), F.lit("")), k).alias("value")) for c, k in sure.items()])).alias("x")
        counts = records.select(cells).select("x.*").join(F.broadcast(wanted), ["name", "value"]).groupBy("name", "value").count()  # at most `counters` rows for each column
        out.append(counts.withColumn("nth", nth).filter(F.col("nth") <= n).select("name", "value", "count", "nth"))
    if rest := {c: k for c, k in columns.items() if c not in sure and c not in counted}:
        out.append(top_values(records, rest, n))
    return reduce(DataFrame.unionByName, out)


def value_candidates(records: DataFrame, column: str, most: int = 200, kind: str = "text", selected: Sequence[str] = ()) -> DataFrame:
    """(value, count) to pick from: all levels for a level; else the selected values, then the most frequent ones, at most so many; numbers first by value, then text."""
    if kind == "level":
        levels = records.sparkSession.createDataFrame([(x, i) for i, x in enumerate(kinds.LEVEL_LABELS)], "value string, i int")
        seen = records.groupBy(kinds.level_label(F.col(column)).alias("value")).count()
        return levels.join(seen, "value", "left").orderBy("i").select("value", F.coalesce("count", F.lit(0)).alias("count"))
    c = F.nullif(F.col(column).cast("string"), F.lit(""))
    counts = records.select(c.alias("value")).filter("value is not null").groupBy("value").count()
    if selected:
        chosen = records.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(selected)], "value string").withColumn("chosen", F.lit(1))
        counts = counts.join(chosen, "value", "full").select("value", F.coalesce("count", F.lit(0)).alias("count"), "chosen")
    else:
        counts = counts.withColumn("chosen", F.lit(None).cast("int"))
    counts = counts.orderBy(F.col("chosen").asc_nulls_last(), F.desc("count"), "value").limit(most).drop("chosen")
    return counts.orderBy(kinds.number(F.col("value")).asc_nulls_last(), "value")


def density(matches: DataFrame, totals: DataFrame, bins: int, tag: str | None = None) -> DataFrame:
    """(source, bin, n, intensity): matches in equal byte slices of each source; totals has (source, size). Intensity is the root of the share of the fullest bin, at least 0.35. tag: a column of matches of which
    each bin's last value (by byte_off) that is not null is returned too.
    """
    d = matches.join(totals, "source").withColumn("bin", F.least(F.floor(F.col("byte_off") * bins / F.col("size")), F.lit(bins - 1)).cast("int"))
    last = [F.max_by(tag, F.when(F.col(tag).isNotNull(), F.col("byte_off"))).alias(tag)] if tag else []
    d = d.groupBy("source", "bin").agg(F.count("*").alias("n"), *last)
    top = F.max("n").over(W.partitionBy("source"))
    return d.withColumn("intensity", F.greatest(F.lit(0.35), F.sqrt(F.col("n") / top)))


def position_density(ranked: DataFrame, marked: Column, bins: int, nth: str = "nth") -> DataFrame:
    """(bin, n) of marked rows in equal slices of a sorted order; ranked has each row's number from 1 (see records.ranked)."""
    total = ranked.agg(F.count("*").alias("_total"))
    d = ranked.filter(F.coalesce(marked, F.lit(False))).crossJoin(F.broadcast(total))  # one row
    return d.groupBy(F.floor((F.col(nth) - 1) * bins / F.col("_total")).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def search_sources(lines: DataFrame, matched: Column, shown: int = 100) -> tuple[DataFrame, DataFrame]:
    """(source, n) of matching lines, and the first hits of each source."""
    hits = lines.filter(F.coalesce(matched, F.lit(False)))
    nth = F.row_number().over(W.partitionBy("source").orderBy("line_no"))
    return hits.groupBy("source").agg(F.count("*").alias("n")), hits.withColumn("nth", nth).filter(F.col("nth") <= shown)


def match_positions(lines: DataFrame, pattern: str) -> DataFrame:
    """(source, line_no, nth, value): non-overlapping matches of each line."""
    return lines.select("source", "line_no", F.posexplode(F.regexp_extract_all("raw", F.lit(pattern), F.lit(0))).alias("nth", "value"))


def as_rows(records: DataFrame, columns: list[str], extra: str | None = None) -> DataFrame:
    """(source, line_no, nth, name, value, is_extra): each record as key-value rows, schema columns first."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"), F.lit(False).alias("is_extra")) for c in columns])
    if extra:
        cells = F.concat(cells, F.transform(F.map_entries(F.coalesce(F.col(extra), F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), F.lit(True).alias("is_extra"))))
    return records.select("source", "line_no", F.posexplode(cells).alias("nth", "x")).select("source", "line_no", "nth", "x.*").filter("value is not null")
