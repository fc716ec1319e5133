"""Operators on streams of lines: growing files, filters, open records, alerts, statistics."""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lograil.operators.rules import notifications

MARK = 64
#: Bytes that are read at a time, of a range that a task reads, and of a batch.
CHUNK, SPAN, BATCH = 1 << 20, 32 << 20, 4 << 30
#: Into how many tasks the ranges of a batch are dealt at least, if there are as many; a task counts one file's ranges, side by side.
TASKS = 64


class _Ranges(InputPartition):
    """The bytes of a file from start to stop, in ranges of span bytes."""

    def __init__(self, path: str, gen: int, start: int, stop: int, span: int):
        self.path, self.gen, self.start, self.stop, self.span = path, gen, start, stop, span


def _mark(path: str, done: int) -> str:
    """A digest of the first and the last bytes before done: another file, or a rewritten one, has other ones."""
    with open(path, "rb") as f:
        head = f.read(min(done, MARK))
        f.seek(max(done - MARK, 0))
        return hashlib.sha1(head + f.read(min(done, MARK))).hexdigest()


def line_ends(path: str, start: int, stop: int) -> int:
    """The number of line breaks in a range of bytes."""
    n = 0
    with open(path, "rb") as f:
        f.seek(start)
        while start < stop and (chunk := f.read(min(CHUNK, stop - start))):
            n, start = n + chunk.count(b"\n"), start + len(chunk)
    return n


def lines_ending(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, bytes) of each line whose break is in a range. The first line may begin long before: it is looked for backwards, in ever larger chunks."""
    with open(path, "rb") as f:
        at, back = start, 256
        while at:
            back = min(4 * back, CHUNK)
            low = max(at - back, 0)
            f.seek(low)
            cut = f.read(at - low).rfind(b"\n") + 1
            at = low + cut
            if cut:
                break
        f.seek(at)
        while (line := f.readline()).endswith(b"\n") and at + len(line) <= stop:
            yield at, line
            at += len(line)


class _Growing(DataSourceStreamReader):
    """Offsets are {path: (generation, bytes, digest of the first and last bytes before)}.

    The driver looks at sizes and at those few bytes only. A batch takes up to `batch` new bytes, file by file, and cuts them into ranges of `span` bytes. As long as more is waiting than it takes, the next one takes twice as much, up to `most`;
    so the batches of a backlog grow in number with its logarithm, not with its size, until they are that large. A file that got shorter, was rewritten at any
    length, or was removed and came back starts a new generation. What has been offered is kept in the file `progress`, so that a query that starts again goes on where it was; without it, a query can't start again.
    """

    def __init__(self, options: dict):
        self.folder, self.progress = options["path"], options.get("progress")
        self.span, self.batch = int(options.get("span", SPAN)), int(options.get("batch", BATCH))
        self.most = max(int(options.get("most", self.batch)), self.batch)
        self.now = self.batch
        self.seen: dict = {}
        if self.progress and os.path.exists(self.progress):
            with open(self.progress) as f:
                self.seen = json.load(f)

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files, left, waiting = dict(self.seen), self.now, 0
        here = {os.path.join(self.folder, name) for name in os.listdir(self.folder)}
        for path in sorted(here | set(files)):
            gen, done, mark = files.get(path, [0, 0, ""])
            if path not in here:
                if done:
                    files[path] = [gen + 1, 0, ""]  # removed: if it comes back, it is another file
                continue
            if not os.path.isfile(path):
                continue
            size = os.stat(path).st_size
            if done and (size < done or _mark(path, done) != mark):
                gen, done = gen + 1, 0  # truncated, rotated or rewritten
            take = min(size - done, left)
            left -= take
            waiting += size - done - take
            files[path] = [gen, done + take, _mark(path, done + take)]
        self.seen = files
        self.now = min(2 * self.now, self.most) if waiting else self.batch
        if self.progress:
            with open(f"{self.progress}.new", "w") as f:
                json.dump(files, f)
            os.replace(f"{self.progress}.new", self.progress)
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = []
        for path, (gen, done, _) in end["files"].items():
            g, at, _ = start["files"].get(path, [0, 0, ""])
            if g > gen or g == gen and at > done:
                raise RuntimeError(f"{path} was read further than is known here; a query that starts again needs the progress file of its first run")
            new.append((path, gen, at if g == gen else 0, done))
        # Ranges of a task: as many as give TASKS tasks, but no more bytes than a range has by default, unless one range has more.
        size = sum(done - at for _, _, at, done in new)
        step = self.span * max(min(size // TASKS, SPAN) // self.span, 1)
        return [_Ranges(path, gen, lo, min(lo + step, done), self.span) for path, gen, at, done in new for lo in range(at, done, step)] or [_Ranges("", 0, 0, 0, self.span)]

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        for lo in range(partition.start, partition.stop, partition.span):
            hi = min(lo + partition.span, partition.stop)
            yield partition.path, partition.gen, lo, hi, line_ends(partition.path, lo, hi)


class GrowingFiles(DataSource):
    """New byte ranges of the files of a mounted folder, with the number of line breaks in each, counted where it is read; for growing_lines. Files may grow, be truncated or rewritten.

    Options: path; span and batch (bytes of a range and of a batch); most (bytes of a batch while more is waiting; batch if it is not given); progress (a file for what has been offered, which belongs to the query's checkpoint).
    """

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "source string, gen int, start long, stop long, n long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Growing(self.options)


def numbered_ranges(ranges: DataFrame) -> DataFrame:
    """(source, gen, start, stop, base): base is the number of lines in all ranges of the file before. The state is one number for each generation of a file."""

    def chain(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines = state.get[0] if state.exists else 0
        b = pd.concat(list(batches)).sort_values("start")
        upto = lines + b["n"].cumsum()
        state.update((int(upto.iloc[-1]),))
        yield pd.DataFrame({"source": key[0], "gen": key[1], "start": b["start"], "stop": b["stop"], "base": upto - b["n"]})

    return ranges.groupBy("source", "gen").applyInPandasWithState(chain, "source string, gen int, start long, stop long, base long", "lines long", "append", GroupStateTimeout.NoTimeout)


def lines_of_ranges(ranges: DataFrame) -> DataFrame:
    """(source, gen, line_no, byte_off, raw) of numbered ranges: the lines whose break is in the range, so an incomplete last line waits for its break. A file that went away meanwhile gives no lines."""

    def rows(path: str, gen: int, start: int, stop: int, base: int) -> Iterator[tuple]:
        if os.path.isfile(path):
            for i, (at, line) in enumerate(lines_ending(path, start, stop)):
                yield path, gen, base + i, at, line[:-1].removesuffix(b"\r").decode("utf-8", "replace")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for r in b.itertuples(index=False):
                for row in rows(*r):
                    held.append(row)
                    size += len(row[4])
                    if size > 4 * CHUNK or len(held) >= 50_000:
                        yield pd.DataFrame(held, columns=NAMES)
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=NAMES)

    NAMES = ["source", "gen", "line_no", "byte_off", "raw"]
    return ranges.mapInPandas(run, "source string, gen int, line_no long, byte_off long, raw string")


def growing_lines(spark: SparkSession, path: str, progress: str, span: int = SPAN, batch: int = BATCH, most: int | None = None) -> DataFrame:
    """The stream of lines (source, gen, line_no, byte_off, raw) of the growing files of a folder that driver and executors mount, numbered as read_lines numbers them.

    A batch has up to `batch` bytes; while more is waiting each has up to twice as many as the one before, up to `most` (batch if None).
    progress is a file of the driver's that belongs to the query's checkpoint. Executors count the line breaks of ranges, a running sum for each file numbers the ranges, and executors read them, all ranges of a file at the same time.
    """
    spark.dataSource.register(GrowingFiles)
    options = {"path": path, "span": str(span), "batch": str(batch), "most": str(most or batch), "progress": progress}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = spark.readStream.format("growing_files").options(**options).load()
    plain = lambda df: df.withColumn("start", F.greatest("start", F.lit(0)))  # noqa: E731  rows from Python are shuffled after a projection only
    return lines_of_ranges(plain(numbered_ranges(plain(ranges))).repartition(parts, "source", "start"))


def live_filter(lines: DataFrame, matched: Column) -> DataFrame:
    return lines.filter(F.coalesce(matched, F.lit(False)))


def live_counts(lines: DataFrame, matched: Column) -> DataFrame:
    """(source, gen if lines has it, n): matches so far; for output mode complete or update. A new generation of a file is counted anew."""
    return live_filter(lines, matched).groupBy(*_keys(lines)[0]).agg(F.count("*").alias("n"))


def live_profile(records: DataFrame, column: str) -> DataFrame:
    """(count, missing, distinct_estimate) of a column so far; for output mode complete."""
    c = F.nullif(F.col(column).cast("string"), F.lit(""))
    return records.agg(F.count(c).alias("count"), F.count_if(c.isNull()).alias("missing"), F.approx_count_distinct(c, 0.016).alias("distinct_estimate"))


def _keys(lines: DataFrame) -> tuple[list[str], str]:
    """The key of a source's state and its schema: with gen, where there is one, so that a new generation of a file starts anew."""
    keys = ["source", "gen"] if "gen" in lines.columns else ["source"]
    return keys, ", ".join(f"{k} {dict(lines.dtypes)[k]}" for k in keys)


def live_records(lines: DataFrame, start: Column, idle_ms: int | None = 500, most_lines: int | None = None) -> DataFrame:
    """(source, gen if lines has it, rec_id, n_lines, body): a record is out when the next start of its source arrives, or after idle_ms without a line (None: never, and the query can end). The open record is the state; where records may be too
    long for that, most_lines gives them out in parts of so many lines, which have the rec_id of their record.
    """
    keys, schema = _keys(lines)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        out = []
        if state.hasTimedOut:
            if held and held[1]:
                out.append((*key, held[0], len(held[1]), "\n".join(held[1])))
            state.remove()
        else:
            b = pd.concat(list(batches)).sort_values("line_no")
            for line_no, raw, begins in zip(b["line_no"], b["raw"], b["begins"]):
                if held and held[1] and (begins or most_lines and len(held[1]) >= most_lines):
                    out.append((*key, held[0], len(held[1]), "\n".join(held[1])))
                    held[1] = []
                if begins:
                    held = [int(line_no), [raw]]
                elif held:
                    held[1].append(raw)
            if held:
                state.update((json.dumps(held),))
                if idle_ms is not None:
                    state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[*keys, "rec_id", "n_lines", "body"])

    rows = lines.select(*keys, "line_no", "raw", F.coalesce(start, F.lit(False)).alias("begins"))
    return rows.groupBy(*keys).applyInPandasWithState(fold, f"{schema}, rec_id long, n_lines long, body string", "held string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def live_context(lines: DataFrame, matched: Column, before: int = 0, after: int = 0) -> DataFrame:
    """(source, gen if lines has it, line_no, raw, is_context): matching lines and those around them, as they arrive. A match brings earlier lines that were not shown yet; the state is the last
    `before` lines of each source and how many lines after a match are still to show.
    """
    keys, schema = _keys(lines)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, left = json.loads(state.get[0]) if state.exists else ([], 0)
        out = []
        b = pd.concat(list(batches)).sort_values("line_no")
        for line_no, raw, hit in zip(b["line_no"].tolist(), b["raw"], b["hit"]):
            if hit:
                out += [(*key, n, r, True) for n, r in held]
                out.append((*key, line_no, raw, False))
                held, left = [], after
            elif left:
                out.append((*key, line_no, raw, True))
                left -= 1
            else:
                held = [*held, [line_no, raw]][-before:] if before else []
        state.update((json.dumps([held, left]),))
        yield pd.DataFrame(out, columns=[*keys, "line_no", "raw", "is_context"])

    rows = lines.select(*keys, "line_no", "raw", F.coalesce(matched, F.lit(False)).alias("hit"))
    return rows.groupBy(*keys).applyInPandasWithState(fold, f"{schema}, line_no long, raw string, is_context boolean", "held string", "append", GroupStateTimeout.NoTimeout)


def live_effective_time(lines: DataFrame, ts: Column) -> DataFrame:
    """lines' (source, gen, line_no, raw) with eff_us, the greatest time so far of its source (null before the first). The scalable live merge: rows come as they arrive and are ordered
    by (eff_us nulls first, source, line_no) where they are read, so late lines are never lost; one number for each source is the state.
    """
    keys, schema = _keys(lines)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = np.iinfo(np.int64).min
        b = pd.concat(list(batches)).sort_values("line_no", ignore_index=True)
        us = b["us"].astype("Int64").to_numpy(np.int64, na_value=none)
        top = np.maximum.accumulate(np.maximum(us, state.get[0] if state.exists and state.get[0] is not None else none))
        state.update((None if top[-1] == none else int(top[-1]),))
        yield b[[*keys, "line_no", "raw"]].assign(eff_us=pd.arrays.IntegerArray(top, top == none))

    rows = lines.select(*keys, "line_no", "raw", F.unix_micros(ts).alias("us"))
    return rows.groupBy(*keys).applyInPandasWithState(fold, f"{schema}, line_no long, raw string, eff_us long", "top long", "append", GroupStateTimeout.NoTimeout)


def emit_final(pending: list, last: dict, now_ms: int, idle_ms: int) -> tuple[list, list]:
    """The part of pending lines (eff_us, source, line_no, raw) that is final, in order, and the rest.

    The least line is final once each source that has none pending is past its time or has been idle for idle_ms; last maps sources to (their time so far, when they were last heard).
    """
    pending = sorted(pending, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    waiting = Counter(x[1] for x in pending)
    for i, (us, source, _, _) in enumerate(pending):
        if any(not waiting[s] and now_ms - heard < idle_ms and (t is None or us is None or t < us) for s, (t, heard) in last.items()):
            return pending[:i], pending[i:]
        waiting[source] -= 1
    return pending, []


def live_merge(lines: DataFrame, idle_ms: int = 500, group: Column | None = None) -> DataFrame:
    """(merge, source, line_no, raw, eff_us, late) of lines from live_effective_time, in one final order for each merge group.

    Only lines whose place is not final yet are held (see emit_final). A line that comes after others of a later time have been given out is given out next, with late true. One merge group is one
    task; for many sources that need no exact live order, read live_effective_time sorted instead.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, last, given = json.loads(state.get[0]) if state.exists else ([], {}, None)
        now = state.getCurrentProcessingTimeMs()
        for b in batches if not state.hasTimedOut else ():
            for source, line_no, raw, us in zip(b["source"].astype(str), b["line_no"].tolist(), b["raw"], b["eff_us"].tolist()):
                us = int(us) if us is not None and us == us else None
                pending.append([us, source, line_no, raw])
                seen = last.get(source, [None, 0])[0]
                last[source] = [us if seen is None else max(seen, us or seen), now]
        final, pending = emit_final(pending, last, now, idle_ms)
        out = []
        for us, source, line_no, raw in final:
            out.append((*key, source, line_no, raw, us, given is not None and (us is None or us < given)))
            given = us if given is None else max(given, us or given)
        state.update((json.dumps([pending, last, given]),))
        if pending:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["merge", "source", "line_no", "raw", "eff_us", "late"]).astype({"eff_us": "Int64"})

    rows = lines.select((group if group is not None else F.lit("all")).cast("string").alias("merge"), F.col("source").cast("string").alias("source"), "line_no", "raw", "eff_us")
    return rows.groupBy("merge").applyInPandasWithState(fold, "merge string, source string, line_no long, raw string, eff_us long, late boolean", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_alerts(hits: DataFrame, seconds: float = 5.0, excerpt: int = 200, timers: bool = True) -> DataFrame:
    """(source, rule, us, suppressed, excerpt) of hits (source, rule, ts, and raw if there is one): notify, hold back for so many seconds of event time, then sum up.

    A summary that is due comes with the next hit or, with timers, after so many seconds without one; a query without timers can end. excerpt is the start of the line that was notified.
    """
    span = int(seconds * 1e6)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, 0)
        columns = ["source", "rule", "us", "suppressed", "excerpt"]
        if state.hasTimedOut:
            state.update((last + span, 0))
            yield pd.DataFrame([(*key, last + span, held, None)], columns=columns)
            return
        b = pd.concat(list(batches)).sort_values(["us", "excerpt"])
        told, last, held = notifications(b["us"].to_numpy(), span, last, held)
        state.update((last, held))
        if held and timers:
            state.setTimeoutDuration(int(seconds * 1000))
        lines = b["excerpt"].to_numpy()
        yield pd.DataFrame([(*key, us, n, None if i is None else lines[i]) for us, n, i in told], columns=columns)

    line = F.substring("raw", 1, excerpt) if "raw" in hits.columns else F.lit("")
    rows = hits.select("source", "rule", F.unix_micros("ts").alias("us"), F.coalesce(line, F.lit("")).alias("excerpt"))
    source = dict(rows.dtypes)["source"]
    return rows.groupBy("source", "rule").applyInPandasWithState(fold, f"source {source}, rule string, us long, suppressed long, excerpt string", "last long, held long", "append", GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout)


def deliver(stream: DataFrame, notify: Callable[[DataFrame, int], None]):
    """Hands each micro-batch to a function, such as one that appends new bookmarks or sends alerts."""
    return stream.writeStream.foreachBatch(notify)
