"""Removal of repeated byte strings by partitioned suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier (smaller id, another row of the same id that comes before, or same row and earlier start).

1. Of all suffixes, those at anchors are enough: an anchor of a string of LENGTH bytes is the place of its least 32-byte hash (the last, if
   tied), so equal strings have their anchors at the same place, and about every 35th suffix is one. A run of strings with one anchor is a record:
   the lead (the 4 leading bytes at the anchor and a hash of the 32 leading ones), a hash of the run's bytes, document (id, digest of the text), start, number of strings.
2. Splitters sampled from some documents range-partition the records by (lead, run, document, start), so that a passage that a
   third of the documents share spreads over partitions. Each partition is sorted. A record of an equal run further up (equal bytes and 96 equal hash bits) is a repeat
   as a whole. Other runs with the same leading bytes, and those that a partition's end may cut, need their bytes.
3. Those runs fetch their bytes, meet again by leading bytes, and are cut into strings. A bucket sorts its strings by multikey quicksort, 8 bytes at a time, and all
   but the first of equal ones are repeats. For leading bytes that go on across a boundary, the firsts of each bucket are compared once more, by all their bytes.
4. Repeats are gathered by document and cut out of the text.

The texts are shuffled once; the two joins share that exchange. A null text is empty. Rows of a null id are returned whole and not compared. Rows that repeat an id are documents
of their own, in the order of a digest of their texts; of equal rows, all but one are repeats as a whole. Other columns are ignored. A long text is read in parts of PART bytes; only the text itself must fit in a task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lograil.llm.common import BYTE_VALUES, WORD_FACTORS, Powers, chunks, materialize, mix, small_batches, text_buffers

LENGTH, LEAD, PLACE_BITS = 100, 32, 28
#: About so many documents are sampled for splitters, and so many of their records at most come to the driver.
SPLIT_DOCS, SPLIT_RECORDS = 1000, 100_000
#: Bytes of runs that a bucket sorts at a time, and of a long text that are read at a time.
BLOCK_BYTES, PART = 4 << 20, 1 << 20


def prefix_sums(raw: np.ndarray, p: Powers) -> np.ndarray:
    p.to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * p.up[: len(raw)], out=sums[1:])
    return sums


def anchor_records(raw: np.ndarray, bounds: np.ndarray, p: Powers, length: int = LENGTH, lead: int = LEAD):
    """(lead, run hash, text, start, strings) of all runs of strings with one anchor. The lead is its first 4 bytes, which order it, and 32 hash bits of all its bytes."""
    n, w = len(raw), length - lead + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    sums = prefix_sums(raw, p)
    h = mix((sums[lead:] - sums[:-lead]) * p.down[: n - lead + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    v = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    blocks = -(-len(v) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max)
    padded[: len(v)] = v
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    least = np.minimum(back[:m], ahead[w - 1 : w - 1 + m])
    place = (low - (least & low)).astype(np.int64)
    size = np.diff(bounds)
    some = size >= length
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, bounds[:-1][some], 1)
    np.add.at(edge, bounds[1:][some] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:m]) > 0)
    if not len(at):
        return none, none, none, none, none
    j = place[at]
    new = np.concatenate([[True], (j[1:] != j[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    lo, hi = at[first], at[first] + count - 1 + length
    run = mix((sums[hi] - sums[lo]) * p.down[lo] + (hi - lo).astype(np.uint64) * WORD_FACTORS[13])
    text = np.searchsorted(bounds, lo, "right") - 1
    head = np.ascontiguousarray(raw[j[first][:, None] + np.arange(4)]).view(">u4").ravel().astype(np.uint64)
    leads = ((head ^ np.uint64(1 << 31)) << np.uint64(32)) | (h[j[first]] >> np.uint64(32))
    return leads.view(np.int64), run.view(np.int64), text, lo - bounds[text], count


class Splitters:
    """Range partitioning by sampled records."""

    def __init__(self, sample: list[tuple], parts: int):
        sample = sorted(sample)
        self.cuts = [sample[i * len(sample) // parts] for i in range(1, parts)] if sample else []
        self.leads = np.array([c[0] for c in self.cuts], np.int64)

    def part(self, *keys: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.leads, keys[0], "left"), np.searchsorted(self.leads, keys[0], "right")
        for i in np.flatnonzero(hi > lo):  # equal leading bytes: the other parts of the key decide
            lo[i] = bisect_right(self.cuts, tuple(int(k[i]) for k in keys), int(lo[i]), int(hi[i]))
        return lo


def records(docs: DataFrame, length: int, splitters: Splitters | None = None) -> DataFrame:
    """docs: (id, row, text)."""

    def run(batches):
        p = Powers()
        for b in batches:
            raw, bounds = text_buffers(b.column(2))
            ids, rows = np.asarray(b.column(0)), np.asarray(b.column(1))
            for lo, hi in chunks(bounds):
                # A string belongs to the part that it starts in; runs are cut there, which makes them meet by leading bytes only.
                for at in range(0, int(bounds[hi] - bounds[lo]), PART) if hi - lo == 1 else (0,):
                    stop = min(bounds[lo] + at + PART + length - 1, bounds[hi]) if hi - lo == 1 else bounds[hi]
                    inside = np.array([0, stop - bounds[lo] - at]) if hi - lo == 1 else bounds[lo : hi + 1] - bounds[lo]
                    lead, whole, text, start, count = anchor_records(raw[bounds[lo] + at : stop], inside, p, length)
                    doc, row, start = ids[lo:hi][text], rows[lo:hi][text], start + at
                    part = splitters.part(lead, whole, doc, row, start) if splitters else np.zeros(len(lead), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((part, pa.int32()), (lead, pa.int64()), (whole, pa.int64()), (doc, pa.int64()), (row, pa.int64()), (start << 24 | count, pa.int64()))], ["part", "lead", "run", "id", "row", "span"])

    return docs.mapInArrow(run, "part int, lead long, run long, id long, row long, span long")


def matches(rows: DataFrame) -> DataFrame:
    """From sorted partitions: repeats as a whole (lead null), and runs that need their bytes (lead set)."""

    def run(batches):
        held, first_lead, last = None, None, None
        for b in batches:
            cols = [np.asarray(b.column(c)) for c in ("lead", "run", "id", "row", "span")]
            if last is not None:
                cols = [np.concatenate([x, c]) for x, c in zip(last, cols)]
            if not len(cols[0]):
                continue
            lead, whole, doc, row, span = cols
            new = np.concatenate([[last is None], (lead[1:] != lead[:-1]) | (whole[1:] != whole[:-1])])
            # Equal rows of docs have one key; their records are one.
            own = np.concatenate([[last is None], new[1:] | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (span[1:] != span[:-1])])
            if first_lead is None:
                first_lead = lead[0]
            last = [c[-1:] for c in cols]
            yield out(*(c[own & ~new] for c in (doc, row, span)))
            f = np.flatnonzero(new)
            cols = [lead[f], whole[f], doc[f], row[f], span[f], lead[f] == first_lead]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if len(cols[0]) > 1:
                near = cols[0][1:] == cols[0][:-1]
                cols[5][1:] |= near
                cols[5][:-1] |= near
            take = cols[5][:-1]
            yield out(*(cols[i][:-1][take] for i in (2, 3, 4, 0, 1)))
            held = [c[-1:] for c in cols]
        if held is not None:
            yield out(*(held[i] for i in (2, 3, 4, 0, 1)))

    def out(doc, row, span, *keys):
        null = pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc, row, span)), *([pa.array(k) for k in keys] or [null] * 2)], ["id", "row", "span", "lead", "run"])

    return rows.mapInArrow(run, "id long, row long, span long, lead long, run long")


def with_bytes(asked: DataFrame, length: int, splitters: Splitters) -> DataFrame:
    """asked: (id, row, text, runs: array of (lead, run, span)). One row for each run, with its bytes."""

    def run(batches):
        for b in batches:
            raw, bounds = text_buffers(b.column("text"))
            raw = raw.tobytes()
            lists = b.column("runs")
            at = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            lead, whole, span = (np.asarray(x) for x in lists.flatten().flatten())
            start, count = span >> 24, span & 0xFFFFFF
            lo = bounds[at] + start
            doc, row = np.asarray(b.column("id"))[at], np.asarray(b.column("row"))[at]
            got = [raw[x : x + n] for x, n in zip(lo.tolist(), (count + length - 1).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(splitters.part(lead, whole, doc, row, start), pa.int32()), pa.array(lead), pa.array(doc), pa.array(row), pa.array(span), pa.array(got, pa.binary())], ["part", "lead", "id", "row", "span", "bytes"])

    return asked.mapInArrow(run, "part int, lead long, id long, row long, span long, bytes binary")


def multikey_sorted(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of the strings of length bytes that start at these places, and which of them equal the one before them in that order.

    Multikey quicksort, all groups at once: strings that agree so far are one group and are parted by their next 8 bytes into those below, equal to and above a pivot (the median of three);
    equal ones go on with the bytes after these. Groups of one string are done.
    """
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(">u8").ravel().astype(np.uint64)
    depths = np.array([*range(0, length - 8, 8), length - 8])  # the last 8 bytes may have been seen in part
    order, same = np.arange(len(at)), np.zeros(len(at), bool)
    start, size, depth = np.array([0]), np.array([len(at)]), np.array([0])
    while True:
        done = depth == len(depths)
        for lo, n in zip(start[done & (size > 1)].tolist(), size[done & (size > 1)].tolist()):
            same[lo + 1 : lo + n] = True
        go = ~done & (size > 1)
        start, size, depth = start[go], size[go], depth[go]
        if not len(start):
            return order, same
        base = np.cumsum(size) - size
        group = np.repeat(np.arange(len(size)), size)
        place = np.repeat(start - base, size) + np.arange(len(group))
        members = order[place]
        key = words[at[members] + depths[depth][group]]
        a, b, c = key[base], key[base + size // 2], key[base + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        below, equal = key < pivot, key == pivot
        n_below, n_equal = np.add.reduceat(below, base, dtype=np.int64), np.add.reduceat(equal, base, dtype=np.int64)
        nth = lambda kind: (s := np.cumsum(kind) - kind) - s[base][group]
        to = start[group] + np.where(below, nth(below), np.where(equal, n_below[group] + nth(equal), (n_below + n_equal)[group] + nth(~below & ~equal)))
        order[to] = members
        start = np.stack([start, start + n_below, start + n_below + n_equal], 1).ravel()
        size = np.stack([n_below, n_equal, size - n_below - n_equal], 1).ravel()
        depth = np.stack([depth, depth + 1, depth], 1).ravel()


def string_repeats(runs: DataFrame, length: int) -> DataFrame:
    """From sorted partitions of runs with bytes: repeats (id, row, start, strings), and the first of each string of open leading bytes, with its bytes."""

    def block(parts, before):
        table = pa.Table.from_batches(parts)
        lead, doc, row, span = (table.column(c).to_numpy() for c in ("lead", "id", "row", "span"))
        raw = np.frombuffer(b"".join(table.column("bytes").combine_chunks().to_pylist()), np.uint8)
        count = span & 0xFFFFFF
        size = count + length - 1
        base = np.cumsum(size) - size
        of = np.repeat(np.arange(len(span)), count)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        start = (span >> 24)[of] + shift
        first = np.lexsort((start, row[of], doc[of]))  # equal strings stay in this order
        d, w, s = doc[of[first]], row[of[first]], start[first]
        first = first[np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (s[1:] != s[:-1])])]  # equal rows of docs are one
        of, start, lo = of[first], start[first], (base[of] + shift)[first]
        order, again = multikey_sorted(raw, lo, length)
        of, start, lo = of[order], start[order], lo[order]
        open_ = (lead == lead[-1]) | (lead == before)
        if before is None:
            open_ |= lead == lead[0]
        edge = ~again & open_[of]
        # repeats as runs of neighbouring starts
        s, o = start[again], of[again]
        order = np.lexsort((s, row[o], doc[o]))
        s, o = s[order], o[order]
        d, w = doc[o], row[o]
        cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (s[1:] > s[:-1] + 1)])) if len(s) else np.zeros(0, int)
        last_s = s[np.append(cut[1:], len(s)) - 1] if len(s) else s
        out_of, out_start = np.concatenate([o[cut], of[edge]]), np.concatenate([s[cut], start[edge]])
        strings = np.concatenate([last_s - s[cut] + 1, np.ones(edge.sum(), np.int64)])
        key = pa.array([None] * len(cut) + [raw[x : x + length].tobytes() for x in lo[edge].tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(doc[out_of], pa.int64()), pa.array(row[out_of], pa.int64()), pa.array(out_start, pa.int64()), pa.array(strings, pa.int64()), key], ["id", "row", "start", "strings", "string"]), lead[-1]

    def run(batches):
        parts, size, before = [], 0, None
        for b in batches:
            if b.num_rows:
                parts.append(b)
                size += b.column("bytes").nbytes
            if size >= BLOCK_BYTES:
                got, before = block(parts, before)
                yield got
                parts, size = [], 0
        if parts:
            yield block(parts, before)[0]

    return runs.mapInArrow(run, "id long, row long, start long, strings long, string binary")


def cut_out(docs: DataFrame, length: int) -> DataFrame:
    """docs: (id, text, nth, runs: array of (start, strings) or null). (id, n_bytes, n_removed, n_spans, kept: binary). Of equal rows, all but the first repeat it as a whole."""

    def run(batches):
        for b in batches:
            raw, bounds = text_buffers(b.column("text"))
            lists = b.column("runs")
            offsets = np.asarray(lists.offsets)
            start, strings = (np.asarray(x) for x in lists.flatten().flatten())
            sizes = np.diff(offsets) if len(offsets) > 1 else np.zeros(0, int)
            begin, nth = offsets - offsets[0], np.asarray(b.column("nth"))
            removed, spans, kept = [], [], []
            for i in range(b.num_rows):
                part = raw[bounds[i] : bounds[i + 1]]
                if nth[i] > 1 and len(part) >= length:
                    removed.append(len(part))
                    spans.append(1)
                    kept.append(b"")
                    continue
                if not sizes[i]:
                    removed.append(0)
                    spans.append(0)
                    kept.append(part.tobytes())
                    continue
                lo = start[begin[i] : begin[i + 1]]
                hi = np.minimum(lo + strings[begin[i] : begin[i + 1]] - 1 + length, len(part))
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                begins, ends = lo[new], hi[np.append(new[1:], len(lo)) - 1]
                removed.append(int((ends - begins).sum()))
                spans.append(len(new))
                kept.append(b"".join(part[x:y].tobytes() for x, y in zip([0, *ends.tolist()], [*begins.tolist(), len(part)])))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    rows = docs.select("id", "text", "nth", F.coalesce("runs", F.array().cast("array<struct<start:bigint,strings:bigint>>")).alias("runs"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    # A row is named by its id and a digest of its text, which the texts need not be written for; rows that have both in common are equal.
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")
    named = every.filter("id is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SPLIT_DOCS / max(named.count(), 1))
    some = named.filter(F.pmod(F.xxhash64(F.lit(5), "id", "row"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = records(some, length).select("lead", "run", "id", "row", "span").orderBy(F.xxhash64("row", "span")).limit(SPLIT_RECORDS).collect()
    splitters = Splitters([(*r[:4], r[4] >> 24) for r in sample], parts)
    keys = ("lead", "run", "id", "row", "span")
    rows = records(named, length, splitters).repartitionById(parts, F.col("part")).sortWithinPartitions(*keys)
    found = materialize(matches(rows), "repeats")
    key = ["id", "row"]
    asked = found.filter("lead is not null").groupBy(*key).agg(F.collect_list(F.struct("lead", "run", "span")).alias("runs"))
    asked = named.join(asked, key).select("id", "row", "text", "runs")
    runs = with_bytes(asked, length, splitters).repartitionById(parts, F.col("part")).sortWithinPartitions("lead", "id", "row", "span")
    # Firsts of open strings meet by their bytes, all other rows alone. One plan to the end, so that both joins share one exchange of the texts.
    alone = F.when(F.col("string").isNull(), F.xxhash64("id", "row", "start"))
    place = F.struct("id", "row", "start")
    strings = string_repeats(runs, length).withColumn("first", F.min(place).over(W.partitionBy("string", alone))).filter(F.col("string").isNull() | (place != F.col("first")))
    repeats = found.filter("lead is null").select("id", "row", F.shiftright("span", 24).alias("start"), F.col("span").bitwiseAND(F.lit((1 << 24) - 1)).alias("strings")).union(strings.select("id", "row", "start", "strings"))
    repeats = repeats.groupBy(*key).agg(F.collect_list(F.struct("start", "strings")).alias("runs"))
    # The window needs the exchange that the join needs.
    copies = named.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy("id")))
    out = cut_out(copies.join(repeats, key, "left"), length).union(cut_out(every.filter("id is null").select("*", F.lit(1).alias("nth"), F.lit(None).alias("runs")), length))
    return out.withColumnRenamed("id", "doc_id")
