"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed (Pagh, 2016).

1. Every text gets a 64-bit fingerprint: bit b is set if it is set in over half of the hashes of its 3-word shingles, repeats included.
   Rows of one fingerprint are one node from then on, so exact copies cost one row, however many.
2. Each bit position has a vector of r + 1 bits, none of them zero, dealt evenly. A table belongs to a nonzero vector v and keeps the
   bits whose vector has an odd product with v. Any r positions leave some v to which all their vectors are orthogonal, so two
   fingerprints that differ in r bits at most agree on all bits that the table of this v keeps: 15 tables of about 34 bits for r = 3.
3. Tables are range-partitioned by (key, fingerprint) and read in order. A bucket of BUCKET fingerprints at most is compared by bit
   counts. A larger one, or one that a partition's edge may cut, is deepened: the same construction deals out the bits that its
   table does not keep, which are all the bits in which a pair there can differ. After two more levels a bucket has 7 free bits or fewer,
   so 128 fingerprints at most, and is compared as it is. So no group grows with the corpus, and no link is lost.
4. Buckets give the links that join what all their links join; components are named by the least id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm.common import materialize, mix, small_batches, text_buffers
from lograil.llm.components import components
from lograil.llm.near_dedup import linked
from lograil.llm.packing import spans

BITS, SEED = 64, 42
#: Fingerprints of a bucket that are compared with each other; larger ones are deepened.
BUCKET = 1024
LEVELS = 3
#: Bytes of a text that are hashed at a time, and shingles whose bits are counted at a time.
SPAN, COUNTED = 4 << 20, 1 << 16


def fingerprint(raw: np.ndarray, size: int = 3) -> int:
    """The fingerprint of one text's UTF-8 bytes: words as bytes.split has them (space and 0x09 to 0x0D), A-Z lower-cased. 0 without words."""
    ones, n, words = np.zeros(BITS, np.int64), 0, []

    def count(shingles: list[bytes]) -> int:
        for k in range(0, len(shingles), COUNTED):
            hashes = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles[k : k + COUNTED]])
            ones[:] += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        return len(shingles)

    for lo, hi in spans(raw, SPAN):
        words += raw[lo:hi].tobytes().lower().split()
        n += count([b" ".join(s) for s in zip(*(words[k:] for k in range(size)))])
        words = words[-(size - 1) :] if n else words  # a span's last words begin shingles that end in the next
    if not n and words:
        n = count([b" ".join(words)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row of docs; fp holds the 64 bits as a signed long. A null text is empty."""

    def run(batches):
        for b in batches:
            raw, bounds = text_buffers(b.column(1))
            fps = [fingerprint(raw[lo:hi], size) for lo, hi in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks of the free bits, such that any radius bits of them are outside some mask. Free bits are dealt evenly to the nonzero vectors."""
    places = [b for b in range(BITS) if free >> b & 1]
    kinds = (1 << radius + 1) - 1
    return [reduce(lambda m, k: m | (1 << places[k] if (1 + k % kinds & v).bit_count() & 1 else 0), range(len(places)), 0) for v in range(1, kinds + 1)]


class Tables:
    """Masks of all tables of a level. The children of a table keep its bits and, of the others, those of one covering mask each."""

    def __init__(self, level: int, radius: int):
        self.kinds = (1 << radius + 1) - 1
        masks = [0]
        for _ in range(level + 1):
            masks = [kept | m for kept in masks for m in covering_masks(~kept & (1 << BITS) - 1, radius)]
        self.masks = np.array(masks, np.uint64)

    def keys(self, fps: np.ndarray, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tables, keys) of all children of each fingerprint's table. A key is a hash of table and kept bits; a chance collision only adds comparisons."""
        tables = parents[:, None] * self.kinds + np.arange(self.kinds)
        kept = fps[:, None] & self.masks[tables]
        return tables, mix(mix(kept) + tables.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def table_rows(fps: np.ndarray, parents: np.ndarray, tables: Tables) -> pa.RecordBatch:
    of, keys = tables.keys(fps, parents)
    again = np.repeat(fps, tables.kinds)
    return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(again.view(np.int64)), pa.array(of.ravel().astype(np.int32))], ["key", "fp", "table"])


ROWS = "key long, fp long, table int"


def first_rows(fps: DataFrame, radius: int) -> DataFrame:
    """A row for each fingerprint and table of the first level."""

    def run(batches):
        tables = Tables(0, radius)
        for b in batches:
            got = np.asarray(b.column(0)).view(np.uint64)
            yield table_rows(got, np.zeros(len(got), np.int64), tables)

    return fps.select("fp").mapInArrow(run, ROWS)


def bucket_links(rows: DataFrame, radius: int, last: bool) -> DataFrame:
    """Reads sorted rows bucket by bucket: links (src, dst) of two fingerprints, and rows (dst null, table) of buckets to be deepened.

    Except at the last level, buckets that touch a partition's edge are deepened too, as the rest may lie in another partition.
    """

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        key, size, first = 0, 0, True
        out: tuple[list, list, list] = ([], [], [])

        def flush():
            src, dst, deep = out
            src, dst = np.array(src, np.uint64), np.array(dst, np.uint64)
            more = np.concatenate([d[0] for d in deep]) if deep else np.zeros(0, np.uint64)
            of = np.concatenate([d[1] for d in deep]) if deep else np.zeros(0, np.int64)
            no = np.zeros(len(src) + len(more), bool)
            no[len(src) :] = True
            batch = pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([src, more]).view(np.int64)), pa.array(np.concatenate([dst, more]).view(np.int64), mask=no), pa.array(np.concatenate([np.zeros(len(src), np.int64), of]).astype(np.int32), mask=~no),
            ], ["src", "dst", "table"])
            for x in out:
                x.clear()
            return batch

        def close(edge: bool):
            nonlocal held, size
            fps, tables = (np.concatenate(x) for x in zip(*held))
            held, size = [], 0
            if not last and (edge or len(fps) > BUCKET):
                out[2].append((fps, tables))
            elif len(fps) == 2:
                if np.bitwise_count(fps[0] ^ fps[1]) <= radius:
                    out[0].append(fps[0])
                    out[1].append(fps[1])
            elif len(fps) > 2:
                linked(len(fps), lambda i: np.bitwise_count(fps ^ fps[i]) <= radius, out[0], out[1], fps)

        for b in batches:
            if not b.num_rows:
                continue
            keys, fps, tables = (np.asarray(b.column(k)) for k in range(3))
            fps = fps.view(np.uint64)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            cuts = np.concatenate([[0], cuts, [len(keys)]])
            if held and key != keys[0]:
                close(first)
                first = False
            # Buckets of one fingerprint have nothing to compare; only those at a batch's ends may be longer than they look.
            sizes = np.diff(cuts)
            want = np.flatnonzero(sizes > 1)
            for k in np.unique(np.concatenate([[0], want, [len(sizes) - 1]])):
                lo, hi = cuts[k], cuts[k + 1]
                if held and k:
                    close(first)
                    first = False
                elif k:
                    first = False
                held.append((fps[lo:hi].copy(), tables[lo:hi].copy()))
                key, size = keys[lo], size + hi - lo
                if size > BUCKET and not last:  # passed on as it comes; what follows of it is as well
                    close(True)
                    held, first = [(fps[lo:lo], tables[lo:lo])], True
            yield flush()
        if held:
            close(True)
            yield flush()

    return rows.mapInArrow(run, "src long, dst long, table int")


def deeper_rows(deep: DataFrame, radius: int, level: int) -> DataFrame:
    """The rows of the next level of what its buckets passed on: (src, table)."""

    def run(batches):
        tables = Tables(level, radius)
        for b in batches:
            if b.num_rows:
                yield table_rows(np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1)).astype(np.int64), tables)

    return deep.mapInArrow(run, ROWS)


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(src, dst): links between distinct fingerprints that differ in radius bits at most, enough of them to give the same components as all."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, links = first_rows(fps, radius), []
    for level in range(LEVELS):
        last = level == LEVELS - 1
        if last:  # buckets are bounded: a whole one goes to one task
            ranged = rows.repartition(parts, "key").sortWithinPartitions("key", "fp")
        else:
            ranged = rows.repartitionByRange(parts, "key", "fp").sortWithinPartitions("key", "fp")
        found = materialize(bucket_links(ranged, radius, last), f"simhash-{level}")
        links.append(found.filter("dst is not null").select("src", "dst"))
        deep = found.filter("dst is null").select("src", "table")
        if last or deep.isEmpty():
            break
        rows = deeper_rows(deep, radius, level + 1)
    return reduce(DataFrame.union, links)


def near_groups(docs: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint as 16 hexadecimal digits, component_id) of every row of docs; radius 1 to 3.

    Rows whose fingerprints differ in radius bits at most are linked; component_id is the least id that a row reaches. A text of fewer words than size has
    its whole sequence as its only shingle. Null and empty texts and those without words have fingerprint 0 and are linked like any other. Rows that repeat an id
    are compared like any others. A null id names no component and links nothing: component_id is null. Other columns are ignored. A text may be of any length; it is hashed in parts.
    """
    if not 1 <= radius <= 3:
        raise ValueError("radius 1 to 3")
    rows = materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = materialize(rows.filter("id is not null").groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    near = components(near_links(nodes, radius), name="simhash")
    named = nodes.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("fp", "component_id")
    out = rows.filter("id is not null").hint("merge").join(named, "fp").select("id", "fp", "component_id")
    out = out.union(rows.filter("id is null").select("id", "fp", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
