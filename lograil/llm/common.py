"""What the operators share: tables in the shared folder, and numpy kernels over batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.shared import materialize, shared_dir  # noqa: F401

#: White space of all word and line rules here: space and the six controls 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with _row, a number of its own for each row. Written to the shared folder, so that every later read finds the same numbers."""
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()), name)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts must fit a Python worker: lower the default row count, keep a smaller one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def ascii_lower(c):
    """Lower-cases A to Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(c):
    """The words of a text column as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WORD_GAP), "")


def n_words_of(c):
    """The number of words of a text column, without building them."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


# ---------------------------------------------------------------------------------------------------------------------
# numpy kernels
# ---------------------------------------------------------------------------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
WORD_FACTORS = np.random.default_rng(7).integers(1, 2**63, 16, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0], done = 1, 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * (out[done - 1 : done] * base)
        done += k
    return out


class Powers:
    """Powers of the hash base and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up, self.down = powers(1, BASE), powers(1, BASE_INV)

    def to(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(n + n // 4, BASE), powers(n + n // 4, BASE_INV)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts and the bounds of each; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def gathered(batches, column: int, most: int):
    """Batches put together until their texts have about so many bytes."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(column).nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def chunks(bounds: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of rows of about that many bytes, one row at least."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word's index of each text (one more entry than texts)."""
    solid = ~IS_SPACE[raw]
    begins, ends = solid.copy(), np.zeros(len(raw) + 1, bool)
    begins[1:] &= ~solid[:-1]
    ends[1:] = solid
    ends[1:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    begins[inner] = solid[inner]
    ends[inner] = solid[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, bounds)


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, p: Powers) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, wherever it lies."""
    p.to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * p.up[: len(raw)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * p.down[starts] + (stops - starts).astype(np.uint64) * WORD_FACTORS[15])


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words, text by text, and each text's bounds among them. A text of fewer words has its whole sequence as one."""
    counts = np.diff(first)
    n = len(words) - size + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        runs += words[j : j + n] * WORD_FACTORS[j]
    out_counts = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(out_counts)])
    got = np.empty(out[-1], np.uint64)
    full = counts >= size
    if full.any():
        keep = np.repeat(first[:-1][full] - np.concatenate([[0], np.cumsum(out_counts[full])[:-1]]), out_counts[full]) + np.arange(out_counts[full].sum())
        got[np.repeat(full, out_counts)] = runs[keep]
    for m in range(1, size):
        at = np.flatnonzero(counts == m)
        acc = np.full(len(at), WORD_FACTORS[14]) * np.uint64(m)
        for j in range(m):
            acc += words[first[at] + j] * WORD_FACTORS[j]
        got[out[at]] = acc
    return mix(got), out


def binary_column(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def key_groups(batches, key: str):
    """Tables of one key each, from batches sorted by that key. Holds one group at a time besides a batch."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == 0 and held and held[-1].column(key)[0].as_py() != keys[0]:
                yield pa.concat_tables(held)
                held = []
            elif lo:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
    if held:
        yield pa.concat_tables(held)
