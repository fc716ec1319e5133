"""Near-duplicate groups of documents by an LSH forest, confirmed on whole shingle sets.

1. Every text becomes a set of word shingles, a MinHash signature of 64 values and a digest of the set. Documents of one
   digest are copies; only the one of the least id goes on. Rows are numbered, so rows that share an id stay apart.
2. The forest has 16 sorted orders of the signatures. Order t sorts by the values 4t, 4t+1, ... (8 of them, cyclically).
   Orders are range-partitioned by (label, id), so a label that a third of the rows share spreads over tasks.
   Neighbours whose longest common prefix has 4 values or more are candidates. A region (run of one 4-value prefix) that
   fits in REGION documents is compared signature by signature. In a larger region, or one that a partition's end may cut,
   the depth is not enough to tell documents apart there: it is cut into blocks of neighbours in the sorted order, and
   all its documents are linked provisionally, so that nothing is lost.
3. Components of these provisional links hold every true link but those that no order brought together (2 in 10,000
   at a similarity of exactly 0.8). Inside each component, whole sets are compared. A component of many shingles is cut into blocks, each of which is compared with itself and with the
   component's first set; sets that end up in the first set's cluster are done with each other, and only the rest are compared with all blocks. A group stops comparing when all documents
   that could still be linked are in one component. So groups of near copies cost about one comparison a document, however large, and only unlike sets that the forest could not tell apart cost pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm.common import LOWER, Powers, binary_column, chunks, key_groups, materialize, numbered, shingle_hashes, small_batches, span_hashes, text_buffers, word_bounds
from lograil.llm.components import components

TREES, DEPTH, LABEL = 16, 4, 8
VALUES = TREES * DEPTH
#: Documents of a region that are compared with each other by signature.
REGION = 4096
#: Shingles of a block of a provisional component; a group holds a block, and the first set or a block of the rest.
BLOCK = 1 << 20
#: How far below the threshold a similarity estimated from 64 values may lie: four standard deviations.
SLACK = 0.2
_rng = np.random.default_rng(11)
SLOPES = _rng.integers(1, 2**63, VALUES, dtype=np.int64).astype(np.uint64) | np.uint64(1)
SHIFTS = _rng.integers(1, 2**63, VALUES, dtype=np.int64).astype(np.uint64)


def text_sets(texts: pa.Array, size: int, p: Powers):
    """The sorted distinct shingle hashes of each text."""
    raw, bounds = text_buffers(texts)
    for lo, hi in chunks(bounds):
        part, at = LOWER[raw[bounds[lo] : bounds[hi]]], bounds[lo : hi + 1] - bounds[lo]
        starts, stops, first = word_bounds(part, at)
        got, cut = shingle_hashes(span_hashes(part, starts, stops, p), first, size)
        for i in range(hi - lo):
            yield np.unique(got[cut[i] : cut[i + 1]])


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of 64 hash functions (upper 32 bits)."""
    out = np.full(VALUES, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 8192):
        out = np.minimum(out, (hashes[k : k + 8192, None] * SLOPES + SHIFTS).min(axis=0))
    return (out >> np.uint64(32)).astype(">u4")


def sketches(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n, digest, sig) of every row of docs, which has _row; digest and sig are null for an empty set."""

    def run(batches):
        p = Powers()
        for b in batches:
            n, digests, sigs = [], [], []
            for s in text_sets(b.column(2), size, p):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["row", "id", "n", "digest", "sig"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("_row").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "row long, id long, n long, digest binary, sig binary")


def forest_rows(reps: DataFrame) -> DataFrame:
    """One row for each document and order: its label (order, then 8 values) and one byte of each of its 64 values."""
    turn = (np.arange(TREES)[:, None] * DEPTH + np.arange(LABEL)) % VALUES

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u4").reshape(n, VALUES)
            labels = np.empty((n, TREES, 1 + 4 * LABEL), np.uint8)
            labels[:, :, 0] = np.arange(TREES)
            labels[:, :, 1:] = np.ascontiguousarray(sig[:, turn]).view(np.uint8).reshape(n, TREES, 4 * LABEL)
            low = np.repeat((sig & 255).astype(np.uint8), TREES, axis=0)
            ids = np.repeat(np.asarray(b.column(0)), TREES)
            yield pa.RecordBatch.from_arrays([binary_column(labels.reshape(n * TREES, -1)), pa.array(ids), binary_column(low)], ["label", "id", "low"])

    return reps.select("id", "sig").mapInArrow(run, "label binary, id long, low binary")


def linked(n: int, likes, src: list, dst: list, ids: np.ndarray) -> None:
    """Adds links that join the same documents as all links of a group do. likes(i) says which documents are linked with i.

    Rows are asked for one by one; once all documents not yet asked for are in one component, no link between them can join
    anything, and every other link has been seen.
    """
    label, open_ = np.arange(n), np.ones(n, bool)
    i = 0
    while True:
        near = np.flatnonzero(likes(i))
        open_[i] = False
        new = near[label[near] != label[i]]
        if len(new):
            _, at = np.unique(label[new], return_index=True)
            src += [ids[i]] * len(at)
            dst += ids[new[at]].tolist()
            label[np.isin(label, label[new])] = label[i]
        left = np.flatnonzero(open_)
        if len(left) < 2:
            return
        of = label[left]
        if (of == of[0]).all():
            return
        # next, a document of the smallest component
        kinds, counts = np.unique(of, return_counts=True)
        i = left[np.argmax(of == kinds[np.argmin(counts)])]


def forest_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Provisional links (src, dst); rows with a prefix instead of dst are runs that may go on in another partition."""
    need = int(np.floor(VALUES * (threshold - SLACK)))
    width = 1 + 4 * DEPTH

    def close(label, ids, low, edge: bool, src, dst, ends):
        """One run of a prefix."""
        n = len(ids)
        if edge:
            src += [ids[0]] * (n - 1)
            dst += ids[1:].tolist()
            ends.append((label[0, :width].tobytes(), ids[0]))
        elif n == 2:
            if (low[0] == low[1]).sum() >= need:
                src.append(ids[0])
                dst.append(ids[1])
        else:
            linked(n, lambda i: (low == low[i]).sum(axis=1) >= need, src, dst, ids)

    def run(batches):
        held, fresh, joined = None, True, False
        for b in batches:
            if not b.num_rows:
                continue
            n = b.num_rows
            label = np.frombuffer(b.column(0).buffers()[2], np.uint8)[: n * (1 + 4 * LABEL)].reshape(n, -1) if b.column(0).offset == 0 else np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(n, -1)
            low = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(n, VALUES)
            ids = np.asarray(b.column(1))
            if held is not None:
                label, ids, low = np.concatenate([held[0], label]), np.concatenate([held[1], ids]), np.concatenate([held[2], low])
            cuts = np.concatenate([[0], np.flatnonzero((label[1:, :width] != label[:-1, :width]).any(axis=1)) + 1])
            src, dst, ends = [], [], []
            sizes = np.diff(np.append(cuts, len(ids)))
            for k in np.flatnonzero((sizes[:-1] > 1) | (cuts[:-1] == 0)):
                lo, hi = cuts[k], cuts[k] + sizes[k]
                close(label[lo:hi], ids[lo:hi], low[lo:hi], joined or (fresh and k == 0), src, dst, ends)
                joined = False
            if len(cuts) > 1:
                fresh = False
            lo = cuts[-1]
            if len(ids) - lo >= REGION:  # a hot region: its blocks of neighbours are joined by their first documents
                close(label[lo:], ids[lo:], low[lo:], True, src, dst, ends)
                lo, joined = len(ids) - 1, True
            held = (label[lo:].copy(), ids[lo:].copy(), low[lo:].copy())
            yield out(src, dst, ends)
        if held is not None:
            src, dst, ends = [], [], []
            close(*held, True, src, dst, ends)
            yield out(src, dst, ends)

    def out(src, dst, ends):
        a = pa.array([*map(int, src), *(int(e[1]) for e in ends)], pa.int64())
        return pa.RecordBatch.from_arrays([a, pa.array([*map(int, dst), *[None] * len(ends)], pa.int64()), pa.array([*[None] * len(dst), *(e[0] for e in ends)], pa.binary())], ["src", "dst", "prefix"])

    return rows.mapInArrow(run, "src long, dst long, prefix binary")


def exact_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (src, dst) of texts that share a group; members: (grp, id, text). One row at most for each document and group."""

    def run(batches):
        p = Powers()
        for g in key_groups(batches, "grp"):
            ids = g.column("id").to_numpy()
            if len(ids) < 2:
                continue
            sets = list(text_sets(g.column("text").combine_chunks(), size, p))
            n = np.array([len(s) for s in sets])
            if not n.any():
                continue
            cut = np.concatenate([[0], np.cumsum(n)])
            hashes, at = np.unique(np.concatenate(sets), return_inverse=True)

            def likes(i):
                here = np.zeros(len(hashes), bool)
                here[at[cut[i] : cut[i + 1]]] = True
                both = np.concatenate([[0], np.cumsum(here[at])])
                both = both[cut[1:]] - both[cut[:-1]]
                return (100 * both >= percent * (n + n[i] - both)) & (n > 0)

            src, dst = [], []
            linked(len(ids), likes, src, dst, ids)
            yield pa.RecordBatch.from_arrays([pa.array([int(x) for x in src], pa.int64()), pa.array([int(x) for x in dst], pa.int64())], ["src", "dst"])

    return members.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "src long, dst long")


def near_rows(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_shingles, component_id, kept) of every row of docs, which is numbered(); see near_groups."""
    sk = materialize(sketches(docs, shingle, id_col, text_col), "sketches")
    # A set is named by the row that comes first by (id, row); first also has the digest, which orders the sets of one id.
    sets = sk.filter("n > 0 and id is not null").groupBy("digest").agg(F.min(F.struct("id", "row")).alias("low"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    sets = materialize(sets.select("digest", F.col("low.row").alias("id"), F.struct("low.id", "digest", "low.row").alias("first"), "sig", "n"), "sets")
    rows = forest_rows(sets)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(forest_links(rows.repartitionByRange(parts, "label", "id").sortWithinPartitions("label", "id"), percent / 100), "forest")
    ends = found.filter("prefix is not null").select("prefix", "src")
    over = ends.join(ends.groupBy("prefix").agg(F.min("src").alias("dst")), "prefix").select("src", "dst")
    near = components(found.filter("prefix is null").select("src", "dst").union(over), name="provisional")
    near = materialize(near.join(sets.select(F.col("id").alias("node"), "n"), "node").groupBy("node", "component").agg(F.max("n").alias("n")), "near")
    texts = docs.select(F.col("_row").alias("node"), F.col(text_col).cast("string").alias("text"))

    def confirmed(placed: DataFrame, name: str) -> DataFrame:
        # The same join at every size: members grow with the corpus, so they are never broadcast.
        members = placed.distinct().hint("merge").join(texts, "node").select("grp", F.col("node").alias("id"), "text")
        return materialize(exact_links(members, shingle, percent), name)

    # Blocks of each component, and the first set of the component in each of them.
    blocks = near.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks"), F.min("node").alias("head"))
    placed = near.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    grp = F.xxhash64("component", "own").alias("grp")
    found = confirmed(placed.select("node", grp).union(placed.filter("blocks > 1").select(F.col("head").alias("node"), grp)), "own-links")
    large = materialize(placed.filter("blocks > 1"), "large")
    if not large.isEmpty():
        # What is in the first set's cluster is linked already; only what is not, the rest, is compared with all blocks.
        clusters = components(found, name="clusters")
        large = large.join(clusters.select("node", F.col("component").alias("cluster")), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
        heads = large.filter("node = head").select("component", F.col("cluster").alias("head_cluster"))
        large = large.join(heads, "component").withColumn("rest", F.col("cluster") != F.col("head_cluster"))
        sizes = large.filter("rest").groupBy("component").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("parts"))
        large = materialize(large.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).cast("int")), "rest")
        every = large.select("node", "component", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        rest = large.filter("rest").select("node", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), "part")
        found = found.union(confirmed(every.unionByName(rest).select("node", F.xxhash64("component", "own", "part").alias("grp")), "rest-links"))
    links = components(found, name="confirmed")
    # The first row of a component; most sets are single and in no link.
    linked_sets = links.join(sets.select(F.col("id").alias("node"), "first"), "node")
    names = linked_sets.groupBy("component").agg(F.min("first").alias("least"))
    links = links.join(names, "component").select(F.col("node").alias("id"), "least")
    # Copies of one digest follow the first of them.
    heads = sets.select("digest", "id", "first").join(links, "id", "left").select("digest", F.coalesce("least", "first").alias("least"))
    out = sk.filter("n > 0 and id is not null").join(heads, "digest").select("row", "id", "n", F.col("least.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("kept"))
    out = out.union(sk.filter("n = 0 or id is null").select("row", "id", "n", F.col("id").alias("component_id"), F.lit(True).alias("kept")))
    return out.withColumnRenamed("n", "n_shingles")


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row of docs.

    Words are runs of bytes that are no white space, A-Z lower-cased. Rows are linked if 100 times the intersection
    of their shingle sets is percent times the union or more; a component is named by its least id, and one row of it
    is kept: the first by (id, digest of the set, row). Null and empty texts, and texts without words, have n_shingles 0 and are
    linked with nothing. Rows that repeat an id are compared like any others. A null id stays alone: component_id is null
    and the row is kept. Other columns are ignored.
    """
    out = near_rows(numbered(docs.select(id_col, text_col), "near-texts"), shingle, percent, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")
