"""Alignment of two tokenizers' tokens over the same texts.

Side A is a byte-level BPE, side B a piece BPE with byte fallback. Both read a blank and the text, so that their tokens cover the same bytes.

1. Texts are cut where a printable ASCII character is followed by a blank. Neither side has a token across such a place (`cuts_are_exact`), so each distinct segment of a batch is
   encoded once, and long texts need no more memory than their longest segment asks for.
2. In a batch, keyed by document, pandas merge_asof finds for each token's start the other side's token that covers it. Both directions together give all overlaps; overlaps of equal
   ends are the links, and cut the tokens into groups.
3. Batches give a row for each document, with its links as (pair, times), and rows that sum up the batch's pairs. The sums meet by pair. In a link the shorter token is the end of the longer,
   so there are no more pairs than suffixes of entries of one vocabulary in the other (`possible_pairs`), whatever the corpus: their counts are small enough to be broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lograil.llm.common import gathered, materialize, small_batches, text_buffers

#: Bytes of text of a batch.
BATCH = 1 << 20
#: Segments, and characters in them, that a worker remembers with their ids; it forgets all before it learns more. Segments encoded as one text.
REMEMBERED, REMEMBERED_BYTES, RUN = 200_000, 4 << 20, 256
BLANK_PIECE = "▁"
#: A pair (a, b) is a * PAIR + b.
PAIR = 1 << 32


def byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 characters stand for themselves, the other bytes for the characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_of_letter()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(BLANK_PIECE, " ").encode() for p in pieces]
        self.sizes = tuple(np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.cuts = self.cuts_are_exact(a_path, pieces)
        self.forget()
        self.names = tuple([str(i).encode() for i in range(len(side))] for side in (self.a_bytes, self.b_bytes))

    def cuts_are_exact(self, a_path: str, pieces: list[str]) -> bool:
        """Whether texts may be cut before a blank that follows a printable character: A splits there first (the byte-level pattern), and no piece of B has a blank behind another character, so no merge can cross it."""
        with open(a_path) as f:
            split = json.load(f).get("pre_tokenizer") or {}
        return split.get("type") == "ByteLevel" and split.get("use_regex", True) and not any(BLANK_PIECE in p.lstrip(BLANK_PIECE) for p in pieces)

    def possible_pairs(self) -> int:
        """How many pairs may ever be linked: of two tokens that end together one is the end of the other."""
        a, b = ({x for x in side if x} for side in (self.a_bytes, self.b_bytes))
        ends = lambda one, other: sum(x[k:] in other for x in one for k in range(len(x)))
        return ends(a, b) + ends(b, a) - len(a & b)

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held_bytes, self.good = 0, np.zeros(0, bool)
        self.ids, self.begin = [np.zeros(0, np.int64)] * 2, [np.zeros(1, np.int64)] * 2

    def one(self, segment: str) -> tuple[list[int], list[int]] | None:
        """Ids of a segment for A and B, or None if it does not come back from them."""
        a, b = self.a.encode(segment, add_special_tokens=False).ids, self.b.encode(segment[1:])
        whole = segment.encode()
        return (a, b) if b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)) else None

    def learn(self, segments: list[str]) -> None:
        """Encodes new segments. Those that end in printable ASCII are encoded many at a time, as text may be cut between them."""
        ids, counts, good = ([], []), ([], []), []

        def single(some: list[str]) -> None:
            for x in some:
                got = self.one(x)
                good.append(got is not None)
                for side in range(2):
                    ids[side].append(np.array(got[side] if got else [], np.int64))
                    counts[side].append(np.array([len(got[side]) if got else 0], np.int64))

        joined = [x for x in segments if self.cuts and "!" <= x[-1] <= "~"]
        odd = [x for x in segments if not (self.cuts and "!" <= x[-1] <= "~")]
        runs = [joined[k : k + RUN] for k in range(0, len(joined), RUN)]
        texts = ["".join(r) for r in runs]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        for run, text, both in zip(runs, texts, zip(a, b)):
            whole = text.encode()
            if any(b"".join(map(side.__getitem__, x)) != whole for side, x in zip((self.a_bytes, self.b_bytes), both)):
                single(run)
                continue
            ends = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in run])
            for side in range(2):
                own = np.array(both[side], np.int64)
                ids[side].append(own)
                counts[side].append(np.diff(np.searchsorted(np.cumsum(self.sizes[side][own]), ends, "right"), prepend=0))
            good += [True] * len(run)
        single(odd)
        self.number.update(zip(joined + odd, range(len(self.good), len(self.good) + len(segments))))
        self.held_bytes += sum(map(len, segments))
        self.good = np.concatenate([self.good, np.array(good, bool)])
        for side in range(2):
            last = self.begin[side][-1]
            self.ids[side] = np.concatenate([self.ids[side], *ids[side]])
            self.begin[side] = np.concatenate([self.begin[side], last + np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts[side]]))])

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """For A and B: all ids of some texts, which begin with a blank, and the bounds of each text's. Texts that do not come back from their tokens have none."""
        cut = np.zeros(len(raw) + 1, bool)
        if self.cuts and len(raw):
            cut[1:-1] = (raw[1:] == 32) & (raw[:-1] > 32) & (raw[:-1] < 127)
        cut[bounds[1:] - 1] = False  # B writes a blank before some text only, so a last blank is no segment
        cut[bounds] = True
        at = np.flatnonzero(cut).astype(np.int64)
        segments = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        own = segments.dictionary.to_pylist()
        if len(self.number) > REMEMBERED or self.held_bytes > REMEMBERED_BYTES:
            self.forget()
        if new := [x for x in own if x not in self.number]:
            self.learn(new)
        number = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))
        first, which = np.searchsorted(at, bounds), number[segments.indices.to_numpy()]
        ok = np.ones(len(bounds) - 1, bool)
        ok[np.searchsorted(first, np.flatnonzero(~self.good[which]), "right") - 1] = False
        keep = np.repeat(ok, np.diff(first))
        take, out = which[keep], []
        for ids, begin in zip(self.ids, self.begin):
            n = np.where(keep, begin[which + 1] - begin[which], 0)
            upto = np.concatenate([[0], np.cumsum(n)])
            n = n[keep]
            starts = begin[take] - (np.cumsum(n) - n)
            out.append((ids[np.repeat(starts, n) + np.arange(n.sum())], upto[first]))
        return tuple(out)


@lru_cache(2)
def sides(a_path: str, b_path: str) -> Sides:
    """A Python worker runs many tasks; the tokenizers stay with it."""
    return Sides(a_path, b_path)


class Tokens(NamedTuple):
    """Of each token of a batch: its document's number, its first byte and the one after its last (counted over the batch), its id. bounds: of each document's tokens."""

    doc: np.ndarray
    at: np.ndarray
    end: np.ndarray
    id: np.ndarray
    bounds: np.ndarray

    def starts(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"doc": self.doc, "at": self.at, name: np.arange(len(self.at))}, copy=False)


def tokens_of(ids: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, base: np.ndarray) -> Tokens:
    size, counts = sizes[ids], np.diff(bounds)
    upto = np.concatenate([[0], np.cumsum(size)])
    at = upto[:-1] - np.repeat(upto[bounds[:-1]] - base, counts)
    return Tokens(np.repeat(np.arange(len(counts)), counts), at, at + size, ids, bounds)


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all A and B tokens that share bytes in a document: each A token with the B token that covers its start, and each B token with the A token that covers its start, once where both start together."""
    left, right = a.starts("a"), b.starts("b")
    a_covered, b_covered = pd.merge_asof(left, right, on="at", by="doc")["b"].to_numpy(), pd.merge_asof(right, left, on="at", by="doc")["a"].to_numpy()
    inside = np.flatnonzero(a.at[b_covered] < b.at)
    return np.concatenate([np.arange(len(a.at)), b_covered[inside]]), np.concatenate([a_covered, inside])


class Aligned(NamedTuple):
    """Tokens of both sides, the overlaps' tokens, and the links' tokens in order."""

    a: Tokens
    b: Tokens
    overlaps: tuple[np.ndarray, np.ndarray]
    links: tuple[np.ndarray, np.ndarray]


def aligned(s: Sides, raw: np.ndarray, bounds: np.ndarray) -> Aligned:
    """Alignment of a batch of texts, each with a blank before it."""
    a, b = (tokens_of(ids, at, size, bounds[:-1]) for (ids, at), size in zip(s.encode(raw, bounds), s.sizes))
    both = overlaps(a, b)
    together = a.end[both[0]] == b.end[both[1]]
    left, right = both[0][together], both[1][together]
    order = np.argsort(left, kind="stable")
    return Aligned(a, b, both, (left[order], right[order]))


def with_blank(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a blank before each that is not empty."""
    full = np.diff(bounds) > 0
    return np.insert(raw, bounds[:-1][full], 32), bounds + np.concatenate([[0], np.cumsum(full)])


def group_texts(s: Sides, got: Aligned) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each document: its groups in order."""
    groups, ends = [], []
    for tokens, links in zip((got.a, got.b), got.links):
        last = np.zeros(len(tokens.id), bool)
        last[links] = True
        ends.append(last)
        groups.append(np.cumsum(last) - last)  # whole groups before
    before = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(got.links[0]) + 1))]) for g in groups]
    # A token of A stands behind the B tokens of the groups before its own, one of B behind the A tokens of its own group as well.
    code, width, table = np.empty(sum(map(len, groups)), np.int64), max(len(x) for x in s.names), _written(s)
    for side, tokens in enumerate((got.a, got.b)):
        place = np.arange(len(tokens.id)) + before[1 - side][groups[side] + side]
        code[place] = tokens.id + width * (2 * side + ends[side])
    written, at = [table[c] for c in code.tolist()], (got.a.bounds + got.b.bounds).tolist()
    return [b"".join(written[lo:hi])[:-1] for lo, hi in zip(at[:-1], at[1:])]


@lru_cache(2)
def _written(s: Sides) -> list[bytes]:
    """What an id gives in a group's text: with a comma, or with what ends its side of the group."""
    width = max(len(x) for x in s.names)
    out = []
    for names, end in zip(s.names, (b"|", b";")):
        for mark in (b",", end):
            out += [x + mark for x in names] + [b""] * (width - len(names))
    return out


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"


def document_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs, with its links as distinct pairs and how often each is there, and rows of n_a null that sum up the pairs of a batch."""

    def counted(pairs: np.ndarray, rows: np.ndarray, n: int):
        """Distinct (row, pair) and their numbers, and the bounds of each row's."""
        order = np.argsort(pairs, kind="stable")
        order = order[np.argsort(rows[order], kind="stable")]
        pairs, rows = pairs[order], rows[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(new)
        return pairs[at], np.diff(np.append(at, len(pairs))), np.searchsorted(rows[at], np.arange(n + 1))

    def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int64)))

    def run(batches):
        s = sides(a_path, b_path)
        for b in gathered(batches, 1, BATCH):
            n = b.num_rows
            got = aligned(s, *with_blank(*text_buffers(b.column(1))))
            rows = got.a.doc[got.links[0]]
            pairs, times, at = counted(got.a.id[got.links[0]] * PAIR + got.b.id[got.links[1]], rows, n)
            n_a, n_b = np.diff(got.a.bounds), np.diff(got.b.bounds)
            sha = [hashlib.sha256(t).hexdigest() if k else "" for t, k in zip(group_texts(s, got), n_a)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_a), pa.array(n_b), pa.array(np.bincount(rows, minlength=n)), pa.array(sha), lists(pairs, at), lists(times, at)], NAMES)
            which, place = np.unique(pairs, return_inverse=True)
            sums = np.zeros(len(which), np.int64)
            np.add.at(sums, place, times)
            nothing = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.nulls(1, pa.string()), lists(which, np.array([0, len(which)])), lists(sums, np.array([0, len(sums)]))], NAMES)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best) over all documents: how many links hold the pair, and whether no other pair of its B id has more."""
    sums = found.filter("n_a is null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    top = F.max("n").over(W.partitionBy(F.pmod("pair", F.lit(PAIR))))
    return sums.select("pair", "n", (F.col("n") == top).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    Tokens of both sides that end at the same byte are linked, and close a group. count_sum adds up how often each link's pair of ids is linked in all documents; n_best counts the links whose pair
    is the most frequent of its B id, ties included. Null and empty texts, and those that do not come back from the tokens of either side, have no tokens: zeros, and an empty groups_sha256.
    Rows that repeat an id each get their own row and all count; a null id stays null. Other columns are ignored. A text of any length is encoded in segments; a task holds one text's tokens.
    """
    found = materialize(document_links(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "links")
    rows = found.filter("n_a is not null")
    counts = materialize(pair_counts(found), "pairs")
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = each.join(F.broadcast(counts), "pair").groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = rows.select("row", F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row", "left")
    return out.select(id_col, "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
