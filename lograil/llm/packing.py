"""Packing token sequences by the linear grouping scheme.

Lengths are integers up to the capacity, so the whole packing problem is a histogram of at most `capacity` rows, however many
documents there are. It is solved on the driver for the histogram; what comes out is a table of slots (length, rank range,
sequence, offset), whose size depends on the number of distinct lengths only. Documents then find their slots by their rank
among documents of equal length, which is counted in buckets, without a global sort and without groups that grow.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lograil.llm.common import IS_SPACE, chunks, gathered, numbered, small_batches, text_buffers

#: Lengths above this share of the capacity are large; equal-cardinality groups of large lengths, few for the best configurations and many for the greedy ones.
LARGE_SHARE, GROUPS, FINE_GROUPS = 0.125, 64, 512
#: Words whose ids a worker remembers; about 200 bytes each.
REMEMBERED = 1_000_000
#: Bytes of text whose words are looked up at a time; a longer text is cut at white space.
SPAN = 16 << 20
#: Words encoded as one text, and what may stand between them: the first that the tokenizer has one id for.
RUN, MARKS = 512, "|~§¶"
#: Documents of one rank bucket, about.
RANK_BUCKET = 50_000
#: Splits of which a letter or digit and an ASCII sign after it never share a piece, so a sign run is a word of its own. The apostrophe stays, as it may take letters with it.
SIGN_SPLITS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
#: 1 for ASCII letters and digits, 3 for ASCII signs but the apostrophe, 2 for all else but white space, 7 for that: only a sign after a letter or digit is 2 more.
KINDS = np.full(256, 2, np.int8)
KINDS[[c for c in range(33, 127) if chr(c).isalnum()]] = 1
KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 3
KINDS[[9, 10, 11, 12, 13, 32]] = 7


def run_ids(tok, runs: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run of words: the ids of all its words, one after the other, and how many each has.

    A run is encoded as one text, with a mark of one id between its words. Blanks keep the mark apart, so each mark gives its
    id. If the id comes more often, words have it too, and they are encoded one by one.
    """
    mark, mark_id = next(((c, e.ids[0]) for c in MARKS if len(e := tok.encode(c, add_special_tokens=False)) == 1), (None, None))
    for k in range(0, len(runs), 32):
        some = runs[k : k + 32]
        whole = tok.encode_batch_fast([f" {mark} ".join(words) for words in some], add_special_tokens=False) if mark else [None] * len(some)
        for words, e in zip(some, whole):
            if e is not None:
                ids = np.array(e.ids, np.uint32)
                cuts = np.flatnonzero(ids == mark_id)
            if e is None or len(cuts) != len(words) - 1:
                each = [x.ids for x in tok.encode_batch_fast(words, add_special_tokens=False)]
                yield np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
                continue
            yield np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1


class WordIds:
    """Ids of texts, from those of their words, which are encoded once and remembered.

    Right for tokenizers that drop ASCII white space and never look across it; others are refused. Where the tokenizer lower-cases, so are the
    words; where it splits signs off (SIGN_SPLITS), so is done here. Both leave the ids as they are and make fewer words.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        if self.ids_of("a\tb") != self.ids_of("a") + self.ids_of("b") or self.ids_of(" \n\t ") or self.ids_of(" ab\n") != self.ids_of("ab"):
            raise ValueError("a tokenizer that keeps white space cannot be used here")
        spec = json.loads(self.tok.to_str())
        parts = lambda kind, many: [p for p in (spec.get(kind) or {}).get(many, [spec.get(kind)]) if p]
        self.lower = any(p["type"] == "Lowercase" for p in parts("normalizer", "normalizers"))
        self.splits = any(p["type"] == "Split" and p["pattern"].get("Regex") in SIGN_SPLITS for p in parts("pre_tokenizer", "pretokenizers"))
        self.forget()

    def ids_of(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.begin, self.held, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def learn(self, words: list[str]) -> None:
        self.number.update(zip(words, range(self.held, self.held + len(words))))
        self.begin = self.room(self.begin, self.held + len(words) + 1)
        for ids, sizes in run_ids(self.tok, [words[k : k + RUN] for k in range(0, len(words), RUN)]):
            self.ids = self.room(self.ids, self.used + len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.begin[self.held + 1 : self.held + len(sizes) + 1] = self.used + np.cumsum(sizes)
            self.held, self.used = self.held + len(sizes), self.used + len(ids)

    @staticmethod
    def room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def of(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and the bounds of each text's."""
        if self.splits and len(raw):
            kind = KINDS[raw]
            at = np.flatnonzero((kind[1:] - kind[:-1]) == 2) + 1
            bounds = bounds + np.searchsorted(at, bounds)
            raw = np.insert(raw, at, 32)
        texts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.lower else texts)
        words = lists.flatten().dictionary_encode()
        own = words.dictionary.to_pylist()
        number = np.fromiter(map(self.number.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(number < 0)
        if self.held + len(new) > REMEMBERED:
            self.forget()
            new = np.arange(len(own))
        if len(new):
            number[new] = self.held + np.arange(len(new))
            self.learn([own[i] for i in new])
        # Starts and sizes of the distinct words first, then of all words by their place among the distinct ones.
        begin, at = self.begin[number], words.indices.to_numpy()
        size = (self.begin[number + 1] - begin)[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin[at] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def spans(raw: np.ndarray, most: int = SPAN) -> Iterator[tuple[int, int]]:
    """Parts of a text of about so many bytes, cut after white space; a word is never cut."""
    at = 0
    while at < len(raw):
        end = at + most
        while end < len(raw):
            gap = np.flatnonzero(IS_SPACE[raw[end - most : end]])
            if len(gap):
                end += int(gap[-1]) + 1 - most
                break
            end += most
        yield at, min(end, len(raw))
        at = end


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of each text and the end id, cut at capacity. Every row of docs gives its pieces, repeated rows too.

    A null text is empty: its only id is the end id. A null id stays null. A long text is encoded in parts of about SPAN bytes and cut into pieces as its
    ids come, so a task holds one text and one part's words. Other columns are ignored.
    """

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        words = _workers_words(tokenizer_path)
        end = np.array([end_id], np.uint32)
        for b in gathered(batches, 1, SPAN):
            raw, bounds = text_buffers(b.column(1))
            out: tuple[list, ...] = ([], [], [], [], [])

            def cut(row: int, ids: np.ndarray, start: int, last: bool) -> np.ndarray:
                """Pieces of a row's ids from start on; what is not a whole piece is left, unless it is the last."""
                whole = len(ids) if last else len(ids) // capacity * capacity
                data = ids.astype("<u4", copy=False)
                for at in range(0, whole, capacity):
                    part = data[at : min(at + capacity, whole)]
                    for column, value in zip(out, (row, (start + at) // capacity, start + at, len(part), zlib.crc32(part.tobytes()))):
                        column.append(value)
                return ids[whole:]

            for lo, hi in chunks(bounds, SPAN):
                if bounds[hi] - bounds[lo] <= SPAN:
                    ids, at = words.of(raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                    for i in range(lo, hi):
                        cut(i, np.concatenate([ids[at[i - lo] : at[i - lo + 1]], end]), 0, True)
                    continue
                text, left, start = raw[bounds[lo] : bounds[hi]], end[:0], 0
                for x, y in spans(text):
                    ids = np.concatenate([left, words.of(text[x:y], np.array([0, y - x]))[0]])
                    left = cut(lo, ids, start, False)
                    start += len(ids) - len(left)
                cut(lo, np.concatenate([left, end]), start, True)
            rows, piece, start, length, crc = out
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@lru_cache(2)
def _workers_words(tokenizer_path: str) -> WordIds:
    """A Python worker runs many tasks; the words that it knows stay with it."""
    return WordIds(tokenizer_path)


def grouped(counts: dict[int, int], groups: int) -> dict[int, list[tuple[int, int]]]:
    """Rounded length -> [(length, count)] of its group, longest first; groups have equal cardinality, or one length."""
    total = sum(counts.values())
    out: dict[int, list[tuple[int, int]]] = {}
    each, room, top = -(-total // max(groups, 1)), 0, 0
    for length in sorted(counts, reverse=True):
        if room <= 0:
            top, room = length, each
            out[top] = []
        out[top].append((length, counts[length]))
        room -= counts[length]
    return out


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """How often to take each size so that the sum of values is greatest within capacity (an unbounded knapsack)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i in np.argsort(sizes):
        s, v = int(sizes[i]), float(value[i])
        if v <= 0:
            continue
        for lo in range(s, capacity + 1, s):  # one block may build on the block before
            hi = min(lo + s, capacity + 1)
            new = best[lo - s : hi - s] + v
            better = new > best[lo:hi] + 1e-12
            best[lo:hi][better] = new[better]
            last[lo:hi][better] = i
    at, count = int(np.argmax(best)), np.zeros(len(sizes), np.int64)
    top = float(best[at])
    while at > 0 and last[at] >= 0:
        count[last[at]] += 1
        at -= int(sizes[last[at]])
    return top, count


def configurations(left: dict[int, int], capacity: int, most: int = 4000) -> list[tuple[int, list[int]]]:
    """(times, sizes) that use up all sizes in few sequences.

    The linear relaxation over all configurations is solved by column generation: a basis of as many configurations as sizes, priced by a knapsack over the dual
    values. Its whole parts are taken; what is left (less than one of each configuration) is filled greedily by the same knapsack.
    """
    sizes = np.array(sorted(left, reverse=True), np.int64)
    need = np.array([left[int(s)] for s in sizes], np.float64)
    basis = np.diag((capacity // sizes).astype(np.float64))  # a column is a configuration
    x = need / np.diag(basis)
    for _ in range(most):
        try:
            dual = np.linalg.solve(basis.T, np.ones(len(sizes)))
        except np.linalg.LinAlgError:
            break
        top, count = best_pattern(sizes, dual, capacity)
        if top <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, count.astype(np.float64))
        ratio = np.where(step > 1e-12, x / np.where(step > 1e-12, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = count
    rest, plans = need.astype(np.int64), []
    for j in np.argsort(-x):
        config = np.rint(basis[:, j]).astype(np.int64)
        used = config > 0
        times = int(min(np.floor(x[j] + 1e-9), (rest[used] // config[used]).min()))
        if times > 0:
            plans.append((times, np.repeat(sizes, config).tolist()))
            rest -= times * config
    return plans + _greedy({int(s): int(n) for s, n in zip(sizes, rest) if n}, capacity)


def _greedy(left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, sizes) that use up all sizes: each holds the largest size left, and what fills the rest best."""
    sizes = np.array(sorted(left, reverse=True), np.int64)
    rest, plans = np.array([left[int(s)] for s in sizes], np.int64), []
    while rest.any():
        open_ = np.flatnonzero(rest)
        config = np.zeros(len(sizes), np.int64)
        config[open_[0]] = 1
        some, n = _fill(sizes[open_], rest[open_] - config[open_], capacity - int(sizes[open_[0]]))
        config[open_[some]] += n
        used = config > 0
        times = int((rest[used] // config[used]).min())
        plans.append((times, np.repeat(sizes, config).tolist()))
        rest -= times * config
    return plans


def _fill(sizes: np.ndarray, most: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes (with how often, at most so often) whose sum comes nearest to room from below."""
    via = np.full(room + 1, -1)
    via[0] = len(sizes)
    for i, (s, m) in enumerate(zip(sizes.tolist(), most.tolist())):
        for _ in range(min(m, room // s)):
            fresh = np.flatnonzero((via[: room + 1 - s] >= 0) & (via[s:] < 0)) + s
            if via[room] >= 0 or not len(fresh):
                break
            via[fresh] = i
    at, used = int(np.flatnonzero(via >= 0)[-1]), np.zeros(len(sizes), np.int64)
    while at:
        used[via[at]] += 1
        at -= int(sizes[via[at]])
    some = np.flatnonzero(used)
    return some, used[some]


def solve(counts: dict[int, int], capacity: int, large_share: float = LARGE_SHARE, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies)]): sequences of equal content, which use each length as often as counts says.

    Large lengths are rounded up within groups of equal cardinality. Few groups get the best configurations, many groups lose less by rounding and are
    filled greedily; of the two plans, the one of fewer sequences is taken.
    """
    plans = [_solve(counts, capacity, large_share, groups, configurations), _solve(counts, capacity, large_share, FINE_GROUPS, _greedy)]
    return min(plans, key=lambda p: sum(t for t, _ in p))


def _solve(counts: dict[int, int], capacity: int, large_share: float, groups: int, configure) -> list[tuple[int, list[tuple[int, int]]]]:
    large = {n: c for n, c in counts.items() if n > large_share * capacity}
    small = {n: c for n, c in counts.items() if n not in large}
    members = grouped(large, groups)
    plans = configure({top: sum(c for _, c in m) for top, m in members.items()}, capacity)
    # Substitute actual lengths, longest first. A configuration splits where one of its places goes on to a shorter length.
    stock = {top: [list(x) for x in m] for top, m in members.items()}
    bins: dict[int, list[list]] = defaultdict(list)  # room left -> [[times, {length: copies}]]
    for times, used in plans:
        while times:
            take: dict[tuple[int, int], int] = defaultdict(int)
            at = {top: 0 for top in used}
            got: dict[tuple[int, int], int] = defaultdict(int)
            for top in used:
                while got[top, at[top]] >= stock[top][at[top]][1]:
                    at[top] += 1
                got[top, at[top]] += 1
                take[top, at[top]] += 1
            n = min(times, *(stock[top][i][1] // k for (top, i), k in take.items()))
            content: dict[int, int] = defaultdict(int)
            for (top, i), k in take.items():
                content[stock[top][i][0]] += k
                stock[top][i][1] -= k * n
            for top in set(used):
                stock[top] = [x for x in stock[top] if x[1]]
            bins[capacity - sum(s * k for s, k in content.items())].append([n, dict(content)])
            times -= n
    # Best fit of small lengths, longest first: the fullest sequences that still have room.
    rooms = sorted(bins)
    for s in sorted(small, reverse=True):
        n = small[s]
        while n:
            room = next((r for r in rooms if r >= s and bins[r]), None)
            if room is None:
                k = capacity // s
                whole = n // k
                fresh = [(whole, k)] if whole else []
                fresh += [(1, n % k)] if n % k else []
                n = 0
                for times, k in fresh:
                    bins[capacity - k * s].append([times, {s: k}])
                rooms = sorted(r for r in bins if bins[r])
                continue
            times, content = bins[room].pop()
            k = room // s
            whole = min(times, n // k)
            parts = [(whole, k)] if whole else []
            n -= whole * k
            if whole < times:
                rest = times - whole
                if n:  # fewer than k are left
                    parts.append((1, n))
                    n, rest = 0, rest - 1
                parts += [(rest, 0)] if rest else []
            for t, k in parts:
                bins[room - k * s].append([t, content | ({s: content.get(s, 0) + k} if k else {})])
            rooms = sorted(r for r in bins if bins[r])
    return [(t, sorted(content.items(), reverse=True)) for r in sorted(bins) for t, content in bins[r]]


def slot_table(plans: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), sorted by length and rank."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for times, content in plans:
        offset = 0
        for length, copies in content:
            rows.append((length, rank[length], copies, sequence, offset))
            rank[length] += times * copies
            offset += length * copies
        sequence += times
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset. Needs doc_id, piece and length (1 to capacity); every row gets a place, repeated rows too."""
    pieces = numbered(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = slot_table(solve(counts, capacity))
    # Rank buckets are dealt by the number of the row, so one id, or equal rows, spread as any others.
    buckets = max(1, sum(counts.values()) // RANK_BUCKET)
    ranked = pieces.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    sums = ranked.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    sums = sums.withColumn("_from", F.sum("_n").over(W.partitionBy("length").orderBy("_b")) - F.col("_n")).drop("_n")
    ranked = ranked.withColumn("_r", F.row_number().over(W.partitionBy("length", "_b").orderBy("_row"))).join(sums, ["length", "_b"])
    ranked = ranked.withColumn("_r", F.col("_r") - 1 + F.col("_from")).drop("_b", "_from", "_row")
    columns = [c for c in ranked.columns if c != "_r"]

    def run(batches):
        keys = (table[:, 0] << 48) | table[:, 1]
        for b in batches:
            length, r = np.asarray(b.column("length")), np.asarray(b.column("_r"))
            row = table[np.searchsorted(keys, (length << 48) | r, "right") - 1]
            i = r - row[:, 1]
            arrays = [b.column(c) for c in columns] + [pa.array(row[:, 3] + i // row[:, 2]), pa.array(row[:, 4] + i % row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    schema = ranked.drop("_r").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)
