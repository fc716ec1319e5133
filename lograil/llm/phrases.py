"""Phrase mining by relations of occurrences, in the manner of SETM (Houtsma and Swami, 1995).

1. Words are counted per language; frequent ones are numbered. The occurrences of frequent words are persisted, a row for each part of a text, sorted by place. Places leave a gap
   where a piece ends, so places that follow each other are neighbours in a piece.
2. Level k + 1 merge-joins the occurrences of level k with themselves by piece and adjacent place: a phrase and the one that begins a word later make a phrase one word longer.
   Pairs are counted in each batch, the counts meet, and frequent pairs are numbered. Occurrences are semi-joined with the frequent pairs, and persisted as the relation of the next level,
   so only occurrences whose two parts are frequent are ever extended.
3. Semi-joins look pairs up in a table that every task holds, if its rows are counted to be at most `lookup`; a larger one meets the occurrences in a shuffle join.
4. Counts of all parts of a phrase are in those tables: cuts join them by text. A phrase is dropped if a phrase one word longer, on either side, is as frequent; longer ones imply that one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lograil.llm.common import LOWER, gathered, materialize, small_batches, text_buffers

#: Bytes of text of a batch, and of a part of a text (cut where a piece ends).
BATCH, PART = 8 << 20, 4 << 20
#: Frequent words or pairs that a task looks up by itself (24 bytes each, and a word's letters).
LOOKUP = 1 << 21
#: Phrases of a language that are compared in one task at a time, at most `top` of each of so many parts.
SALTS = 64
IS_END, IS_GAP = np.zeros(256, bool), np.zeros(256, bool)
IS_END[list(b".,;:!?\n\x0b\x0c\r")] = True
IS_GAP[list(b" \t")] = True
RELATION = "part long, lang string, at array<int>, id array<long>"


def parts_of(raw: np.ndarray, bounds: np.ndarray):
    """(row, lo, hi) of parts of about PART bytes; a part ends behind a separator, so no piece is cut."""
    for row, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        while hi - lo > PART:
            at, ends = lo + PART, np.zeros(0, np.int64)
            while at < hi and not len(ends):
                ends = np.flatnonzero(IS_END[raw[at : at + PART]])
                at += int(ends[0]) + 1 if len(ends) else PART
            if not len(ends):
                break
            yield row, lo, at
            lo = at
        yield row, lo, hi


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of some texts, A-Z lower-cased, the place of each, and each text's bounds among them. A place is the words and piece ends before it in the batch."""
    end = IS_END[raw]
    solid = ~(end | IS_GAP[raw])
    begins, stops = solid.copy(), np.zeros(len(raw) + 1, bool)
    begins[1:] &= ~solid[:-1]
    stops[1:] = solid
    stops[1:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    begins[inner] = solid[inner]
    stops[inner] = solid[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(stops)
    upto = np.concatenate([[0], np.cumsum(stops - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(LOWER[raw[solid]]))
    return words, np.arange(len(starts)) + np.cumsum(end)[starts] if len(raw) else np.zeros(0, np.int64), np.searchsorted(starts, bounds)


def batch_words(batches):
    """(languages, words, places, bounds) of batches of (lang, text), text by text or in parts of long ones."""
    for b in gathered(batches, 1, BATCH):
        raw, bounds = text_buffers(b.column(1))
        langs = b.column(0)
        if len(bounds) > 1 and np.diff(bounds).max() > PART:
            cut = list(parts_of(raw, bounds))
            langs = langs.take(pa.array([row for row, _, _ in cut]))
            bounds = np.array([lo for _, lo, _ in cut] + [len(raw)], np.int64)
        yield langs, *words_of(raw, bounds)


def lists(values: np.ndarray, at: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of texts (lang, text), counted in each batch first."""

    def run(batches):
        for langs, words, _, first in batch_words(batches):
            code = words.dictionary_encode()
            kinds = langs.dictionary_encode()
            which = np.repeat(kinds.indices.to_numpy(zero_copy_only=False), np.diff(first)).astype(np.int64) * max(len(code.dictionary), 1) + code.indices.to_numpy(zero_copy_only=False)
            keys, n = np.unique(which, return_counts=True)
            size = max(len(code.dictionary), 1)
            yield pa.RecordBatch.from_arrays([kinds.dictionary.take(pa.array(keys // size)), code.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def small(table: DataFrame, lookup: int) -> pa.Table | None:
    """The rows of a table that are counted to be at most so many, else None."""
    return table.toArrow() if table.count() <= lookup else None


def regrouped(rows: DataFrame) -> DataFrame:
    """Occurrences (part, lang, at, id) as a relation again, a row for each part."""
    out = rows.groupBy("part").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "id"))).alias("x"))
    return out.select("part", "lang", F.transform("x", lambda r: r["at"]).alias("at"), F.transform("x", lambda r: r["id"]).alias("id"))


def word_occurrences(texts: DataFrame, frequent: DataFrame, lookup: int = LOOKUP) -> DataFrame:
    """The relation of frequent words: texts (lang, text) semi-joined with frequent (lang, phrase, id)."""
    held = small(frequent.select("lang", "phrase", "id"), lookup)

    def known(batches):
        by_lang = {}
        for lang in pc.unique(held["lang"]).to_pylist():
            own = held.filter(pc.equal(held["lang"], lang))
            by_lang[lang] = own["phrase"].combine_chunks().cast(pa.large_string()), own["id"].to_numpy()
        for langs, words, places, first in batch_words(batches):
            code = words.dictionary_encode()
            ids = np.zeros(len(words), np.int64)
            seen, kind = code.indices.to_numpy(zero_copy_only=False), langs.dictionary_encode()
            of = np.repeat(kind.indices.to_numpy(zero_copy_only=False), np.diff(first))
            for i, lang in enumerate(kind.dictionary.to_pylist()):
                if lang in by_lang:
                    found = pc.index_in(code.dictionary, value_set=by_lang[lang][0]).fill_null(-1).to_numpy(zero_copy_only=False)
                    numbers = np.where(found >= 0, by_lang[lang][1][found], -1)
                    at = of == i
                    ids[at] = numbers[seen[at]]
            have = ids >= 0
            rows = np.repeat(np.arange(len(first) - 1), np.diff(first))[have]
            base = np.concatenate([places, [0]])[np.minimum(first[:-1], max(len(places) - 1, 0))]
            yield relation(langs, places[have] - base[rows], ids[have], rows)

    def all_words(batches):
        for langs, words, places, first in batch_words(batches):
            base = np.concatenate([places, [0]])[np.minimum(first[:-1], max(len(places) - 1, 0))]
            at = pa.array((places - np.repeat(base, np.diff(first))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([langs, lists(at, first, pa.int32()), pa.LargeListArray.from_arrays(pa.array(first), words).cast(pa.list_(pa.string()))], ["lang", "at", "words"])

    if held is not None and held.num_rows:
        return texts.mapInArrow(known, "lang string, at array<int>, id array<long>").select(F.monotonically_increasing_id().alias("part"), "lang", "at", "id")
    every = materialize(texts.mapInArrow(all_words, "lang string, at array<int>, words array<string>").withColumn("part", F.monotonically_increasing_id()), "words")
    rows = every.select("part", "lang", F.explode(F.arrays_zip("at", "words")).alias("x")).select("part", "lang", "x.at", F.col("x.words").alias("phrase"))
    return regrouped(rows.hint("merge").join(frequent.select("lang", "phrase", "id"), ["lang", "phrase"]))


def relation(langs: pa.Array, at: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows of occurrences; texts without any have none."""
    cuts = np.searchsorted(rows, np.arange(len(langs) + 1))
    full = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays([langs.take(pa.array(full)), lists(at.astype(np.int32), np.append(cuts[full], len(at)), pa.int32()), lists(ids, np.append(cuts[full], len(at)), pa.int64())], ["lang", "at", "id"])


def neighbours(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merge join of a batch of the relation with itself by piece and adjacent place: (row, at, id of the first, id of the second)."""
    ats, ids = b.column("at"), b.column("id")
    at, id_ = ats.flatten().to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(b.num_rows), pc.list_value_length(ats).to_numpy(zero_copy_only=False))
    near = np.flatnonzero((at[1:] == at[:-1] + 1) & (rows[1:] == rows[:-1]))
    return rows[near], at[near], id_[near], id_[near + 1]


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids, and the number of its pair for each row."""
    a, i = np.unique(first, return_inverse=True)
    b, j = np.unique(second, return_inverse=True)
    codes, which = np.unique(i.astype(np.int64) * max(len(b), 1) + j, return_inverse=True)
    return a[codes // max(len(b), 1)] if len(a) else a, b[codes % max(len(b), 1)] if len(b) else b, which


def pair_counts(occurrences: DataFrame) -> DataFrame:
    """(head, tail, n): how often the phrase of id head is followed, a word later, by that of id tail."""

    def run(batches):
        for b in gathered(batches, 3, BATCH):
            _, _, first, second = neighbours(b)
            heads, tails, which = distinct_pairs(first, second)
            yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(tails), pa.array(np.bincount(which, minlength=len(heads)).astype(np.int64))], ["head", "tail", "n"])

    return occurrences.mapInArrow(run, "head long, tail long, n long").groupBy("head", "tail").agg(F.sum("n").alias("n"))


def extended(occurrences: DataFrame, frequent: DataFrame, lookup: int = LOOKUP) -> DataFrame:
    """The relation of the next level: pairs of neighbours, semi-joined with frequent (head, tail, id)."""
    held = small(frequent.select("head", "tail", "id").sort("head", "tail"), lookup)

    def known(batches):
        heads, tails, ids = (held[c].to_numpy() for c in ("head", "tail", "id"))
        a, b = np.unique(heads), np.unique(tails)
        codes = np.searchsorted(a, heads) * len(b) + np.searchsorted(b, tails)
        for x in gathered(batches, 3, BATCH):
            rows, at, first, second = neighbours(x)
            one, two, which = distinct_pairs(first, second)
            i, j = np.minimum(np.searchsorted(a, one), len(a) - 1), np.minimum(np.searchsorted(b, two), len(b) - 1)
            code = i * len(b) + j
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            got = np.where((a[i] == one) & (b[j] == two) & (codes[place] == code), ids[place], -1)[which]
            have = got >= 0
            out = relation(x.column("lang"), at[have], got[have], rows[have])
            parts = x.column("part").take(pa.array(np.unique(rows[have])))
            yield pa.RecordBatch.from_arrays([parts, *out.columns], ["part", "lang", "at", "id"])

    def pairs(batches):
        for x in gathered(batches, 3, BATCH):
            rows, at, first, second = neighbours(x)
            of = pa.array(rows)
            yield pa.RecordBatch.from_arrays([x.column("part").take(of), x.column("lang").take(of), pa.array(at), pa.array(first), pa.array(second)], ["part", "lang", "at", "head", "tail"])

    if held is not None and held.num_rows:
        return occurrences.mapInArrow(known, RELATION)
    rows = occurrences.mapInArrow(pairs, "part long, lang string, at int, head long, tail long")
    return regrouped(rows.hint("merge").join(frequent.select("head", "tail", "id"), ["head", "tail"]))


def frequent_phrases(texts: DataFrame, least: int, longest: int, lookup: int = LOOKUP) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length (id, lang, phrase, last, head, tail, f) of all phrases found least times or more."""
    counts = materialize(word_counts(texts), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counts.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"), F.col("n").alias("f"))
    levels = [materialize(words.withColumn("id", F.monotonically_increasing_id()), "phrases-1")]
    occurrences = materialize(word_occurrences(texts, levels[0], lookup), "occurrences-1")
    for k in range(2, longest + 1):
        pairs = pair_counts(occurrences).filter(F.col("n") >= least)
        heads = levels[-1].select(F.col("id").alias("head"), "lang", "phrase")
        tails = levels[-1].select(F.col("id").alias("tail"), "last")
        found = pairs.join(heads, "head").join(tails, "tail").select("lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "head", "tail", F.col("n").alias("f"))
        levels.append(materialize(found.withColumn("id", F.monotonically_increasing_id()), f"phrases-{k}"))
        if k < longest:
            if levels[-1].isEmpty():
                break
            occurrences = materialize(extended(occurrences, levels[-1], lookup), f"occurrences-{k}")
    return totals, levels


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text", lookup: int = LOOKUP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `longest` words by score, count and text.

    Texts are lower-cased (A-Z) and split at `.,;:!?` and the line ends 0x0A to 0x0D into pieces, and these at blanks and tabs into words. n: words of the language; a: occurrences of the
    phrase inside pieces, `least` or more, overlaps included; l, r: those of both sides of the cut of the lowest score floor(1000 * a * n / (l * r)), the first such cut. Phrases inside a longer phrase that has
    percent or more of their occurrences are left out. A null lang is `und`, a null or empty text has no words; rows that repeat count each time. Other columns are ignored. Texts are taken in parts of about 4 MiB
    that end where a piece ends; a piece of any length is whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    totals, levels = frequent_phrases(texts, least, longest, lookup)
    every = reduce(DataFrame.unionByName, [x.select("lang", "phrase", F.lit(k + 1).alias("words"), F.col("id"), "f") for k, x in enumerate(levels)])
    # What the longer phrases have of each of their two parts.
    inside = [x.select(F.explode(F.array("head", "tail")).alias("id"), F.lit(k).alias("words"), "f").groupBy("id", "words").agg(F.max("f").alias("longer")) for k, x in enumerate(levels) if k]
    if not inside:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    found = every.filter("words > 1").join(reduce(DataFrame.union, inside), ["id", "words"], "left")
    found = found.filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("f"))).select("lang", "phrase", "words", F.col("f").alias("a")).join(totals, "lang")
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.expr("substring_index(phrase, ' ', cut - words)"))
    counts = every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    cuts = cuts.join(counts, ["lang", "left"]).join(counts.withColumnsRenamed({"left": "right", "l": "r"}), ["lang", "right"])
    score = F.expr("(1000BD * cast(a as decimal(15,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    best = best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language's first rows are among the first of its parts, so no task sorts all phrases of a language.
    first = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    out = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
