"""Bottom-k fingerprints of documents, native.

The fingerprint of a text holds the FINGERPRINT_K least hashes of its shingles (five words; a shorter text is one shingle) and
the number of distinct shingles, estimated where there are more than k. Fingerprints of parts merge to that of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lograil.llm.common import ascii_lower, materialize, words_of
from lograil.operators.records import ranked

FINGERPRINT_K = 128
#: Hashes have 48 bits, written as 12 hexadecimal digits.
HASH_BITS = 48
#: At most so many buckets of documents, each of MIN_WIDTH documents or more. Bounds the broadcast of bucket starts, which are looked up by groups.
MAX_BUCKETS, MIN_WIDTH, GROUP = 50_000, 256, 256


def least_hashes(words: Column, size: int = 5, k: int = FINGERPRINT_K) -> Column:
    """The k least distinct shingle hashes, ascending; an empty array for no words."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(words, i, size)), 64 - HASH_BITS))
    return F.when(n > 0, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).otherwise(F.array().cast("array<bigint>"))


def merged(a: Column, b: Column, k: int = FINGERPRINT_K) -> Column:
    """The sketch of two parts together. Shingles that span the parts are in neither."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(a: Column, k: int = FINGERPRINT_K) -> Column:
    """The number of distinct shingles: exact below k, else estimated from the k-th least hash."""
    kth = F.get(a, F.lit(k - 1))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << HASH_BITS)) / kth.cast("double"))


def resemblance(a: Column, b: Column, k: int = FINGERPRINT_K) -> Column:
    """Estimated intersection over union, 0 to 1. Two empty sketches have 1, an empty and another 0."""
    both = merged(a, b, k)
    same = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(same / F.size(both))


def containment(a: Column, b: Column, k: int = FINGERPRINT_K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    r = resemblance(a, b, k)
    inside = r / (1 + r) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inside / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), HASH_BITS // 4, "0")), "")


def fingerprints(docs: DataFrame, size: int = 5, k: int = FINGERPRINT_K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with sketch (array<bigint>) and n_distinct. A null text is empty. All columns are returned, but for these two names, which are replaced. Ids are not looked at.

    A text is sketched as a whole by one task, so its words must fit there; sketches of its parts merge by merged().
    """
    return docs.withColumn("sketch", least_hashes(words_of(ascii_lower(F.col(text_col))), size, k)).withColumn("n_distinct", distinct_shingles(F.col("sketch"), k))


def merged_sketches(parts: DataFrame, by: list[str], k: int = FINGERPRINT_K) -> DataFrame:
    """(by, sketch, n_distinct): one sketch of all parts of a group. Each part gives k hashes at most, of which the least of the group are counted by Spark before and after the shuffle."""
    hashes = parts.select(*by, F.explode("sketch").alias("h")).distinct()
    nth = F.row_number().over(W.partitionBy(*by).orderBy("h"))
    least = hashes.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias("sketch"))
    every = parts.select(*by).distinct().join(least, by, "left").withColumn("sketch", F.coalesce("sketch", F.array().cast("array<bigint>")))
    return every.withColumn("n_distinct", distinct_shingles(F.col("sketch"), k))


def bucket_starts(keys: DataFrame) -> DataFrame:
    """(n, key, starts, first): the least key of each bucket of MIN_WIDTH rows or more, MAX_BUCKETS buckets at most; starts lists those of its group of GROUP buckets, first is the group's first bucket.

    Rows are ranked by range partitions. Keys of equal rows are one start, so their rows stay in one bucket.
    """
    every = ranked(keys, F.col("key"))
    width = max(MIN_WIDTH, -(-every.count() // MAX_BUCKETS))
    starts = every.filter(F.col("nth") % width == 1).groupBy("key").agg(F.min("nth").alias("nth"))
    starts = starts.withColumn("n", F.row_number().over(W.orderBy("key")) - 1)  # MAX_BUCKETS rows at most
    groups = starts.groupBy(F.floor(F.col("n") / GROUP).alias("g")).agg(F.array_sort(F.collect_list("key")).alias("starts"), F.min("n").alias("first"))
    return groups.select("g", "starts", "first")


def with_next(docs: DataFrame, size: int = 5, k: int = FINGERPRINT_K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, sketch, next_text, next_sketch): the next document is that in descending id order; after the last comes the first.

    Documents fall into buckets of about equally many, whatever their ids. The first document of each bucket is also sent to the bucket before it, so every
    document finds its next one inside its bucket, and the texts are shuffled once. Rows of a null id come after all others.
    Rows that repeat an id are ordered by a hash of their text; equal rows share a bucket.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Ascends as the order does: the complement of an id descends, and has no overflow.
    key = F.struct(F.col("id").isNull().alias("none"), F.coalesce(F.bitwise_not("id"), F.lit(0)).alias("down"), F.xxhash64("text").alias("hash"))
    groups = materialize(bucket_starts(base.select(key.alias("key"))), "bucket-starts")
    coarse = groups.agg(F.array_sort(F.collect_list(F.col("starts")[0])).alias("coarse"), (F.sum(F.size("starts")) - 1).alias("last"))
    rows = base.withColumn("key", key).crossJoin(F.broadcast(coarse))  # one row of MAX_BUCKETS / GROUP keys
    rows = rows.withColumn("g", (F.size(F.filter("coarse", lambda x: x <= F.col("key"))) - 1).cast("long")).drop("coarse")
    rows = rows.join(F.broadcast(groups), "g")  # MAX_BUCKETS keys
    rows = rows.withColumn("at", F.size(F.filter("starts", lambda x: x <= F.col("key"))) - 1)
    own = F.struct((F.col("first") + F.col("at")).cast("long").alias("bucket"), F.lit(0).alias("guest"))
    before = F.when(own["bucket"] > 0, own["bucket"] - 1).otherwise(F.col("last"))
    guest = F.struct(before.cast("long").alias("bucket"), F.lit(1).alias("guest"))
    places = F.when(F.get("starts", F.col("at")) == F.col("key"), F.array(own, guest)).otherwise(F.array(own))
    rows = rows.select("id", "text", "key", F.explode(places).alias("x")).select("id", "text", "key", "x.*")
    # Sketches are made after the texts were dealt out, once for each document.
    rows = rows.repartition("bucket").withColumn("words", words_of(ascii_lower(F.col("text"))))
    rows = rows.withColumn("sketch", least_hashes(F.col("words"), size, k)).drop("words")
    near = W.partitionBy("bucket").orderBy("guest", "key")
    rows = rows.withColumns({"next_text": F.lead("text").over(near), "next_sketch": F.lead("sketch").over(near)}).filter("guest = 0")
    return rows.select(F.col("id").alias(id_col), "text", "sketch", "next_text", "next_sketch")


def edited_fingerprints(docs: DataFrame, size: int = 5, k: int = FINGERPRINT_K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (the second half of the code points replaced by as many first ones of the next document), and how alike they are.

    One row for each row of docs; other columns are ignored. A null text is empty. For null and repeated ids, see with_next. A single document is its own next one. Texts are not cut: a task holds
    the two texts of a row and their words.
    """
    d = with_next(docs, size, k, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    d = d.withColumn("words", words_of(ascii_lower(F.col("edited")))).withColumn("edited_sketch", least_hashes(F.col("words"), size, k))
    a, e, x = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return d.select(
        id_col, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(a).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
        resemblance(a, e, k).alias("near_edited"), resemblance(a, x, k).alias("near_next"), containment(a, e, k).alias("contained_in_edited"), distinct_shingles(a, k).alias("n_distinct"),
    )
