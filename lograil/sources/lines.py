"""Files as numbered lines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lograil.operators import blocked
from lograil.shared import materialize

MAX_PARSE_BYTES = 1 << 20
SAMPLE_BYTES = 1 << 16
#: The bytes of a letter that has begun at the end of UTF-8 text and lacks others, in hex.
_CUT_LETTER = "(?:C[2-9A-F]|D.|E.|F[0-4]|(?:E0[AB]|E[1-9A-CEF][89AB]|ED[89]|F0[9AB]|F[1-3][89AB]|F48).|(?:F0[9AB]|F[1-3][89AB]|F48).[89AB].)$"


def _split_pieces(spark: SparkSession, paths: str | Sequence[str], sep: str, glob: str | None, recursive: bool) -> DataFrame:
    """(source, nth, byte_off, value) of the text between separators of one byte, numbered exactly over the splits of files; value may be any bytes."""
    reader = spark.read.option("lineSep", sep).option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("mid"), (F.octet_length("value") + 1).cast("long").alias("bytes")
    )
    splits = rows.groupBy("source", "block").agg(F.min("mid").alias("first"), F.count("*").alias("lines"), F.sum("bytes").alias("size"))
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("source", "block", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base_off"))
    inside = W.partitionBy("source", "block").orderBy("mid").rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(splits, ["source", "block"])
    return out.select("source", (F.col("mid") - F.col("first") + F.col("base")).alias("nth"), (F.col("base_off") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))).alias("byte_off"), "value")


def read_lines(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(source, line_no, byte_off, byte_len, raw) of every line of UTF-8 files, split at \\n, one \\r before it dropped. Exact for files of many splits.

    Lines of a split are numbered by their order in it, plus what the splits before hold: only one row for each split is summed over a file. Nothing may
    be filtered before the numbering; write the result as a table if it is used more than once.
    """
    rows = _split_pieces(spark, paths, "\n", glob, recursive)
    return rows.select("source", F.col("nth").alias("line_no"), "byte_off", F.octet_length("value").alias("byte_len"), F.regexp_replace("value", "\r$", "").alias("raw"))


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """(source, encoding, line_ending) of each file from its first 64 KiB: byte order mark, then share of NULs at even and odd places, then valid UTF-8, else ISO-8859-1.

    Where a longer file is cut, a letter of UTF-8 or a line end that the cut goes through tells nothing.
    """
    head = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.substring("content", 1, SAMPLE_BYTES).alias("head"), (F.col("length") > SAMPLE_BYTES).alias("cut"))
    x = F.hex("head")
    n = F.floor(F.octet_length("head") / 2).cast("int")  # pairs of bytes
    of_pairs = lambda which: F.regexp_replace(F.decode(F.substring("head", F.lit(1), 2 * n), "ISO-8859-1"), "(?s)(.)(.)", which)
    share = lambda bytes_: F.try_divide(n - F.length(F.replace(bytes_, F.lit("\0"), F.lit(""))), F.octet_length("head") / 2)
    even, odd = share(of_pairs("$1")), share(of_pairs("$2"))
    begun = F.when(F.col("cut"), F.length(F.regexp_extract(F.hex(F.substring("head", -3, 3)), _CUT_LETTER, 0)) / 2).otherwise(0).cast("int")
    whole = F.substring("head", F.lit(1), F.octet_length("head") - begun).cast("string")
    enc = (
        F.when(x.startswith("EFBBBF"), "UTF-8").when(x.startswith("FFFE"), "UTF-16LE").when(x.startswith("FEFF"), "UTF-16BE")
        .when(odd > 0.3, "UTF-16LE").when(even > 0.3, "UTF-16BE").when(F.is_valid_utf8(whole), "UTF-8").otherwise("ISO-8859-1")
    )
    text = F.replace(F.decode("head", "ISO-8859-1"), F.lit("\0"), F.lit(""))  # line ends are ASCII, in UTF-16 with a NUL beside
    text = F.when(F.col("cut"), F.regexp_replace(text, "\r\\z", "")).otherwise(text)
    ending = F.when(F.contains(text, F.lit("\r\n")), "crlf").when(F.contains(text, F.lit("\n")), "lf").when(F.contains(text, F.lit("\r")), "cr").otherwise("lf")
    return head.select("source", enc.alias("encoding"), ending.alias("line_ending"))


#: Bytes of a code unit, and whether the first one is the lowest.
UNITS = {"UTF-16LE": (2, True), "UTF-16BE": (2, False), "UTF-32LE": (4, True), "UTF-32BE": (4, False)}


def _joined_pieces(sep: str, width: int, low_first: bool):
    """For mapInArrow over the pieces (split, byte_off of the split, after, value) of splits in their order: (split, nth, byte_off, value), a row for each line start of a split, nth from 0, with all pieces up to the
    next one put together; nth is -1 for what comes before a split's first line start. after: whether the bytes before the split's first separator byte are zero."""
    cut, rest = sep.encode(), width - 1

    def zeros(data, at, ok):
        """Whether rest bytes from each place are zero."""
        out = ok.copy()
        for k in range(rest):
            out &= data[np.where(ok, at + k, 0)] == 0
        return out

    def table(split, nths, offs, values):
        n = len(nths)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, split, np.int64)), pa.array(nths, pa.int64()), pa.array(offs, pa.int64()), values], ["split", "nth", "byte_off", "value"])

    def run(batches):
        split, held, held_off, nth, at, after = None, [], 0, -1, 0, False  # held: parts of the line that is open
        for b in batches:
            ids = b.column("split").to_numpy()
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if ids[lo] != split:
                    if held:
                        yield table(split, [nth], [held_off], pa.array([b"".join(held)], pa.binary()))
                    split, held, nth, at, after = int(ids[lo]), [], -1, b.column("byte_off")[lo].as_py(), b.column("after")[lo].as_py()
                    held_off, fresh = at, True
                else:
                    fresh = False
                values = b.column("value").slice(lo, hi - lo)
                o = np.frombuffer(values.buffers()[1], np.int32, hi - lo + 1, values.offset * 4).astype(np.int64)
                size = np.diff(o)
                # The pieces as they were in the file, each with the separator byte behind it.
                data = np.full(int(o[-1] - o[0]) + len(size), cut[0], np.uint8)
                begin = o[:-1] - o[0] + np.arange(len(size))
                mine = np.ones(len(data), bool)
                mine[begin + size] = False
                if o[-1] > o[0]:
                    data[mine] = np.frombuffer(values.buffers()[2], np.uint8)[o[0] : o[-1]]
                place = (begin + at - 1) % width  # of the separator byte before
                if low_first:
                    starts = (place == 0) & zeros(data, begin, size >= rest)
                else:
                    ends = zeros(data, begin + size - rest, size >= rest)
                    starts = (place == rest) & np.concatenate([[after], ends[:-1]])
                    after = bool(ends[-1])
                if fresh and at == 0:
                    starts[0] = True
                first = np.flatnonzero(starts)
                if not len(first):
                    held += [cut, data[:-1].tobytes()] if held else [data[:-1].tobytes()]
                else:
                    f = int(begin[first[0]])
                    if f:  # pieces before the first start go to the line that is open, or to that of an earlier split
                        held += [cut, data[: f - 1].tobytes()] if held else [data[: f - 1].tobytes()]
                    if held:
                        yield table(split, [nth], [held_off], pa.array([b"".join(held)], pa.binary()))
                    whole, last = begin[first], int(begin[first[-1]])
                    if len(whole) > 1:
                        keep = np.ones(last - f, bool)
                        keep[whole[1:] - 1 - f] = False
                        ends_at = np.concatenate([[0], np.cumsum(np.diff(whole) - 1)]).astype(np.int32)
                        made = pa.Array.from_buffers(pa.binary(), len(whole) - 1, [None, pa.py_buffer(ends_at), pa.py_buffer(data[f:last][keep])])
                        yield table(split, nth + 1 + np.arange(len(whole) - 1), at + whole[:-1], made)
                    nth += len(whole)
                    held, held_off = [data[last:-1].tobytes()], at + last
                at += len(data)
        if held:
            yield table(split, [nth], [held_off], pa.array([b"".join(held)], pa.binary()))

    return run


def _wide_lines(spark: SparkSession, paths: str | Sequence[str], sep: str, glob: str | None, width: int, low_first: bool) -> DataFrame:
    """(source, line_no, value) of files in UTF-16 or UTF-32, value without the separator.

    A first scan only measures the splits. In the second one each task puts the pieces of its splits together, so that lines are written once and never exchanged; only what is open at the edges of splits, two
    rows for each, is joined.
    """
    reader = spark.read.option("lineSep", sep)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    value = F.col("value").cast("binary")
    rows = reader.text(paths if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"), value.alias("value"))
    size = F.octet_length("value")
    tail = (size >= width - 1) & (F.substring("value", F.greatest(size - (width - 2), F.lit(1)).cast("int"), F.lit(width - 1)) == F.lit(bytes(width - 1)))
    splits = rows.withColumn("mid", F.monotonically_increasing_id()).groupBy("source", "block").agg(F.sum(size.cast("long") + 1).alias("size"), F.max_by(tail, "mid").alias("tail"), F.max("file_size").alias("file_size"))
    by = W.partitionBy("source").orderBy("block")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("source", "block", F.monotonically_increasing_id().alias("split"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("byte_off"), F.coalesce(F.lag("tail").over(by), F.lit(False)).alias("after"), (F.sum("size").over(W.partitionBy("source")) == F.col("file_size")).alias("ended"))
    splits = materialize(splits, "splits")  # a row for each split
    p = rows.join(F.broadcast(splits), ["source", "block"]).select("split", "byte_off", "after", "value")
    p = materialize(p.mapInArrow(_joined_pieces(sep, width, low_first), "split long, nth long, byte_off long, value binary"), "pieces")
    n = p.groupBy("split").agg(F.count_if(F.col("nth") >= 0).alias("n"))
    n = splits.select("source", "block", "split", "ended").join(n, "split").withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "lines": F.sum("n").over(W.partitionBy("source"))})
    p = p.join(F.broadcast(n), "split").withColumns({"line_no": F.col("base") + F.col("nth"), "_open": (F.col("nth") < 0) | (F.col("nth") == F.col("n") - 1)})
    joined = F.array_sort(F.collect_list(F.struct("block", "nth", "byte_off", "value")))
    opened = p.filter("_open").groupBy("source", "line_no").agg(joined.alias("x"), F.first("lines").alias("lines"), F.first("ended").alias("ended"))
    data = F.aggregate(F.slice("x", 2, 1 << 30), F.col("x")[0]["value"], lambda a, b: F.concat(a, F.lit(sep.encode()), b["value"]))
    opened = opened.select("source", "line_no", "lines", "ended", F.col("x")[0]["byte_off"].alias("byte_off"), data.alias("value"))
    # A separator byte at a file's end, which the reader leaves out, may be the last byte of a letter.
    whole = F.col("ended") & (F.col("line_no") == F.col("lines") - 1) & ((F.col("byte_off") + size + 1) % width == 0) & (F.lit(low_first) | ~tail)
    opened = opened.withColumn("value", F.when(whole, F.concat("value", F.lit(sep.encode()))).otherwise(F.col("value"))).drop("ended")
    rows = p.filter("not _open").select("source", "line_no", "lines", "byte_off", "value").unionByName(opened)
    if low_first:  # the rest of the separator before; behind the last separator there is only its rest: no line
        rest = (F.col("line_no") > 0).cast("int") * (width - 1)
        rows = rows.withColumn("value", F.substring("value", rest + 1, size))
        rows = rows.filter((F.col("line_no") < F.col("lines") - 1) | (F.octet_length("value") > 0) | (F.col("line_no") == 0))
    else:  # the first bytes of the separator behind
        rows = rows.withColumn("value", F.substring("value", F.lit(1), (size - (F.col("byte_off") + size) % width).cast("int")))
    return rows.select("source", "line_no", "value")


def read_encoded(spark: SparkSession, paths: str | Sequence[str], encoding: str, line_ending: str = "lf", glob: str | None = None, block_lines: int = blocked.BLOCK_LINES) -> DataFrame:
    """(source, line_no, raw) of files in another encoding: UTF-16 or UTF-32 (LE, BE), ISO-8859-1, US-ASCII, UTF-8, or any other in which the bytes of \\n and \\r stand for nothing else and that Java knows if
    spark.sql.legacy.javaCharsets is set. A byte order mark at a file's start and one \\r before \\n are dropped. line_ending cr: lines end at \\r alone.

    Files are read in splits, at every byte of the separator. In wide encodings such a byte ends a line only where it is the low byte of a code unit whose other bytes are zero; its place in the file tells that.
    Pieces between others are put together, and lines are numbered by the line starts before them, over all splits of a file. No blocks of lines are needed for that any more: block_lines changes nothing.
    """
    width, low_first = UNITS.get(encoding, (1, True))
    sep = "\r" if line_ending == "cr" else "\n"
    if width > 1:
        rows = _wide_lines(spark, paths, sep, glob, width, low_first)
    else:
        p = materialize(_split_pieces(spark, paths, sep, glob, False).select("source", F.col("nth").alias("line_no"), F.col("value").cast("binary").alias("value")), "pieces")
        rows = p.select("source", "line_no", "value")
    # Java reads UTF-32 by its byte order mark.
    text = F.decode(F.concat(F.lit(b"\xff\xfe\x00\x00" if low_first else b"\x00\x00\xfe\xff"), "value"), "UTF-32") if width == 4 else F.decode("value", encoding)
    text = F.when(F.col("line_no") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    return rows.select("source", "line_no", F.regexp_replace(text, "\r$", "").alias("raw"))


def parseable(raw):
    """The line, or null if it is too long to be parsed."""
    return F.when(F.octet_length(raw) <= MAX_PARSE_BYTES, raw)
