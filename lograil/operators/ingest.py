"""Lines to typed records, one job for each format. Native column expressions.

Each function takes a DataFrame with a column raw and returns it with is_record, one text column for each field (null: absent or empty)
and, for open formats, extra (map of the keys outside the schema). Lines that do not fit stay, with is_record false.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograil.functions.kinds import let, unique_names
from lograil.functions.times import MONTHS
from lograil.sources.lines import parseable


# RFC 5424, section 6, rule by rule. The PARAM-VALUE of a parameter holds quote, backslash and closing bracket only behind a backslash.
_PRINTABLE = "[!-~]"
_NAME = '[!-~&&[^="\\]]]{1,32}'
_DATE_TIME = "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\\.[0-9]{1,6})?(?:Z|[+-][0-9]{2}:[0-9]{2})"
_PARAM = rf'{_NAME}="(?:[^"\\\]]|\\.)*+"'
_ELEMENT = rf"\[{_NAME}(?: {_PARAM})*+\]"
SYSLOG_5424 = (
    rf"^<([0-9]{{1,3}})>([1-9][0-9]{{0,2}}) (-|{_DATE_TIME}) ({_PRINTABLE}{{1,255}}) ({_PRINTABLE}{{1,48}}) ({_PRINTABLE}{{1,128}}) ({_PRINTABLE}{{1,32}}) (-|(?:{_ELEMENT})++)(?: (.*))?$",
    ("pri", "version", "ts", "host", "app", "procid", "msgid", "sd", "msg"),
)
# RFC 3164, section 4.1. Relays drop the PRI. A TAG is a program's name, which also holds signs nowadays, and a process id; a colon, a blank or the line's end is behind it.
_MONTH_DAY = f"(?:{MONTHS}) (?: [1-9]|[0-3][0-9])"
_PROGRAM = "[!-~&&[^:\\[\\]]]+"
SYSLOG_3164 = (rf"^(?:<([0-9]{{1,3}})>)?({_MONTH_DAY} [0-2][0-9]:[0-5][0-9]:[0-6][0-9]) ({_PRINTABLE}+) ({_PROGRAM})(?:\[([0-9]+)\])?(?:: ?| |$)(.*)$", ("pri", "ts", "host", "tag", "pid", "msg"))

# The common log format, and the combined one: two more quoted fields; servers may append others. In quotes, a backslash escapes. A request line that is
# not "METHOD target [protocol]" is skipped as a whole; its three fields are then missing.
_QUOTED = r'[^"\\]*(?:\\.[^"\\]*)*'
_COMMON = rf'^([^ ]+) ([^ ]+) ([^ ]+) \[([^\]]+)\] "(?:([A-Z]+) ([^ "]+)(?: ([^"]*))?|{_QUOTED})" ([0-9]{{3}}) ([0-9]+|-)'
_COMMON_NAMES = ("remote", "ident", "user", "ts", "method", "path", "proto", "status", "size")
ACCESS_COMMON = (f"{_COMMON}$", _COMMON_NAMES)
ACCESS_COMBINED = (rf'{_COMMON} "({_QUOTED})" "({_QUOTED})"(?: .*)?$', (*_COMMON_NAMES, "referer", "agent"))


def parsed_once(lines: DataFrame, **columns: Column) -> DataFrame:
    """lines with columns that are computed once a row, however often they are used later: the optimizer copies no expression out of a generator."""
    return lines.select(*[c for c in lines.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _fields(lines: DataFrame, is_record: Column, values: dict[str, Column]) -> DataFrame:
    lines = lines.drop(*[c for c in lines.columns if c in values or c == "is_record"]).withColumn("is_record", F.coalesce(is_record, F.lit(False)))
    return lines.withColumns({n: F.when(F.col("is_record"), F.nullif(v, F.lit(""))) for n, v in values.items()})


#: Stands between the groups of a match; lines that hold it are matched once for each group.
MARK = "\x1e"


def groups_of(raw: Column, pattern: str, n: int, anchored: bool = False) -> Column:
    """The n numbered groups of the first match as an array, from one match of the line; null if there is none. A group that took no part is empty.

    Only \\n ends a line here, whatever else a raw line holds. anchored: the pattern takes the whole line, from ^ to $.
    """
    pattern = "(?d)" + pattern
    whole = pattern if anchored else rf"^(?s:.*?)(?:{pattern})(?s:.*)\z"
    joined = let(F.regexp_replace(raw, whole, MARK + MARK.join(f"${i}" for i in range(1, n + 1))), lambda x: F.when(x.startswith(MARK), F.split(F.substring(x, 2, 1 << 30), MARK, -1)))
    apart = F.when(raw.rlike(pattern), F.array(*[F.regexp_extract(raw, pattern, i) for i in range(1, n + 1)]))
    return F.when(F.contains(raw, F.lit(MARK)), apart).otherwise(joined)


def by_pattern(lines: DataFrame, pattern: str, names: Sequence[str], anchored: bool = False) -> DataFrame:
    """Fields are the numbered groups of a pattern that must match; anchored: it takes the whole line."""
    names = unique_names(names)
    lines = parsed_once(lines, _cells=groups_of(parseable(F.col("raw")), pattern, len(names), anchored))
    return _fields(lines, F.col("_cells").isNotNull(), {n: F.get("_cells", F.lit(i)) for i, n in enumerate(names)}).drop("_cells")


def by_regex(lines: DataFrame, pattern: str) -> DataFrame:
    """Fields are the named groups, `(?P<name>...)`; other groups capture nothing. An invalid pattern raises re.error."""
    names = list(re.compile(pattern).groupindex)
    if not names:
        raise ValueError("a pattern needs a named group")
    bare = re.sub(r"(\\.)|\((?!\?)", lambda m: m[1] or "(?:", pattern)
    return by_pattern(lines, re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", bare), names)


def syslog_3164(lines: DataFrame) -> DataFrame:
    return by_pattern(lines, *SYSLOG_3164, anchored=True)


def syslog_5424(lines: DataFrame) -> DataFrame:
    return by_pattern(lines, *SYSLOG_5424, anchored=True)


def structured_data(sd: Column) -> Column:
    """The parameters of RFC 5424 elements as a map of `id.name` to value, escapes undone; the first of a name wins. Null for none."""
    element = lambda e: F.transform(
        F.regexp_extract_all(e, F.lit(_PARAM), F.lit(0)),
        lambda p: F.struct(F.concat(F.regexp_extract(e, rf"^\[({_NAME})", 1), F.lit("."), F.substring_index(p, "=", 1)).alias("key"), F.regexp_replace(F.regexp_extract(p, '(?s)^[^=]*="(.*)"$', 1), r'\\(["\\\]])', "$1").alias("value")),
    )
    return F.when(sd.startswith("["), first_of_keys(F.flatten(F.transform(F.regexp_extract_all(sd, F.lit(_ELEMENT), F.lit(0)), element))))


def access(lines: DataFrame, combined: bool = True) -> DataFrame:
    """Web access lines; a malformed request leaves method, path and proto null."""
    out = by_pattern(lines, *(ACCESS_COMBINED if combined else ACCESS_COMMON), anchored=True)
    return out if combined else out.withColumns({"referer": F.lit(None).cast("string"), "agent": F.lit(None).cast("string")})


_LOG4J = {"p": ("level", r"\s*([A-Za-z]+)\s*"), "t": ("thread", r"(.*?)"), "c": ("logger", r"\s*(\S*?)\s*"), "C": ("class", r"\s*(\S*?)\s*"), "M": ("method", r"(\S*?)"), "L": ("line", r"(\d*)"), "F": ("file", r"(\S*?)"), "m": ("msg", r"(.*)"), "x": ("ndc", r"(.*?)"), "r": ("elapsed", r"(\d+)")}
_LOG4J_LONG = {"date": "d", "level": "p", "thread": "t", "logger": "c", "message": "m", "msg": "m", "class": "C", "method": "M", "line": "L", "file": "F"}


def log4j_pattern(layout: str) -> tuple[str, list[str]]:
    """A log4j or logback layout as a pattern and its field names; unknown words become columns."""
    out, names, at = "", [], 0
    for m in re.finditer(r"%-?\d*(?:\.-?\d+)?([A-Za-z]+)(?:\{([^}]*)\})?", layout):
        out += re.escape(layout[at : m.start()])
        at = m.end()
        word = m[1]
        if word in ("n", "ex", "xEx", "throwable", "exception"):
            continue
        key = _LOG4J_LONG.get(word, word)
        if key == "d":
            date = m[2] or ""
            text = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[,.]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"
            if date and date not in ("ISO8601", "DEFAULT"):
                parts = {"y": r"\d{2,4}", "M": r"(?:\d{1,2}|[A-Z][a-z]{2})", "S": r"\d{1,9}", "a": "[AP]M", "Z": r"[+-]\d{4}", "X": r"(?:Z|[+-]\d{2}:?\d{2})", "z": r"\S+", "E": "[A-Za-z]+"}
                runs = (g[0] for g in re.finditer(r"([A-Za-z])\1*|'[^']*'|.", date))
                text = "".join(parts.get(g[0], r"\d{1,2}") if g[0].isalpha() else re.escape(g.strip("'")) for g in runs)
            out += f"({text})"
            names.append("ts")
        else:
            name, body = _LOG4J.get(key, (m[2] or word if key in ("X", "mdc") else word, r"(\S*?)"))
            out += body
            names.append(name)
    return f"^{out}{re.escape(layout[at:].rstrip())}$".replace("\\ ", " "), unique_names(names)


def log4j(lines: DataFrame, layout: str) -> DataFrame:
    return by_pattern(lines, *log4j_pattern(layout), anchored=True)


def fixed_width(lines: DataFrame, columns: Sequence[tuple[str, int, int | None]]) -> DataFrame:
    """(name, start, end) in characters, end open if None. Fields are trimmed; a line not longer than the first start is no record."""
    raw = parseable(F.col("raw"))
    values = {n: F.trim(F.substring(raw, s + 1, (1 << 30) if e is None else e - s)) for n, s, e in columns}
    return _fields(lines, F.length(raw) > min(s for _, s, _ in columns), values)


def delimited(lines: DataFrame, columns: Sequence[str], delimiter: str = ",", has_header: bool = True) -> DataFrame:
    """Delimited fields with doubled quotes. Another number of fields is no record, nor is a line equal to the header."""
    names = unique_names(columns)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("_bad", T.StringType())])
    raw = parseable(F.col("raw"))
    row = F.from_csv(raw, schema.simpleString()[7:-1].replace(":", " "), {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1"})
    lines = parsed_once(lines, _row=row)
    ok = F.col("_row._bad").isNull() & (F.col("raw") != "") & raw.isNotNull()
    if has_header:
        ok &= F.col("raw") != delimiter.join(columns)
    return _fields(lines, ok, {n: F.col(f"_row.c{i}") for i, n in enumerate(names)}).drop("_row")


def csv_cells(raw: Column, delimiter: str = ",") -> Column:
    """The cells of a delimited line as an array: quotes taken off, doubled ones halved. Null if the quotes are not right."""
    sep = re.escape(delimiter)
    cell = rf'{sep}(?:"(?:[^"]|"")*+"|[^"{sep}]*+)'
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), raw), F.lit(cell), F.lit(0))
    bare = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    whole = lambda cs: F.aggregate(cs, F.lit(0), lambda n, c: n + F.length(c)) == F.length(raw) + len(delimiter)
    return let(found, lambda cs: F.when(whole(cs), F.transform(cs, lambda c: bare(F.substring(c, len(delimiter) + 1, 1 << 30)))))


def headed(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """lines with is_record and fields, a map of column names to cells, for sources whose first lines name their columns, each in its own way.

    Header lines are one row for each source and meet the lines in one join, so all sources are read in one plan. Empty names are col1, col2, ..., of repeated ones the first cell counts; a line of another number of cells is no record,
    nor is a header. Empty cells are absent.
    """
    cells = csv_cells(parseable(F.col("raw")), delimiter)
    heads = lines.filter("line_no = 0").select(F.col("source").alias("_source"), F.transform(cells, lambda c, i: F.when(F.trim(c) == "", F.concat(F.lit("col"), i + 1)).otherwise(F.trim(c))).alias("_names"))
    d = parsed_once(lines, _cells=cells).join(heads, F.col("source") == F.col("_source"), "left")
    ok = F.coalesce((F.col("line_no") > 0) & (F.col("raw") != "") & (F.size("_cells") == F.size("_names")), F.lit(False))
    entries = F.filter(F.arrays_zip(F.col("_names").alias("key"), F.col("_cells").alias("value")), lambda e: e["value"] != "")
    return d.withColumn("is_record", ok).withColumn("fields", F.when(F.col("is_record"), first_of_keys(entries))).drop("_source", "_names", "_cells")


def header_names(lines: DataFrame, delimiter: str = ",") -> dict[str, list[str]]:
    """Column names of each source from its first line, for a few sources: one row for each source comes to the driver. headed reads any number of sources."""
    heads = lines.filter("line_no = 0").select("source", "raw")
    return {r["source"]: unique_names(next(csv.reader([r["raw"] or ""], delimiter=delimiter), [""])) for r in heads.toLocalIterator()}


def w3c(lines: DataFrame, fields: Sequence[str]) -> DataFrame:
    """W3C extended lines: tab-separated if the line has a tab, else by blanks; `-` is absent; `#` lines are directives."""
    raw = parseable(F.col("raw"))
    lines = parsed_once(lines, _cells=F.when(F.contains(raw, F.lit("\t")), F.split(raw, "\t")).otherwise(F.split(raw, " ")))
    ok = ~raw.startswith("#") & (F.size("_cells") == len(fields))
    return _fields(lines, ok, {n: F.nullif(F.get("_cells", F.lit(i)), F.lit("-")) for i, n in enumerate(unique_names(fields))}).drop("_cells")


def w3c_fields(lines: DataFrame) -> DataFrame:
    """(source, fields) from the first #Fields directive of each source."""
    found = lines.filter(F.col("raw").startswith("#Fields:"))
    return found.groupBy("source").agg(F.min_by(F.split(F.trim(F.substring("raw", 9, 1 << 20)), r"\s+"), "line_no").alias("fields"))


# A key, and its value after =: in quotes with escapes (to the line's end if they are not closed), or up to a blank.
_PAIR = r'(?=\S)[^\s=]*+(?:=(?:"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$)|\S*+))?+'


def first_of_keys(entries: Column) -> Column:
    """A map of (key, value) entries; the first value of a key wins."""
    keys = lambda es: F.transform(es, lambda e: e["key"])
    firsts = lambda es: F.filter(es, lambda e, i: F.array_position(keys(es), e["key"]) == i + 1)
    return let(entries, lambda es: F.map_from_entries(F.when(F.size(F.array_distinct(keys(es))) == F.size(es), es).otherwise(firsts(es))))


def logfmt_pairs(raw: Column) -> Column:
    """The key-value map of a logfmt line: the first value of a key wins, a bare key is true, empty keys are skipped."""
    cells = F.filter(F.regexp_extract_all(raw, F.lit(_PAIR), F.lit(0)), lambda w: ~w.startswith("="))
    value = lambda w: F.when(F.contains(w, F.lit("=")), F.substr(w, F.instr(w, "=") + 1)).otherwise("true")
    return first_of_keys(F.transform(cells, lambda w: F.struct(F.substring_index(w, "=", 1).alias("key"), _unquoted(value(w)).alias("value"))))


def _unquoted(v: Column) -> Column:
    """A value without its quotes, escapes undone from left to right: what stands behind a backslash is a line break, tab or return, or itself. Most values hold none."""
    body = F.regexp_replace(F.substring(v, 2, 1 << 30), r'(?<!\\)((?:\\\\)*)"$', "$1")
    # Parts that begin with a backslash, and what stands before the first one.
    part = lambda p: F.when(~p.startswith("\\"), p).when(F.length(p) == 1, p).otherwise(F.concat(F.translate(F.substring(p, 2, 1), "ntr", "\n\t\r"), F.substring(p, 3, 1 << 30)))
    undone = lambda b: F.array_join(F.transform(F.regexp_extract_all(b, F.lit(r"(?s)\\.[^\\]*|[^\\]+|\\"), F.lit(0)), part), "")
    # Without two backslashes in a row, each of them escapes what is behind it, in any order.
    inner = F.when(v.endswith('"') & ~v.endswith('\\"'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(F.substring(v, 2, 1 << 30))
    plain = F.replace(inner, F.lit('\\"'), F.lit('"'))
    for letter, char in (("n", "\n"), ("t", "\t"), ("r", "\r")):
        plain = F.replace(plain, F.lit("\\" + letter), F.lit(char))
    single = F.when(F.contains(plain, F.lit("\\")), F.regexp_replace(plain, r"(?s)\\(.)", "$1")).otherwise(plain)
    return F.when(~v.startswith('"'), v).when(F.contains(v, F.lit("\\\\")), undone(body)).when(F.contains(v, F.lit("\\")), single).otherwise(F.when(v.endswith('"') & (F.length(v) > 1), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(F.substring(v, 2, 1 << 30)))


def _open(lines: DataFrame, pairs: Column, ok: Column, columns: Sequence[str]) -> DataFrame:
    lines = parsed_once(lines.withColumn("_ok", ok), _pairs=pairs)
    out = _fields(lines, F.col("_ok"), {n: F.try_element_at("_pairs", F.lit(n)) for n in columns})
    return out.withColumn("extra", F.when(F.col("is_record"), F.map_filter("_pairs", lambda k, v: ~k.isin(*columns) if columns else F.lit(True)))).drop("_pairs", "_ok")


def is_logfmt(raw: Column) -> Column:
    """Whether a line is a logfmt record: it has a pair. Cheaper than reading the pairs, where only records are told from other lines."""
    return F.coalesce(parseable(raw).rlike(r"(^|\s)[^\s=]+="), F.lit(False))


def logfmt(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _open(lines, logfmt_pairs(parseable(F.col("raw"))), is_logfmt(F.col("raw")), columns)


_ENTRIES = "map<string,string>"


def json_pairs(raw: Column, depth: int = 4) -> Column:
    """A JSON object as a map, nested keys joined by dots down to depth; arrays, empty objects and deeper ones stay JSON; nulls are absent; the first value of a key wins."""
    entries = lambda text: F.from_json(text, _ENTRIES)
    pairs = F.map_entries(entries(raw))
    for _ in range(depth - 1):
        nested = lambda v: v.startswith("{") & (v != "{}")
        inside = lambda e: F.transform(F.map_entries(entries(e["value"])), lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))
        pairs = F.flatten(F.transform(pairs, lambda e: F.coalesce(F.when(nested(e["value"]), inside(e)), F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))))
    return first_of_keys(F.filter(pairs, lambda x: x["value"].isNotNull()))


def json_lines(lines: DataFrame, columns: Sequence[str], depth: int = 4) -> DataFrame:
    """JSON Lines: only objects are records."""
    raw = parseable(F.col("raw"))
    ok = F.ltrim(raw).startswith("{") & F.rtrim(raw).endswith("}") & F.from_json(raw, _ENTRIES).isNotNull()
    return _open(lines, F.when(ok, json_pairs(raw, depth)), ok, columns)


def discover_columns(lines: DataFrame, pairs: Column, sample: int = 1000, most: int = 64) -> DataFrame:
    """(source, name, nth): keys of the first lines by kind (timestamp, level, others, message last), then by first sight; at most 64."""
    from lograil.functions.kinds import KIND_NAMES
    from pyspark.sql import Window as W

    keys = lines.filter(F.col("line_no") < sample).select("source", "line_no", F.posexplode(F.map_keys(pairs)).alias("pos", "name"))
    # Line and place as one number: the least one needs no sort of all keys, as the least struct would.
    keys = keys.groupBy("source", "name").agg(F.min(F.col("line_no").cast("decimal(20,0)") * F.lit(1 << 31) + F.col("pos")).alias("seen"))
    name = F.lower("name")
    rank = F.when(name.isin(*KIND_NAMES["timestamp"]), 0).when(name.isin(*KIND_NAMES["level"]), 1).when(name.isin("msg", "message"), 3).otherwise(2)
    nth = F.row_number().over(W.partitionBy("source").orderBy(rank, "seen"))
    return keys.withColumn("nth", nth).filter(F.col("nth") <= most).select("source", "name", "nth")


def best_definition(lines: DataFrame, candidates: dict[str, Column], sample: int = 1000) -> DataFrame:
    """(source, definition): the candidate (a boolean column) that accepts most sample lines; the first on ties."""
    counts = lines.filter(F.col("line_no") < sample).groupBy("source").agg(*[F.count_if(c).alias(n) for n, c in candidates.items()])
    ranked = F.array(*[F.struct(F.col(n).alias("hits"), F.lit(-i).alias("first"), F.lit(n).alias("name")) for i, n in enumerate(candidates)])
    return counts.select("source", F.array_max(ranked)["name"].alias("definition"))
