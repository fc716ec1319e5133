"""Which format and which profile a source has."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lograil.functions import kinds, times
from lograil.functions.kinds import let
from lograil.operators import ingest, records
from lograil.shared import materialize

SAMPLE, MIN_SCORE = 1000, 0.5
DELIMITED = {"csv": ",", "tsv": "\t", "psv": r"\|", "ssv": ";"}


# How much a format of each kind is trusted.
TRUST = {"logfmt": 0.97, "delimited": 0.85}
#: Layouts of text lines: the kinds of their first parts (T a time, L a level, B something in brackets, G a logger's name), their fields, and their trust (a fixed value).
LAYOUTS = {
    "time_level_message": ("TL", ("ts", "level", "msg"), 0.95), "time_level_thread_message": ("TLB", ("ts", "level", "thread", "msg"), 0.96), "time_level_thread_logger": ("TLBG", ("ts", "level", "thread", "logger", "msg"), 0.97),
    "time_thread_level_logger": ("TBLG", ("ts", "thread", "level", "logger", "msg"), 0.97), "level_time_message": ("LT", ("level", "ts", "msg"), 0.9), "time_message": ("T", ("ts", "msg"), 0.6),
}
#: Families of times that a text line's parts are told by: the formats that times are read in,
#: and dates with the day first, where they are no others.
FAMILIES = {
    "iso": ("iso", "iso_comma"), "slashed": ("slashed",), "compact": ("compact",), "apache": ("apache",), "rfc2822": ("rfc2822",), "us": ("us",), "syslog": ("syslog",), "clock": ("time",), "epoch": ("epoch_ns", "epoch_us", "epoch_ms", "epoch_s"),
}
DAY_FIRST = r"[0-9]{2}[/.][0-9]{2}[/.][0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?"
#: Characters of a line in which its first parts are looked for, and how many parts are told apart.
HEAD, PARTS = 256, 8


def _stamps() -> dict[str, str]:
    """A pattern for each family of times."""
    bare = lambda n: times.FORMATS[n][0].removeprefix(times.AFTER_KEY)
    return {family: "|".join(bare(n) for n in sorted(names, key=lambda n: -len(bare(n)))) for family, names in FAMILIES.items()} | {"day_first": DAY_FIRST}


def _marked(raw: Column) -> Column:
    """The head of a text line with the time at its start, perhaps behind a level, told apart in one match: marks around the texts of the families, all but one empty, then the head with _TIME for the time. Other heads have no mark."""
    # The time stands at the line's start, in brackets or not, or behind a first word. No family's text can be read on behind that word by another one, so the first family that fits is the first one in order.
    head = F.translate(F.substring(raw, 1, HEAD), _TIME[0], " ")
    stamps = _stamps().values()
    pattern = "^((?:[\\[(]?[A-Za-z]+[\\])]?:?[ \\t]+)?)[\\[(]?(?:" + "|".join(f"({p})" for p in stamps) + ")(?![\\w:/])[\\])]?"
    return F.regexp_replace(head, pattern, "".join(f"{_TIME[0]}${i}" for i in range(2, len(stamps) + 2)) + f"{_TIME[0]}$1{_TIME}")


def _stamped(marked: Column) -> Column:
    """The family's name and a blank before the head, with every digit 0, as digits tell no parts apart; null for a head without a time."""
    nth = F.length(marked) - F.length(F.ltrim(marked, F.lit(_TIME[0])))
    text = F.translate(F.substring_index(marked, _TIME[0], -2), "123456789", "0" * 9)
    return F.when(marked.startswith(_TIME[0]), F.concat(F.get(F.array(*[F.lit(f"{f} ") for f in _stamps()]), nth - 1), text))


def _parts_of(stamped: Column) -> Column:
    """struct(family, code, filled) of a stamped head, as line_parts gives it."""

    def read(text: Column) -> Column:
        tokens = F.slice(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]?|\([^)]*\)?|[^\s\[(]+"), F.lit(0)), 1, PARTS)  # the first one is the family's name
        inner = lambda t: F.trim(F.regexp_replace(t, r"^[\[(]|[\])]$", ""))
        kind = lambda t: (
            F.when(t == _TIME, "T").when((F.length(t) > 2) & kinds.level_rank(F.rtrim(inner(t), F.lit(":"))).isNotNull(), "L").when(t.rlike(r"^[\[(]"), "B").when(t.rlike(r"^[-|:]+$"), "S").when(t.endswith(":"), "G").otherwise("W")
        )
        return let(F.slice(tokens, 2, PARTS), lambda ts: F.struct(F.get(tokens, F.lit(0)).alias("family"), F.array_join(F.transform(ts, kind), "").alias("code"), F.array_join(F.transform(ts, lambda t: F.when(inner(t) == "", "0").otherwise("1")), "").alias("filled")))

    def tidy(x: Column) -> Column:
        """A word before a lone sign is a logger; a sign is no part, and what is behind the parts is the message."""
        code = F.regexp_replace(x["code"], "WS", "G")
        return F.struct(x["family"].alias("family"), F.regexp_replace(code, "S", "").alias("code"), x["filled"].alias("filled"))

    return let(let(stamped, lambda m: F.when(m.isNotNull(), read(m))), lambda x: F.when(x.isNotNull(), tidy(x)))


def line_parts(raw: Column) -> Column:
    """struct(family, code, filled) of a text line: the family of the time that it begins with, perhaps behind a level, the kinds of its first parts, and for each whether it has a value.

    The time is found first and stands for one part. Then the line is read part by part: in brackets, or up to a blank. A part is a level (L), something else in brackets (B),
    a lone sign (S), a word with a colon or a lone sign behind it (G, a logger), or another word (W). Signs are left out but for what they say of the word before.
    """
    return _parts_of(let(_marked(raw), _stamped))


_TIME = "\u0001T"
_FIELDS = "#Fields:"
#: How lines begin that may begin with a time, perhaps behind a first word, and what is neither a separator nor a quote, a blank or a dash.
_MAY_BE_STAMPED, _PLAIN = r"^(?:[\[(]?[A-Za-z]+[\])]?:?[ \t\x01]+)?[\[(]?(?:[0-9]{2}|[0-9]/|[A-Z][a-z]{2},? )", r'[^,\t|; "\-]+'


def _look(raw: Column) -> Column:
    """What text layouts, separators and fields of #Fields: see of a line: its head with every digit 0 if it may begin with a time, and every run of other letters than separators, quotes, blanks and dashes as one x
    in the rest. #Fields: stays as it is."""
    digits = lambda t: F.when(F.octet_length(t) == F.length(t), F.mask(t, *[F.lit(None).cast("string")] * 2, F.lit("0"), F.lit(None).cast("string"))).otherwise(F.translate(t, "123456789", "0" * 9))
    plain = lambda t: F.regexp_replace(t, _PLAIN, "x")
    head = F.when(F.length(raw) <= HEAD, digits(raw)).otherwise(F.concat(digits(F.substring(raw, 1, HEAD)), plain(F.substring(raw, HEAD + 1, 1 << 30))))
    return F.when(raw.startswith(_FIELDS), raw).when(raw.rlike(_MAY_BE_STAMPED), head).otherwise(plain(raw))


def detect_formats(lines: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(source, format, score, nth), best first: coverage x (0.6 + 0.4 x consistency) x trust of each candidate over the first lines, those under 0.5 dropped.

    Consistency is the share of the most frequent shape (which fields have a value) among the lines that a format takes. Of the delimited formats, lines of the most
    frequent number of fields count, and only the best separator is a candidate. Lines are counted by their looks, and what looks alike is read once for text layouts, separators and fields of
    #Fields:. Other formats, in which single digits or names count, are read line by line, where a line has their sign. Candidates are told on the counts.
    """
    raw = F.col("raw")
    d = lines.filter(F.col("line_no") < sample).filter(F.length(F.trim("raw")) > 0).filter(raw.startswith(_FIELDS) | (~raw.startswith("#") & ~records.is_continuation(raw)))
    d = d.select("source", "line_no", F.when(raw.startswith(_FIELDS), raw).otherwise(F.replace("raw", F.lit(ingest.MARK), F.lit(" "))).alias("raw"))
    shape = lambda cells: F.array_join(F.transform(cells, lambda c: F.when(F.coalesce(c, F.lit("")) != "", "1").otherwise("0")), "")
    keys = lambda pairs: F.array_join(F.array_sort(F.map_keys(pairs)), " ")
    # format -> its shape, or null if the line is none of it.
    obj = F.from_json(raw, "map<string,string>")
    words = F.filter(F.regexp_extract_all("raw", F.lit(ingest._PAIR), F.lit(0)), lambda t: ~t.startswith("="))
    pairs = lambda w: F.size(F.filter(w, lambda t: F.contains(t, F.lit("="))))
    paired = let(words, lambda w: let(pairs(w), lambda n: (n >= 2) & (2 * n >= F.size(w))))
    signed = {"json_lines": F.when(F.ltrim(raw).startswith("{"), keys(F.map_filter(obj, lambda k, v: v.isNotNull()))), "logfmt": F.when((F.substring_index(raw, "=", 2) != raw) & paired, keys(ingest.logfmt_pairs(raw)))}
    # The mark of each field, and a digit after it if it has a value; a line that is none of a grammar begins with no mark.
    grammar = lambda g, sign: F.when(sign, F.regexp_replace(raw, "(?d)" + g[0], "".join(f"{ingest.MARK}${i}" for i in range(1, len(g[1]) + 1))))
    access, pri = F.contains(raw, F.lit('] "')), raw.startswith("<")
    month = pri | F.substring(raw, 1, 3).isin(*times.MONTHS.split("|"))
    grammars = {"access_combined": grammar(ingest.ACCESS_COMBINED, access), "access_common": grammar(ingest.ACCESS_COMMON, access), "syslog_5424": grammar(ingest.SYSLOG_5424, pri), "syslog_3164": grammar(ingest.SYSLOG_3164, month)}
    valued = lambda n: F.when(F.col(n).startswith(ingest.MARK), F.regexp_replace(n, f"{ingest.MARK}[^{ingest.MARK}]+", f"{ingest.MARK}1"))
    d = d.select("source", "line_no", _look(raw).alias("raw"), *[c.alias(n) for n, c in (signed | grammars).items()]).withColumns({n: valued(n) for n in grammars})
    looks = materialize(d.groupBy("source", "raw", *signed, *grammars).agg(F.count("*").alias("n"), F.min("line_no").alias("first")), "looks")
    w3c = looks.filter(raw.startswith(_FIELDS)).groupBy("source").agg(F.min_by(F.size(F.split(F.trim(F.substring("raw", 9, 1 << 20)), r"\s+")), "first").alias("_w3c"))  # a number for each source
    d = looks.filter(~raw.startswith(_FIELDS)).join(F.broadcast(w3c), "source", "left")
    w3c_cells = F.when(F.contains(raw, F.lit("\t")), F.split(raw, "\t")).otherwise(F.split(raw, " "))
    # What is used more than once, computed once: lines with their quoted cells cut short, heads with their times found.
    quoted = F.when(F.contains(raw, F.lit('"')), F.regexp_replace("raw", '"(?:[^"]|"")*"', "q")).otherwise(raw)
    d = ingest.parsed_once(d, _quoted=quoted, _marked=_marked(raw))
    # A separated line's shape is its separators, and a sign for each value between them.
    shapes = {
        "w3c": F.when(F.col("_w3c").isNotNull() & (F.size(w3c_cells) == F.col("_w3c")), shape(F.transform(w3c_cells, lambda c: F.nullif(c, F.lit("-"))))),
        **{n: F.when(F.contains("_quoted", F.lit(sep[-1])), F.regexp_replace("_quoted", f"[^{sep[-1]}]+", "1")) for n, sep in DELIMITED.items()},
    }
    # Column by column: the code of all of them together would be too long for the JVM to compile.
    for n, c in (shapes | {"_stamped": _stamped(F.col("_marked"))}).items():
        d = ingest.parsed_once(d, **{n: c})
    shapes = ["w3c", *signed, *DELIMITED]
    alike = d.groupBy("source", "_stamped", *grammars, *shapes).agg(F.sum("n").alias("n"))
    alike = ingest.parsed_once(alike, _parts=_parts_of(F.col("_stamped")))

    # Candidates: the format, the number of fields where it tells lines apart, the shape, the trust. The one without a name takes every line.
    one, names = F.lit(1), [*grammars, *shapes, *[f"{name}:{family}" for family in _stamps() for name in LAYOUTS]]
    fit = lambda format, shape, fields, trust: F.struct(format.alias("format"), fields.alias("fields"), shape.alias("shape"), F.lit(trust).alias("trust"))
    fits = [fit(F.lit(""), F.lit(""), one, 1.0)]
    for n in (*grammars, *shapes):
        sep = DELIMITED.get(n, "")[-1:]
        fields = F.length(n) - F.length(F.replace(F.col(n), F.lit(sep), F.lit(""))) + 1 if sep else one
        fits.append(F.when(F.col(n).isNotNull(), fit(F.lit(n), F.col(n), fields, TRUST["delimited" if sep else n] if sep or n in TRUST else 1.0)))
    parts = F.col("_parts")
    for name, (code, _, trust) in LAYOUTS.items():
        # The shape: a thread may be empty in its brackets, and a message missing.
        empty = F.when(parts["filled"].substr(code.index("B") + 1, 1) == "0", "0").otherwise("1") if "B" in code else F.lit("")
        message = F.when(F.length(parts["code"]) > len(code), "1").otherwise("0")
        fits.append(F.when(parts["code"].startswith(code), fit(F.concat(F.lit(f"{name}:"), parts["family"]), F.concat(empty, message), one, trust)))
    rows = alike.select("source", "n", F.explode(F.array_compact(F.array(*fits))).alias("x")).select("source", "n", "x.*")
    counted = rows.groupBy("source", "format", "trust", "fields", "shape").agg(F.sum("n").alias("n"))
    by = counted.groupBy("source", "format", "trust", "fields").agg(F.sum("n").alias("hits"), F.max("n").alias("modal"))
    # The most frequent number of fields; the larger one on ties.
    best = by.groupBy("source", "format", "trust").agg(F.max(F.struct("hits", "fields", "modal")).alias("m"))
    best = best.withColumn("lines", F.max(F.when(F.col("format") == "", F.col("m.hits"))).over(W.partitionBy("source"))).filter("format <> ''")
    best = best.withColumn("score", F.col("m.hits") / F.col("lines") * (0.6 + 0.4 * F.col("m.modal") / F.col("m.hits")) * F.col("trust"))
    delimited = F.col("format").isin(*DELIMITED)
    best = best.filter((F.col("score") >= MIN_SCORE) & (~delimited | (F.col("m.hits") >= 0.8 * F.col("lines"))))
    order = F.element_at(F.create_map(*[v for i, n in enumerate(names) for v in (F.lit(n), F.lit(i))]), F.col("format"))
    best = best.withColumn("_o", order)
    rank = lambda *by: F.row_number().over(W.partitionBy("source", *by).orderBy(F.desc("score"), "_o"))
    best = best.withColumn("_d", rank(F.when(delimited, "d").otherwise(F.col("format")))).filter("_d = 1")
    return best.withColumn("nth", rank()).select("source", "format", "score", "nth")


@dataclass(frozen=True)
class Profile:
    """Chosen by a glob on the path, a regex on the first lines, or both."""

    name: str
    glob: str | None = None
    content: str | None = None
    builtin: bool = False


def glob_regex(glob: str) -> str:
    """`*` within a folder, `**` across folders, `?`, `[...]`, `{a,b}`. A glob without a folder is for the file name."""
    out = ""
    for m in re.finditer(r"\*\*/?|\*|\?|\[[^\]]*\]|\{[^}]*\}|.", glob):
        t = m[0]
        out += ".*" if t.startswith("**") else "[^/]*" if t == "*" else "[^/]" if t == "?" else t.replace("[!", "[^") if t[0] == "[" else "(?:" + "|".join(map(re.escape, t[1:-1].split(","))) + ")" if t[0] == "{" else re.escape(t)
    return f"(?i)^{'' if '/' in glob else '(?:.*/)?'}{out}$"


def route(lines: DataFrame, profiles: Sequence[Profile], first: int = 20) -> DataFrame:
    """(source, profile): both conditions beat content, content beats glob; then the most literal characters of the glob, own profiles before built-in ones, then order. Null for none."""
    scored = []
    heads = lines.filter(F.col("line_no") < first).groupBy("source").agg(*[F.max(F.col("raw").rlike(p.content) if p.content else F.lit(False)).alias(f"_p{i}") for i, p in enumerate(profiles)])
    for i, p in enumerate(profiles):
        path = F.col("source").cast("string").rlike(glob_regex(p.glob)) if p.glob else F.lit(True)
        ok = path & (F.col(f"_p{i}") if p.content else F.lit(True)) & F.lit(bool(p.glob or p.content))
        weight = 2 * bool(p.content) + bool(p.glob)
        literal = len(re.sub(r"[*?\[\]{}]", "", p.glob or ""))
        scored.append(F.when(ok, F.struct(F.lit(weight).alias("w"), F.lit(literal).alias("l"), F.lit(not p.builtin).alias("own"), F.lit(-i).alias("o"), F.lit(p.name).alias("name"))))
    return heads.select("source", F.array_max(F.array(*scored))["name"].alias("profile"))
