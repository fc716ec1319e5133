"""Timestamps in cells and lines, as Column expressions. Times are UTC unless the text or an argument names a zone."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A timestamp is looked for in so many bytes of a line.
SCAN = 512
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
_ZONE = r"(?:Z|[+-]\d{2}:?\d{2}|[+-]\d{2})?"


def _iso(text: Column) -> Column:
    """ISO text with optional fraction (dot or comma) and zone. Most of it Spark reads as it is; commas, zones without colon, leap seconds and long fractions are rewritten first."""
    t = F.regexp_replace(F.translate(text, ",T", ". "), r"([+-]\d{2})(\d{2})$", "$1:$2")
    t = F.regexp_replace(t, r":60(?=$|[.Z+-])", ":59")
    return F.coalesce(text.try_cast("timestamp"), F.regexp_replace(t, r"(\.\d{6})\d+", "$1").try_cast("timestamp"))


def _clock(date: Column, text: Column) -> Column:
    return F.concat_ws(" ", date, text).try_cast("timestamp")


#: What must stand before an epoch: the line's start, a bracket, or a key of a time.
AFTER_KEY = r"(?<=^|[\[(]|ts=|time=)"


#: Name -> (pattern, expression of the matched text and the reference date). In the order in which ties are decided.
FORMATS = {
    "iso": (rf"{_ISO}(?:\.\d{{1,9}})?{_ZONE}(?!,\d)", lambda t, ref: _iso(t)),
    "iso_comma": (rf"{_ISO},\d{{1,9}}{_ZONE}", lambda t, ref: _iso(t)),
    "slashed": (r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,9})?", lambda t, ref: _iso(F.translate(t, "/", "-"))),
    "compact": (r"\d{8}T\d{6}(?:\.\d{1,9})?Z?", lambda t, ref: _iso(F.regexp_replace(t, r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)", "$1-$2-$3 $4:$5:$6"))),
    "apache": (rf"\d{{2}}/(?:{MONTHS})/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}} [+-]\d{{4}}", lambda t, ref: F.try_to_timestamp(t, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))),
    "rfc2822": (rf"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d{{1,2}} (?:{MONTHS}) \d{{4}} \d{{2}}:\d{{2}}:\d{{2}} [+-]\d{{4}}", lambda t, ref: F.try_to_timestamp(F.regexp_replace(t, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))),
    "syslog": (rf"(?:{MONTHS}) [ \d]\d \d{{2}}:\d{{2}}:\d{{2}}", lambda t, ref: _syslog(t, ref)),
    "us": (r"\d{1,2}/\d{1,2}/\d{4},? \d{1,2}:\d{2}:\d{2} (?:AM|PM)", lambda t, ref: F.try_to_timestamp(F.regexp_replace(t, ",", ""), F.lit("M/d/yyyy h:mm:ss a"))),
    "time": (r"\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?", lambda t, ref: _clock(ref.cast("string"), F.regexp_replace(F.regexp_replace(t, ",", "."), r"(\.\d{6})\d+", "$1"))),
    "epoch_ns": (AFTER_KEY + r"\d{19}", lambda t, ref: F.timestamp_micros((t.try_cast("decimal(20,0)") / 1000).cast("long"))),
    "epoch_us": (AFTER_KEY + r"\d{16}", lambda t, ref: F.timestamp_micros(t.try_cast("long"))),
    "epoch_ms": (AFTER_KEY + r"\d{13}", lambda t, ref: F.timestamp_millis(t.try_cast("long"))),
    "epoch_s": (AFTER_KEY + r"\d{10}(?:\.\d{1,9})?", lambda t, ref: F.timestamp_micros((t.try_cast("decimal(20,9)") * 1000000).cast("long"))),
}


def _syslog(t: Column, ref: Column) -> Column:
    """A date without year: that of the reference date, or the year before if it would lie more than a day after it."""
    text = F.regexp_replace(t, r"\s+", " ")
    at = lambda year: F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), text), F.lit("yyyy MMM d HH:mm:ss"))
    now = at(F.year(ref))
    return F.when(now > F.date_add(ref, 2).cast("timestamp"), at(F.year(ref) - 1)).otherwise(now)


def _bounded(pattern: str) -> str:
    return rf"(?<![\w.:/-]){pattern}(?![\w:])"


def cell_instant(c: Column) -> Column:
    """The instant of a cell: ISO, Apache or epoch of 10, 13, 16 or 19 digits; null for anything else."""
    t = F.trim(c)
    out = []
    for name in ("iso", "iso_comma", "slashed", "compact", "apache", "rfc2822", "epoch_s", "epoch_ms", "epoch_us", "epoch_ns"):
        pattern, read = FORMATS[name]
        out.append(F.when(t.rlike(f"^(?:{pattern})$"), read(t, F.current_date())))
    return F.coalesce(*out)


#: Formats that name a date, and those that are looked for only where none of these is found.
DATED, UNDATED = tuple(FORMATS)[:8], tuple(FORMATS)[8:]


def _any_of(names: Sequence[str]) -> str:
    """Any of some formats; the leftmost match wins, at one place the first format."""
    return _bounded("(?:" + "|".join(FORMATS[n][0] for n in names) + ")")


def head_of(raw: Column) -> Column:
    """The first bytes of a line in which timestamps are looked for. A character that the cut splits is no part of a timestamp."""
    return F.when(F.octet_length(raw) <= SCAN, raw).when(F.octet_length(raw) == F.length(raw), F.substring(raw, 1, SCAN)).otherwise(F.substring(raw.cast("binary"), 1, SCAN).cast("string"))


def stamp_text(raw: Column) -> Column:
    """The first timestamp of a line as text: the earliest match among the formats with a date, else of time of day and epochs. One scan of the line, a second one where no date is found; null for none."""
    from lograil.functions.kinds import let

    found = lambda head, names: F.nullif(F.regexp_extract(head, _any_of(names), 0), F.lit(""))
    return let(head_of(raw), lambda head: F.coalesce(found(head, DATED), found(head, UNDATED)))


def text_format(text: Column) -> Column:
    """The name of the format that a timestamp's text is written in; null for none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, (pattern, _) in FORMATS.items():
        out = out.when(text.rlike(f"^(?:{pattern})$"), name)
    return out


def line_format(raw: Column) -> Column:
    """The name of the first timestamp's format in a line; null for none."""
    from lograil.functions.kinds import let

    return let(stamp_text(raw), text_format)


def read_text(text: Column, name: Column, reference_date: Column | str = "2024-12-31") -> Column:
    """The instant of a timestamp's text in a format."""
    ref = F.lit(reference_date).cast("date") if isinstance(reference_date, str) else reference_date
    return F.coalesce(*[F.when(name == n, read(text, ref)) for n, (_, read) in FORMATS.items()])


def read_as(raw: Column, name: str, reference_date: Column | str = "2024-12-31") -> Column:
    """The first timestamp of one format in a line."""
    ref = F.lit(reference_date).cast("date") if isinstance(reference_date, str) else reference_date
    pattern, read = FORMATS[name]
    text = F.regexp_extract(head_of(raw), _bounded(f"({pattern})"), 1)
    return F.when(text != "", read(text, ref))


def line_instant(raw: Column, learned: str | None = None, reference_date: str = "2024-12-31", tz: str = "UTC") -> Column:
    """The first timestamp of a line: the learned format first, then all. Zone-less text is read in tz."""
    from lograil.functions.kinds import let

    found = let(stamp_text(raw), lambda text: let(text_format(text), lambda name: read_text(text, name, reference_date)))
    at = F.coalesce(read_as(raw, learned, reference_date), found) if learned else found
    return at if tz == "UTC" else F.to_utc_timestamp(at, tz)


def record_time(cell: Column, raw: Column, learned: str | None = None, reference_date: str = "2024-12-31", tz: str = "UTC") -> Column:
    """The time of a record: that of its timestamp cell if it can be read, else the first timestamp of its line."""
    return F.coalesce(cell_instant(cell), line_instant(cell, learned, reference_date, tz), line_instant(raw, learned, reference_date, tz))


def learn_formats(lines: DataFrame, sample: int = 1000) -> DataFrame:
    """(source, format): the format of most of the first lines of each source; ties go to the earlier format. Text that is no valid instant does not vote."""
    order = F.create_map(*[x for i, n in enumerate(FORMATS) for x in (F.lit(n), F.lit(i))])
    votes = lines.filter(F.col("line_no") < sample).select("source", stamp_text(F.col("raw")).alias("text")).withColumn("format", text_format(F.col("text")))
    votes = votes.filter(read_text(F.col("text"), F.col("format")).isNotNull())
    votes = votes.groupBy("source", "format").count()
    return votes.groupBy("source").agg(F.max_by("format", F.struct("count", -F.element_at(order, F.col("format")))).alias("format"))


def goto_target(text: str, now: str) -> tuple[str, float | str]:
    """What a go-to input means: ("end", seconds before the last time), ("start", seconds after the first) or ("at", an instant). `10:15` is today's."""
    t = text.strip()
    if re.match(r"[+-]\d", t):
        return ("start" if t[0] == "+" else "end"), span_seconds(t[1:])
    if m := re.fullmatch(r"(\d{1,2}):(\d{2})(?::(\d{2})(\.\d+)?)?", t):
        return "at", f"{now[:10]} {int(m[1]):02d}:{m[2]}:{m[3] or '00'}{m[4] or ''}"
    if not re.match(r"\d{4}-\d{2}-\d{2}", t):
        raise ValueError(f"cannot read {text!r} as a time; try 2026-09-29 10:00, 10:15, -15m or +1h")
    return "at", t


_SPAN = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def span_seconds(text: str) -> float:
    """Seconds of `1h30m`, `2.5h`, `2w`. Raises ValueError for anything else."""
    if not re.fullmatch(r"(?:\d+(?:\.\d+)?(?:ns|us|ms|s|m|h|d|w))+", text.strip()):
        raise ValueError(f"no span: {text!r}")
    return sum(float(n) * _SPAN[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h|d|w)", text))


def show_relative(us: Column) -> Column:
    """Signed microseconds as `+00:00.153`, `-1h02m`, `+2d03h`."""
    ms = F.floor(F.abs(us) / 1000)
    s = F.floor(ms / 1000)
    text = (
        F.when(s < 3600, F.format_string("%02d:%02d.%03d", F.floor(s / 60), s % 60, ms % 1000))
        .when(s < 86400, F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).otherwise(F.format_string("%dd%02dh", F.floor(s / 86400), F.floor(s % 86400 / 3600)))
    )
    return F.concat(F.when(us < 0, "-").otherwise("+"), text)


def in_zone(ts: Column, tz: str = "UTC") -> Column:
    """A timestamp in a zone, with 0, 3 or 6 fraction digits as needed."""
    t = F.from_utc_timestamp(ts, tz)
    us = F.unix_micros(ts) % 1000000
    return F.when(us == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(us % 1000 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
