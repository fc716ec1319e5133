"""Kinds of columns and how their text is read: levels, quantities, numbers. All are Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of levels by rank, units, names of kinds, aliases.
LEVEL_LABELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
LEVEL_SPELLINGS = (
    ("t", "trace", "trc", "verbose", "finest", "finer", "v"),
    ("d", "debug", "dbg", "fine"),
    ("i", "info", "inf", "information", "notice", "config"),
    ("w", "warn", "warning", "wrn"),
    ("e", "err", "error", "severe"),
    ("f", "fatal", "crit", "critical", "emerg", "emergency", "alert", "panic", "c"),
)
DURATION_UNITS = {"ns": 1.0, "us": 1e3, "µs": 1e3, "μs": 1e3, "ms": 1e6, "s": 1e9, "sec": 1e9, "secs": 1e9, "m": 6e10, "min": 6e10, "mins": 6e10, "h": 3.6e12, "hr": 3.6e12, "hrs": 3.6e12, "d": 8.64e13}
SIZE_UNITS = {"b": 1.0, "kb": 1e3, "mb": 1e6, "gb": 1e9, "tb": 1e12, "kib": 2.0**10, "mib": 2.0**20, "gib": 2.0**30, "tib": 2.0**40}
KIND_NAMES = {
    "timestamp": ("ts", "time", "timestamp", "@timestamp", "datetime", "asctime", "date"),
    "level": ("level", "lvl", "severity", "loglevel", "log_level", "levelname"),
    "number": ("status", "status_code", "code", "pid", "tid", "port", "line", "count", "sc-status", "http.status"),
    "bytes": ("size", "bytes", "length", "content_length", "body_bytes_sent", "bytes_sent", "sc-bytes", "cs-bytes"),
    "duration": ("duration", "elapsed", "latency", "took", "time_taken", "time-taken", "request_time", "response_time", "rt", "duration_ms"),
}
ALIASES = (("ts", "time", "timestamp", "@timestamp", "datetime", "asctime"), ("level", "lvl", "severity", "loglevel", "levelname"), ("msg", "message"))

_RANKS = {s: i for i, names in enumerate(LEVEL_SPELLINGS) for s in names}
_DURATION, _SIZE = "duration", "size"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def level_rank(c: Column) -> Column:
    """0 (trace) to 5 (fatal) of any usual spelling, brackets allowed; null for anything else."""
    bare = F.trim(F.trim(F.trim(c), F.lit("[]")))
    return F.when(F.octet_length(bare) <= 12, F.try_element_at(_map(_RANKS), F.lower(bare)))


def rank_of(text: str) -> Column:
    """The rank of a level at hand as a literal; null if it is none."""
    bare = text.strip(" ").strip("[]").strip(" ")
    return F.lit(_RANKS.get(bare.lower()) if len(bare.encode()) <= 12 else None).cast("int")


def level_label(c: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LEVEL_LABELS]), level_rank(c))


_QUANTITY = r"^\s*([+-]?)(\d+\.?\d*|\.\d+)\s*([A-Za-zµμ]*)\s*$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use takes it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quantity(c: Column) -> Column:
    """struct(value, family, scaled): a signed decimal with an optional unit; null if it is none. family is duration (scaled to ns), size (bytes) or null."""

    def read(parts: Column) -> Column:
        number = parts[1].cast("double") * F.when(parts[0] == "-", -1.0).otherwise(1.0)
        unit = F.lower(parts[2])
        scale = F.try_element_at(_map(DURATION_UNITS | SIZE_UNITS), unit)
        family = F.when(unit == "", F.lit(None)).when(unit.isin(*DURATION_UNITS), _DURATION).otherwise(_SIZE)
        return F.when((unit == "") | scale.isNotNull(), F.struct(number.alias("value"), family.alias("family"), (number * F.coalesce(scale, F.lit(1.0))).alias("scaled")))

    # One match gives the three parts, with the mark between them; text without the mark has not matched.
    return let(F.split(F.regexp_replace(c, _QUANTITY, "$1\u001f$2\u001f$3"), "\u001f", -1), lambda parts: F.when((F.size(parts) == 3) & ~F.contains(c, F.lit("\u001f")), read(parts)))


def quantity_of(text: str) -> tuple[float, str | None, float] | None:
    """The same for a value at hand: (value, family, scaled)."""
    m = re.fullmatch(_QUANTITY[1:-1], text)
    unit = m[3].lower() if m else None
    if m is None or (unit and unit not in DURATION_UNITS and unit not in SIZE_UNITS):
        return None
    value = float(m[2]) * (-1 if m[1] == "-" else 1)
    return value, None if not unit else _DURATION if unit in DURATION_UNITS else _SIZE, value * (DURATION_UNITS | SIZE_UNITS).get(unit, 1.0)


def duration_ns(c: Column) -> Column:
    """Nanoseconds; a bare number is milliseconds; a size is null."""
    return let(quantity(c), lambda q: F.when(q["family"].isNull(), q["value"] * 1e6).when(q["family"] == _DURATION, q["scaled"]))


def size_bytes(c: Column) -> Column:
    """Bytes; a bare number is bytes; a duration is null."""
    return let(quantity(c), lambda q: F.when(q["family"].isNull() | (q["family"] == _SIZE), q["scaled"]))


def number(c: Column, lenient: bool = False) -> Column:
    """A finite number. Strict: the whole trimmed text. Lenient: the leading number, with thousands separators, ignoring what follows."""
    text = F.trim(F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", ""))
    if not lenient:
        return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    head = F.regexp_extract(text, r"^[+-]?(?:\d+(?:,\d{3}(?!\d))*(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?", 0)
    return F.when(head != "", F.regexp_replace(head, ",", "").try_cast("double"))


def guess_kind(name: str) -> str:
    """The kind that a column's name suggests; text if none."""
    return next((k for k, names in KIND_NAMES.items() if name.lower() in names), "text")


def unique_names(names: Sequence[str]) -> list[str]:
    """Names for columns: empty ones become col1, col2, ...; repeated ones get _2, _3."""
    out: list[str] = []
    for i, n in enumerate(names):
        n = n.strip() or f"col{i + 1}"
        k, name = 1, n
        while name in out:
            k += 1
            name = f"{n}_{k}"
        out.append(name)
    return out


def schema_of(names: Sequence[str], kinds: dict[str, str] | None = None) -> T.StructType:
    """A schema of text fields, with the kind of each in its metadata."""
    return T.StructType([T.StructField(n, T.StringType(), True, {"kind": (kinds or {}).get(n) or guess_kind(n)}) for n in unique_names(names)])


def find_column(columns: Sequence[str], name: str) -> str:
    """The column that a name means: itself, ignoring case, or an alias (severity for level). Raises ValueError if there is none."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        if hit := next(filter(same, columns), None):
            return hit
    for group in ALIASES:
        if name.lower() in group and (hit := next((c for c in columns if c.lower() in group), None)):
            return hit
    raise ValueError(f"unknown column {name!r}; there are {', '.join(list(columns)[:12])}")


def ordered_columns(columns: Sequence[str], order: Sequence[str]) -> list[str]:
    """Columns in the order asked for; `*` stands for all others, at the end by default."""
    named = [find_column(columns, x) for x in order if x != "*"]
    named = list(dict.fromkeys(named))
    rest = [c for c in columns if c not in named]
    at = sum(1 for x in order[: list(order).index("*")]) if "*" in order else len(named)
    return named[:at] + rest + named[at:]


def typed(c: Column, kind: str) -> Column:
    """The typed twin of a text column."""
    from lograil.functions.times import cell_instant

    return {"level": level_rank, "duration": duration_ns, "bytes": size_bytes, "number": number, "timestamp": cell_instant}.get(kind, lambda x: x)(c)


def _trimmed(x: Column, places: int) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def show_duration(ns: Column) -> Column:
    """Nanoseconds as `850 ns`, `1.5 ms`, `2.25 s`, `3m 5s`, `2h 3m`."""
    a, total = F.abs(ns), F.round(F.abs(ns) / 1e9).cast("long")
    text = (
        F.when(a < 1e3, F.concat(F.format_string("%.0f", a), F.lit(" ns"))).when(a < 1e6, F.concat(_trimmed(a / 1e3, 2), F.lit(" µs")))
        .when(a < 1e9, F.concat(_trimmed(a / 1e6, 2), F.lit(" ms"))).when(a < 6e10, F.concat(_trimmed(a / 1e9, 2), F.lit(" s")))
        .when(total >= 3600, F.format_string("%dh %dm", F.floor(total / 3600), F.floor(total % 3600 / 60))).otherwise(F.format_string("%dm %ds", F.floor(total / 60), total % 60))
    )
    return F.concat(F.when(ns < 0, "-").otherwise(""), text)


def show_bytes(n: Column) -> Column:
    """Bytes as `512 B`, `1.5 KiB`."""
    a = F.abs(n)
    text = F.when(a < 1024, F.concat(F.format_string("%.0f", a), F.lit(" B")))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        text = text.when(a < 1024.0 ** (k + 1), F.concat(_trimmed(a / 1024.0**k, 2), F.lit(f" {unit}")))
    return F.concat(F.when(n < 0, "-").otherwise(""), text.otherwise(F.concat(_trimmed(a / 1024.0**5, 2), F.lit(" PiB"))))


def show_cell(c: Column, kind: str) -> Column:
    """A readable cell; text that cannot be read stays as it is."""
    shown = {"level": level_label, "duration": lambda x: show_duration(duration_ns(x)), "bytes": lambda x: show_bytes(size_bytes(x))}.get(kind)
    return F.coalesce(shown(c), c) if shown else c


# Escape sequences by ECMA-48: ESC [, parameter bytes (column 3), intermediate bytes (column 2), a final byte (columns 4 to 7); the command strings SOS, DCS, OSC, PM
# and APC, up to ST (terminals take BEL too); ESC, intermediate bytes, a final byte. What is cut off by the line's end runs to it.
_FINAL, _BETWEEN = "[@-~]", "[ -/]*"
_CONTROL = rf"\[[0-?]*{_BETWEEN}{_FINAL}?"
_STRING = rf"[PX\]^_].*?(?:{chr(7)}|\x1b\\|$)"
ANSI = rf"\x1b(?:{_CONTROL}|{_STRING}|{_BETWEEN}[0-~]?)"


def strip_ansi(c: Column) -> Column:
    """Text without terminal escapes; unterminated ones run to the end of the line."""
    return F.regexp_replace(c, ANSI, "")
