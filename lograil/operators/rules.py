"""Rules that tag lines, entities, and rate-limited alerts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.functions import predicates as P
from lograil.functions.kinds import LEVEL_SPELLINGS
from lograil.operators import blocked, records
from lograil.shared import materialize


@dataclass(frozen=True)
class Rule:
    """kind is literal, regex or column (then column, op and pattern are the condition). scope asks for the match inside that column."""

    name: str
    pattern: str
    kind: str = "literal"
    case: str = "smart"
    whole_word: bool = False
    column: str | None = None
    op: str = "eq"
    scope: str | None = None
    priority: int = 0
    tag: str | None = None
    hide: bool = False
    alert: bool = False
    bookmark: bool = False
    enabled: bool = True
    #: The group of a regex that is meant; the whole match if None.
    group: int | None = None

    def check(self) -> None:
        if self.kind == "literal" and not self.pattern:
            raise ValueError(f"{self.name}: empty literal")
        if self.kind == "regex":
            groups = re.compile(self.pattern).groups
            if self.group is not None and not 0 <= self.group <= groups:
                raise ValueError(f"{self.name}: no group {self.group}; the pattern has {groups}")
        if self.kind == "column" and self.op in ("gt", "ge", "lt", "le"):
            float(self.pattern)
        if self.kind == "column" and not self.column:
            raise ValueError(f"{self.name}: no column")

    def matches(self, columns: Sequence[str] = ()) -> Column:
        """columns: the record columns at hand; a rule that needs another never matches."""
        needs = self.column if self.kind == "column" else self.scope
        if needs and needs not in columns:
            return F.lit(False)
        if self.kind == "column":
            return P.rule_condition(F.col(needs), self.op, self.pattern)
        raw = F.col(needs or "raw")
        return P.text(raw, self.pattern, self.case, self.whole_word) if self.kind == "literal" else P.regex(raw, self.pattern, self.case)


def usable(rules: Sequence[Rule]) -> tuple[list[Rule], dict[str, str]]:
    """The rules that can be applied, and why the others cannot, by name; disabled rules are in neither."""
    good, wrong = [], {}
    for r in rules:
        if r.enabled:
            try:
                r.check()
                good.append(r)
            except (ValueError, re.error) as e:
                wrong[r.name] = str(e)
    return good, wrong


def tag_lines(lines: DataFrame, rules: Sequence[Rule], columns: Sequence[str] = ()) -> DataFrame:
    """lines with rules (names of all that match, in order), hidden, alert, bookmark, and tag (that of the matching rule of highest priority, the later one on ties)."""
    rules = [r for r in rules if r.enabled]
    for r in rules:
        r.check()
    hits = F.array_compact(F.array(*[F.when(r.matches(columns), F.lit(i)) for i, r in enumerate(rules)]).cast("array<int>"))
    d = lines.withColumn("_hits", hits)
    names = F.array(*[F.lit(r.name) for r in rules]).cast("array<string>")
    flag = lambda on: F.arrays_overlap("_hits", F.array(*[F.lit(i) for i, r in enumerate(rules) if on(r)]).cast("array<int>"))
    marks = F.array(*[F.when(F.lit(r.tag is not None), F.struct(F.lit(r.priority).alias("p"), F.lit(i).alias("i"), F.lit(r.tag).cast("string").alias("tag"))) for i, r in enumerate(rules)])
    best = F.array_max(F.filter(marks, lambda m: F.array_contains("_hits", m["i"])))["tag"]
    return d.withColumns({"rules": F.transform("_hits", lambda i: F.get(names, i)), "hidden": flag(lambda r: r.hide), "alert": flag(lambda r: r.alert), "bookmark": flag(lambda r: r.bookmark), "tag": best}).drop("_hits")


def rule_hits(tagged: DataFrame) -> DataFrame:
    return tagged.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def up_to(n: int) -> str:
    """A pattern of the decimal numbers 0 to n without leading zeros, larger ones first."""
    text, parts = str(n), []
    for i, d in enumerate(text):
        low = "1" if i == 0 and len(text) > 1 else "0"
        if d > low:
            parts.append(f"{text[:i]}[{low}-{int(d) - 1}]" + "[0-9]" * (len(text) - i - 1))
    shorter = ["[1-9]" + "[0-9]" * (k - 1) for k in range(len(text) - 1, 1, -1)] + (["[0-9]"] if len(text) > 1 else [])
    return "(?:" + "|".join([text, *parts[::-1], *shorter]) + ")"


def _hex(*lengths: int) -> list[str]:
    return [f"[0-9a-fA-F]{{{n}}}" for n in lengths]


_OCTET, _GROUP = up_to(255), "[0-9a-fA-F]{1,4}"
_METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "CONNECT", "OPTIONS", "TRACE", "PATCH")
# RFC 3339, section 5.6, whose dates stand alone too. Logs write a blank for the T and a comma for the fraction's dot, and leave out the offset.
_FULL_DATE = "[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_HOUR_MINUTE = "(?:[01][0-9]|2[0-3]):[0-5][0-9]"
_FULL_TIME = rf"{_HOUR_MINUTE}:(?:[0-5][0-9]|60)(?:[.,][0-9]+)?(?: ?(?:[Zz]|[+-]{_HOUR_MINUTE}))?"
# Numbers as JSON has them, leading zeros allowed, and hexadecimal ones. A unit may follow, a further letter or dot may not precede.
_NUMBER = "0[xX][0-9a-fA-F]+|[0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+\\b)?"
# Java: packages, then a class name that ends as those of throwables do, inner ones behind $ (JLS, section 6.1). Python's exceptions are named alike.
_PACKAGES = "(?:[a-z_][a-zA-Z0-9_]*\\.)*"
_THROWABLE = r"[A-Z][a-zA-Z0-9_]*(?:\$[A-Z][a-zA-Z0-9_]*)*(?<=Exception|Error|Throwable)"
# StackTraceElement.toString: [loader/][module/]class.method(File.java:12), (File.java), (Native Method) or (Unknown Source); and the frames of Python's traceback module.
_JAVA_FRAME = r"[ \t]+at (?:[^\s/()]*/){0,2}[^\s/()]+\.[^\s.()]+\((?:[^():]+(?::[0-9]+)?)\)"
_PYTHON_FRAME = '[ ]+File "[^"]+", line [0-9]+(?:, in [^ ]+)?'
#: Patterns of the entities, from their definitions: four octets, with a port; eight groups of hexadecimal digits, with one run of zero groups left out as :: (RFC 4291);
#: RFC 9562 identifiers; absolute paths of POSIX and of drives; RFC 9110 methods and status codes; the others as above.
ENTITIES = {
    "ipv4": r"\b" + r"\.".join([_OCTET] * 4) + r"(?::[0-9]{1,5})?\b",
    "ipv6": rf"(?<![\w:])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?)(?![\w:])",
    "uuid": r"\b" + "-".join(_hex(8, 4, 4, 4, 12)) + r"\b",
    "timestamp": rf"(?<![\w.-]){_FULL_DATE}(?:[Tt ]{_FULL_TIME})?(?![\w-])",
    "url": r"\b[a-z][a-z0-9+.-]*://[^\s\"'<>]+",
    "path": r"(?<![\w/:.])(?:[A-Za-z]:\\(?:[^\s\\:*?\"<>|]+\\?)+|(?:/[\w.@%+~-]+){2,}/?)",
    "level": r"\b(?:" + "|".join(s.upper() for names in LEVEL_SPELLINGS for s in sorted(names, key=len, reverse=True) if len(s) > 2) + r")\b",
    "http_method": r"\b(?:" + "|".join(_METHODS) + r")\b",
    "http_status": r"(?<=\" )[1-5][0-9]{2}(?= )",
    "number": rf"(?<![\w.])(?:{_NUMBER})",
    "exception": rf"(?<![\w.$]){_PACKAGES}{_THROWABLE}(?![\w$])",
    "stack_frame": f"^(?:{_JAVA_FRAME}|{_PYTHON_FRAME})",
}


def entities(lines: DataFrame, kinds: Sequence[str] = tuple(ENTITIES)) -> DataFrame:
    """(source, line_no, entity, value) of all matches."""
    found = lambda k: F.transform(F.regexp_extract_all("raw", F.lit(ENTITIES[k]), F.lit(0)), lambda v: F.struct(F.lit(k).alias("entity"), v.alias("value")))
    cells = F.flatten(F.array(*[found(k) for k in kinds]))
    return lines.select("source", "line_no", F.explode(cells).alias("x")).select("source", "line_no", "x.*")


def status_class(value: Column) -> Column:
    """The class of an HTTP status: 1xx to 5xx; null for anything else."""
    return F.when(value.rlike("^[1-5][0-9]{2}$"), F.concat(F.substring(value, 1, 1), F.lit("xx")))


def chain_starts(first: np.ndarray, last: np.ndarray, hits: np.ndarray, span: int) -> np.ndarray:
    """For each run of hits, in order, the time of the notification by a hit that its windows are counted from. Runs are a span apart or more, and less than two spans.

    Windows of span follow each other from a start on while each holds a hit. So a chain ends behind a run if the window after the run's last one is over before the next
    run begins, or if the start is the run's only hit.
    """
    out, i = np.empty(len(first), np.int64), 0
    while i < len(first):
        start, j = first[i], i
        if hits[i] > 1:
            while j + 1 < len(first) and first[j + 1] - last[j] < 2 * span - (last[j] - start) % span:
                j += 1
        out[i : j + 1] = start
        i = j + 1
    return out


def limit_alerts(hits: DataFrame, seconds: float = 5.0, block_lines: int = blocked.BLOCK_LINES) -> DataFrame:
    """(source, rule, ts, suppressed): notifications of hits (source, rule, ts). After one, hits are held back for so many seconds; then a summary with their number counts as
    the next notification.

    So notifications come at the starts of windows that follow each other from a hit on, as long as each window holds one. Hits are ranked by time and read in blocks: runs without a gap of
    a window never end a chain, and a gap of two windows always does. Only runs with a smaller gap between them are read in order, a row for each run and a task for each stretch without a gap of two windows; a stretch
    has no more runs than windows, however many hits there are. Hits without a time give nothing.
    """
    span = int(seconds * 1e6)
    if span <= 0:
        raise ValueError("a positive time")
    times = hits.filter("ts is not null").groupBy("source", "rule", F.unix_micros("ts").alias("us")).agg(F.count("*").alias("n"))
    t = records.ranked(times, F.col("source"), F.col("rule"), F.col("us"), out="line_no")
    t = t.select(F.struct("source", "rule").alias("source"), "line_no", "us", "n")
    gap = F.col("us") - F.col("_prev")
    t = blocked.previous(t, F.col("us"), "_prev", block_lines).withColumns({"_run": F.coalesce(gap >= span, F.lit(True)), "_far": F.coalesce(gap >= 2 * span, F.lit(True))}).drop("_prev")
    t = blocked.carry_last(blocked.carry_last(t, F.when(F.col("_run"), F.col("line_no")), "run", block_lines), F.when(F.col("_far"), F.col("line_no")), "stretch", block_lines).drop("_run", "_far")
    t = materialize(t, "alert-times")
    runs = t.groupBy("stretch", "run").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.sum("n").alias("hits"))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in chain(batches, [None]):
            # A stretch is read when the next one begins.
            table = pa.concat_tables([*held, pa.Table.from_batches([b])]) if b is not None else pa.concat_tables(held) if held else None
            if table is None or not table.num_rows:
                continue
            run, first, last, n, stretch = (table.column(c).to_numpy() for c in ("run", "first", "last", "hits", "stretch"))
            cuts = [0, *(np.flatnonzero(stretch[1:] != stretch[:-1]) + 1).tolist(), len(stretch)]
            keep = cuts[-2] if b is not None else len(stretch)
            got = [chain_starts(first[lo:hi], last[lo:hi], n[lo:hi], span) for lo, hi in zip(cuts[:-1], cuts[1:]) if hi <= keep]
            held = [table.slice(keep)]
            yield pa.RecordBatch.from_arrays([pa.array(run[:keep]), pa.array(np.concatenate(got) if got else np.zeros(0, np.int64))], ["line_no", "start"])

    found = runs.repartition("stretch").sortWithinPartitions("stretch", "run").mapInArrow(starts, "line_no long, start long")
    t = blocked.carry_last(t.join(found, "line_no", "left"), F.col("start"), "start", block_lines)
    windows = t.groupBy("source", "start", F.floor((F.col("us") - F.col("start")) / span).cast("long").alias("window")).agg(F.sum("n").alias("n"))
    held = F.when(F.col("window") == 0, F.col("n") - 1).otherwise(F.col("n"))
    told = F.array(F.struct(F.col("start").alias("us"), F.lit(0).cast("long").alias("suppressed"), (F.col("window") == 0).alias("given")), F.struct((F.col("start") + (F.col("window") + 1) * span).alias("us"), held.alias("suppressed"), (held > 0).alias("given")))
    out = windows.select("source", F.explode(told).alias("x")).filter("x.given")
    return out.select("source.source", "source.rule", F.timestamp_micros("x.us").alias("ts"), "x.suppressed")


def notifications(us: np.ndarray, span: int, last: int | None, held: int) -> tuple[list[tuple[int, int, int | None]], int | None, int]:
    """(time, suppressed, number of the hit that is notified or None for a summary) of sorted hits, and the state behind them: the last notification and how many hits it holds back since.

    Goes from one notification to the next by binary search, so hits that are held back cost nothing.
    """
    out, i = [], 0
    while True:
        if last is not None:
            end = int(np.searchsorted(us, last + span))
            held += max(end - i, 0)
            i = max(end, i)
        if i >= len(us):
            return out, last, held
        if last is not None and held:
            last = last + span
            out.append((last, held, None))
            held = 0
        else:
            last = int(us[i])
            out.append((last, 0, i))
            i += 1
