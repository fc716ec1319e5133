"""Predicates over lines and records. All are two-valued: a missing cell never matches, and its negation does."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lograil.functions import kinds, times


def true_only(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def not_(p: Column) -> Column:
    return ~true_only(p)


def all_of(*ps: Column) -> Column:
    return reduce(lambda a, b: a & b, map(true_only, ps), F.lit(True))


def any_of(*ps: Column) -> Column:
    return reduce(lambda a, b: a | b, map(true_only, ps), F.lit(False))


def _ignore_case(pattern: str, case: str, regex: bool) -> bool:
    literal = re.sub(r"\\.|\(\?[^)]*\)", "", pattern) if regex else pattern
    return {"smart": literal == literal.lower(), "insensitive": True, "sensitive": False}[case]


def _escape(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_ " or ord(c) > 127 else "\\" + c for c in text)


def text(raw: Column, literal: str, case: str = "smart", whole_word: bool = False) -> Column:
    """A literal in a line. Smart case ignores case unless the literal has an upper-case letter."""
    if not literal or "\n" in literal:
        raise ValueError("a literal must be non-empty and without line breaks")
    ignore = _ignore_case(literal, case, False)
    if whole_word:
        return true_only(raw.rlike(f"{'(?iu)' if ignore else ''}(?U)(?<!\\w){_escape(literal)}(?!\\w)"))
    return true_only(F.contains(F.lower(raw), F.lit(literal.lower())) if ignore else F.contains(raw, F.lit(literal)))


def any_literal(raw: Column, literals: Sequence[str], case: str = "smart", whole_word: bool = False) -> Column:
    """Any of many literals, in one pass."""
    ignore = all(_ignore_case(x, case, False) for x in literals)
    body = "|".join(map(_escape, sorted(literals, key=len, reverse=True)))
    return true_only(raw.rlike(f"{'(?iu)' if ignore else ''}(?U)" + (rf"(?<!\w)(?:{body})(?!\w)" if whole_word else f"(?:{body})")))


def java_regex(pattern: str) -> str:
    """A pattern in the shared dialect (no look-around, no back-references) as a Java regex with numbered groups."""
    if re.search(r"\(\?(?:=|!|<=|<!)|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not allowed")
    return "(?U)" + re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)


def regex(raw: Column, pattern: str, case: str = "smart") -> Column:
    re.compile(pattern)
    return true_only(raw.rlike(("(?iu)" if _ignore_case(pattern, case, True) else "") + java_regex(pattern)))


def equals(c: Column, value: str, kind: str = "text", now: str | None = None) -> Column:
    """A cell equals a value by its kind: level by rank, quantities with units and a tolerance of 1e-9, instants, else text ignoring case; `*` is a wildcard."""
    same_text = F.lower(c) == value.lower()
    if "*" in value and kind != "level":
        same_text = c.rlike("(?ius)^" + ".*".join(map(_escape, value.split("*"))) + "$")
    if kind == "level":
        return true_only(F.coalesce(kinds.level_rank(c) == kinds.rank_of(value), same_text))
    if kind in ("number", "duration", "bytes"):
        return true_only(F.coalesce(_on_one_scale(c, value, lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))), same_text))
    if kind == "timestamp":
        return true_only(F.startswith(F.lower(c), F.lit(value.lower())) | (times.cell_instant(c) == times.cell_instant(F.lit(value))))
    return true_only(same_text)


def _on_one_scale(c: Column, value: str, test: Callable[[Column, Column], Column], mixed: bool | None = None) -> Column:
    """test of a cell and a value as numbers: a side without unit takes the other's family (ms or bytes). Null if a side is no quantity; mixed if the families differ."""
    v = kinds.quantity_of(value)
    if v is None:
        return F.lit(None).cast("boolean")
    plain, family, scaled = v

    def both(q: Column) -> Column:
        a = F.when(q["family"].isNull(), q["value"] * (1e6 if family == "duration" else 1.0)).otherwise(q["scaled"])
        b = F.lit(scaled) if family else F.when(q["family"] == "duration", F.lit(plain * 1e6)).otherwise(F.lit(plain))
        same = F.lit(family is None) | q["family"].isNull() | (q["family"] == F.lit(family))
        return F.when(q.isNotNull(), F.when(same, test(a, b)).otherwise(F.lit(mixed)))

    return kinds.let(kinds.quantity(c), both)


def compare(c: Column, op: str, value: str, kind: str = "text") -> Column:
    """<, <=, >, >=: levels by severity, quantities by value (a duration and a size never match), instants, else text ignoring case."""
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    as_text = ops(F.lower(c), F.lit(value.lower()))
    if kind == "level":
        return true_only(F.coalesce(ops(kinds.level_rank(c), kinds.rank_of(value)), as_text))
    if kind == "timestamp":
        return true_only(F.coalesce(ops(times.cell_instant(c), times.cell_instant(F.lit(value))), as_text))
    return true_only(F.coalesce(_on_one_scale(c, value, ops, mixed=False), as_text))


def one_of(c: Column, values: Sequence[str], kind: str = "text") -> Column:
    return any_of(*(equals(c, v, kind) for v in values))


def matches(c: Column, pattern: str) -> Column:
    """A regex found in a cell; case counts."""
    return true_only(c.rlike(java_regex(pattern)))


def time_range(ts: Column, lower: str | None = None, upper: str | None = None, now: str | None = None) -> Column:
    """lower <= ts <= upper. Bounds are instants, `-1h` before now, or for upper `+15m` after lower; they become literals, so they reach the scan."""

    def bound(b: str, base: str | None, sign: int) -> Column:
        if base is None:
            raise ValueError(f"{b!r} needs {'now' if sign < 0 else 'a lower bound'}")
        return F.timestamp_micros(F.unix_micros(F.lit(base).cast("timestamp")) + F.lit(int(sign * times.span_seconds(b[1:]) * 1e6)))

    lo = None if lower is None else bound(lower, now, -1) if lower[0] == "-" else F.lit(lower).cast("timestamp")
    hi = None if upper is None else bound(upper, now, -1) if upper[0] == "-" else F.timestamp_micros(F.unix_micros(lo) + int(times.span_seconds(upper[1:]) * 1e6)) if upper[0] == "+" and lo is not None else bound(upper, None, 1) if upper[0] == "+" else F.lit(upper).cast("timestamp")
    return all_of(*([ts >= lo] if lo is not None else []), *([ts <= hi] if hi is not None else []))


def extra(extra_col: Column, key: str) -> Column:
    """The value of a key outside the schema, ignoring case."""
    return F.get(F.map_values(F.map_filter(extra_col, lambda k, v: F.lower(k) == key.lower())), F.lit(0))


def rule_condition(c: Column, op: str, value: str) -> Column:
    """A rule's column condition: eq and ne compare numbers if both sides are numbers; gt, ge, lt and le read the leading number. A missing cell never matches, not even ne."""
    if op in ("gt", "ge", "lt", "le"):
        v = float(value)
        n = kinds.number(c, lenient=True)
        return true_only({"gt": n > v, "ge": n >= v, "lt": n < v, "le": n <= v}[op])
    if op in ("eq", "ne"):
        a, b = kinds.number(c), kinds.number(F.lit(value))
        same = F.coalesce(a == b, c == value)
        return true_only(same if op == "eq" else ~same)
    return text(c, value, "sensitive") if op == "contains" else matches(c, value)


def filter_stack(includes: Sequence[Column] = (), excludes: Sequence[Column] = ()) -> Column:
    """Passes all includes and no exclude."""
    return all_of(*includes, *(not_(p) for p in excludes))


@dataclass(frozen=True)
class Row:
    """A row of a filter stack: a literal or a pattern that lines must hold, or must not."""

    pattern: str
    kind: str = "literal"
    case: str = "smart"
    whole_word: bool = False
    exclude: bool = False
    enabled: bool = True


def build_stack(raw: Column, rows: Sequence[Row]) -> tuple[Column, dict[int, str]]:
    """The predicate of all rows that can be built, and why the others cannot, by their place. Disabled and empty rows are left out."""
    includes, excludes, wrong = [], [], {}
    for i, r in enumerate(rows):
        if not r.enabled or not r.pattern:
            continue
        try:
            p = text(raw, r.pattern, r.case, r.whole_word) if r.kind == "literal" else regex(raw, r.pattern, r.case)
        except (ValueError, re.error) as e:
            wrong[i] = str(e)
            continue
        (excludes if r.exclude else includes).append(p)
    return filter_stack(includes, excludes), wrong
