"""Selectors and conjunctions as text, in a query form and a display form, and back."""

from __future__ import annotations

import math
import re

from lodeseam.errors import DialectError
from lodeseam.functions.selectors import Conjunction, Equality, Interval, IsNull, Negated, Selector

NUMBER = r"-?(?:\d+(?:\.\d*)?(?:e[-+]?\d+)?|inf)"


def _number(x: float, whole: bool, display: bool) -> str:
    if whole and float(x).is_integer():
        return str(int(x))
    if display and math.isfinite(x) and not float(x).is_integer():
        return format(x, ".2f")
    return repr(float(x))


def _value(s: Equality) -> str:
    if isinstance(s.value, bool):
        return str(s.value)
    if isinstance(s.value, str):
        return f"'{s.value}'"
    return _number(s.value, s.whole or isinstance(s.value, int), False)


def print_selector(s: Selector, form: str = "query") -> str:
    """`form` is query (exact bounds, `(not s)`) or display (two decimals, `NOT s`)."""
    display = form == "display"
    if isinstance(s, Equality):
        return f"{s.attribute}=={_value(s)}"
    if isinstance(s, IsNull):
        return f"{s.attribute}.isnull()"
    if isinstance(s, Interval):
        lo, hi = (_number(x, s.whole, display) for x in (s.lo, s.hi))
        if s.lo == -math.inf and s.hi == math.inf:
            return f"{s.attribute} = anything"
        if s.lo == -math.inf:
            return f"{s.attribute}<{hi}"
        return f"{s.attribute}>={lo}" if s.hi == math.inf else f"{s.attribute}: [{lo}:{hi}["
    if isinstance(s, Negated):
        inner = print_selector(s.inner, form)
        return f"NOT {inner}" if display else f"(not {inner})"
    raise DialectError(f"not a selector: {s!r}")


def print_conjunction(c: Conjunction, form: str = "query") -> str:
    """Parts sorted by their text; the empty conjunction is `True`, for display `Dataset`."""
    if not c.selectors:
        return "Dataset" if form == "display" else "True"
    parts = sorted(print_selector(s, form) for s in c.selectors)
    return (" AND " if form == "display" else " and ").join(parts)


def _whole(text: str) -> bool:
    return re.fullmatch(r"-?\d+", text) is not None


def parse_selector(text: str) -> Selector:
    """The selector of either form's text."""
    t = text.strip()
    if m := re.fullmatch(r"\(not (.*)\)", t, re.S) or re.fullmatch(r"NOT (.*)", t, re.S):
        return Negated(parse_selector(m[1]))
    if m := re.fullmatch(rf"(.+): \[({NUMBER}):({NUMBER})\[", t, re.S):
        return Interval(m[1], float(m[2]), float(m[3]), _whole(m[2]) and _whole(m[3]))
    if m := re.fullmatch(r"(.+?)==(.*)", t, re.S):
        raw = m[2]
        if raw in ("True", "False"):
            return Equality(m[1], raw == "True")
        if len(raw) > 1 and raw[0] == raw[-1] == "'":
            return Equality(m[1], raw[1:-1])
        if re.fullmatch(NUMBER, raw):
            return Equality(m[1], float(raw), _whole(raw))
    if m := re.fullmatch(rf"(.+?)>=({NUMBER})", t, re.S):
        return Interval(m[1], lo=float(m[2]), whole=_whole(m[2]))
    if m := re.fullmatch(rf"(.+?)<({NUMBER})", t, re.S):
        return Interval(m[1], hi=float(m[2]), whole=_whole(m[2]))
    if m := re.fullmatch(r"(.+) = anything", t, re.S):
        return Interval(m[1])
    if m := re.fullmatch(r"(.+)\.isnull\(\)", t, re.S):
        return IsNull(m[1])
    raise DialectError(f"not a selector: {text!r}")


def parse_conjunction(text: str) -> Conjunction:
    """The conjunction of either form's text; quoted values may hold the joining word."""
    t = text.strip()
    if t in ("True", "Dataset"):
        return Conjunction(())
    parts = re.split(r" (?:and|AND) (?=(?:[^']*'[^']*')*[^']*$)", t)
    return Conjunction([parse_selector(p) for p in parts])
