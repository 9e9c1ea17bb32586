"""Elementary predicates and their combinations, compiled to two-valued boolean columns.

A missing value satisfies no predicate but IsNull; a negation covers the attribute's present values outside
the inner cover. An equality of another type than its column covers nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.errors import ValidationError

Value = bool | float | int | str


def kind_of(schema: T.StructType, attribute: str) -> str:
    """boolean, numeric or categorical; an unknown name is an error that lists the known ones."""
    if attribute not in schema.names:
        raise ValidationError(f"no column {attribute!r}; there are {', '.join(schema.names)}")
    found = schema[attribute].dataType
    if isinstance(found, T.BooleanType):
        return "boolean"
    return "numeric" if isinstance(found, T.NumericType) else "categorical"


def value_kind(value: Value) -> str:
    return "boolean" if isinstance(value, bool) else "numeric" if isinstance(value, (int, float)) else "categorical"


class Selector:
    """A predicate on one attribute. Selectors are equal if they are the same predicate."""

    def key(self) -> tuple:
        """Sorts selectors: attribute, kind, operands; truth values before numbers before texts."""
        raise NotImplementedError

    def column(self, schema: T.StructType) -> Column:
        """True or false for every row, never null."""
        raise NotImplementedError

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Selector) and self.key() == other.key()

    def __hash__(self) -> int:
        return hash(self.key())

    def __lt__(self, other: Selector) -> bool:
        return self.key() < other.key()


@dataclass(frozen=True, eq=False)
class Equality(Selector):
    attribute: str
    value: Value
    whole: bool = False  # printed as a whole number

    def key(self) -> tuple:
        rank = {"boolean": 0, "numeric": 1, "categorical": 2}[value_kind(self.value)]
        return (self.attribute, 0, rank, self.value if rank == 2 else float(self.value))

    def column(self, schema: T.StructType) -> Column:
        if kind_of(schema, self.attribute) != value_kind(self.value):
            return F.lit(False)
        return F.coalesce(F.col(f"`{self.attribute}`") == F.lit(self.value), F.lit(False))


@dataclass(frozen=True, eq=False)
class IsNull(Selector):
    attribute: str

    def key(self) -> tuple:
        return (self.attribute, 1)

    def column(self, schema: T.StructType) -> Column:
        kind_of(schema, self.attribute)
        return F.col(f"`{self.attribute}`").isNull()


@dataclass(frozen=True, eq=False)
class Interval(Selector):
    """lo <= value < hi; either side may be infinite."""

    attribute: str
    lo: float = -math.inf
    hi: float = math.inf
    whole: bool = False

    def __post_init__(self) -> None:
        if not self.lo < self.hi:
            raise ValidationError(f"an interval needs lo < hi, not {self.lo} and {self.hi}")

    def key(self) -> tuple:
        return (self.attribute, 2, float(self.lo), float(self.hi))

    def column(self, schema: T.StructType) -> Column:
        if kind_of(schema, self.attribute) != "numeric":
            raise ValidationError(f"an interval needs a numeric column, not {self.attribute!r}")
        value = F.col(f"`{self.attribute}`")
        parts = [value.isNotNull()]
        parts += [value >= F.lit(self.lo)] if self.lo > -math.inf else []
        parts += [value < F.lit(self.hi)] if self.hi < math.inf else []
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


@dataclass(frozen=True, eq=False)
class Negated(Selector):
    inner: Selector

    @property
    def attribute(self) -> str:
        return self.inner.attribute

    def key(self) -> tuple:
        return (self.attribute, 3, self.inner.key())

    def column(self, schema: T.StructType) -> Column:
        return F.col(f"`{self.attribute}`").isNotNull() & ~self.inner.column(schema)


def equality(attribute: str, value: Value | None, whole: bool = False) -> Selector:
    """An equality; a missing value (None or NaN) makes it IsNull."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return IsNull(attribute)
    return Equality(attribute, value, whole)


def negated(selector: Selector) -> Selector:
    """The negation; two cancel out on a predicate that only covers present values."""
    if isinstance(selector, Negated) and not isinstance(selector.inner, IsNull):
        return selector.inner
    return Negated(selector)


def validity(attribute: str) -> Column:
    """Rows where the attribute is present."""
    return F.col(f"`{attribute}`").isNotNull()


def canonical(selectors: list[Selector] | tuple[Selector, ...]) -> tuple[Selector, ...]:
    """Sorted without repetition; places in this list are the numbers that searches use."""
    return tuple(sorted(set(selectors)))


class Description:
    """A set of rows given by selectors."""

    def column(self, schema: T.StructType) -> Column:
        raise NotImplementedError

    def covered(self, df: DataFrame) -> DataFrame:
        return df.where(self.column(df.schema))


class _Set(Description):
    def __init__(self, selectors: tuple[Selector, ...] | list[Selector] = ()) -> None:
        self.selectors = canonical(selectors)

    @property
    def depth(self) -> int:
        return len(self.selectors)

    def key(self) -> tuple:
        return tuple(s.key() for s in self.selectors)

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.key() == other.key()

    def __hash__(self) -> int:
        return hash((type(self).__name__, self.key()))


class Conjunction(_Set):
    """All selectors hold; the empty one covers every row."""

    def column(self, schema: T.StructType) -> Column:
        return reduce(lambda a, b: a & b, (s.column(schema) for s in self.selectors), F.lit(True))


class Disjunction(_Set):
    """Some selector holds; the empty one covers nothing."""

    def column(self, schema: T.StructType) -> Column:
        return reduce(lambda a, b: a | b, (s.column(schema) for s in self.selectors), F.lit(False))


@dataclass(frozen=True)
class DNF(Description):
    """Some conjunction holds."""

    conjunctions: tuple[Conjunction, ...]

    def column(self, schema: T.StructType) -> Column:
        return reduce(lambda a, b: a | b, (c.column(schema) for c in self.conjunctions), F.lit(False))
