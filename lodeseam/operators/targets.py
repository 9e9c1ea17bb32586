"""What a search explains: a condition, a number, nothing, or a straight-line model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.errors import ValidationError
from lodeseam.functions.selectors import Selector, equality, kind_of


@dataclass(frozen=True)
class Constants:
    """Figures of the whole table that measures use as literals."""

    n: int
    positives: int = 0
    mean: float | None = None
    median: float | None = None
    std: float | None = None
    low: float | None = None
    high: float | None = None


#: Bins of one pass, and how many values of a group's bins come to the driver.
MEDIAN_BINS, MEDIAN_VALUES = 1_024, 512


def medians(rows: DataFrame, bounds: list[tuple[int, float | None, float | None]]) -> list[float | None]:
    """Exact medians of the groups 0 .. of `rows` (i, _t), whose sizes, least and greatest values are `bounds`.

    Each pass counts the values of every group in bins between its bounds and narrows the bounds to the bin
    that holds the middle, until that holds few values (which are then sorted) or one. So no task and not the
    driver ever holds a group, and only counts move. The two middle values of an even group are sought apart.
    """
    found: dict[tuple[int, int], float] = {}
    seek = {}  # (group, rank) to (least, greatest, values below, values inside)
    for i, (n, low, high) in enumerate(bounds):
        for rank in {(n - 1) // 2, n // 2} if n else ():
            seek[i, rank] = (float(low), float(high), 0, n)
    while seek:
        for key, (low, high, _, _) in list(seek.items()):
            if low == high:
                found[key] = low
                del seek[key]
        spans = sorted({(i, low, high, below, inside) for (i, _), (low, high, below, inside) in seek.items()})
        if not spans:
            break
        number = {(i, low, high): k for k, (i, low, high, _, _) in enumerate(spans)}
        of = [[k for k, s in enumerate(spans) if s[0] == i] for i in range(len(bounds))]
        spread = F.explode(F.get(F.array(*[F.array(*map(F.lit, x)).cast("array<int>") for x in of]), F.col("i"))).alias("k")
        at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("k"))
        inside = rows.select(spread, "_t").select("k", "_t", at([s[1] for s in spans]).alias("low"), at([s[2] for s in spans]).alias("high")).where("_t between low and high")
        if sum(s[4] for s in spans) <= MEDIAN_VALUES * len(spans):
            values: dict[int, list[float]] = {}
            for k, v in inside.select("k", "_t").collect():  # at most MEDIAN_VALUES of each
                values.setdefault(k, []).append(v)
            for (i, rank), (low, high, below, _) in seek.items():
                found[i, rank] = sorted(values[number[i, low, high]])[rank - below]
            break
        bin_ = F.least(F.lit(MEDIAN_BINS - 1), F.floor((F.col("_t") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * MEDIAN_BINS))
        counted = inside.groupBy("k", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("low"), F.max("_t").alias("high")).orderBy("k", "bin").collect()  # MEDIAN_BINS rows each
        for key, (low, high, below, _) in list(seek.items()):
            for r in (r for r in counted if r.k == number[key[0], low, high]):
                if key[1] < below + r.n:
                    seek[key] = (r.low, r.high, below, r.n)
                    break
                below += r.n
    return [0.5 * found[i, (n - 1) // 2] + 0.5 * found[i, n // 2] if n else None for i, (n, _, _) in enumerate(bounds)]


class Target:
    kind = ""

    def attributes(self) -> tuple[str, ...]:
        """Attributes that must stay out of the search space."""
        return ()

    def columns(self, schema: T.StructType) -> list[Column]:
        """The row's contribution."""
        return []

    def prepare(self, df: DataFrame) -> Constants:
        return Constants(df.count())


@dataclass(frozen=True)
class Binary(Target):
    selector: Selector
    kind = "binary"

    def attributes(self) -> tuple[str, ...]:
        return (self.selector.attribute,)

    def columns(self, schema: T.StructType) -> list[Column]:
        return [self.selector.column(schema).cast("long").alias("_y")]

    def prepare(self, df: DataFrame) -> Constants:
        n, p = df.agg(F.count(F.lit(1)), F.sum(self.selector.column(df.schema).cast("long"))).first()
        return Constants(n, p or 0)


def binary(attribute: str, value: object) -> Binary:
    return Binary(equality(attribute, value))


def _usable(df: DataFrame, names: tuple[str, ...]) -> None:
    for name in names:
        if kind_of(df.schema, name) != "numeric":
            raise ValidationError(f"the target {name!r} must be numeric")
    bad = df.agg(*[F.count_if(F.col(f"`{n}`").isNull() | F.isnan(F.col(f"`{n}`").cast("double")) | (F.abs(F.col(f"`{n}`").cast("double")) == float("inf"))) for n in names]).first()
    for name, count in zip(names, bad, strict=True):
        if count:
            raise ValidationError(f"the target {name!r} lacks a finite value in {count} rows")


@dataclass(frozen=True)
class Numeric(Target):
    attribute: str
    kind = "numeric"

    def attributes(self) -> tuple[str, ...]:
        return (self.attribute,)

    def columns(self, schema: T.StructType) -> list[Column]:
        return [F.col(f"`{self.attribute}`").cast("double").alias("_t")]

    def prepare(self, df: DataFrame) -> Constants:
        _usable(df, (self.attribute,))
        t = F.col(f"`{self.attribute}`").cast("double")
        n, mean, std, low, high = df.agg(F.count(F.lit(1)), F.avg(t), F.stddev_pop(t), F.min(t), F.max(t)).first()
        median = medians(df.select(F.lit(0).alias("i"), t.alias("_t")), [(n, low, high)])[0]
        return Constants(n, 0, mean, median, std, low, high)


@dataclass(frozen=True)
class Itemsets(Target):
    kind = "itemsets"


@dataclass(frozen=True)
class Line(Target):
    """y as a straight line of x."""

    x: str
    y: str
    degree: int = 1
    kind = "line"

    def attributes(self) -> tuple[str, ...]:
        return (self.x, self.y)

    def columns(self, schema: T.StructType) -> list[Column]:
        return [F.col(f"`{self.x}`").cast("double").alias("_x"), F.col(f"`{self.y}`").cast("double").alias("_v")]

    def prepare(self, df: DataFrame) -> Constants:
        if self.degree != 1:
            raise ValidationError("only straight lines are supported")
        _usable(df, (self.x, self.y))
        return Constants(df.count())
