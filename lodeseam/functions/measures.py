"""Quality measures as column algebra over the statistics of covers.

A measure gives the quality of a cover and, where it can, an optimistic estimate no refinement exceeds.
Undefined is null. Operation order is part of a measure: ranks compare the unrounded doubles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseam.errors import ValidationError
from lodeseam.functions.scalars import chi2_tail_column
from lodeseam.operators.stats import Plan, order_name
from lodeseam.operators.targets import Constants, Target

ANY = ("binary", "numeric", "itemsets", "line")


def power(base: Column, a: float) -> Column:
    if a == 0:
        return F.when(base.isNotNull(), F.lit(1.0))
    return base if a == 1 else F.sqrt(base) if a == 0.5 else F.pow(base, F.lit(a))


class Measure:
    """`targets` it fits, `safe` if its estimate may prune, `whole` if it needs all statistics of the lattice.

    `reads` names the row measures its quality and estimate use, besides counts; None stands for all.
    """

    targets: tuple[str, ...] = ANY
    safe = False
    whole = False
    reads: tuple[str, ...] | None = None

    def plan(self, c: Constants) -> Plan:
        return Plan(c.mean or 0.0)

    def check(self, target: Target, c: Constants) -> None:
        if target.kind not in self.targets:
            raise ValidationError(f"{type(self).__name__} does not fit a target of kind {target.kind}")

    def quality(self, c: Constants) -> Column:
        raise NotImplementedError

    def estimate(self, c: Constants) -> Column | None:
        return None

    def of_empty(self, depth: int) -> float | None:
        """The quality of a cover without rows, if it has one."""
        return None


@dataclass(frozen=True)
class Standard(Measure):
    """(n/N)^a (p/n - P/N)."""

    a: float = 1.0
    targets = ("binary",)

    def __post_init__(self) -> None:
        if self.a < 0:
            raise ValidationError("the exponent must not be negative")

    @property
    def safe(self) -> bool:
        return self.a <= 1

    def quality(self, c: Constants) -> Column:
        return power(F.col("n") / F.lit(float(c.n)), self.a) * (F.try_divide(F.col("p"), F.col("n")) - F.lit(c.positives / c.n))

    def estimate(self, c: Constants) -> Column:
        return F.when(F.col("p") == 0, 0.0).otherwise(power(F.col("p") / F.lit(float(c.n)), self.a) * (1 - F.lit(c.positives / c.n)))

    def generalization_estimate(self, c: Constants) -> Column:
        return power((F.col("n") + c.positives - F.col("p")) / F.lit(float(c.n)), self.a) * (1 - F.lit(c.positives / c.n))


def wracc() -> Standard:
    return Standard(1.0)


def simple_binomial() -> Standard:
    return Standard(0.5)


def lift() -> Standard:
    return Standard(0.0)


@dataclass(frozen=True)
class ChiSquared(Measure):
    """The 2x2 statistic without correction, or its p-value; a direction makes the other side negative."""

    direction: str = "both"
    least: int = 5
    stat: str = "chi2"
    targets = ("binary",)

    def check(self, target: Target, c: Constants) -> None:
        super().check(target, c)
        if self.direction not in ("both", "positive", "negative") or self.stat not in ("chi2", "p_value"):
            raise ValidationError("direction is both, positive or negative; stat is chi2 or p_value")
        if not 0 < c.positives < c.n:
            raise ValidationError("the target must hold for some rows and not for others")

    def quality(self, c: Constants) -> Column:
        n, p, rows, P = F.col("n"), F.col("p"), F.lit(float(c.n)), F.lit(float(c.positives))
        cells = ((p, P * n / rows), (P - p, P * (rows - n) / rows), (n - p, (rows - P) * n / rows), (rows - n - (P - p), (rows - P) * (rows - n) / rows))
        total = F.lit(0.0)
        for seen, due in cells:
            total = total + F.try_divide((seen - due) * (seen - due), due)
        value = total if self.stat == "chi2" else chi2_tail_column(total)
        if self.direction != "both":
            more = F.try_divide(p, n) > P / rows if self.direction == "positive" else F.try_divide(p, n) < P / rows
            value = F.when(more, value).otherwise(-value)
        return F.when((n < self.least) | (rows - n < self.least) | (n == 0) | (n == rows), F.lit(-math.inf)).otherwise(value)


@dataclass(frozen=True)
class StandardNumeric(Measure):
    """n^a (mean - mean of all), on the negated number if `invert`; four estimates to choose from."""

    a: float = 1.0
    invert: bool = False
    estimator: str = "sum"
    targets = ("numeric",)

    @property
    def safe(self) -> bool:
        return self.a >= 0 and (self.estimator == "order" or self.a <= 1)

    @property
    def reads(self) -> tuple[str, ...]:
        return ("total",) + {"sum": ("excess",), "order": ()}.get(self.estimator, ("tail_n", "tail_max"))

    def plan(self, c: Constants) -> Plan:
        return Plan(c.mean or 0.0, -1 if self.invert else 1, frozenset({self.a} if self.estimator == "order" else ()))

    def check(self, target: Target, c: Constants) -> None:
        super().check(target, c)
        if self.estimator not in ("sum", "average", "max", "order"):
            raise ValidationError(f"no such estimator: {self.estimator!r}")

    def quality(self, c: Constants) -> Column:
        away = F.try_divide(F.col("total").cast("double"), F.col("n")) - F.lit(c.mean)
        return power(F.col("n").cast("double"), self.a) * (-away if self.invert else away)

    def estimate(self, c: Constants) -> Column:
        if self.estimator == "order":
            return F.coalesce(F.col(order_name(self.a)), F.lit(0.0))
        if self.estimator == "sum":
            return F.col("excess").cast("double")
        return F.when(F.col("tail_n") > 0, power(F.col("tail_n").cast("double"), self.a) * F.col("tail_max")).otherwise(0.0)


@dataclass(frozen=True)
class StandardMedian(Measure):
    """n^a (median - median of all)."""

    a: float = 1.0
    invert: bool = False
    estimator: str = "average"
    targets = ("numeric",)

    @property
    def safe(self) -> bool:
        return self.a >= 0

    def plan(self, c: Constants) -> Plan:
        return Plan(c.median or 0.0, -1 if self.invert else 1, median=True)

    def quality(self, c: Constants) -> Column:
        away = F.col("median") - F.lit(c.median)
        return power(F.col("n").cast("double"), self.a) * (-away if self.invert else away)

    def estimate(self, c: Constants) -> Column:
        return F.when((F.col("n") > 0) & (F.col("tail_n") > 0), power(F.col("n").cast("double"), self.a) * F.col("tail_max")).otherwise(0.0)


@dataclass(frozen=True)
class TScore(Measure):
    """sqrt(n) (mean - mean of all) / deviation of the cover; 0 where that is 0."""

    invert: bool = False
    targets = ("numeric",)

    def quality(self, c: Constants) -> Column:
        n = F.col("n").cast("double")
        mean = F.try_divide(F.col("total").cast("double"), n)
        centred = F.try_divide(F.col("total").cast("double"), n) - F.lit(c.mean)
        spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("squares").cast("double"), n) - centred * centred))
        away = (mean - F.lit(c.mean)) * (-1 if self.invert else 1)
        return F.when(n > 0, F.when(spread == 0, 0.0).otherwise(F.sqrt(n) * away / spread))


@dataclass(frozen=True)
class Count(Measure):
    safe = True

    def quality(self, c: Constants) -> Column:
        return F.col("n").cast("double")

    def estimate(self, c: Constants) -> Column:
        return F.col("n").cast("double")

    def of_empty(self, depth: int) -> float:
        return 0.0


@dataclass(frozen=True)
class Area(Measure):
    """n times the number of selectors; its estimate needs a bound on that number."""

    most: float = math.inf

    @property
    def safe(self) -> bool:
        return math.isfinite(self.most)

    def quality(self, c: Constants) -> Column:
        return (F.col("n") * F.size("items")).cast("double")

    def estimate(self, c: Constants) -> Column | None:
        return F.col("n") * F.lit(float(self.most)) if self.safe else None

    def of_empty(self, depth: int) -> float:
        return 0.0


@dataclass(frozen=True)
class Likelihood(Measure):
    """Mean density of the line's residuals inside the cover minus outside."""

    targets = ("line",)

    def quality(self, c: Constants) -> Column:
        return F.col("likelihood_sg") - F.col("likelihood_complement")


@dataclass(frozen=True)
class Combined(Measure):
    """A weighted sum of measures of one kind of target."""

    parts: tuple[tuple[Measure, float], ...] = field(default_factory=tuple)

    def check(self, target: Target, c: Constants) -> None:
        if not self.parts:
            raise ValidationError("a combination needs a measure")
        for m, _ in self.parts:
            m.check(target, c)
            if m.whole:
                raise ValidationError("a combination takes measures of single covers only")
        plans = {m.plan(c) for m, _ in self.parts}
        if target.kind == "numeric" and len({(p.centre, p.sign) for p in plans}) > 1 and self.safe:
            raise ValidationError("combined measures of a number must share centre and direction")

    def plan(self, c: Constants) -> Plan:
        plans = [m.plan(c) for m, _ in self.parts]
        return Plan(plans[0].centre, plans[0].sign, frozenset().union(*(p.orders for p in plans)), any(p.median for p in plans))

    @property
    def safe(self) -> bool:
        return all(m.safe and w >= 0 for m, w in self.parts)

    def quality(self, c: Constants) -> Column:
        total = F.lit(0.0)
        for m, w in self.parts:
            total = total + F.lit(float(w)) * m.quality(c)
        return total

    def estimate(self, c: Constants) -> Column | None:
        total = F.lit(0.0)
        for m, w in self.parts:
            one = m.estimate(c)
            if one is None:
                return None
            total = total + F.lit(float(w)) * one
        return total

    def of_empty(self, depth: int) -> float | None:
        found = [(m.of_empty(depth), w) for m, w in self.parts]
        return None if any(q is None for q, _ in found) else sum(q * w for q, w in found)


def combined(*parts: Measure | tuple[Measure, float]) -> Combined:
    return Combined(tuple(p if isinstance(p, tuple) else (p, 1.0) for p in parts))


@dataclass(frozen=True)
class GeneralizationAware(Measure):
    """The inner quality minus the best of all strict generalisations, 0 at least."""

    inner: Measure
    whole = True

    def check(self, target: Target, c: Constants) -> None:
        if self.inner.whole:
            raise ValidationError("the inner measure must be one of single covers")
        self.inner.check(target, c)

    def plan(self, c: Constants) -> Plan:
        return self.inner.plan(c)


@dataclass(frozen=True)
class GaStandard(Measure):
    """(n/N)^a (p/n - reference share): the highest share of all generalisations ("difference"), or that of
    the best generalisation carried upwards ("max")."""

    a: float = 1.0
    strategy: str = "difference"
    targets = ("binary",)
    whole = True

    def check(self, target: Target, c: Constants) -> None:
        super().check(target, c)
        if self.strategy not in ("difference", "max"):
            raise ValidationError("the strategy is difference or max")


@dataclass(frozen=True)
class GaStandardNumeric(Measure):
    """(n/N)^a (centre - centre of the generalisation whose branch reaches highest); centre is mean or median."""

    a: float = 1.0
    median: bool = False
    targets = ("numeric",)
    whole = True

    def plan(self, c: Constants) -> Plan:
        return Plan(c.mean or 0.0, median=self.median)


@dataclass(frozen=True)
class Custom(Measure):
    """A measure given as functions from the constants to a column over the statistics."""

    of: Callable[[Constants], Column]
    bound: Callable[[Constants], Column] | None = None
    targets: Sequence[str] = ANY
    safe: bool = False
    reads = None

    def quality(self, c: Constants) -> Column:
        return self.of(c)

    def estimate(self, c: Constants) -> Column | None:
        return self.bound(c) if self.bound else None
