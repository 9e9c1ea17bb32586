"""A search task: what to explain, with which selectors, by which measure, under which constraints."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.errors import SearchSpaceError, ValidationError
from lodeseam.functions.measures import Measure
from lodeseam.functions.selectors import Conjunction, Description, Disjunction, Interval, Negated, Selector, canonical, kind_of
from lodeseam.operators.stats import Plan
from lodeseam.operators.targets import Constants, Target


@dataclass(frozen=True)
class Constraint:
    """A condition on a cover's statistics; `monotone` if a refinement of a failing cover fails too."""

    name: str
    holds: Callable[[Constants], Column]
    monotone: bool = False


def min_support(count: int | None = None, fraction: float | None = None) -> Constraint:
    """At least `count` rows, or that fraction of all, rounded up."""
    if (count is None) == (fraction is None):
        raise ValidationError("give either a count or a fraction")
    if fraction is not None and not 0 <= fraction <= 1:
        raise ValidationError("the fraction must be in 0 .. 1")
    return Constraint("min_support", lambda c: F.col("n") >= (count if count is not None else math.ceil(fraction * c.n)), True)


@dataclass(frozen=True)
class Task:
    """`k` best descriptions of at most `depth` selectors with a quality above `min_quality`."""

    df: DataFrame
    target: Target
    space: Sequence[Selector]
    measure: Measure
    k: int = 10
    depth: int = 3
    min_quality: float = -math.inf
    constraints: tuple[Constraint, ...] = ()
    progress: Callable[[dict], None] | None = None
    should_stop: Callable[[], bool] | None = None


@dataclass(frozen=True)
class Prepared:
    """A checked task: its selectors sorted, each known by its place, and the constants of its table."""

    task: Task
    selectors: tuple[Selector, ...]
    constants: Constants
    plan: Plan
    form: str = "conjunction"
    counters: dict = field(default_factory=dict)

    def description(self, items: Sequence[int]) -> Description:
        chosen = [self.selectors[i] for i in items]
        return Conjunction(chosen) if self.form == "conjunction" else Disjunction(chosen)

    def holds(self, monotone_only: bool = False) -> Column:
        out = F.lit(True)
        for c in self.task.constraints:
            if c.monotone or not monotone_only:
                out = out & F.coalesce(c.holds(self.constants), F.lit(False))
        return out


def _leaf(s: Selector) -> Selector:
    return _leaf(s.inner) if isinstance(s, Negated) else s


def prepare(task: Task, form: str = "conjunction") -> Prepared:
    """Check the task against its table and compute the table's constants (one job)."""
    for name, value in (("k", task.k), ("depth", task.depth)):
        if not isinstance(value, int) or value < 1:
            raise ValidationError(f"{name} must be a whole number of at least 1")
    if not task.space:
        raise SearchSpaceError("the search space is empty")
    selectors = canonical(list(task.space))
    for s in selectors:
        if kind_of(task.df.schema, s.attribute) != "numeric" and isinstance(_leaf(s), Interval):
            raise SearchSpaceError(f"an interval on {s.attribute!r}, which is not numeric")
    if leaks := {s.attribute for s in selectors} & set(task.target.attributes()):
        raise SearchSpaceError(f"the search space holds the target's attributes: {sorted(leaks)}")
    constants = task.target.prepare(task.df)
    task.measure.check(task.target, constants)
    return Prepared(task, selectors, constants, task.measure.plan(constants), form)
