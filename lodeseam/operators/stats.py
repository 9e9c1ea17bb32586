"""Statistics of covers: mergeable measures for the lattice, full tables for single descriptions.

Sums of numbers are taken in DECIMAL(38), so they do not depend on the order in which partitions meet and
equal covers get equal figures.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.functions.scalars import normal_density
from lodeseam.functions.selectors import Description
from lodeseam.operators.targets import Constants, Target

DIGITS = 38


@dataclass(frozen=True)
class Plan:
    """Which figures of a numeric target a measure reads: centre and direction of the excess, and extras.

    The median and the ordered bounds, one for each of the powers in `orders`, need all values of a cover.
    """

    centre: float = 0.0
    sign: int = 1
    orders: frozenset[float] = frozenset()
    median: bool = False

    @property
    def values(self) -> bool:
        return self.median or bool(self.orders)


def order_name(a: float) -> str:
    """The column of the ordered bound for the power `a`."""
    return f"order_bound_{a!r}".replace(".", "_").replace("-", "_")


def scale_of(constants: Constants) -> int:
    """Decimal places that leave room for the sum of squares of all rows."""
    widest = max(1.0, *(abs(x) for x in (constants.low, constants.high, constants.mean) if x is not None))
    whole = math.ceil(math.log10(max(1, constants.n)) + 2 * math.log10(2 * widest)) + 1
    return max(2, min(18, DIGITS - whole))


def row_measures(target: Target, constants: Constants, plan: Plan) -> dict[str, tuple[Column, str]]:
    """Of one row: measure name to its value and how values merge (sum or max)."""
    out = {"n": (F.lit(1).cast("long"), "sum")}
    if target.kind == "binary":
        out["p"] = (F.col("_y"), "sum")
    if target.kind == "numeric":
        exact = lambda c: c.cast(f"decimal({DIGITS},{scale_of(constants)})")
        over = F.lit(float(plan.sign)) * (F.col("_t") - F.lit(plan.centre))
        out |= {
            "total": (exact(F.col("_t")), "sum"), "squares": (exact((F.col("_t") - F.lit(constants.mean)) * (F.col("_t") - F.lit(constants.mean))), "sum"),
            "excess": (exact(F.greatest(over, F.lit(0.0))), "sum"), "tail_n": ((over > 0).cast("long"), "sum"), "tail_max": (F.when(over > 0, over), "max"),
        }
    if target.kind == "line":
        x, v = F.col("_x"), F.col("_v")
        out |= {"sx": (x, "sum"), "sy": (v, "sum"), "sxx": (x * x, "sum"), "sxy": (x * v, "sum"), "syy": (v * v, "sum")}
    return out


def merged(measures: dict[str, tuple[Column, str]]) -> list[Column]:
    """The same measures over rows that already hold them."""
    return [(F.max(name) if how == "max" else F.sum(name)).alias(name) for name, (_, how) in measures.items()]


def bucket_of(value: Column, edges: list[float]) -> Column:
    """How many of the ascending `edges` a value reaches."""
    return reduce(lambda a, e: a + (value >= F.lit(e)).cast("int"), edges, F.lit(0))


def from_values(counted: DataFrame, measures: dict[str, tuple[Column, str]], plan: Plan, edges: list[float]) -> DataFrame:
    """(items, measures..., median, ordered bounds) from the measures of every (items, _t).

    Values are ranked from the plan's better end. With `edges`, range by range: the ranges' totals carry ranks
    and sums into each range, so a task holds one range of one cover; without, a task sorts a cover. Equal
    values are one row. Between the first and the last of w equal values the ordered bound has at most one
    peak, which is tried too.
    """
    sign = F.lit(plan.sign)
    ranked = _ranked_by_range(counted, sign, edges) if edges else _ranked(counted, sign)
    last, first, value = F.col("_upto").cast("double"), (F.col("_upto") - F.col("n") + 1).cast("double"), sign * F.col("_t")
    out = []
    if plan.median:
        at = lambda place: F.max(F.when((place >= F.col("_upto") - F.col("n")) & (place < F.col("_upto")), F.col("_t")))
        out.append((0.5 * at(F.floor((F.col("_all") - 1) / 2)) + 0.5 * at(F.floor(F.col("_all") / 2))).alias("median"))
    for a in sorted(plan.orders):
        bound = lambda j: F.pow(j, F.lit(a)) * ((F.col("_runs") - value * (last - j)) / j - F.lit(plan.sign * plan.centre))  # noqa: B023, E731
        peak = F.coalesce(F.try_divide((1 - a) * (F.col("_runs") - value * last), a * (value - F.lit(plan.sign * plan.centre))), last)
        within = lambda j: F.least(last, F.greatest(first, j.cast("double")))
        out.append(F.max(F.greatest(*[bound(j) for j in (first, last, within(F.floor(peak)), within(F.ceil(peak)))])).alias(order_name(a)))
    return ranked.groupBy("items").agg(*merged(measures), *out)


def _ranked(counted: DataFrame, sign: Column) -> DataFrame:
    """`counted` with rank and sum up to each value, and the size of the cover."""
    upto = Window.partitionBy("items").orderBy(F.desc(sign * F.col("_t"))).rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumns({"_upto": F.sum("n").over(upto), "_runs": sign * F.sum("total").over(upto).cast("double"), "_all": F.sum("n").over(Window.partitionBy("items"))})


def _ranked_by_range(counted: DataFrame, sign: Column, edges: list[float]) -> DataFrame:
    """The same, sorted within ranges only."""
    ranged = counted.withColumn("_range", sign * bucket_of(F.col("_t"), edges))
    before = Window.partitionBy("items").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("items", "_range").agg(F.sum("n").alias("_n"), F.sum("total").alias("_sum"))
    carried = totals.select("items", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank"), F.sum("_sum").over(before).alias("_run"), F.sum("_n").over(Window.partitionBy("items")).alias("_all"))
    inside = Window.partitionBy("items", "_range").orderBy(F.desc(sign * F.col("_t"))).rowsBetween(Window.unboundedPreceding, 0)
    upto, run = F.col("_rank") + F.sum("n").over(inside), sign * (F.coalesce(F.col("_run"), F.lit(0)) + F.sum("total").over(inside)).cast("double")
    return ranged.join(carried, ["items", "_range"]).withColumns({"_upto": upto, "_runs": run})

def slope(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> Column:
    spread = n * sxx - sx * sx
    return F.when((n > 2) & (spread != 0), F.try_divide(n * sxy - sx * sy, spread))


def intercept(n: Column, sx: Column, sy: Column, fitted: Column) -> Column:
    return F.try_divide(sy - fitted * sx, n)


def share(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def binary_table(n: Column, N: Column, p: Column, P: Column) -> dict[str, Column]:
    """13 fields of a condition's cover; shares of nothing are null."""
    return {
        "size_sg": n, "size_dataset": N, "positives_sg": p, "positives_dataset": P, "size_complement": N - n, "relative_size_sg": share(n, N), "relative_size_complement": share(N - n, N),
        "coverage_sg": share(p, P), "coverage_complement": share(P - p, P), "target_share_sg": share(p, n), "target_share_complement": share(P - p, N - n), "target_share_dataset": share(P, N),
        "lift": F.try_divide(share(p, n), share(P, N)),
    }


def numeric_aggregates(inside: Column, t: Column) -> dict[str, Column]:
    """14 fields of a number's cover, as aggregates over all rows."""
    of = F.when(inside, t)
    out = {"size_sg": F.count_if(inside), "size_dataset": F.count(F.lit(1))}
    for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("median", F.median), ("max", F.max), ("min", F.min)):
        out |= {f"{name}_sg": f(of), f"{name}_dataset": f(t)}
    return out | {"mean_lift": F.try_divide(F.avg(of), F.avg(t)), "median_lift": F.try_divide(F.median(of), F.median(t))}


def describe(df: DataFrame, target: Target, description: Description) -> DataFrame:
    """One row: the full table of any description, in one pass (two for a line, which is fitted first)."""
    rows = df.select(description.column(df.schema).alias("_in"), *target.columns(df.schema))
    inside = F.col("_in")
    if target.kind == "binary":
        got = rows.agg(F.count_if(inside).alias("n"), F.count(F.lit(1)).alias("all_n"), F.coalesce(F.sum(F.when(inside, F.col("_y")).otherwise(0)), F.lit(0)).alias("p"), F.coalesce(F.sum("_y"), F.lit(0)).alias("all_p"))
        return got.select(*[c.alias(k) for k, c in binary_table(F.col("n"), F.col("all_n"), F.col("p"), F.col("all_p")).items()])
    if target.kind == "numeric":
        target.prepare(df)
        return rows.agg(*[c.alias(k) for k, c in numeric_aggregates(inside, F.col("_t")).items()])
    if target.kind == "line":
        return _describe_line(rows)
    return rows.agg(F.count_if(inside).alias("size_sg"), F.count(F.lit(1)).alias("size_dataset"))


def _describe_line(rows: DataFrame) -> DataFrame:
    """Slope and intercept of the cover, and the mean density of its residuals inside and outside."""
    x, v = F.when(F.col("_in"), F.col("_x")), F.when(F.col("_in"), F.col("_v"))
    sums = rows.agg(F.count_if("_in").alias("n"), F.sum(x).alias("sx"), F.sum(v).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * v).alias("sxy"))
    fit = sums.withColumn("slope", slope(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")])).withColumn("intercept", intercept(F.col("n"), F.col("sx"), F.col("sy"), F.col("slope")))
    fit = fit.select("slope", "intercept").first()  # two numbers
    lit = lambda x: F.lit(x).cast("double")
    density = normal_density(lit(fit.slope) * F.col("_x") + lit(fit.intercept) - F.col("_v"))
    return rows.agg(
        F.count_if("_in").alias("size_sg"), F.count(F.lit(1)).alias("size_dataset"), lit(fit.slope).alias("slope"), lit(fit.intercept).alias("intercept"),
        F.avg(F.when(F.col("_in"), density)).alias("likelihood_sg"), F.avg(F.when(~F.col("_in"), density)).alias("likelihood_complement"),
    )

