"""Measures that compare a set with its generalisations: joins of the lattice with itself, level by level."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.functions.measures import GaStandard, GaStandardNumeric, GeneralizationAware, power
from lodeseam.operators.lattice import Lattice
from lodeseam.plans.task import Prepared


def with_generalizations(lattice: Lattice, depth: int) -> DataFrame:
    """Statistics of all sets with `quality` (and `estimate` where there is one)."""
    p, m = lattice.p, lattice.p.task.measure
    stats = lattice.all_statistics(depth).persist()
    try:
        if isinstance(m, GeneralizationAware):
            return _aware(p, m, stats, lattice, depth)
        if isinstance(m, GaStandard):
            return _difference(p, m, stats, depth) if m.strategy == "difference" else _carried(p, m, stats, depth)
        if isinstance(m, GaStandardNumeric):
            return _centres(p, m, stats, lattice, depth)
        raise TypeError(type(m))
    finally:
        p.counters.setdefault("persisted", []).append(stats)


def _below(level: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """Each set of `level` with each of its immediate generalisations' `columns`; at is the place left out."""
    out = level.select("items", F.explode(F.sequence(F.lit(0), F.size("items") - 1)).alias("at"))
    out = out.withColumn("up", F.concat(F.slice("items", F.lit(1), F.col("at")), F.slice("items", F.col("at") + 2, F.size("items"))))
    return out.join(known.select(F.col("items").alias("up"), *columns), "up")


def _levels(stats: DataFrame, depth: int, top: DataFrame, columns: list[str], reduce: list[Column], finish) -> DataFrame:
    """Carry `columns` from level to level: reduce over the generalisations, then finish with own statistics."""
    known, out = top, None
    for d in range(1, depth + 1):
        level = stats.where(F.size("items") == d)
        carried = _below(level, known, columns).groupBy("items").agg(*reduce)
        known = finish(level.join(carried, "items"))
        out = known if out is None else out.unionByName(known)
    return out


def _top(stats: DataFrame, **values: Column) -> DataFrame:
    empty = stats.sparkSession.range(1).select(F.array().cast("array<int>").alias("items"))
    return empty.select("items", *[v.alias(k) for k, v in values.items()])


def _aware(p: Prepared, m: GeneralizationAware, stats: DataFrame, lattice: Lattice, depth: int) -> DataFrame:
    scored = stats.withColumn("own", m.inner.quality(p.constants))
    highest = F.coalesce(F.max(F.greatest("own", "best")), F.lit(0.0)).alias("best")
    finish = lambda df: df.withColumn("best", F.greatest("best", F.lit(0.0))).withColumn("quality", F.col("own") - F.col("best"))
    top = lattice.whole().select("items", m.inner.quality(p.constants).alias("own"), F.lit(0.0).alias("best"))
    return _levels(scored, depth, top, ["own", "best"], [highest], finish)


def _difference(p: Prepared, m: GaStandard, stats: DataFrame, depth: int) -> DataFrame:
    c = p.constants
    top = _top(stats, n=F.lit(c.n).cast("long"), p=F.lit(c.positives).cast("long"), high=F.lit(c.positives / c.n), gap=F.lit(math.inf))
    reduce = [F.max(F.greatest(F.try_divide("p", "n"), "high")).alias("high"), F.min(F.col("n") - F.col("p")).alias("least"), F.min("gap").alias("above")]

    def finish(df: DataFrame) -> DataFrame:
        gap = F.least((F.col("least") - (F.col("n") - F.col("p"))).cast("double"), F.col("above"))
        df = df.withColumn("gap", gap).withColumn("quality", power(F.col("n") / F.lit(float(c.n)), m.a) * (F.try_divide("p", "n") - F.col("high")))
        if m.a == 0:
            pos = F.lit(1.0)
        elif m.a == 1:
            pos = F.col("p").cast("double")
        else:
            pos = F.least(F.ceil(F.lit(m.a) * F.col("gap") / (1 - m.a)).cast("double"), F.col("p").cast("double"))
        tau = F.greatest(F.coalesce(F.try_divide(pos, pos + F.col("gap")), F.lit(-1.0)), F.coalesce(F.try_divide("p", "n"), F.lit(-1.0)), F.col("high"))
        bound = F.when(F.col("gap") == math.inf, F.lit(math.inf)).otherwise(power(F.col("p") / F.lit(float(c.n)), m.a) * (1 - tau))
        return df.withColumn("estimate", bound).drop("least", "above")

    return _levels(stats, depth, top, ["n", "p", "high", "gap"], reduce, finish)


def _carried(p: Prepared, m: GaStandard, stats: DataFrame, depth: int) -> DataFrame:
    c = p.constants
    top = _top(stats, n=F.lit(c.n).cast("long"), p=F.lit(c.positives).cast("long"), an=F.lit(c.n).cast("long"), ap=F.lit(c.positives).cast("long"))
    own = F.struct(F.try_divide("p", "n").alias("share"), F.col("at").alias("at"), F.lit(1).alias("first"), F.col("n").alias("an"), F.col("p").alias("ap"))
    carried = F.struct(F.try_divide("ap", "an").alias("share"), F.col("at").alias("at"), F.lit(0).alias("first"), F.col("an").alias("an"), F.col("ap").alias("ap"))
    reduce = [F.max(F.greatest(own, carried)).alias("ref")]

    def finish(df: DataFrame) -> DataFrame:
        df = df.withColumn("an", F.col("ref.an")).withColumn("ap", F.col("ref.ap")).drop("ref")
        ref = F.try_divide("ap", "an")
        df = df.withColumn("quality", power(F.col("n") / F.lit(float(c.n)), m.a) * (F.try_divide("p", "n") - ref))
        return df.withColumn("estimate", power(F.col("p") / F.lit(float(c.n)), m.a) * (1 - ref))

    return _levels(stats, depth, top, ["n", "p", "an", "ap"], reduce, finish)


def _centres(p: Prepared, m: GaStandardNumeric, stats: DataFrame, lattice: Lattice, depth: int) -> DataFrame:
    c = p.constants
    centre = F.col("median") if m.median else F.try_divide(F.col("total").cast("double"), F.col("n"))
    stats = stats.withColumn("centre", centre)
    start = c.median if m.median else c.mean
    top = _top(stats, centre=F.lit(start), ref=F.lit(start))
    best = F.max(F.struct(F.greatest("ref", "centre").alias("reach"), F.col("at").alias("at"), F.col("centre").alias("centre"))).alias("won")

    def finish(df: DataFrame) -> DataFrame:
        df = df.withColumn("ref", F.col("won.centre")).drop("won")
        return df.withColumn("quality", power(F.col("n") / F.lit(float(c.n)), m.a) * (F.col("centre") - F.col("ref")))

    return _levels(stats, depth, top, ["centre", "ref"], [best], finish)
