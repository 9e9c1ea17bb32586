"""The lattice of selector sets as DataFrames.

Every row becomes the ascending array of the selectors it satisfies. Rows with the same array are one
pattern (unless a measure needs all values of a cover), so the lattice is searched over distinct patterns:
its cost follows their number, not the table's. A level's statistics are one aggregation over patterns
unfolded into the level's subsets; map-side partial aggregation keeps the shuffle at one row per subset and
task. Nothing but survivors' bounds ever comes to the driver.

Over many selectors nearly every row is a pattern of its own, and unfolding it into pairs is the cost. There,
pairs and beam extensions are matrix products of the 0/1 row-by-selector matrix, taken Arrow batch by Arrow
batch and summed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.functions.scalars import normal_density
from lodeseam.functions.selectors import Equality, Selector, kind_of, value_kind
from lodeseam.operators.stats import from_values, intercept, merged, row_measures, slope
from lodeseam.plans.task import Prepared


def selector_groups(p: Prepared) -> tuple[list[list[int]], list[int]]:
    """The selectors as runs of equalities that one value of an attribute decides, and all others."""
    schema, runs, others, i = p.task.df.schema, [], [], 0
    while i < len(p.selectors):
        same = [i]
        while isinstance(p.selectors[i], Equality) and same[-1] + 1 < len(p.selectors) and _alike(p.selectors[i], p.selectors[same[-1] + 1]):
            same.append(same[-1] + 1)
        if len(same) > 2 and kind_of(schema, p.selectors[i].attribute) == value_kind(p.selectors[i].value):
            runs.append(same)
        else:
            others += same
        i = same[-1] + 1
    return runs, others


def item_array(p: Prepared) -> Column:
    """Ascending numbers of the selectors a row satisfies.

    The equalities of one attribute are neighbours and exclude each other, so several of them are one lookup.
    """
    schema, (runs, others) = p.task.df.schema, selector_groups(p)
    flags = []
    for same in sorted([*runs, *([j] for j in others)]):
        i = same[0]
        if len(same) > 2:
            key = F.lit(p.selectors[i].value) if value_kind(p.selectors[i].value) != "numeric" else None
            value = lambda j: F.lit(p.selectors[j].value) if key is not None else F.lit(float(p.selectors[j].value))
            given = F.col(f"`{p.selectors[i].attribute}`") if key is not None else F.col(f"`{p.selectors[i].attribute}`").cast("double")
            table = F.create_map(*[x for j in same for x in (value(j), F.lit(j))])
            flags.append(F.when(given.isNotNull(), F.element_at(table, given)))
        else:
            flags += [F.when(p.selectors[j].column(schema), F.lit(j)) for j in same]
    chunks = [F.array_compact(F.array(*flags[i : i + 64])) for i in range(0, len(flags), 64)]
    return F.concat(*chunks) if len(chunks) > 1 else chunks[0]


def _alike(a: Selector, b: Selector) -> bool:
    return isinstance(b, Equality) and a.attribute == b.attribute and value_kind(a.value) == value_kind(b.value)


#: From this many selectors on, pairs and extensions are matrix products; up to the second, so their matrix fits.
WIDE, WIDEST = 128, 2_048
#: Ranges into which the values of a cover are cut where all of them are ranked, in tables of more rows than the second.
RANGES, RANKED_AT_ONCE = 32, 5_000_000


class Lattice:
    """The patterns of a prepared task and the statistics of its subsets."""

    def __init__(self, p: Prepared) -> None:
        self.p = p
        self.measures = row_measures(p.task.target, p.constants, p.plan)
        self.by_value = p.plan.values
        sums_only = all(how == "sum" for _, how in self.measures.values())
        self.wide = WIDE <= len(p.selectors) <= WIDEST and not self.by_value and p.task.target.kind != "line"
        self.pairs_as_product = self.wide and sums_only
        rows = p.task.df.select(item_array(p).alias("items"), *p.task.target.columns(p.task.df.schema))
        if self.wide:
            self.rows = rows.select("items", *[c.alias(n) for n, (c, _) in self.measures.items()])
        else:
            aggregated = [(F.max(c) if how == "max" else F.sum(c)).alias(n) for n, (c, how) in self.measures.items()]
            self.rows = rows.groupBy("items", *(["_t"] if self.by_value else [])).agg(*aggregated)
        in_ranges = self.by_value and p.constants.n > RANKED_AT_ONCE
        self.edges = sorted(set(rows.approxQuantile("_t", [i / RANGES for i in range(1, RANGES)], 0.005))) if in_ranges else []
        if not self.wide:  # there the table itself is read, column by column, for each product
            self.rows = self.rows.persist()
        self.kept = [c for c in self.rows.columns if c != "items"]

    def close(self) -> None:
        if not self.wide:
            self.rows.unpersist()

    def unfolded(self) -> DataFrame:
        """(t, rest, ...): the empty subset of every pattern."""
        return self.rows.select(F.array().cast("array<int>").alias("t"), F.col("items").alias("rest"), *self.kept)

    def deeper(self, level: DataFrame) -> DataFrame:
        """Each subset with each later selector of its pattern added."""
        step = level.select("t", "rest", *self.kept, F.posexplode("rest").alias("at", "e"))
        return step.select(F.concat("t", F.array("e")).alias("t"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), *self.kept)

    def statistics(self, level: DataFrame) -> DataFrame:
        """(items, measures...) of every subset in `level`."""
        if not self.by_value:
            return level.groupBy(F.col("t").alias("items")).agg(*merged(self.measures))
        return from_values(level.groupBy(F.col("t").alias("items"), "_t").agg(*merged(self.measures)), self.measures, self.p.plan, self.edges)

    def levels(self, depth: int) -> DataFrame:
        """The subsets of 1 .. depth selectors of every pattern."""
        level = self.deeper(self.unfolded())
        union = level
        for _ in range(1, depth):
            level = self.deeper(level)
            union = union.union(level)
        return union

    def all_statistics(self, depth: int) -> DataFrame:
        """Statistics of every non-empty-cover subset of 1 .. depth selectors, in one aggregation."""
        return self.statistics(self.levels(depth))

    def products(self, parents: list[tuple[int, ...]] | None) -> DataFrame:
        """Statistics of every pair and single (no parents), or of every parent with one selector added.

        Sums only; a maximum is null here. Counts are exact; sums of numbers are taken in doubles inside a
        task and exactly between tasks. A child of several parents comes from the first of them.
        """
        size, schema, reads = len(self.p.selectors), self.p.task.df.schema, self.p.task.measure.reads
        sums = [n for n, (_, how) in self.measures.items() if how == "sum" and (reads is None or n in ("n", "p", *reads))]
        whole = [n for n in sums if n in ("n", "p", "tail_n")]
        real = [n for n in sums if n not in whole]
        runs, others = selector_groups(self.p)
        texts = [value_kind(self.p.selectors[same[0]].value) != "numeric" for same in runs]
        values = [[self.p.selectors[j].value if t else float(self.p.selectors[j].value) for j in same] for same, t in zip(runs, texts, strict=True)]
        own = [F.col(f"`{self.p.selectors[same[0]].attribute}`") if t else F.col(f"`{self.p.selectors[same[0]].attribute}`").cast("double") for same, t in zip(runs, texts, strict=True)]
        given = [*own, *(self.p.selectors[j].column(schema) for j in others)]
        n_given = len(given)
        rows = self.p.task.df.select(*[c.alias(f"_g{k}") for k, c in enumerate(given)], *self.p.task.target.columns(schema))
        rows = rows.select(*[f"_g{k}" for k in range(n_given)], *[self.measures[n][0].cast("double").alias(n) for n in [*whole, *real]])
        first, keep = (None, np.triu(np.ones((size, size), bool))) if parents is None else ([list(t) for t in parents], _owned(parents, size))

        def matrix(batch: pa.RecordBatch) -> np.ndarray:
            """The 0/1 rows by selectors."""
            at = np.arange(batch.num_rows)
            x = np.zeros((batch.num_rows, size + 1), np.float64 if real else np.float32)
            for k, same in enumerate(runs):
                place = pc.index_in(batch.column(k), value_set=pa.array(values[k], batch.column(k).type)).fill_null(len(same))
                x[at, np.array([*same, size])[place.to_numpy(zero_copy_only=False)]] = 1
            for k, j in enumerate(others, len(runs)):
                x[:, j] = batch.column(k).to_numpy(zero_copy_only=False)
            return x[:, :size]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = None
            for batch in batches:
                weights = [batch.column(n_given + k).to_numpy(zero_copy_only=False) for k in range(len(sums))]
                x = matrix(batch)
                left = x if first is None else np.stack([x[:, t].all(axis=1) if t else np.ones(len(x), bool) for t in first], axis=1).astype(x.dtype)
                got = []
                for name, w in zip([*whole, *real], weights, strict=True):
                    some = slice(None) if name == "n" else np.flatnonzero(w)
                    own = left[some] if name in ("n", "p", "tail_n") else left[some] * w[some, None].astype(x.dtype)
                    got.append((own.T @ x[some]).astype(np.float64))
                done = got if done is None else [a + b for a, b in zip(done, got, strict=True)]
            if done is not None:
                a, b = np.nonzero((done[0] > 0) & keep)
                if first is None:
                    items = [[i] if i == j else [i, j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                else:
                    items = [sorted([*first[i], j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.int32())), *(pa.array(t[a, b]) for t in done)], ["items", *whole, *real])

        made = rows.mapInArrow(run, "items array<int>, " + ", ".join(f"{n} double" for n in [*whole, *real]))
        out = made.groupBy("items").agg(*[F.sum(F.col(n).cast("long")).alias(n) for n in whole], *[F.sum(F.col(n).cast("decimal(38,15)")).alias(n) for n in real])
        types = {n: "decimal(38,15)" if n in real else "long" for n in sums}
        return out.select("items", *[F.col(n) if n in types else F.lit(None).cast("double").alias(n) for n in self.measures])

    def extensions(self, parents: list[tuple[int, ...]]) -> DataFrame:
        """Statistics of every parent with one selector added, anywhere; each row counts once per child."""
        if self.wide:
            return self.products(parents)
        known = F.array(*[F.array(*[F.lit(i) for i in t]).cast("array<int>") for t in parents])
        held = F.filter(known, lambda t: F.size(F.array_except(t, "items")) == 0)
        children = F.flatten(F.transform(held, lambda t: F.transform(F.array_except("items", t), lambda e: F.array_sort(F.concat(t, F.array(e))))))
        rows = self.rows.select(F.explode(F.array_distinct(children)).alias("t"), *self.kept)
        return self.statistics(rows)

    def whole(self) -> DataFrame:
        """Statistics of the table itself, as the subset without selectors."""
        return self.statistics(self.unfolded())

    def candidates(self, depth: int) -> DataFrame:
        """(items) of every set of 1 .. depth selectors, whatever its cover."""
        spark = self.p.task.df.sparkSession
        n = len(self.p.selectors)
        level = spark.range(n).select(F.array(F.col("id").cast("int")).alias("items"))
        out = level
        for _ in range(1, depth):
            later = F.explode(F.sequence(F.element_at("items", -1) + 1, F.lit(n - 1)))
            level = level.where(F.element_at("items", -1) < n - 1).select("items", later.alias("e")).select(F.concat("items", F.array("e")).alias("items"))
            out = out.union(level)
        return out

    def union_statistics(self, depth: int) -> DataFrame:
        """Statistics of every set's union of covers.

        Sums by inclusion and exclusion over the statistics of its subsets, maxima over its members; where
        all values of a cover are needed, so for every value.
        """
        sets, value = self.candidates(depth), ["_t"] if self.by_value else []
        stats = self.levels(depth).groupBy(F.col("t").alias("items"), *value).agg(*merged(self.measures))
        subsets = F.transform(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("items")).cast("int") - 1), _chosen)
        parts = sets.select("items", F.explode(subsets).alias("s")).withColumn("sign", F.when(F.size("s") % 2 == 1, 1).otherwise(-1))
        joined = parts.join(stats.withColumnRenamed("items", "s"), "s")
        mixed = [(F.max(F.when(F.size("s") == 1, F.col(n))) if how == "max" else F.sum(F.when(F.col("sign") > 0, F.col(n)).otherwise(-F.col(n)))).alias(n) for n, (_, how) in self.measures.items()]
        unions = joined.groupBy("items", *value).agg(*mixed)
        return from_values(unions, self.measures, self.p.plan, self.edges) if self.by_value else unions

    def likelihoods(self, stats: DataFrame) -> DataFrame:
        """`stats` with slope, intercept and the mean residual density inside and outside each cover.

        Every candidate has a line of its own, so each meets every distinct point once for the density of the
        whole table; that of a cover comes from its own points only. Candidates that fail a monotone
        constraint get none.
        """
        fitted = slope(F.col("n"), *[F.col(c) for c in ("sx", "sy", "sxx", "sxy")])
        lines = stats.withColumn("slope", fitted).withColumn("intercept", intercept(F.col("n"), F.col("sx"), F.col("sy"), F.col("slope")))
        p = self.p
        points = p.task.df.select(item_array(p).alias("items"), *p.task.target.columns(p.task.df.schema)).groupBy("items", "_x", "_v").agg(F.count(F.lit(1)).alias("w"))
        density = normal_density(F.col("slope") * F.col("_x") + F.col("intercept") - F.col("_v")) * F.col("w")
        lit = lines.where(F.col("slope").isNotNull() & p.holds(True)).select(F.col("items").alias("c"), "slope", "intercept")
        if p.form == "conjunction":
            everywhere = points.groupBy("_x", "_v").agg(F.sum("w").alias("w")).join(lit, F.lit(True)).groupBy("c").agg(F.sum(density).alias("whole"))
            level = points.select(F.array().cast("array<int>").alias("t"), F.col("items").alias("rest"), "_x", "_v", "w")
            held = None
            for _ in range(p.task.depth):
                level = level.select("t", "rest", "_x", "_v", "w", F.posexplode("rest").alias("at", "e"))
                level = level.select(F.concat("t", F.array("e")).alias("t"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "_x", "_v", "w")
                held = level if held is None else held.union(level)
            inside = held.groupBy(F.col("t").alias("c"), "_x", "_v").agg(F.sum("w").alias("w")).join(lit, "c").groupBy("c").agg(F.sum(density).alias("inside"))
            sums = everywhere.join(inside, "c").withColumn("outside", F.col("whole") - F.col("inside"))
        else:
            covered = F.arrays_overlap("c", "items")
            sums = points.join(lit, F.lit(True)).groupBy("c").agg(F.sum(F.when(covered, density)).alias("inside"), F.sum(F.when(~covered, density)).alias("outside"))
        out = lines.join(sums.select(F.col("c").alias("items"), "inside", "outside"), "items", "left")
        return out.withColumn("likelihood_sg", F.try_divide("inside", "n")).withColumn("likelihood_complement", F.try_divide(F.col("outside"), F.lit(p.constants.n) - F.col("n"))).drop("inside", "outside")


def _owned(parents: list[tuple[int, ...]], size: int) -> np.ndarray:
    """Which (parent, selector) make a child that no parent before makes."""
    keep, seen = np.zeros((len(parents), size), bool), set()
    for i, t in enumerate(parents):
        for j in range(size):
            child = frozenset((*t, j))
            if j not in t and child not in seen:
                seen.add(child)
                keep[i, j] = True
    return keep


def _chosen(mask: Column) -> Column:
    """The members of `items` at the set bits of `mask`."""
    return F.filter("items", lambda x, i: (F.floor(mask / F.pow(F.lit(2), i)) % 2) == 1)
