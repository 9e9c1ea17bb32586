"""Searches of the lattice. All exact ones return the same list; they differ in what they visit.

Ranks: quality falling, then fewer selectors, then the ascending numbers of the selectors. The driver holds
the k best, the bound they set and, where a search works from a frontier, that frontier; statistics stay in
DataFrames, one job per level or batch of parents.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.errors import AbortedError, BackendError, ValidationError
from lodeseam.functions.measures import StandardNumeric
from lodeseam.operators.generalize import with_generalizations
from lodeseam.operators.lattice import Lattice
from lodeseam.operators.results import Results, build
from lodeseam.plans.task import Task, prepare


@dataclass(frozen=True)
class Scored:
    quality: float
    items: tuple[int, ...]
    estimate: float | None
    n: int | None = None
    p: int | None = None

    @property
    def rank(self) -> tuple:
        return (-self.quality, len(self.items), self.items)


class TopK:
    """The k best of what was offered above a quality, whatever the order of offers."""

    def __init__(self, k: int, above: float) -> None:
        self.k, self.above, self.entries = k, above, []

    def offer(self, found: list[Scored]) -> None:
        good = [s for s in found if s.quality is not None and not math.isnan(s.quality) and s.quality > self.above]
        self.entries = sorted({s.items: s for s in [*self.entries, *good]}.values(), key=lambda s: s.rank)[: self.k]

    @property
    def full(self) -> bool:
        return len(self.entries) == self.k

    @property
    def worst(self) -> float:
        return self.entries[-1].quality if self.entries else -math.inf

    def prunes(self, estimate: float | None) -> bool:
        """Whether no refinement under this estimate can enter."""
        if estimate is None or math.isnan(estimate):
            return False
        return estimate <= self.above or (self.full and estimate < self.worst)


class _Run:
    """What all searches share: scoring, membership, progress and the stop request."""

    def __init__(self, task: Task, form: str = "conjunction", pruning: bool = True) -> None:
        self.p = prepare(task, form)
        self.lattice = Lattice(self.p)
        self.top = TopK(task.k, task.min_quality)
        self.bounds = pruning and task.measure.safe and form == "conjunction" and not task.measure.whole
        self.pruning, self.evaluated, self.pruned, self.layer = pruning, 0, 0, 0

    def scored(self, stats: DataFrame) -> DataFrame:
        """Statistics with quality, estimate and whether they meet the constraints."""
        m, c = self.p.task.measure, self.p.constants
        if self.p.task.target.kind == "line":
            stats = self.lattice.likelihoods(stats)
        if not m.whole:
            bound = m.estimate(c)
            stats = stats.withColumn("quality", m.quality(c)).withColumn("estimate", F.lit(None).cast("double") if bound is None else bound)
        elif "estimate" not in stats.columns:
            stats = stats.withColumn("estimate", F.lit(None).cast("double"))
        return stats.withColumn("quality", F.nanvl(F.col("quality").cast("double"), F.lit(None).cast("double"))).withColumn("member", self.p.holds()).withColumn("alive", self.p.holds(True))

    def best(self, scored: DataFrame, k: int | None = None) -> list[Scored]:
        """The first k of a scored level above the asked quality, ranked by Spark."""
        ranked = scored.where(F.col("quality").isNotNull() & (F.col("quality") > self.top.above) & F.col("member"))
        p = F.col("p") if "p" in scored.columns else F.lit(None).cast("long")
        rows = ranked.select("quality", "items", "estimate", "n", p.alias("p")).orderBy(F.desc("quality"), F.size("items"), "items").limit(k or self.p.task.k).collect()
        return [Scored(r[0], tuple(r[1]), *r[2:]) for r in rows]

    def admit(self, scored: DataFrame) -> None:
        self.step()
        self.top.offer(self.best(scored))

    def step(self) -> None:
        """Between jobs: tell the caller, and stop if asked to."""
        task = self.p.task
        self.layer += 1
        if task.should_stop and task.should_stop():
            raise AbortedError("the search was stopped")
        if task.progress:
            first = self.top.entries[0] if self.top.entries else None
            task.progress({"layer": self.layer, "evaluated": self.evaluated, "pruned": self.pruned, "best_quality": first and first.quality, "best_description": first and self.p.description(first.items)})

    def survivors(self, scored: DataFrame) -> Column:
        """Which sets may have refinements that enter."""
        keep = F.col("alive") if self.pruning else F.lit(True)
        if self.bounds:
            sure = F.col("estimate").isNull() | F.isnan("estimate")
            reach = F.col("estimate") > self.top.above
            if self.top.full:
                reach = reach & (F.col("estimate") >= self.top.worst)
            keep = keep & (sure | reach)
        return keep

    def fill_empty(self) -> None:
        """Covers without rows are no patterns; where they have a quality, those that rank next join here."""
        task, depth = self.p.task, self.p.task.depth
        worth = task.measure.of_empty(depth) if not task.measure.whole else None
        if worth is None or self.top.full or not worth > self.top.above:
            return
        zero = self.lattice.p.task.df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("p"))
        if not zero.select(self.p.holds()).first()[0]:
            return
        held = self.lattice.levels(depth).select(F.col("t").alias("items")).distinct()
        free = self.lattice.candidates(depth).join(held, "items", "left_anti").orderBy(F.size("items"), "items").limit(task.k).collect()
        self.top.offer([Scored(float(worth), tuple(r[0]), float(worth), 0, 0) for r in free])

    def finish(self, note: str) -> Results:
        try:
            return build(self.p, self.top.entries, self.evaluated, self.pruned, note)
        finally:
            for df in self.p.counters.get("persisted", []):
                df.unpersist()
            self.lattice.close()


def exhaustive(task: Task, form: str = "conjunction") -> Results:
    """Every set, no pruning: one aggregation over the whole lattice."""
    run = _Run(task, form, pruning=False)
    if task.measure.whole:
        if form != "conjunction":
            raise ValidationError("measures of generalisations fit conjunctions only")
        stats = with_generalizations(run.lattice, task.depth)
    elif form == "disjunction":
        stats = run.lattice.union_statistics(task.depth)
    else:
        stats = run.lattice.all_statistics(task.depth)
    run.admit(run.scored(stats))
    if form == "conjunction":
        run.fill_empty()
    return run.finish("exhaustive")


def apriori(task: Task, pruning: bool = True) -> Results:
    """Level by level; a set is extended only if every subset one smaller survived its level."""
    if task.measure.whole:
        return exhaustive(task)
    run = _Run(task, pruning=pruning)
    if run.lattice.pairs_as_product and task.depth <= 2:
        run.admit(run.scored(run.lattice.products(None).where(F.size("items") <= task.depth)))
        run.fill_empty()
        return run.finish("pairs as a matrix product")
    level = run.lattice.deeper(run.lattice.unfolded())
    for d in range(1, task.depth + 1):
        scored = run.scored(run.lattice.statistics(level)).persist()
        run.p.counters.setdefault("persisted", []).append(scored)
        run.admit(scored)
        if d == task.depth:
            break
        kept = scored.where(run.survivors(scored)).select("items")
        total, left = scored.count(), kept.count()
        run.evaluated, run.pruned = run.evaluated + total, run.pruned + total - left
        if not left:
            break
        if left < total:
            level = level.join(kept.withColumnRenamed("items", "t"), "t", "left_semi")
        level = run.lattice.deeper(level)
        if left < total:
            for j in range(d):
                level = level.withColumn("_sub", F.concat(F.slice("t", F.lit(1), F.lit(j)), F.slice("t", j + 2, d)))
                level = level.join(kept.withColumnRenamed("items", "_sub"), "_sub", "left_semi").drop("_sub")
    if run.bounds or not task.constraints:
        run.fill_empty()
    return run.finish("level-wise")


def dfs(task: Task, pruning: bool = True, chunk: int = 64) -> Results:
    """Prefixes in ascending order, `chunk` of them at a time to full depth, under the bound found so far."""
    if task.measure.whole:
        return exhaustive(task)
    run = _Run(task, pruning=pruning)
    first = run.lattice.deeper(run.lattice.unfolded())
    scored = run.scored(run.lattice.statistics(first)).persist()
    run.p.counters.setdefault("persisted", []).append(scored)
    run.admit(scored)
    roots = [r[0][0] for r in scored.where(run.survivors(scored)).select("items").orderBy("items").collect()]  # selectors
    for i in range(0, len(roots), chunk):
        level = first.where(F.col("t")[0].isin(roots[i : i + chunk]))
        for _ in range(2, task.depth + 1):
            level = run.lattice.deeper(level)
            below = run.scored(run.lattice.statistics(level)).persist()
            run.p.counters["persisted"].append(below)
            run.admit(below)
            level = level.join(below.where(run.survivors(below)).select(F.col("items").alias("t")), "t", "left_semi")
    run.fill_empty()
    return run.finish("depth-first")


def dfs_numeric(task: Task, pruning: bool = True) -> Results:
    """Depth-first with the ordered bound of the standard measure of a number."""
    if not isinstance(task.measure, StandardNumeric):
        raise ValidationError("this search takes the standard measure of a number only")
    m = StandardNumeric(task.measure.a, task.measure.invert, "order")
    return dfs(Task(**{**task.__dict__, "measure": m}), pruning and m.a >= 0)


def pattern_tree(task: Task) -> Results:
    """Over distinct patterns with mergeable counts; sets without rows are never visited."""
    if task.target.kind not in ("binary", "itemsets") or task.measure.whole:
        raise ValidationError("this search takes counts of conditions or itemsets only")
    if task.target.kind == "itemsets" and task.min_quality < 0 and not any(c.name == "min_support" for c in task.constraints):
        raise ValidationError("itemsets need a quality of at least 0 or a minimum support")
    return apriori(task)


def best_first(task: Task, pruning: bool = True, batch: int = 256) -> Results:
    """The frontier's best estimates first, `batch` parents per job; stops when the best cannot enter."""
    if task.measure.whole:
        return exhaustive(task)
    run = _Run(task, pruning=pruning)
    frontier: list[tuple] = []
    last = len(run.p.selectors) - 1

    def expand(parents: list[tuple[int, ...]]) -> None:
        level = run.lattice.unfolded() if parents == [()] else _prefixed(run.lattice, parents)
        scored = run.scored(run.lattice.statistics(run.lattice.deeper(level))).persist()
        run.admit(scored)
        open_ = scored.where(run.survivors(scored) & (F.size("items") < task.depth) & (F.element_at("items", -1) < last))
        for r in open_.select("items", "estimate").toLocalIterator():  # the frontier
            bound = r[1] if r[1] is not None and not math.isnan(r[1]) else math.inf
            heapq.heappush(frontier, (-bound, len(r[0]), tuple(r[0])))
        scored.unpersist()

    expand([()])
    while frontier:
        parents = []
        while frontier and len(parents) < batch:
            bound, _, items = heapq.heappop(frontier)
            if run.bounds and run.top.prunes(-bound):
                run.pruned += len(frontier) + 1
                frontier.clear()
                break
            parents.append(items)
        if parents:
            expand(parents)
    run.fill_empty()
    return run.finish("best-first")


def _prefixed(lattice: Lattice, parents: list[tuple[int, ...]]) -> DataFrame:
    """Every pattern once for each of `parents` it holds, with what follows the parent's last selector."""
    spark = lattice.p.task.df.sparkSession
    given = F.broadcast(spark.createDataFrame([(list(t), t[0]) for t in parents], "t array<int>, head int"))  # one batch
    rows = lattice.rows.select("items", *lattice.kept, F.explode("items").alias("head")).join(given, "head")
    held = rows.where(F.size(F.array_except("t", "items")) == 0)
    return held.select("t", F.filter("items", lambda x: x > F.element_at("t", -1)).alias("rest"), *lattice.kept)


def generalizing_bfs(task: Task) -> Results:
    """Exact over unions of covers."""
    if task.measure.whole:
        raise ValidationError("measures of generalisations fit conjunctions only")
    return exhaustive(task, "disjunction")


def beam_search(task: Task, width: int = 20, adaptive: bool = False) -> Results:
    """The `width` best so far, extended by every selector, as often as the depth allows; not exact.

    An adaptive beam is as wide as the result is long, whatever `width` says.
    """
    width = task.k if adaptive else width
    if width < 1 or width < task.k:
        raise ValidationError("the width must be at least k")
    if task.measure.whole:
        raise ValidationError("a beam takes measures of single covers only")
    run = _Run(task, pruning=False)
    beam, offered, expanded = TopK(width, task.min_quality), set(), set()

    def expand(parents: list[tuple[int, ...]]) -> None:
        run.step()
        stats = run.lattice.extensions(parents)
        if offered:
            known = task.df.sparkSession.createDataFrame([(list(t),) for t in offered], "items array<int>")
            stats = stats.join(F.broadcast(known), "items", "left_anti")
        found = run.best(run.scored(stats), width)
        offered.update(s.items for s in found)
        beam.offer(found)

    expand([()])
    for _ in range(2, task.depth + 1):
        parents = [s.items for s in beam.entries if len(s.items) < task.depth and s.items not in expanded]
        if not parents:
            break
        expanded.update(parents)
        expand(parents)
    run.top.entries = beam.entries[: task.k]
    return run.finish("beam")


ENGINES = {
    "exhaustive": exhaustive, "apriori": apriori, "dfs": dfs, "dfs_numeric": dfs_numeric, "pattern_tree": pattern_tree, "best_first": best_first,
    "generalizing_bfs": generalizing_bfs, "beam": beam_search,
}


def search(task: Task, engine: str = "auto", **options: object) -> Results:
    """Run a task; auto takes level-wise search where bounds can prune, else one pass over the lattice."""
    if engine == "auto":
        engine = "apriori" if task.measure.safe or any(c.monotone for c in task.constraints) else "exhaustive"
    if engine not in ENGINES:
        raise BackendError(f"no engine {engine!r}; there are {', '.join(ENGINES)}")
    return ENGINES[engine](task, **options)


