"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 .. 1, piecewise linear. Its integral is the
source's cumulative share of its token demand; a document that starts at word u of its source's demand
is trained at the time where that integral reaches u. Documents are sorted by that time.

Cumulative word counts inside a source come from two levels (totals of hash ranges, then rows inside one
range), so a source that holds a third of all rows is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.llm.base import checkpointed, pieces, unit_hash, whole_text

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = 5_021
RANGE_ROWS = 2_000
#: (time, factor) knots of the schedule of each weight class: light sources early, heavy ones late.
SCHEDULES = (((0.0, 3.0), (0.5, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 1.0), (1.0, 3.0)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """Targets of `sizes` (source, source_size): shares of all words by weight, none above `repeats` sizes.

    Sources by code point, null last, take the weights in turn. The level at which capped and uncapped
    sources meet is found in one ordered pass: below it a source stops at its cap, above it shares by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = (F.lit(repeats) * F.col("source_size")).cast("double")
    w = sizes.withColumn("_class", (F.row_number().over(order) - 1) % len(weights)).withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_class") + 1).cast("int")))
    by_ratio = Window.orderBy(cap / F.col("_weight"), F.col("source").asc_nulls_last())
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("_level", level).withColumn("_level", F.max(F.when(F.col("_level") * F.col("_weight") <= cap, F.col("_level"))).over(Window.partitionBy()))
    return w.select("source", "source_size", "_class", F.least(cap, F.coalesce(F.col("_level") * F.col("_weight"), cap)).alias("target"))


def training_time(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of the schedule through `knots` reaches `share` (0 .. 1) of its whole."""
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    steps = []
    for area, (t0, a), (t1, b) in zip(areas, knots, knots[1:], strict=False):
        need, slope = share * whole - done, (b - a) / (t1 - t0)
        at = need / a if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2 * slope * need)) - a) / slope
        steps.append((done + area, t0 + at))
        done += area
    for upto, at in reversed(steps):
        out = F.when(share * whole <= upto, at).otherwise(out)
    return out


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, range_rows: int = RANGE_ROWS, repeats: int = MOST_REPEATS
) -> DataFrame:
    """`id_col`, size, source_size, target, taken, position and positions of every row, sorted by position.

    size counts words; a null or wordless text has size 0 and nothing of it is taken. A null source is a
    source like any other, after all others. taken counts repeats and is cut in the one document where the
    source's target is reached. position is the training time (0 .. 1) of the first use, null when unused;
    positions has that of every use, the last of which may be cut. Identical rows are interchangeable; an empty table gives no rows; other columns are not read.
    """
    slim = checkpointed(df.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size")))
    ranges = pieces(slim.count(), range_rows)
    slim = slim.withColumn("_hash", unit_hash("_id", seed=seed)).withColumn("_range", F.floor(F.col("_hash") / F.lit((1 << 62) / ranges)).cast("int"))
    parts = slim.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("_words").alias("source_size")), repeats=repeats)
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "_range", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    parts = parts.join(targets, parts["source"].eqNullSafe(targets["source"])).select(parts["source"], "_range", "_before", "source_size", "target", "_class")
    inside = Window.partitionBy("source", "_range").orderBy("_hash", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = slim.join(parts, slim["source"].eqNullSafe(parts["source"]) & (slim["_range"] == parts["_range"])).select("_id", "size", "source_size", "target", "_class", (F.col("_before") + F.col("_inside")).alias("_at"))
    left = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - F.col("source_size") * k - F.col("_at")))
    taken = sum((left(k) for k in range(1, repeats)), left(0))

    def at(k: int) -> Column:
        """The training time of use `k`: where the source's demand reaches the row for the (k + 1)th time."""
        share, time = F.try_divide((F.col("_at") + F.col("source_size") * k).cast("double"), F.col("target")), F.lit(None).cast("double")
        for c, knots in enumerate(SCHEDULES):
            time = F.when(F.col("_class") == c, training_time(share, knots)).otherwise(time)
        return time

    uses = F.array_compact(F.array(*[F.when(left(k) > 0, at(k)) for k in range(repeats)]))
    out = rows.select(F.col("_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), uses.alias("positions"))
    return out.select(id_col, "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), "positions").orderBy(F.col("position").asc_nulls_last(), id_col)
