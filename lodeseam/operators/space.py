"""Search spaces: lists of selectors made from a table's values."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.errors import SearchSpaceError, ValidationError
from lodeseam.functions.selectors import Interval, IsNull, Selector, equality, kind_of, negated
from lodeseam.operators.stats import bucket_of
from lodeseam.sources.table import RID


#: Ranges of distinct values that are counted apart.
RANGES = 128
#: A text column of (about) more different values makes no selectors but an error; name such columns in `ignore`.
MOST_VALUES = 100_000


def nominal_selectors(df: DataFrame, ignore: Iterable[str] = (), most_values: int = MOST_VALUES) -> list[Selector]:
    """One equality per distinct value of every column that is not numeric, by first appearance.

    Missing values make IsNull at the place of the first one. One job counts, one covers all columns.
    """
    names = [c for c in df.columns if c not in {*ignore, RID} and kind_of(df.schema, c) != "numeric"]
    if not names:
        return []
    about = df.agg(*[F.approx_count_distinct(f"`{c}`") for c in names]).first()
    if many := [c for c, n in zip(names, about, strict=True) if n > most_values]:
        raise SearchSpaceError(f"more than {most_values} values in {', '.join(many)}")
    place = F.min(RID) if RID in df.columns else F.lit(0)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(names)])).alias("s")
    rows = df.select(*([RID] if RID in df.columns else []), pairs).groupBy("s.i", "s.v").agg(place.alias("first")).orderBy("i", "first", "v").collect()  # distinct values only
    out = []
    for r in rows:
        truth = kind_of(df.schema, names[r[0]]) == "boolean"
        out.append(equality(names[r[0]], r[1] == "true" if truth and r[1] is not None else r[1]))
    return out


def equal_frequency_cutpoints(df: DataFrame, attribute: str, bins: int) -> list[float]:
    """The value at every i/bins-th of the sorted present values, walking past values already chosen.

    Ranges of the distinct values are counted first; only those that hold a place are sorted, each in its task.
    """
    v = df.where(F.col(attribute).isNotNull()).groupBy(F.col(attribute).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    edges = sorted(set(v.approxQuantile("v", [i / RANGES for i in range(1, RANGES)], 0.005)))
    ranged = v.withColumn("range", bucket_of(F.col("v"), edges))
    totals = ranged.groupBy("range").agg(F.sum("n")).orderBy("range").collect()  # RANGES rows
    total, before, wanted = sum(r[1] for r in totals), 0, []
    for r in totals:
        wanted += [(r[0], i, i * total // bins - before) for i in range(1, bins) if before <= i * total // bins < before + r[1]]
        before += r[1]
    if not wanted:
        return []
    places = df.sparkSession.createDataFrame(wanted, "range int, i int, place long")
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("v"))
    hit = ranged.where(F.col("range").isin(sorted({w[0] for w in wanted}))).select("range", "v", upto.alias("upto")).join(F.broadcast(places), "range").where("upto > place")
    firsts = [r[1] for r in hit.groupBy("i").agg(F.min("v").alias("v")).orderBy("i").collect()]  # bins - 1 rows
    cuts: list[float] = []
    for first in firsts:
        if cuts and first <= cuts[-1]:
            row = v.where(F.col("v") > cuts[-1]).agg(F.min("v")).first()
            if row[0] is None:
                break
            first = row[0]
        cuts.append(first)
    return cuts


def equal_width_cutpoints(low: float, high: float, bins: int) -> list[float]:
    if not low < high:
        return []
    return sorted({low + i * (high - low) / bins for i in range(1, bins)} - {low})


def intervals(attribute: str, cuts: Sequence[float], between: bool = True, whole: bool = False) -> list[Selector]:
    """Between cutpoints with open ends; or, if not `between`, both one-sided intervals of each cutpoint."""
    if between:
        edges = [-math.inf, *cuts, math.inf]
        return [Interval(attribute, a, b, whole) for a, b in zip(edges, edges[1:], strict=False)]
    return [s for c in cuts for s in (Interval(attribute, c, math.inf, whole), Interval(attribute, -math.inf, c, whole))]


def numeric_selectors(df: DataFrame, ignore: Iterable[str] = (), bins: int = 5, method: str | Sequence[float] = "equal_frequency", between: bool = True) -> list[Selector]:
    """IsNull where values are missing, then equalities (few values) or intervals of every numeric column."""
    if not isinstance(bins, int) or bins < 2:
        raise ValidationError("bins must be a whole number of at least 2")
    names = [c for c in df.columns if c not in {*ignore, RID} and kind_of(df.schema, c) == "numeric"]
    if not names:
        return []
    stats = df.agg(*[F.struct(F.count_if(F.col(f"`{c}`").isNull()).alias("na"), F.min(f"`{c}`").cast("double").alias("lo"), F.max(f"`{c}`").cast("double").alias("hi"), F.approx_count_distinct(f"`{c}`").alias("about")).alias(f"_{i}") for i, c in enumerate(names)]).first()
    out: list[Selector] = []
    for i, c in enumerate(names):
        s, whole = stats[f"_{i}"], isinstance(df.schema[c].dataType, T.IntegralType)
        out += [IsNull(c)] if s.na else []
        if s.lo is None:
            continue
        if not isinstance(method, str):
            cuts = [float(x) for x in method]
            if any(a >= b for a, b in zip(cuts, cuts[1:], strict=False)):
                raise ValidationError("cutpoints must rise")
        elif method == "equal_frequency":
            few = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double")).distinct().orderBy(c).limit(bins + 1).collect() if s.about <= 2 * bins + 5 else []
            if few and len(few) <= bins:
                out += [equality(c, r[0], whole) for r in few]
                continue
            cuts = equal_frequency_cutpoints(df, c, bins)
        elif method == "equal_width":
            cuts = equal_width_cutpoints(s.lo, s.hi, bins)
        else:
            raise ValidationError(f"no such method: {method!r}")
        out += intervals(c, cuts, between, whole)
    return out


def all_selectors(df: DataFrame, ignore: Iterable[str] = (), bins: int = 5, method: str | Sequence[float] = "equal_frequency", between: bool = True, negations: bool = False) -> list[Selector]:
    """Nominal, then numeric selectors; with `negations` the negation of each after them."""
    ignore = tuple(ignore)
    out = nominal_selectors(df, ignore) + numeric_selectors(df, ignore, bins, method, between)
    if not out:
        raise SearchSpaceError("no selectors in this table")
    return out + [negated(s) for s in out] if negations else out


def remove_attributes(selectors: Iterable[Selector], attributes: Iterable[str]) -> list[Selector]:
    gone = set(attributes)
    return [s for s in selectors if s.attribute not in gone]


def space_size(selectors: int, depth: int) -> int:
    """How many non-empty conjunctions of at most `depth` selectors there are."""
    return sum(math.comb(selectors, k) for k in range(1, depth + 1))


def suggest_target(df: DataFrame) -> tuple[str, object] | None:
    """A likely target: a column of a usual name, else the first with two values; its rarer value."""
    usual = [c for c in df.columns if c.lower() in ("class", "target", "label", "outcome", "income", "survived", "y")]
    for c in [*usual, *(c for c in df.columns if c not in usual and c != RID)]:
        values = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy("count", c).limit(3).collect()
        if len(values) == 2 or (len(values) > 2 and c in usual):
            return c, values[0][0]
    return None


def suggest_attributes(df: DataFrame, most: int = 25) -> list[str]:
    """Columns fit for search: no text of very many values, no whole numbers that are all distinct."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_distinct(f"`{c}`").alias(c) for c in df.columns if c != RID]).first()
    keep = lambda c: counts[c] <= most if kind_of(df.schema, c) != "numeric" else not (isinstance(df.schema[c].dataType, T.IntegralType) and counts[c] == counts["_n"])
    return [c for c in df.columns if c != RID and keep(c)]
