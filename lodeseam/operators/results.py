"""Results: ranked descriptions with their full statistics, filters over them, and their text forms."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.errors import ValidationError
from lodeseam.functions.dialect import print_conjunction, print_selector
from lodeseam.functions.scalars import normal_density
from lodeseam.functions.selectors import Conjunction, Disjunction, Equality, Interval, IsNull, Negated, Selector, equality, kind_of
from lodeseam.operators.stats import intercept, slope
from lodeseam.operators.targets import medians
from lodeseam.plans.task import Prepared
from lodeseam.sources.table import RID, csv_text

FORMAT, VERSION = "lodeseam-results", 1


@dataclass(frozen=True)
class Entry:
    quality: float
    description: Conjunction | Disjunction
    stats: dict[str, float | int | None]
    estimate: float | None = None

    def text(self, form: str = "display") -> str:
        if isinstance(self.description, Disjunction):
            return " OR ".join(sorted(print_selector(s, form) for s in self.description.selectors))
        return print_conjunction(self.description, form)


@dataclass(frozen=True)
class Results:
    entries: tuple[Entry, ...]
    evaluated: int = 0
    pruned: int = 0
    note: str = ""
    df: DataFrame | None = field(default=None, compare=False, repr=False)

    def rows(self) -> list[dict]:
        return [{"quality": e.quality, "subgroup": e.text(), **e.stats} for e in self.entries]

    def to_csv(self, header: Iterable[str] = ()) -> str:
        rows = self.rows()
        return csv_text(rows, list(rows[0]) if rows else ["quality", "subgroup", *header])

    def frame(self, spark) -> DataFrame:
        """The entries as a DataFrame: rank, quality, depth, subgroup, estimate and the statistics."""
        names = list(self.entries[0].stats) if self.entries else []
        schema = "rank int, quality double, depth int, subgroup string, estimate double" + "".join(f", {n} double" for n in names)
        number = lambda x: None if x is None else float(x)
        return spark.createDataFrame([(i, float(e.quality), e.description.depth, e.text("query"), number(e.estimate), *(number(e.stats[n]) for n in names)) for i, e in enumerate(self.entries, 1)], schema)

    def cover(self, i: int) -> DataFrame:
        """(_rid) of the rows of entry i, ascending."""
        if self.df is None:
            raise ValidationError("these results have no table")
        return self.entries[i].description.covered(self.df).select(RID).orderBy(RID)


def build(p: Prepared, top: list, evaluated: int, pruned: int, note: str) -> Results:
    """Statistics tables of at most k winners.

    A condition's and an itemset's follow from the counts at hand; a number's takes one aggregation over the
    table for all winners, a line's two.
    """
    descriptions = [p.description(s.items) for s in top]
    if p.task.target.kind in ("binary", "itemsets"):
        tables = [counted_table(p, s.n, s.p) for s in top]
    else:
        tables = full_tables(p, descriptions) if descriptions else []
    entries = tuple(Entry(s.quality, d, t, s.estimate) for s, d, t in zip(top, descriptions, tables, strict=True))
    return Results(entries, evaluated, pruned, note, p.task.df)


def counted_table(p: Prepared, n: int, positives: int | None) -> dict:
    """binary_table() of known counts, or the sizes of an itemset."""
    N, P = p.constants.n, p.constants.positives
    if p.task.target.kind == "itemsets":
        return {"size_sg": n, "size_dataset": N}
    of = lambda a, b: a / b if b else None
    own, base = of(positives, n), of(P, N)
    return {
        "size_sg": n, "size_dataset": N, "positives_sg": positives, "positives_dataset": P, "size_complement": N - n, "relative_size_sg": of(n, N), "relative_size_complement": of(N - n, N),
        "coverage_sg": of(positives, P), "coverage_complement": of(P - positives, P), "target_share_sg": own, "target_share_complement": of(P - positives, N - n), "target_share_dataset": base,
        "lift": None if own is None or not base else own / base,
    }


def full_tables(p: Prepared, descriptions: list) -> list[dict]:
    schema, target = p.task.df.schema, p.task.target
    if target.kind == "numeric":
        return _numbers(p, descriptions)
    rows = p.task.df.select(*[d.column(schema).alias(f"_d{i}") for i, d in enumerate(descriptions)], *target.columns(schema))
    first = _lines(rows, [F.col(f"_d{i}") for i in range(len(descriptions))]).first()
    return [first[f"r{i}"].asDict() for i in range(len(descriptions))]


def _numbers(p: Prepared, descriptions: list) -> list[dict]:
    """numeric_aggregates() of every description from one aggregation by description; the table's figures are at hand."""
    c, schema = p.constants, p.task.df.schema
    hit = F.array_compact(F.array(*[F.when(d.column(schema), F.lit(i)) for i, d in enumerate(descriptions)]))
    rows = p.task.df.select(F.explode(hit).alias("i"), *p.task.target.columns(schema)).persist()
    found = {r.i: r for r in rows.groupBy("i").agg(F.count(F.lit(1)).alias("size"), *[f("_t").alias(k) for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min))]).collect()}  # k rows
    middle = medians(rows, [(found[i]["size"], found[i]["min"], found[i]["max"]) if i in found else (0, None, None) for i in range(len(descriptions))])
    rows.unpersist()
    base, out = {"mean": c.mean, "std": c.std, "median": c.median, "max": c.high, "min": c.low}, []
    for i in range(len(descriptions)):
        own = (found[i].asDict() if i in found else dict.fromkeys(base)) | {"median": middle[i]}
        table = {"size_sg": own.get("size", 0), "size_dataset": c.n}
        for k, of in base.items():
            table |= {f"{k}_sg": own[k], f"{k}_dataset": of}
        lift = lambda k: own[k] / base[k] if own[k] is not None and base[k] else None  # noqa: B023, E731
        out.append(table | {"mean_lift": lift("mean"), "median_lift": lift("median")})
    return out


def _lines(rows: DataFrame, inside: list[Column]) -> DataFrame:
    x, v = F.col("_x"), F.col("_v")
    sums = rows.agg(*[F.struct(F.count_if(d).alias("n"), *[F.sum(F.when(d, c)).alias(k) for k, c in (("sx", x), ("sy", v), ("sxx", x * x), ("sxy", x * v))]).alias(f"r{i}") for i, d in enumerate(inside)])
    col = lambda i, k: F.col(f"r{i}.{k}")
    fits = sums.select(*[slope(*[col(i, k) for k in ("n", "sx", "sy", "sxx", "sxy")]).alias(f"s{i}") for i in range(len(inside))], *sums.columns)
    fits = fits.select(*[F.col(f"s{i}") for i in range(len(inside))], *[intercept(col(i, "n"), col(i, "sx"), col(i, "sy"), F.col(f"s{i}")).alias(f"c{i}") for i in range(len(inside))]).first()
    out = []
    for i, d in enumerate(inside):
        a, b = (F.lit(fits[f"{k}{i}"]).cast("double") for k in "sc")
        density = normal_density(a * x + b - v)
        out.append(F.struct(F.count_if(d).alias("size_sg"), F.count(F.lit(1)).alias("size_dataset"), a.alias("slope"), b.alias("intercept"), F.avg(F.when(d, density)).alias("likelihood_sg"), F.avg(F.when(~d, density)).alias("likelihood_complement")).alias(f"r{i}"))
    return rows.agg(*out)


def minimum_quality(results: Results, least: float) -> Results:
    """Entries of at least that quality."""
    return replace(results, entries=tuple(e for e in results.entries if e.quality >= least))


def _statistic(results: Results, key: str) -> None:
    if results.entries and key not in results.entries[0].stats:
        raise ValidationError(f"no statistic {key!r}; there are {', '.join(results.entries[0].stats)}")


def minimum_statistic(results: Results, key: str, least: float) -> Results:
    _statistic(results, key)
    return replace(results, entries=tuple(e for e in results.entries if e.stats[key] is not None and e.stats[key] >= least))


def maximum_statistic(results: Results, key: str, most: float) -> Results:
    _statistic(results, key)
    return replace(results, entries=tuple(e for e in results.entries if e.stats[key] is not None and e.stats[key] <= most))


def overlaps(df: DataFrame, entries: tuple[Entry, ...]) -> DataFrame:
    """(i, j, both, either): rows in both covers and in either of every pair i < j, in one aggregation."""
    flags = df.select(F.array_compact(F.array(*[F.when(e.description.column(df.schema), F.lit(i)) for i, e in enumerate(entries)])).alias("in"))
    flags = flags.where(F.size("in") > 0).groupBy("in").count()
    single = flags.select(F.explode("in").alias("i"), "count").groupBy("i").agg(F.sum("count").alias("n"))
    pairs = flags.select(F.explode("in").alias("i"), "in", "count").select("i", F.explode("in").alias("j"), "count").where("i < j").groupBy("i", "j").agg(F.sum("count").alias("both"))
    sized = pairs.join(single, "i").withColumnRenamed("n", "n_i").join(single.withColumnRenamed("i", "j"), "j").withColumnRenamed("n", "n_j")
    return sized.select("i", "j", "both", (F.col("n_i") + F.col("n_j") - F.col("both")).alias("either"))


def overlap_filter(results: Results, similarity: float) -> Results:
    """In rank order, entries whose Jaccard overlap with every kept one is at most `similarity`."""
    if results.df is None or not results.entries:
        return results
    near = {(r.i, r.j) for r in overlaps(results.df, results.entries).collect() if r.both > similarity * r.either}  # pairs of k entries
    kept: list[int] = []
    for j in range(len(results.entries)):
        if not any((i, j) in near for i in kept):
            kept.append(j)
    return replace(results, entries=tuple(results.entries[i] for i in kept))


def unique_attributes(results: Results, df: DataFrame) -> Results:
    """The first entry of every combination of attributes; entries on categories only all stay."""
    seen, kept = set(), []
    for e in results.entries:
        used = tuple(s.attribute for s in e.description.selectors)
        if all(kind_of(df.schema, a) != "numeric" for a in used):
            kept.append(e)
        elif used not in seen:
            seen.add(used)
            kept.append(e)
    return replace(results, entries=tuple(kept))


def roc_points(results: Results) -> list[tuple[float, float]]:
    """(false-positive rate, true-positive rate) of each entry."""
    out = []
    for e in results.entries:
        n, p, N, P = (e.stats[k] for k in ("size_sg", "positives_sg", "size_dataset", "positives_dataset"))
        out.append(((n - p) / (N - P) if N > P else 0.0, p / P if P else 0.0))
    return out


def histogram(df: DataFrame, attribute: str, description: Conjunction, bins: int = 20) -> DataFrame:
    """(bin, covered, rows): a number's distribution inside and outside a cover."""
    v = F.col(attribute).cast("double")
    low, high = df.agg(F.min(v), F.max(v)).first()
    width = (high - low) / bins if high > low else 1.0
    at = F.least(F.floor((v - low) / width).cast("int"), F.lit(bins - 1))
    return df.select(at.alias("bin"), description.column(df.schema).alias("covered")).groupBy("bin", "covered").agg(F.count(F.lit(1)).alias("rows"))


def preview(df: DataFrame, description: Conjunction, rows: int = 10) -> DataFrame:
    """The first rows of a cover by input place."""
    return description.covered(df).orderBy(RID).limit(rows)


def _tagged(x: object) -> object:
    if isinstance(x, float) and not math.isfinite(x):
        return {"$f": "nan" if math.isnan(x) else "inf" if x > 0 else "-inf"}
    return x


def _plain(x: object) -> object:
    return float(x["$f"]) if isinstance(x, dict) and set(x) == {"$f"} else x


def selector_to_dict(s: Selector) -> dict:
    if isinstance(s, Equality):
        return {"kind": "equality", "attribute": s.attribute, "value": s.value, "whole": s.whole}
    if isinstance(s, IsNull):
        return {"kind": "isNull", "attribute": s.attribute}
    if isinstance(s, Interval):
        return {"kind": "interval", "attribute": s.attribute, "lo": _tagged(float(s.lo)), "hi": _tagged(float(s.hi)), "whole": s.whole}
    return {"kind": "negated", "inner": selector_to_dict(s.inner)}


def selector_from_dict(d: dict) -> Selector:
    kind = d.get("kind")
    if kind == "equality":
        return equality(d["attribute"], d["value"], d.get("whole", False))
    if kind == "isNull":
        return IsNull(d["attribute"])
    if kind == "interval":
        return Interval(d["attribute"], _plain(d["lo"]), _plain(d["hi"]), d.get("whole", False))
    if kind == "negated":
        return Negated(selector_from_dict(d["inner"]))
    raise ValidationError(f"no such selector: {kind!r}")


def to_json(results: Results) -> str:
    """Versioned text with structured selectors; numbers that JSON lacks are tagged."""
    entries = [
        {"quality": _tagged(e.quality), "form": type(e.description).__name__.lower(), "selectors": [selector_to_dict(s) for s in e.description.selectors], "estimate": _tagged(e.estimate), "stats": {k: _tagged(v) for k, v in e.stats.items()}}
        for e in results.entries
    ]
    return json.dumps({"format": FORMAT, "version": VERSION, "evaluated": results.evaluated, "pruned": results.pruned, "note": results.note, "entries": entries})


def from_json(text: str, df: DataFrame | None = None) -> Results:
    """The results of to_json(); covers are found again in `df` if it is given."""
    data = json.loads(text)
    if not isinstance(data, dict) or data.get("format") != FORMAT or data.get("version") != VERSION:
        raise ValidationError("not results of this format and version")
    forms = {"conjunction": Conjunction, "disjunction": Disjunction}
    entries = tuple(Entry(_plain(e["quality"]), forms[e["form"]]([selector_from_dict(s) for s in e["selectors"]]), {k: _plain(v) for k, v in e["stats"].items()}, _plain(e["estimate"])) for e in data["entries"])
    return Results(entries, data["evaluated"], data["pruned"], data["note"], df)
