"""One query per operator over the driver's tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions import measures as M
from lodeseam.functions import dialect, scalars
from lodeseam.functions.selectors import DNF, Conjunction, Disjunction, Equality, Interval, IsNull, Negated, canonical
from lodeseam.operators import results as R
from lodeseam.operators import search as S
from lodeseam.operators import space, stats
from lodeseam.operators.targets import Binary, Itemsets, Line, Numeric, binary
from lodeseam.plans import sql
from lodeseam.plans.task import Task, min_support
from lodeseam.sources import synth, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LINES = canonical(
    [Equality("l_linestatus", x) for x in "OF"] + [Equality("l_linenumber", i, True) for i in range(1, 8)]
    + [Interval("l_quantity", hi=10.0), Interval("l_quantity", 10.0, 25.0), Interval("l_quantity", lo=25.0), Interval("l_discount", hi=0.05), Interval("l_discount", lo=0.05), Interval("l_tax", hi=0.04), Interval("l_tax", lo=0.04)]
)
FLAGS = canonical([*(s for s in LINES if s.attribute in ("l_linestatus", "l_linenumber")), *(Equality("l_returnflag", x) for x in "ANR")])
ORDERS = canonical([Equality("o_orderstatus", x) for x in "FOP"] + [Equality("o_orderpriority", x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")] + [Interval("o_custkey", hi=500.0), Interval("o_custkey", lo=500.0)])
SHOPPERS = canonical([Equality("o_orderstatus", x) for x in "FOP"] + [Equality("c_mktsegment", x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")] + [Equality("c_nationkey", i, True) for i in range(25)])
DOCS = canonical([s for e in [*(Equality("lang", x) for x in ("de", "en", "es", "fr")), *(Equality("source", f"src{i}") for i in range(8)), Equality("quality", 0, True), Equality("quality", 1, True)] for s in (e, Negated(e))] + [IsNull("quality"), Negated(IsNull("quality"))])
PARTS = canonical([Equality("p_brand", f"Brand#{i}{j}") for i in range(1, 6) for j in range(1, 6)] + [Interval("p_size", hi=10.0), Interval("p_size", 10.0, 30.0), Interval("p_size", lo=30.0)])
RETURNED, URGENT, TOXIC = binary("l_returnflag", "R"), binary("o_orderpriority", "1-URGENT"), binary("toxic", 1)

SHOPPING = "SELECT o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey"
LABELLED = "SELECT documents.doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"
COUNTS_ONLY = {"n": "count(*)"}
COUNTS, SHARES = {"n": "count(*)", "p": "sum(CASE WHEN {y} THEN 1 ELSE 0 END)"}, {"nn": "count(*)", "pp": "sum(CASE WHEN {y} THEN 1 ELSE 0 END)"}


def query(name: str, oracle: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select("o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")


def listed(spark: SparkSession, results: R.Results, selectors: tuple, places: int = 9) -> DataFrame:
    """rank, key, depth, size, quality of at most k entries."""
    place = {s: i for i, s in enumerate(canonical(list(selectors)))}
    rows = [(i, "-".join(map(str, sorted(place[s] for s in e.description.selectors))), e.description.depth, int(e.stats["size_sg"]), round(float(e.quality), places)) for i, e in enumerate(results.entries, 1)]
    return spark.createDataFrame(rows, "rank int, key string, depth int, size long, quality double")


def fill(d: dict[str, str], y: str) -> dict[str, str]:
    return {k: v.format(y=y) for k, v in d.items()}


def add(name: str, source: Callable | str, given: str, target, selectors: tuple, measure: M.Measure, quality: str | None, y: str = "false", *, engine: str = "auto", k: int = 10, depth: int = 2, above: float | None = None, support: int = 0, form: str = "conjunction", extra: dict | None = None, constants: dict | None = None, places: int = 9, **options) -> None:
    """Register a search and, if `quality` is its SQL, the check."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir) if callable(source) else read(spark, sf_dir, source)
        constraints = (min_support(support),) if support else ()
        task = Task(df, target, selectors, measure, k, depth, float("-inf") if above is None else above, constraints)
        found = S.exhaustive(task, form) if form == "disjunction" and engine == "exhaustive" else S.search(task, engine, **options)
        return listed(spark, found, selectors, places)

    QUERIES[name] = run
    if quality:
        ctes = sql.lattice(given, selectors, fill(COUNTS, y) | (extra or {}), depth, fill(SHARES, y) | (constants or {}), form)
        ORACLE[name] = sql.ranked(ctes, quality, k, *([repr(above)] if above is not None else []), places=places, **({"having": f"n >= {support}"} if support else {}))


R_IS, URGENT_IS, TOXIC_IS = "l_returnflag = 'R'", "o_orderpriority = '1-URGENT'", "coalesce(toxic = 1, false)"
LINEITEM, ORDER = "SELECT * FROM lineitem", "SELECT * FROM orders"
WRACC = "(n / nn::DOUBLE) * (p / n::DOUBLE - pp / nn::DOUBLE)"
BINOMIAL = "sqrt(n / nn::DOUBLE) * (p / n::DOUBLE - pp / nn::DOUBLE)"
LIFT = "1.0::DOUBLE * (p / n::DOUBLE - pp / nn::DOUBLE)"
CELLS = "+".join(f"(({o}) - ({e})) * (({o}) - ({e})) / nullif({e}, 0)" for o, e in (("p", "pp * n / nn::DOUBLE"), ("pp - p", "pp * (nn - n) / nn::DOUBLE"), ("n - p", "(nn - pp) * n / nn::DOUBLE"), ("nn - n - (pp - p)", "(nn - pp) * (nn - n) / nn::DOUBLE")))
CHI2 = f"CASE WHEN n < 5 OR nn - n < 5 THEN '-infinity'::DOUBLE WHEN p / n::DOUBLE > pp / nn::DOUBLE THEN {CELLS} ELSE -({CELLS}) END"


def tail_sql(x: str) -> str:
    """P(chi-squared of one degree > x) by the power series of the lower incomplete gamma function."""
    return f"(CASE WHEN {x} <= 0 THEN 1.0::DOUBLE WHEN {x} > 400 THEN 0.0::DOUBLE ELSE 1 - list_sum(list_transform(range(0, 500), lambda j: exp((j + 0.5) * ln(({x}) / 2) - ({x}) / 2 - lgamma(j + 1.5)))) END)"


P_VALUE = f"CASE WHEN n < 5 OR nn - n < 5 THEN '-infinity'::DOUBLE WHEN p / n::DOUBLE < pp / nn::DOUBLE THEN {tail_sql(f'({CELLS})')} ELSE -{tail_sql(f'({CELLS})')} END"

add("search_wracc_apriori", "lineitem", LINEITEM, RETURNED, LINES, M.wracc(), WRACC, R_IS, engine="apriori")
add("search_wracc_depth3", "orders", ORDER, URGENT, tuple(s for s in ORDERS if s.attribute != "o_orderpriority"), M.wracc(), WRACC, URGENT_IS, engine="apriori", depth=3)
add("search_exhaustive", "lineitem", LINEITEM, RETURNED, LINES, M.Standard(0.5), BINOMIAL, R_IS, engine="exhaustive")
add("search_dfs_binomial", "lineitem", LINEITEM, RETURNED, LINES, M.simple_binomial(), BINOMIAL, R_IS, engine="dfs", above=0.0)
add("search_best_first", "lineitem", LINEITEM, RETURNED, LINES, M.wracc(), WRACC, R_IS, engine="best_first", above=0.0)
add("search_pattern_tree", "lineitem", LINEITEM, RETURNED, LINES, M.wracc(), WRACC, R_IS, engine="pattern_tree", above=0.0)
add("search_lift_support", "lineitem", LINEITEM, RETURNED, LINES, M.lift(), LIFT, R_IS, support=200)
add("search_chi2_positive", "lineitem", LINEITEM, RETURNED, LINES, M.ChiSquared("positive"), CHI2, R_IS)
add("search_chi2_p_value", "lineitem", LINEITEM, RETURNED, LINES, M.ChiSquared("negative", stat="p_value"), P_VALUE, R_IS)
add("search_join", shopping, SHOPPING, URGENT, SHOPPERS, M.wracc(), WRACC, URGENT_IS)
add("search_missing_values", labelled, LABELLED, TOXIC, DOCS, M.simple_binomial(), BINOMIAL, TOXIC_IS, k=20)
add("search_combined", "lineitem", LINEITEM, RETURNED, LINES, M.combined((M.wracc(), 1.0), (M.lift(), 2.0)), f"0.0::DOUBLE + 1.0::DOUBLE * ({WRACC}) + 2.0::DOUBLE * ({LIFT})", R_IS)
add("search_disjunctions", "orders", ORDER, URGENT, tuple(s for s in ORDERS if s.attribute != "o_orderpriority"), M.wracc(), WRACC, URGENT_IS, engine="generalizing_bfs", form="disjunction")
add("search_count_itemsets", "part", "SELECT * FROM part", Itemsets(), PARTS, M.Count(), "n::DOUBLE", engine="pattern_tree", above=0.0)
add("search_area_itemsets", "part", "SELECT * FROM part", Itemsets(), PARTS, M.Area(2), "(n * depth)::DOUBLE", engine="apriori", above=0.0)
add("search_beam", "lineitem", LINEITEM, RETURNED, LINES, M.wracc(), None, engine="beam", depth=3, width=20)
_order = "quality DESC, depth, a, b NULLS FIRST, c NULLS FIRST"
_sub = lambda x, y: f"EXISTS (SELECT 1 FROM beam2 WHERE beam2.a = s.{x} AND beam2.b = s.{y})"

def beam_sql(width: int) -> str:
    """Three rounds of a beam over at most three selectors, its first ten."""
    return (
        sql.lattice(LINEITEM, LINES, fill(COUNTS, R_IS), 3, fill(SHARES, R_IS)) + f", s AS (SELECT *, {WRACC} AS quality FROM stats, whole), beam1 AS (SELECT * FROM s WHERE depth = 1 ORDER BY {_order} LIMIT {width}), "
        f"beam2 AS (SELECT * FROM (SELECT * FROM beam1 UNION ALL SELECT * FROM s WHERE depth = 2 AND (a IN (SELECT a FROM beam1) OR b IN (SELECT a FROM beam1))) ORDER BY {_order} LIMIT {width}), "
        f"beam3 AS (SELECT * FROM (SELECT * FROM beam2 UNION ALL SELECT * FROM s WHERE depth = 3 AND ({_sub('a', 'b')} OR {_sub('a', 'c')} OR {_sub('b', 'c')})) ORDER BY {_order} LIMIT 10) "
        f"SELECT CAST(row_number() OVER (ORDER BY {_order}) AS INTEGER) AS rank, key, CAST(depth AS INTEGER) AS depth, CAST(n AS BIGINT) AS size, round(quality, 9) AS quality FROM beam3"
    )


ORACLE["search_beam"] = beam_sql(20)
add("search_beam_adaptive", "lineitem", LINEITEM, RETURNED, LINES, M.wracc(), None, engine="beam", depth=3, adaptive=True)
ORACLE["search_beam_adaptive"] = beam_sql(10)
add("search_beam_wide", "lineitem", LINEITEM, RETURNED, LINES, M.wracc(), WRACC, R_IS, engine="beam", width=500)

EXACT = {"total": "sum(o_totalprice::DECIMAL(38,6))"}
MEAN = {"mean": "avg(o_totalprice)", "med": "median(o_totalprice)"}
PRICE = "o_totalprice"
add("search_standard_numeric", "orders", ORDER, Numeric(PRICE), ORDERS, M.StandardNumeric(1.0), "n * (total::DOUBLE / n - mean)", extra=EXACT, constants=MEAN, places=3)
add("search_numeric_inverted", "orders", ORDER, Numeric(PRICE), ORDERS, M.StandardNumeric(0.5, True, "max"), "sqrt(n) * -(total::DOUBLE / n - mean)", extra=EXACT, constants=MEAN, places=3)
add("search_dfs_numeric", "orders", ORDER, Numeric(PRICE), ORDERS, M.StandardNumeric(1.0), "n * (total::DOUBLE / n - mean)", engine="dfs_numeric", extra=EXACT, constants=MEAN, places=3)
add("search_numeric_median", "orders", ORDER, Numeric(PRICE), ORDERS, M.StandardMedian(1.0), "n * (own - med)", extra={"own": "median(o_totalprice)"}, constants=MEAN, places=3)
add("search_numeric_tscore", "orders", ORDER, Numeric(PRICE), ORDERS, M.TScore(), "sqrt(n) * (own - mean) / nullif(dev, 0)", extra={"own": "avg(o_totalprice)", "dev": "stddev_pop(o_totalprice)"}, constants=MEAN, support=50)

GA = sql.lattice(LINEITEM, LINES, fill(COUNTS, R_IS), 2, fill(SHARES, R_IS))
ONE = f"{GA}, one AS (SELECT *, {WRACC} AS q FROM stats, whole)"
UP = "one LEFT JOIN (SELECT a AS ua, q AS uq, n AS un, p AS up FROM one WHERE depth = 1) AS u1 ON one.depth = 2 AND u1.ua = one.a LEFT JOIN (SELECT a AS va, q AS vq, n AS vn, p AS vp FROM one WHERE depth = 1) AS u2 ON one.depth = 2 AND u2.va = one.b"
add("search_generalization_aware", "lineitem", LINEITEM, RETURNED, LINES, M.GeneralizationAware(M.wracc()), None)
ORACLE["search_generalization_aware"] = sql.ranked(ONE, "q - greatest(0.0::DOUBLE, coalesce(uq, 0), coalesce(vq, 0))", 10, source=UP)
add("search_ga_standard", "lineitem", LINEITEM, RETURNED, LINES, M.GaStandard(1.0), None)
ORACLE["search_ga_standard"] = sql.ranked(ONE, "(n / nn::DOUBLE) * (p / n::DOUBLE - greatest(pp / nn::DOUBLE, coalesce(up / un::DOUBLE, 0), coalesce(vp / vn::DOUBLE, 0)))", 10, source=UP)
add("search_ga_standard_max", "lineitem", LINEITEM, RETURNED, LINES, M.GaStandard(0.5, "max"), None)
ORACLE["search_ga_standard_max"] = sql.ranked(ONE, "sqrt(n / nn::DOUBLE) * (p / n::DOUBLE - greatest(pp / nn::DOUBLE, coalesce(up / un::DOUBLE, 0), coalesce(vp / vn::DOUBLE, 0)))", 10, source=UP)
add("search_ga_numeric", "orders", ORDER, Numeric(PRICE), ORDERS, M.GaStandardNumeric(1.0), None, places=3)
_centred = sql.lattice(ORDER, ORDERS, COUNTS_ONLY | EXACT, 2, {"nn": "count(*)"} | MEAN) + ", one AS (SELECT *, total::DOUBLE / n AS own FROM stats, whole)"
_above = "one LEFT JOIN (SELECT a AS ua, own AS uo FROM one WHERE depth = 1) AS u1 ON one.depth = 2 AND u1.ua = one.a LEFT JOIN (SELECT a AS va, own AS vo FROM one WHERE depth = 1) AS u2 ON one.depth = 2 AND u2.va = one.b"
ORACLE["search_ga_numeric"] = sql.ranked(_centred, "(n / nn::DOUBLE) * (own - CASE WHEN depth = 1 THEN mean WHEN greatest(mean, uo) >= greatest(mean, vo) THEN uo ELSE vo END)", 10, source=_above, places=3)
LIKE = canonical([*(Equality("l_returnflag", x) for x in "ANR"), *(Equality("l_linestatus", x) for x in "OF")])
add("search_line_likelihood", "lineitem", LINEITEM, Line("l_discount", "l_tax"), LIKE, M.Likelihood(), None)
SUMS = {"sx": "sum(l_discount)", "sy": "sum(l_tax)", "sxx": "sum(l_discount * l_discount)", "sxy": "sum(l_discount * l_tax)"}
_fit = sql.lattice(LINEITEM, LIKE, {"n": "count(*)"} | SUMS, 1, {"nn": "count(*)"})
_line = "(n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0)"
ORACLE["search_line_likelihood_1"] = sql.ranked(
    f"{_fit}, fit AS (SELECT *, {_line} AS slope, (sy - {_line} * sx) / n AS icpt FROM stats, whole WHERE n > 2), "
    "res AS (SELECT fit.a AS fa, exp(-0.5 * power(slope * l_discount + icpt - l_tax, 2)) / 2.5066282746310002 AS d, sat.rid IS NOT NULL AS hit FROM fit CROSS JOIN src LEFT JOIN sat ON sat.i = fit.a AND sat.rid = src.rid), "
    "lik AS (SELECT fa, avg(d) FILTER (hit) - avg(d) FILTER (NOT hit) AS q FROM res GROUP BY fa)",
    "q", 10, source="fit JOIN lik ON fa = a",
)
_fit2 = sql.lattice(LINEITEM, LIKE, COUNTS_ONLY | SUMS, 2, {"nn": "count(*)"})
ORACLE["search_line_likelihood"] = sql.ranked(
    f"{_fit2}, fit AS (SELECT *, {_line} AS slope, (sy - {_line} * sx) / n AS icpt FROM stats, whole WHERE n > 2), "
    "res AS (SELECT fit.key AS fk, exp(-0.5 * power(slope * l_discount + icpt - l_tax, 2)) / 2.5066282746310002 AS d, x.rid IS NOT NULL AND (fit.b IS NULL OR y.rid IS NOT NULL) AS hit "
    "FROM fit CROSS JOIN src LEFT JOIN sat x ON x.i = fit.a AND x.rid = src.rid LEFT JOIN sat y ON y.i = fit.b AND y.rid = src.rid), "
    "lik AS (SELECT fk, avg(d) FILTER (hit) - avg(d) FILTER (NOT hit) AS q FROM res GROUP BY fk)",
    "q", 10, source="fit JOIN lik ON fk = key",
)
add("search_line_likelihood_1", "lineitem", LINEITEM, Line("l_discount", "l_tax"), LIKE, M.Likelihood(), None, depth=1)

CELL = Conjunction([Equality("l_linestatus", "F"), Interval("l_quantity", hi=10.0)])
IN = "(l_linestatus = 'F' AND l_quantity < 10)"
_s = lambda a, b: f"({a}) / nullif({b}, 0)::DOUBLE"
_binary = {
    "size_sg": "n", "size_dataset": "nn", "positives_sg": "p", "positives_dataset": "pp", "size_complement": "nn - n", "relative_size_sg": _s("n", "nn"), "relative_size_complement": _s("nn - n", "nn"), "coverage_sg": _s("p", "pp"),
    "coverage_complement": _s("pp - p", "pp"), "target_share_sg": _s("p", "n"), "target_share_complement": _s("pp - p", "nn - n"), "target_share_dataset": _s("pp", "nn"), "lift": "(p / n::DOUBLE) / (pp / nn::DOUBLE)",
}


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def _round(names: dict[str, str]) -> str:
    return ", ".join(f"{e}::BIGINT AS {n}" if n.startswith(("size", "positives")) else f"round({e}, 9) AS {n}" for n, e in names.items())


@query("describe_binary", f"WITH s AS (SELECT count(*) FILTER ({IN}) n, count(*) nn, count(*) FILTER ({IN} AND {R_IS}) p, count(*) FILTER ({R_IS}) pp FROM lineitem) SELECT {_round(_binary)} FROM s")
def describe_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.describe(read(spark, sf_dir, "lineitem"), RETURNED, CELL))


_o = "(o_orderstatus = 'F' AND o_custkey < 500)"
_numeric = {"size_sg": f"count(*) FILTER ({_o})", "size_dataset": "count(*)"} | {f"{n}_{w}": f"{f}(o_totalprice)" + (f" FILTER ({_o})" if w == "sg" else "") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("median", "median"), ("max", "max"), ("min", "min")) for w in ("sg", "dataset")}
_numeric |= {"mean_lift": f"avg(o_totalprice) FILTER ({_o}) / avg(o_totalprice)", "median_lift": f"median(o_totalprice) FILTER ({_o}) / median(o_totalprice)"}
OLD = Conjunction([Equality("o_orderstatus", "F"), Interval("o_custkey", hi=500.0)])


@query("describe_numeric", "SELECT " + ", ".join(f"{e} AS {n}" if n.startswith("size") else f"round({e}, 5) AS {n}" for n, e in _numeric.items()) + " FROM orders")
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.describe(read(spark, sf_dir, "orders"), Numeric(PRICE), OLD), 5)


@query("describe_itemsets", f"SELECT count(*) FILTER ({IN}) AS size_sg, count(*) AS size_dataset FROM lineitem")
def describe_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.describe(read(spark, sf_dir, "lineitem"), Itemsets(), CELL)


@query("describe_line", f"WITH s AS (SELECT count(*) n, sum(l_discount) sx, sum(l_tax) sy, sum(l_discount * l_discount) sxx, sum(l_discount * l_tax) sxy FROM lineitem WHERE {IN}), f AS (SELECT {_line} AS b, (sy - {_line} * sx) / n AS c FROM s), r AS (SELECT {IN} AS hit, b, c, exp(-0.5 * power(b * l_discount + c - l_tax, 2)) / 2.5066282746310002 AS d FROM lineitem, f) SELECT count(*) FILTER (hit) AS size_sg, count(*) AS size_dataset, round(any_value(b), 9) AS slope, round(any_value(c), 9) AS intercept, round(avg(d) FILTER (hit), 9) AS likelihood_sg, round(avg(d) FILTER (NOT hit), 9) AS likelihood_complement FROM r")
def describe_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.describe(read(spark, sf_dir, "lineitem"), Line("l_discount", "l_tax"), CELL))


@query("target_constants", "SELECT count(*) AS n, round(avg(o_totalprice), 5) AS mean, round(median(o_totalprice), 5) AS median, round(stddev_pop(o_totalprice), 5) AS std, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def target_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Numeric(PRICE).prepare(read(spark, sf_dir, "orders"))
    return spark.createDataFrame([(c.n, round(c.mean, 5), round(c.median, 5), round(c.std, 5), c.low, c.high)], "n long, mean double, median double, std double, low double, high double")


@query("covers_of_every_form", f"SELECT count(*) FILTER ({IN}) AS conj, count(*) FILTER (l_linestatus = 'F' OR l_quantity < 10) AS disj, count(*) FILTER ({IN} OR l_tax < 0.02) AS dnf, count(*) AS everything, 0::BIGINT AS nothing, count(*) FILTER (l_linestatus <> 'F') AS negated, 0::BIGINT AS other_type FROM lineitem")
def covers_of_every_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    forms = {"conj": CELL, "disj": Disjunction(CELL.selectors), "dnf": DNF((CELL, Conjunction([Interval("l_tax", hi=0.02)]))), "everything": Conjunction(()), "nothing": Disjunction(()), "negated": Conjunction([Negated(Equality("l_linestatus", "F"))]), "other_type": Conjunction([Equality("l_linestatus", 1)])}
    return df.agg(*[F.count_if(d.column(df.schema)).alias(n) for n, d in forms.items()])


@query("covers_with_missing", "SELECT count(*) FILTER (quality = 1) AS eq, count(*) FILTER (quality IS NULL) AS isnull, count(*) FILTER (quality <> 1) AS negated, count(quality) AS valid, count(*) FILTER (quality >= 0 AND quality < 1) AS interval FROM (" + LABELLED + ")")
def covers_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q = labelled(spark, sf_dir), Equality("quality", 1)
    forms = {"eq": q, "isnull": IsNull("quality"), "negated": Negated(q), "valid": Negated(IsNull("quality")), "interval": Interval("quality", 0, 1)}
    return df.agg(*[F.count_if(s.column(df.schema)).alias(n) for n, s in forms.items()])


@query("cover_rows", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {IN}")
def cover_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CELL.covered(read(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber")


@query("space_nominal", "SELECT 'c_mktsegment' AS attribute, c_mktsegment AS value FROM customer GROUP BY 2")
def space_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = space.nominal_selectors(read(spark, sf_dir, "customer"), ignore=("c_name",))
    return spark.createDataFrame([(s.attribute, s.value) for s in found], "attribute string, value string")


def _cut_sql(bins: int) -> str:
    """Equal-frequency cutpoints: each the least value at or after its place and above the one before."""
    steps = ["v AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders)", "c0 AS (SELECT '-infinity'::DOUBLE AS v)"]
    steps += [f"c{i} AS (SELECT min(v.v) AS v FROM v, c{i - 1} WHERE v.i >= ({i} * n) // {bins} AND v.v > c{i - 1}.v)" for i in range(1, bins)]
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS place, v AS cutpoint FROM c{i} WHERE v IS NOT NULL" for i in range(1, bins))


@query("space_equal_frequency", _cut_sql(7))
def space_equal_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(space.equal_frequency_cutpoints(read(spark, sf_dir, "orders"), PRICE, 7), 1)), "place int, cutpoint double")


@query("space_equal_width", "SELECT i::INTEGER AS place, round(lo + i * (hi - lo) / 5, 6) AS cutpoint FROM (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders), range(1, 5) AS r(i)")
def space_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = read(spark, sf_dir, "orders").agg(F.min(PRICE), F.max(PRICE)).first()
    return spark.createDataFrame([(i, round(c, 6)) for i, c in enumerate(space.equal_width_cutpoints(low, high, 5), 1)], "place int, cutpoint double")


@query("space_numeric_equalities", "SELECT DISTINCT l_linenumber::DOUBLE AS value FROM lineitem")
def space_numeric_equalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = space.numeric_selectors(read(spark, sf_dir, "lineitem").select("l_linenumber"), bins=7)
    return spark.createDataFrame([(float(s.value),) for s in found], "value double")


@query("space_size", "SELECT 16::BIGINT AS selectors, (16 + 120 + 560)::BIGINT AS conjunctions")
def space_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(len(LINES), space.space_size(len(LINES), 3))], "selectors long, conjunctions long")


@query("table_missing_counts", f"SELECT count(*) - count(doc_id) AS doc_id, count(*) - count(lang) AS lang, count(*) - count(quality) AS quality FROM ({LABELLED})")
def table_missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.missing_counts(labelled(spark, sf_dir).select("doc_id", "lang", "quality"))


@query("table_categories", "SELECT p_brand AS value, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code, min(p_partkey) AS first FROM part GROUP BY p_brand")
def table_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.categories(read(spark, sf_dir, "part"), "p_brand", "p_partkey").select("value", F.col("code").cast("long").alias("code"), "first")


@query("table_head", "SELECT p_partkey, p_brand FROM part WHERE p_partkey < 20")
def table_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.head_rows(read(spark, sf_dir, "part"), 20, "p_partkey").select("p_partkey", "p_brand")


@query("table_typed_text", "SELECT c_custkey::BIGINT AS c_custkey, c_acctbal::DOUBLE AS c_acctbal, c_mktsegment FROM customer")
def table_typed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "customer").select(*[F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_acctbal", "c_mktsegment")])
    return table.typed(raw)


@query("table_from_csv", "SELECT * FROM (VALUES (1::BIGINT, 1.5::DOUBLE, true, 'x'), (2, NULL, false, NULL)) AS t(i, f, b, c)")
def table_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.from_csv(spark, 'i,f,b,c\r\n1,1.5,True,"x"\r\n2,NA,FALSE,\r\n').drop(table.RID)


@query("table_content_hash")
def table_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.content_hash(read(spark, sf_dir, "part"))


@query("synth_tie_stress", "SELECT i AS _rid, 'A' || (i % 8 % 2) AS c1, 'B' || (i % 8 // 2 % 2) AS c2, 'C' || (i % 8 // 4) AS c3, 'D' || (i % 8 % 2) AS d1, (i // 8 < CASE WHEN i % 2 = 0 THEN 6 ELSE 3 END)::BIGINT AS y FROM range(96) AS r(i)")
def synth_tie_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.tie_stress(spark)


def draw_sql(seed: int, at: str = "i") -> str:
    return f"(('0x' || substr(md5({at} || ':{seed}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def pick_sql(values: str, seed: int) -> str:
    """One of the letters of `values`."""
    return f"substr('{values}', (floor({draw_sql(seed)} * {len(values)}) + 1)::INTEGER, 1)"


PLANTED = f"SELECT i AS _rid, {pick_sql('pqr', 1)} AS a1, {pick_sql('xyz', 2)} AS a2, " + ", ".join(f"'v' || {pick_sql('012', 101 + m)} AS m{m}" for m in range(4))
PLANTED = f"SELECT *, ({draw_sql(3, '_rid')} < CASE WHEN a1 = 'p' AND a2 = 'x' THEN 0.95 ELSE 0.25 END)::BIGINT AS y FROM ({PLANTED} FROM range(3000) AS r(i))"
POCKET = canonical([Equality(a, v) for a, values in (("a1", "pqr"), ("a2", "xyz")) for v in values] + [Equality(f"m{m}", f"v{v}") for m in (0, 1) for v in range(3)])


@query("synth_planted", sql.ranked(sql.lattice(PLANTED, POCKET, fill(COUNTS, "y = 1"), 2, fill(SHARES, "y = 1")), WRACC, 3, "0.0"))
def synth_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = synth.planted_binary(spark, 3000, 1)
    sel = space.nominal_selectors(df.select("a1", "a2", "m0", "m1"))
    return listed(spark, S.apriori(Task(df, binary("y", 1), sel, M.wracc(), 3, 2, 0.0)), tuple(sel))


_top8 = sql.lattice(LINEITEM, FLAGS, {"n": "count(*)"}, 1, {"nn": "count(*)"}) + ", top AS (SELECT a, n, row_number() OVER (ORDER BY n DESC, a) - 1 AS i FROM stats ORDER BY n DESC, a LIMIT 8)"
_quoted = lambda t: "'" + t.replace("'", "''") + "'"
_texts = "(VALUES " + ", ".join(f"({i}, {_quoted(dialect.print_selector(s))})" for i, s in enumerate(FLAGS)) + ") AS t(place, subgroup)"


_flag_counts = sql.lattice(LINEITEM, FLAGS, fill(COUNTS, "l_quantity >= 25"), 1, fill(SHARES, "l_quantity >= 25"))
_fields = ", ".join(f"round(({e})::DOUBLE, 9) AS {n}" for n, e in _binary.items())


@query("results_frame", f"{_flag_counts} SELECT CAST(row_number() OVER (ORDER BY n DESC, a) AS INTEGER) AS rank, n::DOUBLE AS quality, 1::INTEGER AS depth, subgroup, n::DOUBLE AS estimate, {_fields} FROM stats JOIN {_texts} ON place = a, whole ORDER BY n DESC, a LIMIT 8")
def results_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.from_json(R.to_json(_flags(spark, sf_dir))).frame(spark))


def _flags(spark: SparkSession, sf_dir: str) -> R.Results:
    return S.search(Task(read(spark, sf_dir, "lineitem"), Binary(Interval("l_quantity", lo=25.0)), FLAGS, M.Count(), 8, 1, 0.0))




@query("results_overlaps", f"{_top8}, hit AS (SELECT top.i AS t, sat.rid FROM top JOIN sat ON sat.i = top.a), pairs AS (SELECT x.t AS i, y.t AS j, count(*) AS c FROM hit x JOIN hit y ON x.rid = y.rid AND x.t < y.t GROUP BY 1, 2) SELECT pairs.i::INTEGER AS i, pairs.j::INTEGER AS j, c AS \"both\", (p.n + q.n - c)::BIGINT AS either FROM pairs JOIN top p ON p.i = pairs.i JOIN top q ON q.i = pairs.j")
def results_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlaps(read(spark, sf_dir, "lineitem"), _flags(spark, sf_dir).entries)


_listed = "SELECT CAST(row_number() OVER (ORDER BY n DESC, a) AS INTEGER) AS rank, CAST(a AS VARCHAR) AS key, 1::INTEGER AS depth, n AS size, round(n::DOUBLE, 9) AS quality FROM top"
_near = (
    f"{_top8}, hit AS (SELECT top.i AS t, sat.rid FROM top JOIN sat ON sat.i = top.a), pairs AS (SELECT x.t AS i, y.t AS j, count(*) AS c FROM hit x JOIN hit y ON x.rid = y.rid AND x.t < y.t GROUP BY 1, 2), "
    "near AS (SELECT pairs.i, pairs.j FROM pairs JOIN top p ON p.i = pairs.i JOIN top q ON q.i = pairs.j WHERE c > 0.5 * (p.n + q.n - c)), kept0 AS (SELECT 0::BIGINT AS i)"
) + "".join(f", kept{j} AS (SELECT i FROM kept{j - 1} UNION ALL SELECT {j}::BIGINT WHERE NOT EXISTS (SELECT 1 FROM near JOIN kept{j - 1} k ON k.i = near.i WHERE near.j = {j}))" for j in range(1, 8))


@query("results_overlap_filter", f"{_near} {_listed} WHERE i IN (SELECT i FROM kept7)")
def results_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, R.overlap_filter(_flags(spark, sf_dir), 0.5), FLAGS)


@query("results_statistic_filter", f"{_top8} SELECT CAST(row_number() OVER (ORDER BY n DESC, a) AS INTEGER) AS rank, CAST(a AS VARCHAR) AS key, 1::INTEGER AS depth, n AS size, round(n::DOUBLE, 9) AS quality FROM top, whole WHERE n <= nn / 3.0")
def results_statistic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _flags(spark, sf_dir)
    return listed(spark, R.maximum_statistic(found, "relative_size_sg", 1 / 3), FLAGS)


@query("results_minimum_quality", f"{_top8} SELECT CAST(row_number() OVER (ORDER BY n DESC, a) AS INTEGER) AS rank, CAST(a AS VARCHAR) AS key, 1::INTEGER AS depth, n AS size, round(n::DOUBLE, 9) AS quality FROM top WHERE n >= 1000")
def results_minimum_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, R.minimum_quality(_flags(spark, sf_dir), 1000.0), FLAGS)


_used = "CASE " + " ".join(f"WHEN {{x}} = {i} THEN '{s.attribute}'" for i, s in enumerate(LINES)) + " ELSE '' END"


@query(
    "results_unique_attributes",
    sql.lattice(LINEITEM, LINES, fill(COUNTS, R_IS), 2, fill(SHARES, R_IS)) + f", best AS (SELECT *, {WRACC} AS quality FROM stats, whole ORDER BY {_order} LIMIT 10), "
    f"named AS (SELECT *, {_used.format(x='a')} || ',' || {_used.format(x='b')} AS used FROM best), "
    f"firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY used ORDER BY {_order}) = 1 OR used IN ('l_linestatus,', 'l_linestatus,l_linestatus')) "
    f"SELECT CAST(row_number() OVER (ORDER BY {_order}) AS INTEGER) AS rank, key, CAST(depth AS INTEGER) AS depth, n::BIGINT AS size, round(quality, 9) AS quality FROM firsts",
)
def results_unique_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    return listed(spark, R.unique_attributes(S.search(Task(df, RETURNED, LINES, M.wracc(), 10, 2)), df), LINES)


@query("results_roc", sql.lattice(LINEITEM, LINES, fill(COUNTS, R_IS), 1, fill(SHARES, R_IS)) + f", best AS (SELECT *, {WRACC} AS q FROM stats, whole ORDER BY q DESC, a LIMIT 5) SELECT CAST(row_number() OVER (ORDER BY q DESC, a) AS INTEGER) AS rank, round((n - p) / (nn - pp)::DOUBLE, 9) AS fpr, round(p / pp::DOUBLE, 9) AS tpr FROM best")
def results_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search(Task(read(spark, sf_dir, "lineitem"), RETURNED, LINES, M.wracc(), 5, 1))
    return spark.createDataFrame([(i, round(x, 9), round(y, 9)) for i, (x, y) in enumerate(R.roc_points(found), 1)], "rank int, fpr double, tpr double")


@query("results_histogram", f"WITH w AS (SELECT min(l_extendedprice) lo, (max(l_extendedprice) - min(l_extendedprice)) / 12 AS d FROM lineitem) SELECT least(floor((l_extendedprice - lo) / d), 11)::INTEGER AS bin, {IN} AS covered, count(*) AS rows FROM lineitem, w GROUP BY 1, 2")
def results_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", CELL, 12)


FORMS = [Equality("x", 5, True), Equality("s", "it"), Equality("b", True), IsNull("s"), Interval("x", 0.125, 2.0), Interval("x", hi=3, whole=True), Interval("x", lo=1e16), Interval("x"), Negated(Equality("s", "a"))]
PRINTED = [
    ("x==5", "x==5"), ("s=='it'", "s=='it'"), ("b==True", "b==True"), ("s.isnull()", "s.isnull()"), ("x: [0.125:2.0[", "x: [0.12:2.0["), ("x<3", "x<3"), ("x>=1e+16", "x>=1e+16"), ("x = anything", "x = anything"), ("(not s=='a')", "NOT s=='a'"),
]


@query("text_forms", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)}, true)" for i, (a, b) in enumerate(PRINTED)) + ") AS t(place, query, display, same)")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, dialect.print_selector(s), dialect.print_selector(s, "display"), dialect.parse_selector(dialect.print_selector(s)) == s) for i, s in enumerate(FORMS)]
    return spark.createDataFrame(rows, "place int, query string, display string, same boolean")


@query("results_text", "SELECT 'quality,subgroup,size_sg,size_dataset,positives_sg,positives_dataset,size_complement,relative_size_sg,relative_size_complement,coverage_sg,coverage_complement,target_share_sg,target_share_complement,target_share_dataset,lift' AS header, 8::BIGINT AS rows")
def results_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _flags(spark, sf_dir).to_csv().splitlines()
    return spark.createDataFrame([(lines[0], len(lines) - 1)], "header string, rows long")


@query("space_of_cubes", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, sum((o_totalprice >= 100000)::BIGINT)::BIGINT AS p FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))")
def space_of_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equalities of two attributes: the lattice's counts are those of grouping sets."""
    df = read(spark, sf_dir, "orders")
    sel = canonical(space.nominal_selectors(df.select("o_orderstatus", "o_orderpriority")))
    every = M.combined((M.wracc(), 1.0))
    found = S.exhaustive(Task(df, Binary(Interval("o_totalprice", lo=100000.0)), sel, every, 1000, 2))
    value = lambda e, a: next((s.value for s in e.description.selectors if s.attribute == a), "*")
    rows = [(value(e, "o_orderstatus"), value(e, "o_orderpriority"), int(e.stats["size_sg"]), int(e.stats["positives_sg"])) for e in found.entries]
    return spark.createDataFrame(rows, "status string, priority string, n long, p long")


@query("scalar_density", "SELECT l_orderkey, l_linenumber, round(exp(-0.5 * l_discount * l_discount) / 2.5066282746310002, 12) AS density FROM lineitem")
def scalar_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", F.round(scalars.normal_density(F.col("l_discount")), 12).alias("density"))


@query("scalar_chi2_tail", f"WITH t AS (SELECT q, round({tail_sql('q')}, 12) AS p FROM (SELECT DISTINCT l_quantity AS q FROM lineitem)) SELECT l_orderkey, l_linenumber, p FROM lineitem JOIN t ON q = l_quantity")
def scalar_chi2_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", F.round(scalars.chi2_tail_column(F.col("l_quantity")), 12).alias("p"))
