"""Queries of the parts around a search: tables in and out, generated tables, spaces, text forms, hooks."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions import dialect, scalars
from lodeseam.functions import measures as M
from lodeseam.functions.selectors import Conjunction, Equality, Interval, IsNull, Negated, canonical, negated
from lodeseam.operators import results as R
from lodeseam.operators import search as S
from lodeseam.operators import space
from lodeseam.operators.lattice import Lattice
from lodeseam.operators.stats import order_name
from lodeseam.operators.targets import Numeric
from lodeseam.plans import sql
from lodeseam.plans.queries import CELL, COUNTS, FLAGS, IN, LINEITEM, LINES, ORACLE, ORDER, ORDERS, PRICE, QUERIES, R_IS, RETURNED, SHARES, WRACC, draw_sql, fill, listed, pick_sql, query, read
from lodeseam.plans.queries import _flags, _listed, _quoted, _top8
from lodeseam.plans.task import Constraint, Task, prepare
from lodeseam.sources import synth, table

_before = set(QUERIES)


def _values(rows: list[tuple], names: str) -> str:
    """SQL of a small table."""
    text = lambda v: "NULL" if v is None else _quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS t({names})"


@query("table_from_columns", "SELECT * FROM (VALUES (0::BIGINT, 7::BIGINT, 0.5::DOUBLE, true, 'red', '1'), (1, 8, NULL, NULL, NULL, '2'), (2, 9, -2.0, false, 'blue', NULL)) AS t(_rid, i, x, b, s, c)")
def table_from_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.from_columns(spark, {"i": [7, 8.0, 9], "x": [0.5, float("nan"), -2], "b": [True, None, False], "s": ["red", None, "blue"], "c": {"kind": "categorical", "values": [1, 2, None]}})


@query("table_from_rows", "SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE, 'u', NULL), (1, NULL, 'v', true), (2, 3.0, NULL, false)) AS t(_rid, p, q, r)")
def table_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.from_rows(spark, [{"p": 1, "q": "u"}, {"q": "v", "r": True}, {"p": 3, "r": False}])


@query("table_to_csv", "SELECT n_nationkey::BIGINT AS place, n_nationkey || ',' || n_name || ',\"' || n_name || ', \"\"' || n_regionkey || '\"\"\"' AS line FROM nation")
def table_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes and separators are escaped; the header line is left out here."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(table.RID), "n_nationkey", "n_name", F.concat("n_name", F.lit(', "'), F.col("n_regionkey").cast("string"), F.lit('"')).alias("both"))
    lines = table.to_csv(n).splitlines()
    assert lines[0] == "n_nationkey,n_name,both"
    return spark.createDataFrame(list(enumerate(lines[1:])), "place long, line string")


@query("table_to_rows", "SELECT (row_number() OVER (ORDER BY r_regionkey) - 1)::BIGINT AS place, r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def table_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
    rows = table.to_rows(df.withColumn(table.RID, F.col("r_regionkey")))
    return spark.createDataFrame([(i, r["r_regionkey"], r["r_name"]) for i, r in enumerate(rows)], "place long, r_regionkey long, r_name string")


@query("synth_draws", "SELECT i AS id, " + ", ".join(f"{draw_sql(k)} AS u{k}" for k in (1, 2)) + " FROM range(2000) AS r(i)")
def synth_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(2000).select("id", *[synth.draw(k).alias(f"u{k}") for k in (1, 2)])


def _normal_sql(u: str, v: str) -> str:
    return f"sqrt(-2.0::DOUBLE * ln(1.0 - {u})) * cos(2.0::DOUBLE * pi() * {v})"


_numeric_rows = f"SELECT i AS _rid, {pick_sql('uvw', 5)} AS b1, {pick_sql('mno', 6)} AS b2, " + ", ".join(f"'v' || {pick_sql('012', 105 + m)} AS m{m}" for m in range(4)) + " FROM range(2000) AS r(i)"


@query("synth_planted_numeric", f"SELECT _rid, b1, b2, m0, m1, m2, m3, round({_normal_sql(draw_sql(7, '_rid'), draw_sql(8, '_rid'))} + CASE WHEN b1 = 'u' AND b2 = 'm' THEN 2.0 ELSE 0.0 END, 9) AS t FROM ({_numeric_rows})")
def synth_planted_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.planted_numeric(spark, 2000, 5).withColumn("t", F.round("t", 9))


_gap = lambda e, k: f"CASE WHEN {draw_sql(3 + k)} >= 0.35 THEN {e} END"
_letters = lambda names, seed: f"['{names[0]}', '{names[1]}', '{names[-1]}'][(floor({draw_sql(seed)} * {len(names)}) + 1)::INTEGER]"


@query(
    "synth_missing_values",
    f"SELECT _rid, g1, CASE WHEN g1 IS NULL AND _rid % 5 = 0 THEN 'none' ELSE g2 END AS g2, x1, x2, t, y FROM (SELECT i AS _rid, {_gap(_letters(['a', 'b', 'none'], 3), 10)} AS g1, {_gap(_letters(['k', 'l'], 4), 11)} AS g2, "
    f"{_gap(f'floor({draw_sql(5)} * 5)::DOUBLE', 12)} AS x1, round({_normal_sql(draw_sql(6), draw_sql(9))}, 9) AS x2, round({_normal_sql(draw_sql(7), draw_sql(10))}, 9) AS t, ({draw_sql(8)} < 0.4)::BIGINT AS y FROM range(1500) AS r(i))",
)
def synth_missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.na_stress(spark, 1500, 3).withColumns({"x2": F.round("x2", 9), "t": F.round("t", 9)})


@query("synth_duplicate_rows", f"SELECT h1, h2, x, y FROM (SELECT {pick_sql('abc', 4)} AS h1, {pick_sql('xy', 5)} AS h2, (floor({draw_sql(6)} * 3) + 1) * 10.0::DOUBLE AS x, ({draw_sql(7)} < 0.5)::BIGINT AS y, unnest(range((floor({draw_sql(8)} * 9) + 1)::BIGINT)) AS copy FROM range(300) AS r(i))")
def synth_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.dup_rows(spark, 300, 4)


def _spelled(selectors: list) -> list[tuple[int, str]]:
    return [(i, dialect.print_selector(s)) for i, s in enumerate(selectors)]


@query("space_explicit_cutpoints", _values([(0, "l_quantity<10.0"), (1, "l_quantity: [10.0:24.5["), (2, "l_quantity>=24.5")], "place, selector"))
def space_explicit_cutpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_quantity")
    return spark.createDataFrame(_spelled(space.numeric_selectors(df, method=[10, 24.5])), "place int, selector string")


@query("space_one_sided_intervals", _values([(0, "x>=1.5"), (1, "x<1.5"), (2, "x>=4.0"), (3, "x<4.0")], "place, selector"))
def space_one_sided_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_spelled(space.intervals("x", [1.5, 4.0], between=False)), "place int, selector string")


_status = "SELECT DISTINCT 'l_linestatus==''' || l_linestatus || '''' AS s FROM lineitem UNION ALL SELECT DISTINCT 'l_linenumber==' || l_linenumber FROM lineitem"


@query("space_with_negations", f"SELECT s AS selector FROM ({_status}) UNION ALL SELECT '(not ' || s || ')' FROM ({_status})")
def space_with_negations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_linestatus", "l_linenumber")
    return spark.createDataFrame([(t,) for _, t in _spelled(space.all_selectors(df, bins=7, negations=True))], "selector string")


@query("space_without_attributes", f"SELECT s AS selector FROM ({_status}) WHERE s LIKE 'l_linenumber%'")
def space_without_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_linestatus", "l_linenumber")
    return spark.createDataFrame([(t,) for _, t in _spelled(space.remove_attributes(space.all_selectors(df, bins=7), ["l_linestatus"]))], "selector string")


_fit = " UNION ALL ".join(f"SELECT '{c}' AS attribute WHERE (SELECT {test.format(c=c)} FROM customer)" for c, test in (("c_custkey", "count(DISTINCT {c}) < count(*)"), ("c_name", "count(DISTINCT {c}) <= 25"), ("c_mktsegment", "count(DISTINCT {c}) <= 25"), ("c_nationkey", "count(DISTINCT {c}) < count(*)"), ("c_acctbal", "count(*) >= 0")))


@query("space_suggested_attributes", _fit)
def space_suggested_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")
    return spark.createDataFrame([(a,) for a in space.suggest_attributes(df)], "attribute string")


@query("space_suggested_target", "SELECT 'l_linestatus' AS attribute, l_linestatus AS value FROM lineitem GROUP BY l_linestatus ORDER BY count(*), l_linestatus LIMIT 1")
def space_suggested_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([space.suggest_target(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"))], "attribute string, value string")


PLAIN = [Equality("s", "a"), Equality("x", 2, True), Equality("b", False), IsNull("s"), Interval("x", lo=0.5), Interval("x", -1.0, 3.0), Negated(Equality("s", "a"))]
STORED = [
    '{"attribute": "s", "kind": "equality", "value": "a", "whole": false}', '{"attribute": "x", "kind": "equality", "value": 2, "whole": true}', '{"attribute": "b", "kind": "equality", "value": false, "whole": false}', '{"attribute": "s", "kind": "isNull"}',
    '{"attribute": "x", "hi": {"$f": "inf"}, "kind": "interval", "lo": 0.5, "whole": false}', '{"attribute": "x", "hi": 3.0, "kind": "interval", "lo": -1.0, "whole": false}', '{"inner": {"attribute": "s", "kind": "equality", "value": "a", "whole": false}, "kind": "negated"}',
]


@query("selectors_as_json", _values([(i, t, True) for i, t in enumerate(STORED)], "place, stored, same"))
def selectors_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infinite bounds carry a tag, and every selector comes back equal."""
    rows = [(i, json.dumps(R.selector_to_dict(s), sort_keys=True), R.selector_from_dict(R.selector_to_dict(s)) == s) for i, s in enumerate(PLAIN)]
    return spark.createDataFrame(rows, "place int, stored string, same boolean")


@query("results_json_round_trip", f"{_top8} {_listed}")
def results_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, R.from_json(R.to_json(_flags(spark, sf_dir))), FLAGS)


PAIRS = [(), (Equality("s", "b"), Equality("b", True)), (Interval("x", 0.125, 2.0), Negated(IsNull("s"))), (Equality("s", "b"), Equality("s", "b"))]
SPELLED = [("True", "Dataset"), ("b==True and s=='b'", "b==True AND s=='b'"), ("(not s.isnull()) and x: [0.125:2.0[", "NOT s.isnull() AND x: [0.12:2.0["), ("s=='b'", "s=='b'")]


@query("text_of_conjunctions", _values([(i, *t, True) for i, t in enumerate(SPELLED)], "place, query, display, same"))
def text_of_conjunctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated parts are one, parts are sorted, and the query form reads back."""
    made = [Conjunction(p) for p in PAIRS]
    rows = [(i, dialect.print_conjunction(c), dialect.print_conjunction(c, "display"), dialect.parse_conjunction(dialect.print_conjunction(c)) == c) for i, c in enumerate(made)]
    return spark.createDataFrame(rows, "place int, query string, display string, same boolean")


MIXED = [Interval("x", 1.0, 2.0), Equality("x", 3, True), Equality("a", "z"), Equality("a", "b"), IsNull("a"), Equality("x", 3, True), negated(negated(Equality("a", "b")))]


@query("selectors_canonical", _values([(0, "a=='b'"), (1, "a=='z'"), (2, "a.isnull()"), (3, "x==3"), (4, "x: [1.0:2.0[")], "place, selector"))
def selectors_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by attribute, kind and operands; equal ones are one, also under two negations."""
    return spark.createDataFrame(_spelled(list(canonical(MIXED))), "place int, selector string")


NUMBERS = [(0.1, "0.1", "0.10"), (2.0, "2.0", "2.00"), (1e16, "1e+16", "10000000000000000.00"), (0.125, "0.125", "0.12"), (-1.5, "-1.5", "-1.50")]


@query("scalar_number_text", _values(NUMBERS, "x, shortest, fixed"))
def scalar_number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x, scalars.python_float(x), scalars.fixed(x, 2)) for x, _, _ in NUMBERS], "x double, shortest string, fixed string")


@query("results_minimum_statistic", f"{_top8} {_listed}, whole WHERE n >= nn / 4.0")
def results_minimum_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, R.minimum_statistic(_flags(spark, sf_dir), "relative_size_sg", 0.25), FLAGS)


@query("results_preview", f"SELECT l_orderkey * 10 + l_linenumber AS _rid, l_quantity FROM lineitem WHERE {IN} ORDER BY 1 LIMIT 10")
def results_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").withColumn(table.RID, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return R.preview(df, CELL).select(table.RID, "l_quantity")


_custom = "p - n / 2.0::DOUBLE"
_lattice2 = sql.lattice(LINEITEM, LINES, fill(COUNTS, R_IS), 2, fill(SHARES, R_IS))


@query("search_custom_measure", sql.ranked(_lattice2, _custom, 10))
def search_custom_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure from two columns; its bound, the number of positives over two, may prune."""
    m = M.Custom(lambda c: F.col("p") - F.col("n") / 2.0, lambda c: F.col("p") / 2.0, ("binary",), True)
    return listed(spark, S.search(Task(read(spark, sf_dir, "lineitem"), RETURNED, LINES, m, 10, 2)), LINES)


@query("search_custom_constraint", sql.ranked(_lattice2, WRACC, 10, having="n % 3 = 0 AND p < 2000"))
def search_custom_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (Constraint("thirds", lambda c: F.col("n") % 3 == 0), Constraint("few", lambda c: F.col("p") < 2000))
    return listed(spark, S.search(Task(read(spark, sf_dir, "lineitem"), RETURNED, LINES, M.wracc(), 10, 2, constraints=rules)), LINES)


@query("search_without_pruning", sql.ranked(_lattice2, WRACC, 10))
def search_without_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, S.apriori(Task(read(spark, sf_dir, "lineitem"), RETURNED, LINES, M.wracc(), 10, 2), pruning=False), LINES)


_sums = {"n": "count(*)", "excess": "sum(greatest(o_totalprice - mean, 0))", "tail_n": "count(*) FILTER (o_totalprice > mean)", "tail_max": "max(o_totalprice) - any_value(mean)"}
_priced = "SELECT *, avg(o_totalprice) OVER () AS mean FROM orders"
_ranked = "SELECT i, o_totalprice - mean AS w, row_number() OVER (PARTITION BY i ORDER BY o_totalprice DESC) AS j FROM sat JOIN src ON src.rid = sat.rid"


@query(
    "numeric_bounds",
    sql.lattice(_priced, ORDERS, _sums, 1, {"nn": "count(*)"}) + f", ranked AS ({_ranked}), running AS (SELECT i, j, sum(w) OVER (PARTITION BY i ORDER BY j) AS run FROM ranked), "
    "bound AS (SELECT i, max(run) AS whole_bound, max(run / sqrt(j)) AS root_bound FROM running GROUP BY i) "
    "SELECT a::INTEGER AS selector, n, round(excess, 2) AS excess, tail_n, round(greatest(tail_max, 0), 2) AS tail_max, round(whole_bound, 2) AS order_1, round(root_bound, 2) AS order_half FROM stats JOIN bound ON i = a",
)
def numeric_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What estimates read of every single selector: excess and tail over the mean, and the ordered bounds."""
    both = M.combined(M.StandardNumeric(1.0, estimator="order"), M.StandardNumeric(0.5, estimator="order"))
    lattice = Lattice(prepare(Task(read(spark, sf_dir, "orders"), Numeric(PRICE), ORDERS, both, 1, 1)))
    found = lattice.all_statistics(1)
    number = lambda c: F.round(F.col(c).cast("double"), 2)
    return found.select(F.col("items")[0].alias("selector"), "n", number("excess").alias("excess"), "tail_n", F.coalesce(number("tail_max"), F.lit(0.0)).alias("tail_max"), number(order_name(1.0)).alias("order_1"), number(order_name(0.5)).alias("order_half"))


#: The queries of this module.
NAMES = [n for n in itertools.chain(QUERIES) if n not in _before]
