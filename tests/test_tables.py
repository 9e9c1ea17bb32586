"""CSV, typing, missing values, canonical order, text forms, selector spaces and generators."""

import math

import pytest

from lodeseam.errors import CsvError, DialectError, ValidationError
from lodeseam.functions import dialect, scalars
from lodeseam.functions.selectors import Conjunction, Equality, Interval, IsNull, Negated, canonical, equality, negated
from lodeseam.operators import space
from lodeseam.sources import synth, table


def test_csv_records():
    read = lambda t: list(table.csv_records(t))
    assert read('a,b\n1,"x ""y""\n z"\r\n\n"",2\n') == [["a", "b"], ["1", 'x "y"\n z'], ["", "2"]]
    assert read('a\n""\n \n') == [["a"], [""], [" "]] and read("a,\n,b") == [["a", ""], ["", "b"]] and read('"x"y\n') == [["xy"]] and read("a,b,") == [["a", "b", ""]]
    assert read("") == [] and list(table.csv_records("a;b", ";")) == [["a", "b"]]
    for bad in ('x"y"', "a\rb", '"open', '"a"b"c'):
        with pytest.raises(CsvError):
            read(bad)


def test_csv_tables(spark, tmp_path):
    text = "i,f,b,c,n,m\n1,1.5,True,x,NA,1\n2,,false,,NaN,a\n"
    df = table.from_csv(spark, text)
    assert dict(df.dtypes) == {"_rid": "bigint", "i": "bigint", "f": "double", "b": "boolean", "c": "string", "n": "string", "m": "string"}
    assert [tuple(r.values()) for r in table.to_rows(df)] == [(1, 1.5, True, "x", None, "1"), (2, None, False, None, None, "a")]
    assert dict(table.from_csv(spark, text, {"i": "categorical"}).dtypes)["i"] == "string"
    assert table.from_csv(spark, "a\nNA\n", na_tokens=["-"]).first().a == "NA"
    for bad in ("", "a,a\n1,2\n", "a,b\n1\n", "a\n"):
        with pytest.raises(CsvError):
            table.from_csv(spark, bad)
    with pytest.raises(CsvError):
        table.from_csv(spark, text, {"m": "numeric"})
    (tmp_path / "t.csv").write_text(text)
    assert table.read_csv(spark, str(tmp_path)).dtypes == df.drop("_rid").dtypes
    assert table.to_csv(df).splitlines()[1] == "1,1.5,True,x,,1"


def test_columns_and_rows(spark):
    df = table.from_columns(spark, {"a": [True, None], "b": [1, float("nan")], "c": [1, 2.0], "d": [1, "x"], "e": [None, None], "f": {"kind": "categorical", "values": [1, 2]}})
    assert [t for _, t in df.dtypes[1:]] == ["boolean", "double", "bigint", "string", "string", "string"]
    assert table.missing_counts(df).first().asDict() == {"_rid": 0, "a": 1, "b": 1, "c": 0, "d": 0, "e": 2, "f": 0}
    assert table.from_rows(spark, [{"x": 1}, {"y": "b"}]).drop("_rid").collect()[1].asDict() == {"x": None, "y": "b"}
    assert table.value_at(df, "c", 1) == 2 and table.head_rows(df, 1).count() == 1
    for bad in ({}, {"a": [1], "b": [1, 2]}, {"a": {"kind": "numeric", "values": ["x"]}}):
        with pytest.raises(ValidationError):
            table.from_columns(spark, bad)
    with pytest.raises(ValidationError):
        table.value_at(df, "zz", 0)
    codes = table.categories(table.from_columns(spark, {"v": ["b", "a", None, "b"]}), "v").orderBy("code").collect()
    assert [(r.value, r.code) for r in codes] == [("b", 0), ("a", 1)]
    a, b = (table.content_hash(df.repartition(n)).first() for n in (1, 3))
    assert a == b != table.content_hash(df.limit(1)).first()


def test_missing_values(spark):
    df = table.from_columns(spark, {"x": [1.0, 2.0, None, 1.0, 3.0], "cat": ["a", None, "b", "a", "b"]})
    mask = lambda s: [int(r[0]) for r in df.orderBy("_rid").select(s.column(df.schema)).collect()]
    assert mask(Equality("x", 1.0)) == [1, 0, 0, 1, 0] and mask(Negated(Equality("x", 1.0))) == [0, 1, 0, 0, 1]
    assert mask(IsNull("cat")) == [0, 1, 0, 0, 0] and mask(Negated(IsNull("cat"))) == [1, 0, 1, 1, 1] and mask(Negated(Negated(IsNull("cat")))) == [0] * 5
    assert mask(Equality("cat", 1)) == [0] * 5 and mask(Negated(Equality("cat", 1))) == [1, 0, 1, 1, 1]
    assert mask(Interval("x", 1, 3)) == [1, 1, 0, 1, 0] and mask(Negated(Interval("x", 1, 3))) == [0, 0, 0, 0, 1] and mask(Interval("x")) == [1, 1, 0, 1, 1]
    assert equality("x", math.nan) == IsNull("x") and negated(negated(Equality("x", 1))) == Equality("x", 1)
    with pytest.raises(ValidationError):
        mask(Interval("cat", 0, 1))
    with pytest.raises(ValidationError):
        Interval("x", 2, 2)


def test_canonical_order():
    want = [Equality("a", False), Equality("a", True), Equality("a", 1), Equality("a", 10.0), Equality("a", "1"), Equality("a", "é"), Equality("a", "😀"), IsNull("a"), Interval("a", 0, 5), Interval("a", 0), Negated(Equality("a", 1)), Negated(IsNull("a")), Equality("b", 1)]
    assert list(canonical(want[::-1] + want)) == want
    assert Conjunction(want[2:4]) == Conjunction(want[3:1:-1]) and Equality("a", 1) == Equality("a", 1.0) != Equality("a", True)


def test_text_forms():
    for s, query, display in (
        (Equality("x", 5, True), "x==5", "x==5"), (Equality("x", 5.0), "x==5.0", "x==5.0"), (Equality("s", "it"), "s=='it'", "s=='it'"), (Equality("b", True), "b==True", "b==True"), (IsNull("s"), "s.isnull()", "s.isnull()"),
        (Interval("x", 0.125, 2.0), "x: [0.125:2.0[", "x: [0.12:2.0["), (Interval("x", hi=3, whole=True), "x<3", "x<3"), (Interval("x", lo=1e16), "x>=1e+16", "x>=1e+16"), (Interval("x"), "x = anything", "x = anything"),
        (Negated(Equality("s", "a")), "(not s=='a')", "NOT s=='a'"),
    ):
        assert (dialect.print_selector(s), dialect.print_selector(s, "display")) == (query, display)
        assert dialect.parse_selector(query) == s
    both = Conjunction([Equality("s", "a and b"), Equality("x", 1.0)])
    assert dialect.print_conjunction(both) == "s=='a and b' and x==1.0" and dialect.parse_conjunction("s=='a and b' and x==1.0") == both
    assert dialect.print_conjunction(Conjunction(())) == "True" and dialect.print_conjunction(Conjunction(()), "display") == "Dataset" and dialect.parse_conjunction("True") == Conjunction(())
    with pytest.raises(DialectError):
        dialect.parse_selector("what is this")


def walk(values, bins):
    v, out = sorted(values), []
    for i in range(1, bins):
        at = i * len(v) // bins
        while at < len(v) and v[at] in out:
            at += 1
        if at < len(v):
            out.append(v[at])
    return out


@pytest.mark.parametrize("values", [[1, 1, 1, 1, 2, 3], [5, 5, 5], list(range(20)), [3, 1, 2, 2, 2, 2, 9, 9, 0.5], [None, 1, None, 4, 8]])
def test_cutpoints(spark, values):
    df = table.from_columns(spark, {"x": values})
    for bins in (2, 5):
        assert space.equal_frequency_cutpoints(df, "x", bins) == walk([v for v in values if v is not None], bins)


def test_spaces(spark):
    df = table.from_columns(spark, {"s": ["b", None, "a", "b", "c"], "b": [True, False, None, True, True], "x": [1, 2, 3, 4, 5], "z": [0.5, None, 0.5, 1.5, 0.5]})
    assert space.nominal_selectors(df) == [Equality("s", "b"), IsNull("s"), Equality("s", "a"), Equality("s", "c"), Equality("b", True), Equality("b", False), IsNull("b")]
    assert space.numeric_selectors(df, bins=2) == [Interval("x", hi=3), Interval("x", lo=3), IsNull("z"), Equality("z", 0.5), Equality("z", 1.5)]
    assert space.numeric_selectors(df, ["z"], 2, between=False) == [Interval("x", lo=3), Interval("x", hi=3)]
    assert space.numeric_selectors(df, ["z"], method=[2, 4]) == [Interval("x", hi=2), Interval("x", 2, 4), Interval("x", lo=4)]
    assert space.numeric_selectors(df, ["z"], 4, "equal_width") == space.intervals("x", [2.0, 3.0, 4.0])
    assert len(space.all_selectors(df, negations=True)) == 2 * len(space.all_selectors(df)) and space.space_size(5, 2) == 15
    assert {s.attribute for s in space.remove_attributes(space.all_selectors(df), ["s"])} == {"b", "x", "z"}
    assert space.suggest_target(df) == ("b", False) and "x" not in space.suggest_attributes(df)
    for bad in (lambda: space.numeric_selectors(df, bins=1), lambda: space.numeric_selectors(df, method=[2, 1]), lambda: space.numeric_selectors(df, method="no")):
        with pytest.raises(ValidationError):
            bad()


def test_generators(spark):
    ties = synth.tie_stress(spark)
    assert ties.count() == 96 and ties.where("c1 = 'A0' and c2 = 'B0'").count() == 24 and ties.where("c1 = 'A0' or c2 = 'B0'").count() == 72
    df = synth.planted_binary(spark, 2000, 3)
    share = {r[0]: r[1] for r in df.selectExpr("a1 = 'p' and a2 = 'x' as inside", "y").groupBy("inside").avg("y").collect()}
    assert share[True] > 0.85 and share[False] < 0.35
    assert synth.planted_numeric(spark, 2000, 3).where("b1 = 'u' and b2 = 'm'").agg({"t": "avg"}).first()[0] > 1.5
    assert synth.dup_rows(spark, 20, 1).count() >= 20 and synth.na_stress(spark, 100, 1).where("x1 is null").count() > 15
    assert len(synth.wide_synth(spark, 100, 4, numeric=True).columns) == 6


def test_scalars(spark):
    assert scalars.chi2_tail(0.4) == pytest.approx(0.5270892568655381, rel=1e-13) and scalars.chi2_tail(-1) == 1
    assert scalars.chi2_tail(7.5, 2) == pytest.approx(math.exp(-3.75)) and scalars.chi2_tail(7.8147279, 3) == pytest.approx(0.05, rel=1e-6) and scalars.chi2_tail(9.487729, 4) == pytest.approx(0.05, rel=1e-6)
    xs = [0.0, 1e-6, 0.1, 0.4, 3.84, 7.9, 8.1, 20.0, 90.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.orderBy("x").select(scalars.chi2_tail_column(df["x"])).collect()]
    assert got == pytest.approx([scalars.chi2_tail(x) for x in xs], rel=1e-9)
    assert scalars.fixed(0.125, 2) == "0.12" and scalars.python_float(1e16) == "1e+16"


def test_scalar_queries_cover_the_whole_table(spark, tmp_path):
    from lodeseam.plans.queries import QUERIES

    rows = [(k, n, n / 100, float(n)) for k in (1, 999, 1000, 70_000) for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {"scalar_density": lambda r: math.exp(-0.5 * r[2] ** 2) / scalars.ROOT_TAU, "scalar_chi2_tail": lambda r: scalars.chi2_tail(r[3])}
    for name, value in want.items():
        got = {r[:2]: r[2] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {r[:2]: pytest.approx(value(r), abs=1e-11) for r in rows}
