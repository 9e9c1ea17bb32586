"""Tables: strict CSV, rows and columns into DataFrames, with missing values as nulls, and back out.

`_rid` is a row's place in its input; it only serves listings (first appearance, heads, covers).
"""

from __future__ import annotations

import csv as _csv
import io
import math
import re
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseam.errors import CsvError, ValidationError
from lodeseam.functions.selectors import kind_of

RID = "_rid"
#: Tokens that mean a missing value by default (fixed values, the usual ones of data-frame readers).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
WHOLE = r"^[+-]?\d+$"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def csv_records(text: str, delimiter: str = ",") -> Iterator[list[str]]:
    """Records of RFC 4180 text, LF or CRLF; a record of one empty unquoted field is skipped.

    Fields end at a delimiter, a line end or the text's end; a quoted part may be followed by plain
    characters. A quote inside a plain field, a lone CR and an open quote are errors.
    """
    field = re.compile(rf'(?:"((?:[^"]|"")*)")?([^"{re.escape(delimiter)}\r\n]*)')
    at, line, row = 0, 1, []
    plain = True
    while at < len(text) or row:
        m = field.match(text, at)
        quoted, rest = m[1], m[2]
        if quoted is None and text[m.end() : m.end() + 1] == '"':
            raise CsvError("a quote that is not closed" if m.end() == at else "a quote inside a plain field", line)
        plain = plain and quoted is None
        row.append((quoted or "").replace('""', '"') + rest)
        line += m[0].count("\n")
        at = m.end()
        end = text[at : at + 1]
        if end == delimiter:
            at += 1
            if at == len(text):
                row.append("")
                yield row
                return
            continue
        if end == "\r" and text[at + 1 : at + 2] != "\n":
            raise CsvError("a carriage return without a line feed", line)
        if end == '"':
            raise CsvError("a quote after a closed field", line)
        at += 2 if end == "\r" else 1
        line += 1
        if row != [""] or not plain:
            yield row
        row, plain = [], True


def from_csv(spark: SparkSession, text: str, overrides: Mapping[str, str] | None = None, na_tokens: Iterable[str] = NA_TOKENS, delimiter: str = ",") -> DataFrame:
    """A typed table of CSV text with a header; `overrides` forces categorical, numeric or boolean."""
    records = csv_records(text, delimiter)
    header = next(records, None)
    if header is None:
        raise CsvError("no header")
    if len(set(header)) < len(header):
        raise CsvError("a column name occurs twice", 1)
    rows = list(records)
    for i, r in enumerate(rows, 2):
        if len(r) != len(header):
            raise CsvError(f"record {i} has {len(r)} fields, the header {len(header)}")
    if not rows:
        raise CsvError("no records")
    schema = T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(h, T.StringType()) for h in header)])
    return typed(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema), overrides, na_tokens)


def read_csv(spark: SparkSession, path: str, overrides: Mapping[str, str] | None = None, na_tokens: Iterable[str] = NA_TOKENS, delimiter: str = ",") -> DataFrame:
    """Like from_csv() over files of any size, parsed by Spark's reader; records of blanks only are dropped there."""
    raw = spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=True, mode="FAILFAST", inferSchema=False, emptyValue="")
    return typed(raw, overrides, na_tokens)


def typed(raw: DataFrame, overrides: Mapping[str, str] | None = None, na_tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Text columns typed: whole numbers, numbers, truth values, else text; all missing is text.

    One aggregation decides all columns. A whole column without gaps is a BIGINT, which also records that
    its values print as whole numbers.
    """
    overrides, names = dict(overrides or {}), [c for c in raw.columns if c != RID]
    if unknown := set(overrides) - set(names):
        raise ValidationError(f"overrides name no column: {sorted(unknown)}")
    tokens = list(na_tokens)
    clean = lambda c: F.when(F.col(f"`{c}`").isin(tokens), None).otherwise(F.col(f"`{c}`"))
    tests = {"whole": lambda v: v.rlike(WHOLE), "number": lambda v: v.rlike(NUMBER), "truth": lambda v: v.isin(*TRUE, *FALSE), "full": lambda v: v.isNotNull()}
    found = raw.agg(*[F.coalesce(F.bool_and(t(clean(c))), F.lit(False)).alias(f"{n}:{i}") for i, c in enumerate(names) for n, t in tests.items()]).first()
    out = [F.col(RID)] if RID in raw.columns else []
    for i, c in enumerate(names):
        is_ = {n: found[f"{n}:{i}"] for n in tests}
        kind = overrides.get(c) or ("numeric" if is_["number"] else "boolean" if is_["truth"] else "categorical")
        if kind == "numeric" and not is_["number"] and overrides.get(c):
            bad = raw.where(~F.coalesce(clean(c).rlike(NUMBER), F.lit(True))).select(*out, clean(c)).first()
            if bad is not None:
                raise CsvError(f"column {c!r} is not numeric: {bad[-1]!r}" + (f" in row {bad[0]}" if out else ""))
        out.append(_cast(clean(c), kind, is_["whole"] and is_["full"]).alias(c))
    return raw.select(*out)


def _cast(value: Column, kind: str, whole: bool) -> Column:
    if kind == "numeric":
        return value.cast("bigint" if whole else "double")
    if kind == "boolean":
        return F.when(value.isin(*TRUE), True).when(value.isin(*FALSE), False)
    return value


def _missing(x: object) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))


def from_columns(spark: SparkSession, columns: Mapping[str, object]) -> DataFrame:
    """A table of equally long columns, each a list or {"kind", "values"}; None and NaN are missing."""
    if not columns:
        raise ValidationError("a table needs a column")
    kinds, values = {}, {}
    for name, given in columns.items():
        forced, data = (given["kind"], list(given["values"])) if isinstance(given, Mapping) else (None, list(given))
        present = [v for v in data if not _missing(v)]
        numbers = [v for v in present if isinstance(v, (int, float)) and not isinstance(v, bool)]
        truths = [v for v in present if isinstance(v, bool)]
        kind = forced or ("boolean" if present and len(truths) == len(present) else "numeric" if present and len(numbers) == len(present) else "categorical")
        if (kind == "numeric" and len(numbers) < len(present)) or (kind == "boolean" and len(truths) < len(present)):
            raise ValidationError(f"column {name!r} holds values that are not {kind}")
        whole = kind == "numeric" and len(present) == len(data) and all(isinstance(v, int) or float(v).is_integer() for v in present)
        cast = {"numeric": int if whole else float, "boolean": bool, "categorical": str}[kind]
        kinds[name] = {"numeric": T.LongType() if whole else T.DoubleType(), "boolean": T.BooleanType(), "categorical": T.StringType()}[kind]
        values[name] = [None if _missing(v) else cast(v) for v in data]
    if len({len(v) for v in values.values()}) > 1:
        raise ValidationError("columns differ in length")
    schema = T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(n, t) for n, t in kinds.items())])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(zip(*values.values(), strict=True))], schema)


def from_rows(spark: SparkSession, rows: list[Mapping[str, object]]) -> DataFrame:
    """A table of records over the union of their keys, in order of first use."""
    if not rows:
        raise ValidationError("no rows")
    names = list(dict.fromkeys(k for r in rows for k in r))
    return from_columns(spark, {n: [r.get(n) for r in rows] for n in names})


def present(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    return df.select(*[F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema])


def categories(df: DataFrame, attribute: str, order: str = RID) -> DataFrame:
    """(value, code, first): the distinct present values in order of first appearance."""
    from pyspark.sql import Window

    firsts = df.where(F.col(attribute).isNotNull()).groupBy(F.col(attribute).alias("value")).agg(F.min(order).alias("first"))
    return firsts.withColumn("code", F.row_number().over(Window.orderBy("first")) - 1)


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: how many values each column lacks."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def value_at(df: DataFrame, attribute: str, row: int) -> object:
    kind_of(df.schema, attribute)
    found = df.where(F.col(RID) == row).select(attribute).first()
    if found is None:
        raise ValidationError(f"no row {row}")
    return found[0]


def head_rows(df: DataFrame, n: int, order: str = RID) -> DataFrame:
    """The first n rows by input place."""
    return df.where(F.col(order) < n)


def content_hash(df: DataFrame) -> DataFrame:
    """One row: a fingerprint of all rows that does not depend on their order."""
    hashes = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(hashes).alias("fingerprint"))


def to_rows(df: DataFrame) -> Iterator[dict]:
    """Records in input order, partition by partition."""
    ordered = df.orderBy(RID).drop(RID) if RID in df.columns else df
    return (r.asDict() for r in ordered.toLocalIterator())


def csv_text(rows: Iterable[Mapping[str, object]], header: list[str]) -> str:
    """RFC 4180 text, missing values empty."""
    out = io.StringIO()
    writer = _csv.writer(out, lineterminator="\n")
    writer.writerow(header)
    writer.writerows(["" if _missing(r[h]) else r[h] for h in header] for r in rows)
    return out.getvalue()


def to_csv(df: DataFrame) -> str:
    return csv_text(to_rows(df), [c for c in df.columns if c != RID])


def write_csv(df: DataFrame, path: str) -> None:
    """Distributed: one file per partition."""
    df.drop(RID).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")
