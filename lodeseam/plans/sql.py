"""The same questions as plain SQL, for checking: selectors as predicates, lattices as self-joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from lodeseam.functions.selectors import Equality, Interval, IsNull, Negated, Selector


def predicate(s: Selector) -> str:
    """A condition that is never null."""
    a = f'"{s.attribute}"'
    if isinstance(s, Equality):
        value = "'" + s.value.replace("'", "''") + "'" if isinstance(s.value, str) else str(s.value).upper() if isinstance(s.value, bool) else repr(s.value)
        return f"coalesce({a} = {value}, false)"
    if isinstance(s, IsNull):
        return f"{a} IS NULL"
    if isinstance(s, Interval):
        parts = [f"{a} IS NOT NULL"] + ([f"{a} >= {s.lo!r}"] if s.lo > -math.inf else []) + ([f"{a} < {s.hi!r}"] if s.hi < math.inf else [])
        return "coalesce(" + " AND ".join(parts) + ", false)"
    assert isinstance(s, Negated)
    return f"({a} IS NOT NULL AND NOT {predicate(s.inner)})"


def lattice(source: str, selectors: Sequence[Selector], measures: dict[str, str], depth: int, constants: dict[str, str], form: str = "conjunction") -> str:
    """CTEs up to `stats`: key, depth, a, b, c and the measures of every set; `whole` has the table's constants.

    `measures` maps a name to an aggregate over the columns of `source`; `rid` numbers the rows.
    """
    sat = " UNION ALL ".join(f"SELECT rid, {i} AS i FROM src WHERE {predicate(s)}" for i, s in enumerate(selectors))
    fields = ", ".join(f"{a} AS {n}" for n, a in measures.items())
    whole = ", ".join(f"{a} AS {n}" for n, a in constants.items())
    out = [f"src AS (SELECT *, row_number() OVER () AS rid FROM ({source}) AS given)", f"whole AS (SELECT {whole} FROM src)", f"sat AS ({sat})"]
    levels = []
    for d in range(1, depth + 1):
        names = "abc"[:d]
        if form == "conjunction" or d == 1:
            joined = "sat s1" + "".join(f" JOIN sat s{k} ON s{k}.rid = s1.rid AND s{k - 1}.i < s{k}.i" for k in range(2, d + 1))
            keys, rows = [f"s{k}.i" for k in range(1, d + 1)], f"{joined} JOIN src ON src.rid = s1.rid"
        else:
            n = len(selectors)
            sets = " JOIN ".join(f"range({n}) AS r{k}(i)" + (f" ON r{k - 1}.i < r{k}.i" if k > 1 else "") for k in range(1, d + 1))
            hit = f"SELECT DISTINCT {', '.join(f'r{k}.i AS i{k}' for k in range(1, d + 1))}, sat.rid FROM {sets} JOIN sat ON sat.i IN ({', '.join(f'r{k}.i' for k in range(1, d + 1))})"
            keys, rows = [f"hit.i{k}" for k in range(1, d + 1)], f"({hit}) AS hit JOIN src ON src.rid = hit.rid"
        picked = ", ".join(f"{k} AS {n}" for k, n in zip(keys, names, strict=True)) + "".join(f", NULL AS {n}" for n in "abc"[d:])
        key = " || '-' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
        levels.append(f"SELECT {key} AS key, {d} AS depth, {picked}, {fields} FROM {rows} GROUP BY {', '.join(keys)}")
    out.append("stats AS (" + " UNION ALL ".join(levels) + ")")
    return "WITH " + ", ".join(out)


def ranked(ctes: str, quality: str, k: int, above: str = "'-infinity'::DOUBLE", having: str = "true", source: str = "stats, whole", places: int = 9) -> str:
    """The k best sets: rank, key, depth, size and the quality to that many places."""
    scored = f"SELECT *, {quality} AS quality FROM {source}"
    return (
        f"{ctes}, scored AS ({scored}), best AS (SELECT * FROM scored WHERE quality IS NOT NULL AND NOT isnan(quality) AND quality > {above} AND {having} ORDER BY quality DESC, depth, a, b NULLS FIRST, c NULLS FIRST LIMIT {k}) "
        f"SELECT CAST(row_number() OVER (ORDER BY quality DESC, depth, a, b NULLS FIRST, c NULLS FIRST) AS INTEGER) AS rank, key, CAST(depth AS INTEGER) AS depth, CAST(n AS BIGINT) AS size, round(quality, {places}) AS quality FROM best"
    )
