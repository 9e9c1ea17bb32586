"""The searches again, in plain Python over rows: the independent path that exactness is tested against."""

import itertools
import math

from lodeseam.functions.selectors import Equality, Interval, IsNull, Negated


def holds(s, row):
    v = row[s.attribute]
    if isinstance(s, IsNull):
        return v is None
    if v is None:
        return False
    if isinstance(s, Equality):
        same = isinstance(v, bool) == isinstance(s.value, bool) and isinstance(v, str) == isinstance(s.value, str)
        return same and v == s.value
    if isinstance(s, Interval):
        return s.lo <= v < s.hi
    assert isinstance(s, Negated)
    return not holds(s.inner, row)


def covers(rows, selectors, items, form="conjunction"):
    test = all if form == "conjunction" else any
    return [test(holds(selectors[i], r) for i in items) for r in rows]


def lattice(selectors, depth):
    return [t for d in range(1, depth + 1) for t in itertools.combinations(range(len(selectors)), d)]


def standard(a, rows, y):
    N, P = len(rows), sum(y)

    def q(cover):
        n, p = sum(cover), sum(v for v, c in zip(y, cover) if c)
        return None if n == 0 else (n / N) ** a * (p / n - P / N)

    return q


def standard_numeric(a, t, centre=None, of=None):
    mean = sum(t) / len(t) if centre is None else centre

    def q(cover):
        own = [v for v, c in zip(t, cover) if c]
        return None if not own else len(own) ** a * ((of or (lambda x: sum(x) / len(x)))(own) - mean)

    return q


def chi2(rows, y, least):
    N, P = len(rows), sum(y)

    def q(cover):
        n, p = sum(cover), sum(v for v, c in zip(y, cover) if c)
        if n < least or N - n < least or n in (0, N):
            return -math.inf
        cells = ((p, P * n / N), (P - p, P * (N - n) / N), (n - p, (N - P) * n / N), (N - n - P + p, (N - P) * (N - n) / N))
        return sum((o - e) ** 2 / e for o, e in cells)

    return q


def best(rows, selectors, depth, k, quality, above=-math.inf, support=0, form="conjunction"):
    found = []
    for t in lattice(selectors, depth):
        cover = covers(rows, selectors, t, form)
        q = quality(cover)
        if q is not None and q > above and sum(cover) >= support:
            found.append((-q, len(t), t))
    return sorted(found)[:k]
