"""Measures on hand-made tables, and every engine against brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodeseam.errors import AbortedError, SearchSpaceError, ValidationError
from lodeseam.functions import measures as M
from lodeseam.functions.selectors import DNF, Conjunction, Disjunction, Equality, Interval, IsNull, Negated, canonical
from lodeseam.operators import results as R
from lodeseam.operators import search as S
from lodeseam.operators import space, stats
from lodeseam.operators.targets import Binary, Itemsets, Line, Numeric, binary
from lodeseam.plans.task import Constraint, Task, min_support
from lodeseam.sources import synth
from lodeseam.sources.table import from_columns, to_rows
from tests import brute

SHOPS = {"city": ["K", "K", "L", "L", "L", "M", "M", "K", "L", "M", "K", "M", "L"], "late": ["no", "yes", "no", "no", "yes", "yes", "no", "yes", "yes", "yes", "no", "no", "no"], "y": [1, 1, 0, 0, 1, 1, 1, 0, 0, 1, 0, 0, 0]}
GAPS = {"tag": ["u", "v", None, "u", None, "v", "w", "u", "w"], "y": [1, 1, 0, 1, 1, 0, 0, 0, 1]}
LOADS = {"t": [3.0, 9.5, 4.0, 4.0, 11.0, 6.5, 1.0, 8.0, 2.0, 12.5], "dock": ["n", "n", "s", "s", "s", "n", "n", "s", "s", "n"], "kind": ["box", "bag", "bag", "box", "bag", "box", "box", "bag", "bag", "bag"]}
TRACKS = {"x": [0, 1, 2, 4, 5, 1, 3, 4, 6, 7], "v": [1, 3, 5, 9, 11, 2, 2, 1, 0, 3], "side": ["up"] * 5 + ["flat"] * 5}


@pytest.fixture(scope="module")
def tables(spark):
    return {name: from_columns(spark, columns).cache() for name, columns in {"shops": SHOPS, "gaps": GAPS, "loads": LOADS, "tracks": TRACKS}.items()}


def records(columns):
    return [dict(zip(columns, values)) for values in zip(*columns.values())]


def only(df, target, measure, *selectors):
    """The quality of one conjunction."""
    chosen = canonical(selectors)
    got = S.exhaustive(Task(df, target, chosen, measure, k=100, depth=len(chosen)))
    return {e.description: e for e in got.entries}[Conjunction(chosen)]


def test_binary_measures(tables):
    rows, y = records(SHOPS), SHOPS["y"]
    N, P = len(y), sum(y)
    counts = lambda *given: [(sum(c), sum(v for v, hit in zip(y, c) if hit)) for c in [[all(r[s.attribute] == s.value for s in given) for r in rows]]][0]
    for city, late in (("K", "yes"), ("L", "no"), ("M", "yes")):
        one, two = Equality("city", city), Equality("late", late)
        at = lambda m, *s: only(tables["shops"], binary("y", 1), m, *s)
        (n, p), (n2, p2), (n12, p12) = counts(one), counts(two), counts(one, two)
        wracc, lift = n / N * (p / n - P / N), p / n - P / N
        assert at(M.wracc(), one).quality == pytest.approx(wracc) and at(M.wracc(), one).estimate == pytest.approx(p / N * (1 - P / N))
        assert at(M.lift(), one).quality == pytest.approx(lift) and at(M.simple_binomial(), one).quality == pytest.approx(math.sqrt(n / N) * lift)
        cells = ((p, P * n / N), (P - p, P * (N - n) / N), (n - p, (N - P) * n / N), (N - n - P + p, (N - P) * (N - n) / N))
        chi2 = sum((seen - due) ** 2 / due for seen, due in cells)
        assert at(M.ChiSquared(least=1), one).quality == pytest.approx(chi2)
        assert at(M.ChiSquared(least=1, stat="p_value"), one).quality == pytest.approx(math.erfc(math.sqrt(chi2 / 2)), rel=1e-12)
        assert at(M.ChiSquared("positive", 1), one).quality == pytest.approx(chi2 if lift > 0 else -chi2) and at(M.ChiSquared("negative", 1), one).quality == pytest.approx(chi2 if lift < 0 else -chi2)
        both = at(M.combined(M.wracc(), (M.lift(), 2.0)), one)
        assert both.quality == pytest.approx(wracc + 2 * lift) and both.estimate == pytest.approx((p / N + 2) * (1 - P / N))
        q = lambda n, p: n / N * (p / n - P / N)
        assert at(M.GeneralizationAware(M.wracc()), one, two).quality == pytest.approx(q(n12, p12) - max(0, q(n, p), q(n2, p2)))
        highest = max(P / N, p / n, p2 / n2)
        assert at(M.GaStandard(1.0), one, two).quality == pytest.approx(n12 / N * (p12 / n12 - highest)) == at(M.GaStandard(1.0, "max"), one, two).quality
    rows, y = records(GAPS), GAPS["y"]
    for s in (Equality("tag", "u"), Negated(Equality("tag", "u")), IsNull("tag")):
        assert only(tables["gaps"], binary("y", 1), M.wracc(), s).quality == pytest.approx(brute.standard(1.0, rows, y)([brute.holds(s, r) for r in rows]))


def test_numeric_measures(tables):
    t, N = LOADS["t"], len(LOADS["t"])
    mean, middle = sum(t) / N, statistics.median(t)
    at = lambda m, *s: only(tables["loads"], Numeric("t"), m, *s)
    for kind in ("bag", "box"):
        s, own = Equality("kind", kind), [v for v, k in zip(t, LOADS["kind"]) if k == kind]
        n, away = len(own), sum(own) / len(own) - mean
        for a in (0.0, 0.5, 1.0):
            assert at(M.StandardNumeric(a), s).quality == pytest.approx(n**a * away) and at(M.StandardNumeric(a, invert=True), s).quality == pytest.approx(-(n**a) * away)
        for sign in (1, -1):
            over = sorted((sign * (v - mean) for v in own), reverse=True)
            high = [v for v in over if v > 0]
            order = lambda a: max(j**a * sum(over[:j]) / j for j in range(1, n + 1))
            bound = lambda a, how: at(M.StandardNumeric(a, sign < 0, how), s).estimate
            want = [sum(high), len(high) * high[0] if high else 0, math.sqrt(len(high)) * high[0] if high else 0, order(1.0), order(0.5)]
            assert [bound(1.0, "sum"), bound(1.0, "max"), bound(0.5, "average"), bound(1.0, "order"), bound(0.5, "order")] == pytest.approx(want)
        med, above = at(M.StandardMedian(), s), [v - middle for v in own if v > middle]
        assert (med.quality, med.estimate) == pytest.approx((n * (statistics.median(own) - middle), n * max(above) if above else 0))
        assert at(M.TScore(), s).quality == pytest.approx(math.sqrt(n) * away / statistics.pstdev(own))
        table = stats.describe(tables["loads"], Numeric("t"), Conjunction([s])).first()
        want = [n, N, sum(own) / n, mean, statistics.pstdev(own), statistics.pstdev(t), statistics.median(own), middle, max(own), max(t), min(own), min(t), sum(own) / n / mean, statistics.median(own) / middle]
        assert list(table) == pytest.approx(want)
        assert at(M.GaStandardNumeric(), s).quality == pytest.approx(n / N * away)
        north = Equality("dock", "n")
        both, dock = [v for v, k, d in zip(t, LOADS["kind"], LOADS["dock"]) if (k, d) == (kind, "n")], [v for v, d in zip(t, LOADS["dock"]) if d == "n"]
        assert at(M.GaStandardNumeric(), north, s).quality == pytest.approx(len(both) / N * (sum(both) / len(both) - max(mean, sum(own) / n, sum(dock) / len(dock))))
        sets = lambda m, *s: only(tables["loads"], Itemsets(), m, *s).quality
        assert sets(M.Count(), s) == n and sets(M.Area(), north, s) == 2 * len(both)


def test_line(tables):
    s, density = Equality("side", "up"), lambda r: math.exp(-r * r / 2) / math.sqrt(2 * math.pi)
    one = only(tables["tracks"], Line("x", "v"), M.Likelihood(), s)
    assert (one.stats["slope"], one.stats["intercept"]) == pytest.approx((2, 1))
    assert one.quality == pytest.approx(density(0) - sum(density(2 * x + 1 - v) for x, v in zip(TRACKS["x"][5:], TRACKS["v"][5:])) / 5)
    with pytest.raises(ValidationError):
        S.exhaustive(Task(tables["tracks"], Line("x", "v", 2), [s], M.Likelihood()))


SHOP_SELECTORS = [Equality("city", "K"), Equality("city", "L"), Equality("city", "M"), Equality("late", "yes"), Equality("late", "no")]


def test_order_threshold_and_support(tables):
    sel, rows = canonical(SHOP_SELECTORS), records(SHOPS)
    quality = brute.standard(1.0, rows, SHOPS["y"])
    task = Task(tables["shops"], binary("y", 1), sel, M.wracc(), k=20, depth=2)
    same(S.exhaustive(task), sel, brute.best(rows, sel, 2, 20, quality))
    above = S.apriori(Task(**{**task.__dict__, "min_quality": 0.0}))
    same(above, sel, brute.best(rows, sel, 2, 20, quality, 0.0))
    few = S.apriori(Task(**{**task.__dict__, "k": 4, "constraints": (min_support(4),)}))
    same(few, sel, brute.best(rows, sel, 2, 4, quality, support=4))
    assert few.entries[0].stats["size_sg"] >= 4 and len(above.entries) < 11


@pytest.mark.parametrize("engine", [S.apriori, S.dfs, S.best_first])
@pytest.mark.parametrize("powers", [(0.0, 1.0), (1.0, 0.5), (0.5, 0.5)])
def test_combinations_of_different_powers_lose_nothing(spark, engine, powers):
    rng = random.Random(str(powers))
    columns = {"a": [rng.choice("xyz") for _ in range(150)], "b": [rng.choice("uvw") for _ in range(150)], "c": [rng.choice("kl") for _ in range(150)], "t": [float(rng.randrange(100)) for _ in range(150)]}
    df = from_columns(spark, columns)
    m = M.combined(*[M.StandardNumeric(a, estimator="order") for a in powers])
    task = Task(df, Numeric("t"), space.nominal_selectors(df), m, 8, 2)
    assert [(e.quality, e.description) for e in engine(task).entries] == [(e.quality, e.description) for e in S.exhaustive(task).entries]


@pytest.mark.parametrize("m", [M.StandardNumeric(1.5, True, "order"), M.StandardMedian(1.0)])
def test_values_ranked_in_ranges_give_the_same(spark, monkeypatch, m):
    from lodeseam.operators import lattice

    rng = random.Random(11)
    df = from_columns(spark, {"a": [rng.choice("xyz") for _ in range(120)], "b": [rng.choice("uv") for _ in range(120)], "t": [float(rng.randrange(30)) for _ in range(120)]})
    task = Task(df, Numeric("t"), space.nominal_selectors(df), m, 12, 2)
    figures = lambda: [(e.quality, e.estimate, e.description) for e in S.exhaustive(task).entries]
    at_once = figures()
    monkeypatch.setattr(lattice, "RANKED_AT_ONCE", 0)
    assert [e[0::2] for e in figures()] == [e[0::2] for e in at_once] and [e[1] for e in figures()] == pytest.approx([e[1] for e in at_once])
    if isinstance(m, M.StandardNumeric):
        rows, mean = list(to_rows(df)), df.agg({"t": "avg"}).first()[0]
        for _, estimate, d in at_once:
            own = sorted((r["t"] for r in rows if all(brute.holds(s, r) for s in d.selectors)))
            assert estimate == pytest.approx(max(j**1.5 * (mean - sum(own[:j]) / j) for j in range(1, len(own) + 1)))


@pytest.fixture(scope="module")
def stress(spark):
    df = synth.na_stress(spark, 160, 5).cache()
    rows = list(to_rows(df))
    return df, rows, space.all_selectors(df, ignore=("t", "y"), bins=3)


CELLS = [
    ("binary", M.wracc(), 2, -math.inf, 0), ("binary", M.Standard(0.5), 2, 0.0, 12), ("binary", M.ChiSquared(), 2, 0.0, 0),
    ("numeric", M.StandardNumeric(1.0), 2, 0.0, 0), ("numeric", M.StandardMedian(0.5), 2, -math.inf, 5), ("itemsets", M.Area(2), 2, 0.0, 0),
]


def expected(cell, rows, sel, form="conjunction"):
    kind, m, depth, above, support = cell
    y, t = [r["y"] for r in rows], [r["t"] for r in rows]
    if kind == "itemsets":
        found = sorted((-sum(brute.covers(rows, sel, i)) * len(i), len(i), i) for i in brute.lattice(sel, depth))
        return [f for f in found if -f[0] > above][:10]
    q = {
        "Standard": lambda: brute.standard(m.a, rows, y), "ChiSquared": lambda: brute.chi2(rows, y, m.least), "StandardNumeric": lambda: brute.standard_numeric(m.a, t),
        "StandardMedian": lambda: brute.standard_numeric(m.a, t, statistics.median(t), statistics.median),
    }[type(m).__name__]()
    return brute.best(rows, sel, depth, 10, q, above, support, form)


def same(results, sel, want):
    place = {s: i for i, s in enumerate(sel)}
    got = [(-e.quality, e.description.depth, tuple(sorted(place[s] for s in e.description.selectors))) for e in results.entries]
    assert [g[0] for g in got] == pytest.approx([w[0] for w in want], rel=1e-9, abs=1e-12)
    tied = lambda q: any(abs(q - w[0]) < 1e-12 for w in want if w[0] != q) or abs(q - want[-1][0]) < 1e-9
    assert [g for g in got if not tied(g[0])] and all(g[1:] == w[1:] for g, w in zip(got, want) if not tied(w[0]))


@pytest.mark.parametrize("i", range(len(CELLS)))
def test_engines_agree_with_brute_force(stress, i):
    df, rows, selectors = stress
    kind, m, depth, above, support = cell = CELLS[i]
    target = {"binary": binary("y", 1), "numeric": Numeric("t"), "itemsets": Itemsets()}[kind]
    sel = canonical(selectors)
    task = Task(df, target, sel, m, 10, depth, above, (min_support(support),) if support else ())
    want = expected(cell, rows, sel)
    engines = [S.exhaustive, S.apriori, S.best_first] if i % 2 else [S.apriori, S.dfs]
    for engine in engines:
        same(engine(task), sel, want)
    if i == 0:
        same(S.apriori(task, pruning=False), sel, want)
        same(S.pattern_tree(task), sel, want)
        same(S.generalizing_bfs(task), sel, expected(cell, rows, sel, "disjunction"))
    if i == 3:
        same(S.dfs_numeric(task), sel, want)
        same(S.generalizing_bfs(task), sel, expected(cell, rows, sel, "disjunction"))
    if i == 4:
        same(S.generalizing_bfs(task), sel, expected(cell, rows, sel, "disjunction"))


def test_beam(stress):
    df, rows, selectors = stress
    sel = canonical(selectors)
    task = Task(df, binary("y", 1), sel, M.wracc(), 10, 2)
    wide = len(brute.lattice(sel, 2))
    same(S.beam_search(task, wide), sel, expected(CELLS[0], rows, sel))
    q = brute.standard(1.0, rows, [r["y"] for r in rows])
    score = lambda t: (-q(c), len(t), t) if sum(c := brute.covers(rows, sel, t)) else None
    first = sorted(filter(None, (score((i,)) for i in range(len(sel)))))[:12]
    children = {tuple(sorted({*t, s})) for _, _, t in first for s in range(len(sel)) if s not in t}
    same(S.beam_search(task, 12), sel, sorted([*first, *filter(None, map(score, children))])[:10])
    with pytest.raises(ValidationError):
        S.beam_search(task, 5)


def test_generalisations_against_brute_force(stress):
    df, rows, selectors = stress
    sel, y = canonical(selectors)[:9], [r["y"] for r in rows]
    q = brute.standard(1.0, rows, y)
    own = {t: q(brute.covers(rows, sel, t)) for t in brute.lattice(sel, 3)}
    subs = lambda t: [u for u in own if set(u) < set(t)]
    want = sorted((-(v - max([0.0, *(own[u] for u in subs(t) if own[u] is not None)])), len(t), t) for t, v in own.items() if v is not None)[:10]
    same(S.exhaustive(Task(df, binary("y", 1), sel, M.GeneralizationAware(M.wracc()), 10, 3)), sel, want)


def test_empty_covers_count_where_they_have_a_quality(tables):
    sel = [Equality("late", "yes"), Equality("late", "no")]
    got = S.exhaustive(Task(tables["shops"], Itemsets(), sel, M.Count(), 5, 2, -1.0))
    assert [(e.quality, e.description.depth) for e in got.entries] == [(7, 1), (6, 1), (0, 2)]
    bounded = S.exhaustive(Task(tables["shops"], Itemsets(), SHOP_SELECTORS, M.Count(), 20, 2, -1.0, (Constraint("few", lambda c: F.col("n") < 3),)))
    rows = records(SHOPS)
    want = [(sum(brute.covers(rows, canonical(SHOP_SELECTORS), i)), i) for i in brute.lattice(SHOP_SELECTORS, 2)]
    same(bounded, canonical(SHOP_SELECTORS), sorted((-n, len(i), i) for n, i in want if n < 3)[:20])


def test_task_errors(tables):
    shops, sel, y = tables["shops"], [Equality("city", "K")], binary("y", 1)
    for bad, error in (
        (Task(shops, y, [], M.wracc()), SearchSpaceError), (Task(shops, y, [Equality("y", 1)], M.wracc()), SearchSpaceError), (Task(shops, y, [Interval("city", 0, 1)], M.wracc()), SearchSpaceError),
        (Task(shops, y, sel, M.wracc(), k=0), ValidationError), (Task(shops, y, sel, M.StandardNumeric()), ValidationError), (Task(shops, Numeric("city"), [Equality("late", "no")], M.StandardNumeric()), ValidationError),
        (Task(shops, y, [Equality("nope", 1)], M.wracc()), ValidationError), (Task(shops, y, sel, M.wracc(), should_stop=lambda: True), AbortedError),
    ):
        with pytest.raises(error):
            S.search(bad)
    seen = []
    S.search(Task(shops, y, sel, M.wracc(), progress=seen.append))
    assert seen and seen[0]["layer"] == 1


def test_custom_measures_and_constraints(tables):
    rows, sel = records(SHOPS), canonical(SHOP_SELECTORS)
    m = M.Custom(lambda c: F.col("p") * 2.0 - F.col("n"), lambda c: F.col("p").cast("double"), ("binary",), True)
    odd = Constraint("odd", lambda c: F.col("n") % 2 == 1)
    want = []
    for i in brute.lattice(sel, 2):
        cover = brute.covers(rows, sel, i)
        n, p = sum(cover), sum(y for y, c in zip(SHOPS["y"], cover) if c)
        if n % 2:
            want.append((-(2.0 * p - n), len(i), i))
    for engine in (S.exhaustive, S.apriori, S.best_first):
        got = engine(Task(tables["shops"], binary("y", 1), sel, m, 6, 2, constraints=(odd,)))
        assert [(-e.quality, e.description.depth, tuple(sorted(map(sel.index, e.description.selectors)))) for e in got.entries] == sorted(want)[:6]


def test_descriptions(tables):
    shops, y = tables["shops"], binary("y", 1)
    k, m, no = Equality("city", "K"), Equality("city", "M"), Equality("late", "no")
    size = lambda d: stats.describe(shops, y, d).first().size_sg
    assert [size(Conjunction(())), size(Disjunction(())), size(Conjunction([k, no])), size(Disjunction([k, no])), size(DNF((Conjunction([k, no]), Conjunction([m]))))] == [13, 0, 2, 9, 6]
    row = stats.describe(shops, Binary(Negated(Equality("y", 0))), Conjunction(())).first()
    assert row.size_sg == 13 and row.target_share_complement is None and row.positives_sg == 6


def test_results(tables):
    df = tables["loads"]
    sel = [*space.nominal_selectors(df), Interval("t", 3, 8), Interval("t", 3, 9)]
    got = S.exhaustive(Task(df, Itemsets(), sel, M.Count(), 10, 1, 0.0))
    back = R.from_json(R.to_json(got), df)
    assert back.entries == got.entries and [r[0] for r in back.cover(0).collect()] == [r[0] for r in got.cover(0).collect()]
    with pytest.raises(ValidationError):
        R.from_json('{"format": "other"}')
    assert len(R.minimum_quality(got, 5).entries) == sum(e.quality >= 5 for e in got.entries)
    assert all(e.stats["size_sg"] <= 4 for e in R.maximum_statistic(got, "size_sg", 4).entries)
    with pytest.raises(ValidationError):
        R.minimum_statistic(got, "nope", 1)
    assert [s.attribute for e in R.unique_attributes(got, df).entries for s in e.description.selectors].count("t") == 1
    covers = [frozenset(r[0] for r in e.description.covered(df).select("_rid").collect()) for e in got.entries]
    kept = []
    for i, c in enumerate(covers):
        if all(len(c & covers[j]) <= 0.5 * len(c | covers[j]) for j in kept):
            kept.append(i)
    assert R.overlap_filter(got, 0.5).entries == tuple(got.entries[i] for i in kept)
    assert got.to_csv().splitlines()[0] == "quality,subgroup,size_sg,size_dataset"
    assert got.frame(df.sparkSession).count() == len(got.entries)
    assert sum(r.rows for r in R.histogram(df, "t", Conjunction([sel[0]]), 4).collect()) == 10
    binary_results = S.exhaustive(Task(tables["shops"], binary("y", 1), [Equality("late", "yes")], M.wracc()))
    assert R.roc_points(binary_results) == [pytest.approx((2 / 7, 4 / 6))]


def test_wide_spaces_use_products_and_agree(stress, monkeypatch):
    from lodeseam.operators import lattice

    monkeypatch.setattr(lattice, "WIDE", 2)
    df, rows, selectors = stress
    sel = canonical(selectors)
    same(S.apriori(Task(df, binary("y", 1), sel, M.wracc(), 10, 2)), sel, expected(CELLS[0], rows, sel))
    same(S.beam_search(Task(df, binary("y", 1), sel, M.wracc(), 10, 2), 500), sel, expected(CELLS[0], rows, sel))
    same(S.beam_search(Task(df, Numeric("t"), sel, M.StandardNumeric(1.0), 10, 2, 0.0), 500), sel, expected(CELLS[3], rows, sel))
    same(S.apriori(Task(df, binary("y", 1), sel, M.Standard(0.5), 10, 2, 0.0, (min_support(12),))), sel, expected(CELLS[1], rows, sel))
