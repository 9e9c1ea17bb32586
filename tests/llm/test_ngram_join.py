"""Components and sizes of the n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from lodeseam.llm import ngram_join, tokens
from lodeseam.llm.graph import components


def shingles(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").translate({9: " ", 10: " ", 13: " "}).split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(s), low.get(find(k), i) if s else i) for k, (i, s) in enumerate(sets))


def noisy(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=3):
    """Chains of edits, a large group of near copies, copies and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(25)]
    out = [" ".join(base)] * 5 + [noisy(rng, base, rng.choice([1, 1, 2, 3, 4])) for _ in range(60)]
    for _ in range(30):
        text = " ".join(word() for _ in range(rng.choice([3, 5, 9, 60])))
        out.append(text)
        for _ in range(rng.randrange(5)):
            text = noisy(rng, text.split(), 1)
            out.append(text)
    out += [" ".join([word() for _ in range(rng.choice([2, 10, 60]))] + passage) for _ in range(40)]
    out += ["", None, " \n", "a b c d", "A b\tC d", "a b c", "a b c d e", "x y z x y z x y z x y z"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [3, 4])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.jaccard_components(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_edge_rows(spark, docs, rows, empty):
    assert sorted(map(tuple, ngram_join.jaccard_components(docs).collect())) == brute([(r[0], r[1]) for r in rows])
    assert ngram_join.jaccard_components(empty).count() == 0


def test_bounds_are_exact():
    for a in range(1, 60):
        for b in range(1, 60):
            least = next((o for o in range(min(a, b) + 1) if 100 * o >= 75 * (a + b - o)), None)
            if least is not None:
                assert ngram_join.needed(a, b) == least
    assert [ngram_join.prefix_length(n) for n in (0, 1, 4, 8)] == [0, 1, 2, 3]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_word_hashes_follow_words(spark):
    import pyarrow as pa

    texts = ["Aa bb\tcc", None, "", "  aa", "é É aA", "x" * 9000, "bb"]
    h, off = tokens.word_hashes(pa.array(texts))
    assert list(np.diff(off)) == [3, 0, 0, 1, 3, 1, 1]
    assert h[0] == h[3] == h[6] and h[1] == h[8] and h[4] != h[5] and len(set(h.tolist())) == 6


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        both, one, two = (rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64) for _ in range(3))
        a, b = np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, two]))
        differ = len(np.setxor1d(a, b))
        assert ngram_join.differing(ngram_join.sketch(a), ngram_join.sketch(b)) <= differ
        assert ngram_join.differing(ngram_join.sketch(a), ngram_join.sketch(a)) == 0


def test_null_and_shared_identifiers(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(60)]
    other = [f"v{rng.randrange(4000)}" for _ in range(60)]
    rows = [(None, " ".join(base)), (7, noisy(rng, base, 1)), (None, noisy(rng, other, 1)), (None, " ".join(other)), (4, " ".join(base[:3])), (4, noisy(rng, base, 1)), (9, None), (None, ""), (None, "")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    sets = [(i, shingles(t)) for i, t in rows]
    parts = [0, 0, 1, 1, 2, 0, 3, 4, 5]
    least = {p: min((i for (i, _), q in zip(rows, parts) if q == p and i is not None), default=None) for p in parts}
    assert sorted(map(tuple, got), key=key) == sorted(((i, len(s), least[p]) for (i, s), p in zip(sets, parts)), key=key)


@pytest.mark.parametrize("each", [4, 64])
def test_cut_blocks_lose_nothing(spark, monkeypatch, each):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", each)
    monkeypatch.setattr(ngram_join, "PAIRS_EACH", 3)
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 2)
    rows = corpus(5)
    assert sorted(map(tuple, ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)
