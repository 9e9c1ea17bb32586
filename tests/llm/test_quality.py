"""The ordinal classifier: held-out accuracy, its gradient's optimum, bounds and edge rows."""

import math
import random

import numpy as np
import pyarrow as pa

from lodeseam.llm import quality


def corpus(n=1500, seed=2):
    rng = random.Random(seed)
    words = [f"wo{rng.randrange(10**5)}" for _ in range(4000)]
    docs, labels = [], []
    for i in range(n):
        text, kind = [rng.choice(words) for _ in range(rng.choice([8, 60, 300, 1500]))], rng.choice([0, 1, 2, 2, 2])
        if kind == 0:
            text = [w + "$$" for w in text] if rng.random() < 0.5 else [w for w in text[:20] for _ in range(9)]
        if kind == 1:
            for _ in range(1 + len(text) // 50):
                text[rng.randrange(len(text))] = rng.choice(["baddy", "nastya", "nastyb", "Vile,"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(kind > 0), int(kind == 1)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = quality.train(df, spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int"), per_grade=200)
    assert len(model.keys) <= quality.MOST_FEATURES and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    held = [(q + q * (1 - t), got[i]) for i, q, t in labels[900:]]
    assert np.mean([r.keep for g, r in held if g == 2]) > 0.98
    assert np.mean([r.keep for g, r in held if g < 2]) < 0.05
    assert all(0 <= r.tail <= 1 and r.tail <= r.expected_grade <= 2 for r in got.values())


def test_thresholds_of_no_features_are_the_shares():
    grade = np.repeat([0, 1, 2], [20, 30, 50])
    w, theta = quality.fit_ordinal(np.zeros((100, 1)), grade, np.ones(100), steps=3000, rate=0.02)
    assert np.allclose(quality.logistic(-theta), [0.8, 0.5], atol=0.01) and w[0] == 0


def test_features_do_not_depend_on_the_slice():
    texts = ["One two", None, "", "  x", "two one!! !!", "é", "a " * 40]
    row, feature = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        r, f = quality.features(pa.array([t], pa.string()))
        assert sorted(f.tolist()) == sorted(feature[row == i].tolist())


def test_edge_rows(docs, rows, empty, spark):
    labels = spark.createDataFrame([(5, 0, 0), (6, 1, 0), (7, 1, 1), (8, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model)
    assert set(docs.columns) < set(got.columns) and got.count() == len(rows)
    assert quality.score(empty, model).count() == 0
    none = quality.train(docs, labels.where("doc_id > 2000"))
    assert quality.score(docs, none).where("not keep").count() == 0


def loss(x, grade, weight, w, theta, ridge=1e-6):
    """The penalised loss in plain Python."""
    total = 0.0
    for row, g, share in zip(x, grade, weight):
        s = sum(a * b for a, b in zip(row, w))
        tail = [1.0, *(1 / (1 + math.exp(t - s)) for t in theta), 0.0]
        total -= share / sum(weight) * math.log(tail[g] - tail[g + 1])
    return total + ridge / 2 * sum(b * b for b in w)


def test_the_fit_is_a_minimum_of_the_plain_loss():
    rng = random.Random(4)
    x = [[float(rng.random() < 0.5) for _ in range(3)] for _ in range(60)]
    grade = [min(2, max(0, round(1 + a - b + rng.gauss(0, 0.8)))) for a, b, _ in x]
    weight = [rng.choice([0.5, 1.0, 2.0]) for _ in x]
    w, theta = quality.fit_ordinal(np.array(x), np.array(grade), np.array(weight), steps=4000, rate=0.02)
    at = [*w, *theta]
    value = lambda p: loss(x, grade, weight, p[:3], p[3:])
    for i in range(5):
        up, down = ([v + h * (j == i) for j, v in enumerate(at)] for h in (1e-4, -1e-4))
        assert abs(value(up) - value(down)) / 2e-4 < 1e-3
        assert all(value([v + h * (j == i) for j, v in enumerate(at)]) > value(at) for h in (-0.1, 0.1))


def test_scores_are_sums_over_the_features_a_text_has(spark):
    texts = ["one two three two", "", None, "two", "!! ONE $$ two two", "three " * 300]
    own = [set(quality.features(pa.array([t or ""]))[1].tolist()) for t in texts]
    keys = sorted(set().union(*own))[::2]
    rng = random.Random(8)
    weights, theta = {k: rng.uniform(-1, 1) for k in keys}, [-0.5, 0.75]
    model = quality.Model(np.array(keys, np.uint64), np.array([weights[k] for k in keys]), np.array(theta), 0.4)
    got = {r.i: r for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3), model).collect()}
    for i, have in enumerate(own):
        tails = [1 / (1 + math.exp(t - sum(weights.get(f, 0.0) for f in have))) for t in theta]
        assert math.isclose(got[i].expected_grade, sum(tails), rel_tol=1e-9) and math.isclose(got[i].tail, tails[-1], rel_tol=1e-9)
        assert got[i].keep == (tails[-1] >= 0.4)
