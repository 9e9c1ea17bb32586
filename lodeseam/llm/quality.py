"""Quality by ordinal cumulative-link regression over hashed text features.

Graded ratings train one weight per hashed feature and ordered thresholds: P(grade >= k) is the logistic
function of score - threshold k. All grades share the weights. Their sum over k is the expected grade, the
last one the tail probability by which documents are selected.

Features are hashes: words, the first bytes and the last two bytes of words, and binned shape figures of the
text. A feature counts once a text. Those are kept, by their whole 64-bit hash, that a lower grade has
several times as often as the top one: what most good texts share would only reward length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodeseam.llm.base import checkpointed, in_arrow, unit_hash, whole_text
from lodeseam.llm.tokens import SPACE, VALUE, mixed, noise, places, released, slices, utf8

GRADES = 3
#: Bounds of the training sample and of the model.
SAMPLE_PER_GRADE = 2_000
MOST_FEATURES = 1_024
LEAST_Z, LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO = 5.0, 3, 0.015, 4.0
PREFIXES = (3, 4, 5, 6)
LEAST_WORDS = 16
SEED = 11
#: The share of top-grade sample texts that the cut on the tail probability lets pass.
PASSED = 0.996
KINDS = noise(7, 64)
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
SIGN = np.zeros(256, bool)
SIGN[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all features of a text column, repeated ones included."""
    data, off = utf8(column)
    n = len(off) - 1
    rows, found = [], []
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = SPACE[data]
    start, end = ~space, ~space
    start[1:] &= space[:-1]
    end = end.copy()
    end[:-1] &= space[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    start[edge] = ~space[edge]
    last = off[1:][off[:-1] < off[1:]] - 1
    end[last] = ~space[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of = np.searchsorted(off, starts, side="right") - 1
    size = ends - starts
    at = np.arange(len(data)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(starts, append=len(data)))])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[data] * places(int(at.max()) + 1)[at], dtype=np.uint64)])
    word = mixed(total[ends] - total[starts])
    rows.append(of)
    found.append(word)
    for k in PREFIXES:
        long = size > k
        rows.append(of[long])
        found.append(mixed((total[starts[long] + k] - total[starts[long]]) ^ KINDS[k]))
    two = size > 1
    rows.append(of[two])
    found.append(mixed((data[ends[two] - 2].astype(np.uint64) << np.uint64(8) | data[ends[two] - 1]) ^ KINDS[10]))

    words = np.bincount(of, minlength=n)
    again = np.bincount(of[1:][(word[1:] == word[:-1]) & (of[1:] == of[:-1])], minlength=n)
    order = np.lexsort((word, of))
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][fresh], minlength=n)
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags[data])])[off])
    length, filled = np.maximum(1, np.diff(off)), np.maximum(1, words)
    band = np.log2(filled).astype(np.int64)
    some = words >= LEAST_WORDS  # shares of a few words say little
    shape = (
        np.minimum(9, 20 * again // filled) * some, 16 * np.minimum(15, band) + 10 * distinct // filled * some,
        10 * count(UPPER) // length * some, np.minimum(9, 20 * count(SIGN) // length) * some,
    )
    full = np.flatnonzero(words)
    for k, value in enumerate(shape):
        rows.append(full)
        found.append(mixed(value[full].astype(np.uint64) ^ KINDS[20 + k]))
    return np.concatenate(rows), np.concatenate(found)


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights, the rising thresholds and the least tail probability to select."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def scores(self, column: pa.Array) -> np.ndarray:
        """The sum of the weights of the features that each text has."""
        row, feature = features(column)
        likely = np.zeros(1 << 16, bool)
        likely[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        near = likely[(feature & np.uint64(0xFFFF)).astype(np.int64)]
        row, feature = row[near], feature[near]
        if not len(self.keys) or not len(row):
            return np.zeros(len(column))
        place = np.minimum(np.searchsorted(self.keys, feature), len(self.keys) - 1)
        held = self.keys[place] == feature
        pairs = np.unique(row[held] * len(self.keys) + place[held])
        return np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], minlength=len(column))

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1."""
        return logistic(self.scores(column)[:, None] - self.thresholds[None, :])


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int = GRADES, ridge: float = 1e-6, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of least penalised loss, by Adam steps on the whole sample."""
    n, d = x.shape
    w, cuts = np.zeros(d), np.concatenate([[-1.0], np.zeros(grades - 2)])
    state = [np.zeros(d), np.zeros(d), np.zeros(grades - 1), np.zeros(grades - 1)]
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        gaps = np.exp(cuts[1:])
        theta = cuts[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        tail = logistic((x @ w)[:, None] - theta[None, :])
        full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        slope = full * (1 - full)
        pick = np.arange(n)
        share = np.maximum(full[pick, grade] - full[pick, grade + 1], 1e-9)
        up, down = weight * slope[pick, grade] / share, weight * slope[pick, grade + 1] / share
        by_cut = np.array([up[grade == k].sum() - down[grade == k - 1].sum() for k in range(1, grades)])
        gw = -((up - down) @ x) + ridge * w
        gc = np.concatenate([[by_cut.sum()], gaps * np.cumsum(by_cut[::-1])[::-1][1:]])
        for i, (value, g) in enumerate(((w, gw), (cuts, gc))):
            m, v = state[2 * i], state[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w, cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(cuts[1:]))])


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labelled rows: 0 for low quality, 1 for toxic, 2 for neither; unlabelled ones go."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).where("grade is not null")


def train(docs: DataFrame, labels: DataFrame, per_grade: int = SAMPLE_PER_GRADE, seed: int = SEED) -> Model:
    """Fit on at most `per_grade` labelled documents of each grade, those with the least seeded hash.

    Ratings count by the square root of how much rarer they are in the sample than among all labels. With
    fewer than two grades among the labels no feature is used and every document is selected.
    """
    rated = graded(labels)
    shares = {r[0]: r[1] for r in rated.groupBy("grade").count().collect()}  # GRADES rows
    chosen = [rated.where(F.col("grade") == k).orderBy(unit_hash("doc_id", seed=seed), "doc_id").limit(per_grade) for k in range(GRADES)]
    chosen = chosen[0].union(chosen[1]).union(chosen[2])  # GRADES * per_grade rows at most
    texts = docs.select("doc_id", whole_text().alias("_text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "_text")

    @released
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            row, feature = features(part.column(2))
            own = [np.unique(f).view(np.int64) for f in np.split(feature[np.argsort(row, kind="stable")], np.cumsum(np.bincount(row, minlength=part.num_rows))[:-1])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "grade", "features"])

    sample = checkpointed(in_arrow(texts, hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, features array<long>"))
    sizes = {r[0]: r[1] for r in sample.groupBy("grade").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([-2.0, -1.0]), 0.0)
    n = sum(sizes.values())
    counts = sample.select("grade", F.explode("features").alias("feature")).groupBy("feature").agg(*[F.count_if(F.col("grade") == k).cast("double").alias(f"c{k}") for k in range(GRADES)])
    held = sum((F.col(f"c{k}") for k in range(1, GRADES)), F.col("c0"))
    z = [F.abs(F.col(f"c{k}") - held * size / n) / F.sqrt(held * (1 - held / n) * (size / n) * (1 - size / n) + 0.25) for k, size in sizes.items()]
    rates = [(F.col(f"c{k}") + 0.5) / (sizes.get(k, 0) + 1) for k in range(GRADES)]
    ranked = counts.where(F.greatest(*rates[:-1]) >= LEAST_RATIO * rates[-1]).withColumn("_held", held).where(F.col("_held") >= max(LEAST_TEXTS, LEAST_SHARE * min(sizes.values()))).withColumn("_z", F.greatest(*z)).where(F.col("_z") >= LEAST_Z)
    keys = np.sort(np.array([r[0] for r in ranked.orderBy(F.desc("_z"), "feature").limit(MOST_FEATURES).select("feature").collect()], np.int64).view(np.uint64))
    own = F.array_intersect("features", F.array(*[F.lit(int(k)) for k in keys.view(np.int64)])) if len(keys) else F.array().cast("array<long>")
    rows = sample.select("grade", "doc_id", own.alias("features")).orderBy("grade", "doc_id").collect()
    x = np.zeros((len(rows), len(keys)))
    for i, r in enumerate(rows):
        x[i, np.searchsorted(keys, np.array(r[2], np.int64).view(np.uint64))] = 1
    grade = np.array([r[0] for r in rows])
    w, theta = fit_ordinal(x, grade, np.array([(shares[g] / sizes[g]) ** 0.5 for g in grade]))
    top = logistic(x[grade == GRADES - 1] @ w - theta[-1])
    return Model(keys, w, theta, 0.98 * float(np.quantile(top, 1 - PASSED)) if len(top) else 0.0)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`df` with expected_grade, tail and keep (tail >= the model's cut). A null text counts as empty and has no features.

    Columns of `df` with those names are replaced. Rows are scored each for itself.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in ("expected_grade", "tail", "keep")]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, len(kept)):
            tails = shared.value.tails(part.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], [*kept, "expected_grade", "tail"])

    schema = StructType([*(df.schema[c] for c in kept), StructField("expected_grade", DoubleType()), StructField("tail", DoubleType())])
    out = in_arrow(df.select(*kept, whole_text(text_col).alias("_quality_text")), run, schema)
    return out.withColumn("keep", F.col("tail") >= model.cut)
