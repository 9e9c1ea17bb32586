"""Generated tables with a known pocket, made on the executors.

Every draw follows from the row's number and a seed alone, so a table is the same however it is partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, at: str = "id") -> Column:
    """Uniform in [0, 1): 52 bits of the MD5 of "number:seed", which any SQL engine can repeat."""
    digits = F.substring(F.md5(F.concat(F.col(at).cast("string"), F.lit(f":{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**52)


def _fast(seed: int) -> Column:
    """Uniform in [0, 1) from a quicker hash, for large tables."""
    return F.shiftrightunsigned(F.xxhash64("_rid", F.lit(seed)), 11).cast("double") / F.lit(2.0**53)


def normal(u: Column, v: Column) -> Column:
    """A standard normal draw from two uniform ones."""
    return F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(F.lit(2.0 * math.pi) * v)


def _pick(values: list[str], seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(draw(seed) * len(values)) + 1).cast("int"))


def _noise(k: int, cardinality: int, seed: int) -> list[Column]:
    return [_pick([f"v{j}" for j in range(cardinality)], seed + 100 + i).alias(f"m{i}") for i in range(k)]


def planted_binary(spark: SparkSession, n: int, seed: int, pocket: float = 0.95, base: float = 0.25, noise_attributes: int = 4, noise_cardinality: int = 3) -> DataFrame:
    """y is likely where a1 is 'p' and a2 is 'x'."""
    df = spark.range(n).select(F.col("id").alias("_rid"), _pick(["p", "q", "r"], seed).alias("a1"), _pick(["x", "y", "z"], seed + 1).alias("a2"), *_noise(noise_attributes, noise_cardinality, seed))
    share = F.when((F.col("a1") == "p") & (F.col("a2") == "x"), pocket).otherwise(base)
    return df.withColumn("y", (draw(seed + 2, "_rid") < share).cast("bigint"))


def planted_numeric(spark: SparkSession, n: int, seed: int, shift: float = 2.0, noise_attributes: int = 4) -> DataFrame:
    """t is standard normal, `shift` higher where b1 is 'u' and b2 is 'm'."""
    df = spark.range(n).select(F.col("id").alias("_rid"), _pick(["u", "v", "w"], seed).alias("b1"), _pick(["m", "n", "o"], seed + 1).alias("b2"), *_noise(noise_attributes, 3, seed))
    return df.withColumn("t", normal(draw(seed + 2, "_rid"), draw(seed + 3, "_rid")) + F.when((F.col("b1") == "u") & (F.col("b2") == "m"), shift).otherwise(0.0))


def tie_stress(spark: SparkSession, block: int = 12) -> DataFrame:
    """Eight interleaved groups, one per combination of c1, c2, c3; d1 equals c1.

    The first half of each even group and the first quarter of each odd one is positive, so many
    descriptions tie exactly.
    """
    group, place = F.col("id") % 8, F.floor(F.col("id") / 8)
    bit = lambda k, name: F.concat(F.lit(name), (F.shiftright(group, k) % 2).cast("string"))
    positive = place < F.when(group % 2 == 0, block // 2).otherwise(block // 4)
    return spark.range(8 * block).select(F.col("id").alias("_rid"), bit(0, "A").alias("c1"), bit(1, "B").alias("c2"), bit(2, "C").alias("c3"), bit(0, "D").alias("d1"), positive.cast("bigint").alias("y"))


def na_stress(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """About a third of each attribute is missing; g1 'none' never meets g2 'none'."""
    gap = lambda c, k: F.when(draw(seed + k) >= 0.35, c)
    df = spark.range(n).select(
        F.col("id").alias("_rid"), gap(_pick(["a", "b", "none"], seed), 10).alias("g1"), gap(_pick(["k", "l"], seed + 1), 11).alias("g2"),
        gap(F.floor(draw(seed + 2) * 5).cast("double"), 12).alias("x1"), normal(draw(seed + 3), draw(seed + 6)).alias("x2"), normal(draw(seed + 4), draw(seed + 7)).alias("t"), (draw(seed + 5) < 0.4).cast("bigint").alias("y"),
    )
    return df.withColumn("g2", F.when((F.col("g1").isNull()) & (F.col("_rid") % 5 == 0), "none").otherwise(F.col("g2")))


def dup_rows(spark: SparkSession, distinct: int, seed: int, most: int = 9) -> DataFrame:
    """Every distinct row 1 .. most times."""
    df = spark.range(distinct).select(_pick(["a", "b", "c"], seed).alias("h1"), _pick(["x", "y"], seed + 1).alias("h2"), ((F.floor(draw(seed + 2) * 3) + 1) * 10.0).alias("x"), (draw(seed + 3) < 0.5).cast("bigint").alias("y"), (F.floor(draw(seed + 4) * most) + 1).cast("int").alias("_n"))
    return df.select("h1", "h2", "x", "y", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).drop("_copy")


def wide_synth(spark: SparkSession, rows: int = 2_000_000, attributes: int = 32, cardinality: int = 8, seed: int = 7, numeric: bool = False) -> DataFrame:
    """c00 .. with values k0 ..; the plant is c00 = 'k0' and c01 = 'k0'."""
    cols = [F.concat(F.lit("k"), F.floor(_fast(seed + i) * cardinality)).alias(f"c{i:02d}") for i in range(attributes)]
    df = spark.range(rows).withColumnRenamed("id", "_rid").select("_rid", *cols)
    plant = (F.col("c00") == "k0") & (F.col("c01") == "k0")
    if numeric:
        return df.withColumn("t", normal(_fast(seed + 1000), _fast(seed + 1001)) + F.when(plant, 2.0).otherwise(0.0))
    return df.withColumn("y", (_fast(seed + 1000) < F.when(plant, 0.9).otherwise(0.3)).cast("bigint"))
