"""A corpus pipeline of five stages; counted as part of the subpackage lodeseam.llm.

Each stage takes the documents its predecessor wrote and decides over all of them:

quality     fits the ordinal classifier on the labelled documents it is given and drops those below its cut;
near_dups   keeps one row of each n-gram Jaccard component, that with the least identifier;
pii         replaces every confirmed span of personal data by its kind;
mix         gives each source its target words: documents not taken go, others are repeated as often as
            they are taken, the one at which a source's target is reached ends there; the rows are written
            in order of training position (file by file, ties by row and use);
tokens      encodes the texts with SentencePiece and returns tokens instead of texts.

A null text counts as empty: it passes `quality`, is nobody's near copy, holds nothing, and is not taken by
`mix`. Extra columns are dropped by the first stage. Rows that repeat stay until `near_dups`, which keeps one;
rows that share an identifier but not the rest are decided one by one, the least of one component by a hash. A
null identifier is greater than all others. `mix` takes every row by its own words, whatever its identifier, and
equal rows (masking can make some) each as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm import mixing, ngram_join, pii, quality, sentencepiece_bpe
from lodeseam.llm.base import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("keep").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of `docs` and `_row`: one key for each distinct row, by identifier (null last), then a hash of the rest."""
    rest = F.xxhash64(*[x for c in COLUMNS[1:] for x in (F.col(c).isNull(), F.col(c))])
    return docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", rest.alias("rest")).alias("_row"))


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = keyed(docs)
    parts = ngram_join.jaccard_components(docs, "_row")
    others = parts.where("_row <> component_id").select("_row").distinct()
    return docs.join(others, "_row", "left_anti").select(*COLUMNS).distinct()


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find_pii(docs.select(*COLUMNS))
    text = pii.masked(F.col("text"), F.col("_pii"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = keyed(docs)
    taken = mixing.mix_sources(docs, "_row").where("taken > 0").select("_row", "size", "taken", F.posexplode("positions").alias("_use", "_position"))
    rows = docs.repartition("_row").distinct().join(taken, "_row")
    left = F.col("taken") - F.col("size") * F.col("_use")
    words = F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), left.cast("int"))
    used = rows.withColumn("text", F.when(left >= F.col("size"), F.col("text")).otherwise(F.array_join(words, "")))
    used = used.withColumn("n_chars", F.when(left >= F.col("size"), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return used.orderBy("_position", "_row", "_use").select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(docs)


STAGES = [("quality", quality_stage), ("near_dups", near_dups_stage), ("pii", pii_stage), ("mix", mix_stage), ("tokens", tokens_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
