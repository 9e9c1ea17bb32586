"""Sharding whole records by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records with seeded hashes: the identifier and the number of shards decide the
shard (highest random weight, so one more shard takes rows only into itself), a second hash, of identifier
and text, decides the memory-sized bucket inside the shard. Pass two shuffles each sorted bucket by
Fisher-Yates (inside-out, its draws seeded by bucket and step, since Spark's own `shuffle` depends on the
partition a row happens to be in), numbers its records after those of the buckets before it and writes them.

No bucket depends on how skewed a column other than the identifier is. Identical records of an identifier
that has more rows than a bucket are counted before the shuffle, so they cost one list entry, and are spread
out again afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.llm.base import checkpointed, fresh_folder, pieces, whole_text

SEED = 20_240_229
SHARDS = 24
BUCKET_ROWS = 512


def fisher_yates(records: Column, *keys: Column) -> Column:
    """The array `records` in an order drawn uniformly by the hash of `keys` and the step."""

    def step(done: Column, record: Column) -> Column:
        at = F.pmod(F.xxhash64(*keys, F.size(done)), F.size(done) + 1).cast("int")
        swapped = F.concat(F.slice(done, F.lit(1), at), F.array(record), F.slice(done, at + 2, F.size(done)), F.array(F.get(done, at)))
        return F.when(at == F.size(done), F.concat(done, F.array(record))).otherwise(swapped)

    return F.aggregate(records, F.slice(records, 1, 0), step)


def _weights(shards: int, seed: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.xxhash64(F.lit(seed), F.col("_id"), s))


def assign_shards(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, path: str | None = None
) -> DataFrame:
    """`id_col`, size, text_crc32, law, shard, slot and grown_shard of every record of the shards of `df`.

    The whole records are written to `path` (a folder in the shared one, deleted when Python ends, if None) and
    read back. size is the UTF-8 length of the text plus 8. A null text counts as empty (size 8, checksum 0); a
    null identifier is a value like any other; an empty table gives no rows.
    """
    back = write_shards(df, path or fresh_folder(df.sparkSession), id_col, text_col, shards, seed, bucket_rows)
    out = back.select(F.col(id_col).alias("_id"), (F.octet_length(whole_text(text_col)) + 8).cast("long").alias("size"), F.crc32(whole_text(text_col)).alias("text_crc32"), "_shard", "_slot")
    moves = F.xxhash64(F.lit(seed), F.col("_id"), F.lit(shards)) > F.array_max(_weights(shards, seed))
    return out.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
        F.when(moves, F.lit(shards)).otherwise(F.col("_shard")).cast("int").alias("grown_shard"),
    )


def write_shards(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Write whole records to `path`, one folder per shard, in slot order; return the records read back.

    Slots stay in the column `_slot`, so a reader restores the exact order from any number of files. Identical
    records get neighbouring slots. The columns of `df` must be of kinds that can be ordered.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark, names = df.sparkSession, df.columns
    subs = pieces(df.select(id_col).count(), shards * bucket_rows)
    rows = df.select(F.col(id_col).alias("_id"), F.struct(*names).alias("_row"), whole_text(text_col).alias("_text"), F.lit(1).cast("long").alias("_copies"))
    often = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket_rows).select(F.col("_id").alias("_often"), F.lit(True).alias("_hot"))
    often = checkpointed(often)  # one in `bucket_rows` rows at most
    hot = not often.isEmpty()
    if hot:
        marked = rows.join(F.broadcast(often), rows["_id"].eqNullSafe(often["_often"]), "left").drop("_often")
        copies = marked.where("_hot").groupBy("_id", "_row", "_text").agg(F.count(F.lit(1)).alias("_copies"))
        rows = marked.where("_hot is null").drop("_hot").union(copies)
    weights = rows.withColumn("_weights", _weights(shards, seed)).withColumn("_best", F.array_max("_weights"))
    placed = weights.select(
        (F.array_position("_weights", F.col("_best")) - 1).cast("int").alias("_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_id"), F.col("_text")), F.lit(subs)).cast("int").alias("_sub"), F.struct("_id", "_row", "_copies").alias("_record"),
    )
    before = Window.partitionBy("_shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_shard", "_sub").agg(F.sum("_record._copies").alias("_n"))
    offsets = checkpointed(offsets.select("_shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))  # one in `bucket_rows` rows
    buckets = (
        placed.repartitionByRange("_shard", "_sub").groupBy("_shard", "_sub")
        .agg(F.array_sort(F.collect_list("_record")).alias("_bucket"))
        .withColumn("_bucket", fisher_yates(F.col("_bucket"), F.lit(seed), F.col("_shard"), F.col("_sub")))
        .join(F.broadcast(offsets), ["_shard", "_sub"])
    )
    if hot:
        start = lambda i: F.aggregate(F.slice("_bucket", F.lit(1), i), F.lit(0).cast("long"), lambda acc, r: acc + r["_copies"])
        buckets = buckets.withColumn("_bucket", F.transform("_bucket", lambda r, i: F.struct(r["_row"].alias("_row"), r["_copies"].alias("_copies"), start(i).alias("_at"))))
        spread = buckets.select("_shard", "_offset", F.explode("_bucket").alias("_record")).select("_shard", "_offset", "_record", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_record._copies") - 1)).alias("_copy"))
        slots = spread.select("_record._row.*", "_shard", (F.col("_offset") + F.col("_record._at") + F.col("_copy")).alias("_slot"))
    else:
        slots = buckets.select("_shard", "_offset", F.posexplode("_bucket").alias("_at", "_record")).select("_record._row.*", "_shard", (F.col("_offset") + F.col("_at")).alias("_slot"))
    slots.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").mode("overwrite").parquet(path)
    return spark.read.schema(df.select("*", F.lit(0).cast("long").alias("_slot"), F.lit(0).alias("_shard")).schema).parquet(path)
