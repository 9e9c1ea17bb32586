"""Canonical document fingerprints: exact digests of normalised text, confirmed byte by byte.

The canonical text is NFKC-normalised, case-folded, normalised again, its white space runs single spaces.
Its fingerprint is a 128-bit xxHash. Documents are grouped by fingerprint; inside a group of more than one
the canonical bytes themselves are compared (losslessly packed, which keeps equality), so two texts that
merely collide stay apart in `group_id`. Equal rows are pre-aggregated before each shuffle.

Neighbours in identifier order come from one range-partitioned pass: bucket limits are identifiers that
occur, and the row at a limit also travels to the next bucket, so no bucket waits for another.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import NumericType

from lodeseam.llm.base import checkpointed, in_arrow, pieces, whole_text
from lodeseam.llm.tokens import released, slices

BUCKET_ROWS = 512
MOST_BUCKETS = 20_000


def canonical(text: str) -> bytes:
    """The canonical form's UTF-8; code points that cannot be encoded stay as their surrogate bytes."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def fingerprint(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def likeness(a: bytes, b: bytes) -> float:
    """Of two canonical forms: an exact digest knows only equal (1) and different (0)."""
    return 1.0 if a == b else 0.0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and fingerprint of every row; a null text counts as empty."""
    kind = df.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t) for t in part.column(1).to_pylist()], pa.string())], [id_col, "fingerprint"])

    return in_arrow(df.select(id_col, whole_text(text_col).alias("_text")), run, f"`{id_col}` {kind}, fingerprint string")


def _bucket(limits: list, of: Column) -> Column:
    """How many of the ascending `limits` are less than `of`, by halving."""
    if not limits:
        return F.lit(0)
    array, steps = F.array(*map(F.lit, limits)), F.sequence(F.lit(1), F.lit(len(limits).bit_length()))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(array, middle(s)) < of, F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi")))
    return F.when(of.isNull(), 0).otherwise(F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(limits)).alias("hi")), step, lambda s: s["lo"]))


def _limits(ids: DataFrame, parts: int, numeric: bool) -> list:
    """At most parts - 1 identifiers that occur, ascending: quantiles of numbers, else those of the least hashes."""
    parts = min(MOST_BUCKETS, parts)
    if parts < 2:
        return []
    if numeric:
        cuts = ids.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0] or []
    else:
        cuts = [r[0] for r in ids.where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(parts - 1).collect()]  # MOST_BUCKETS rows at most
    return sorted(set(cuts))


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, likenesses, and the group of equal canonical texts.

    The edited text has its last third replaced by as much of the start of the next document's text, by
    descending identifier (equal ones by text, null ones last; after the last comes the first). group_id is
    the least identifier of the rows with the same canonical bytes (null if all are null), copies their
    number. A null text counts as empty; a lone document is its own next; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    ids = df.select(F.col(id_col).alias("_id"))
    n, top = ids.agg(F.count(F.lit(1)), F.max("_id")).first()
    limits = _limits(ids, pieces(n, bucket_rows), isinstance(df.schema[id_col].dataType, NumericType))

    prints = checkpointed(fingerprints(docs, "_id", "_text"))
    several = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    flags = prints.join(several, "fingerprint").select("_id").distinct()

    home = _bucket(limits, F.col("_id"))
    after = F.filter(F.array(F.when(F.col("_id").isin(limits) if limits else F.lit(False), home + 1), F.when(F.col("_id").eqNullSafe(F.lit(top)), F.lit(0))), lambda b: b.isNotNull())
    goes = F.concat(F.array(F.struct(home.alias("bucket"), F.lit(False).alias("carried"))), F.transform(after, lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("carried"))))
    sent = docs.select("_id", F.explode(goes).alias("_to"), F.lit(False).alias("_flag"), "_text")
    sent = sent.union(flags.select("_id", F.struct(home.alias("bucket"), F.lit(False).alias("carried")), F.lit(True), F.lit("")))
    sent = sent.select("_id", "_text", F.col("_to.bucket").alias("_bucket"), F.col("_to.carried").alias("_carried"), "_flag")
    order = ["_bucket", "_carried", F.col("_id").desc_nulls_last(), F.col("_flag").desc(), "_text"]
    dealt = sent.repartition(len(limits) + 1, "_bucket").sortWithinPartitions(*order)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        last, flagged, out = None, object(), []

        def row(one: tuple, nxt: str) -> tuple:
            i, text, canon, several = one[1:]
            cut = len(text) // 3
            edited = text[: len(text) - cut] + nxt[:cut]
            other, after = canonical(edited), canonical(nxt)
            return (
                i, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), xxhash.xxh3_128_hexdigest(canon), xxhash.xxh3_128_hexdigest(other),
                likeness(canon, other), likeness(canon, after), hashlib.sha256(canon).hexdigest() if several else None, pack.compress(canon) if several else None,
            )

        for part in slices(batches, 1):
            for i, text, bucket, carried, flag in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if flag:
                    flagged = i
                    continue
                if last is not None and last[0] == bucket:
                    out.append(row(last, text))
                last = None if carried else (bucket, i, text, canonical(text), i == flagged)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in out], fields)
                out = []

    fields = pa.schema([
        ("_id", to_arrow_type(df.schema[id_col].dataType)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("_sha", pa.string()), ("_packed", pa.binary()),
    ])
    made = in_arrow(dealt, run, f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, _sha string, _packed binary")
    grouped = made.where("_packed is not null").groupBy("fingerprint", "_sha", "_packed").agg(F.min("_id").alias("group_id"), F.count(F.lit(1)).alias("copies")).drop("_packed")
    one = made.where("_packed is null").drop("_sha", "_packed").withColumns({"group_id": F.col("_id"), "copies": F.lit(1).cast("long")})
    more = made.where("_packed is not null").drop("_packed").join(grouped, ["fingerprint", "_sha"]).select(*one.columns)
    return one.union(more).withColumnRenamed("_id", id_col)
