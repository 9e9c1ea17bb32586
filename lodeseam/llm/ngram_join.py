"""Exact n-gram Jaccard join as a blocked sparse product of documents by shingles.

1. Documents with one shingle set are one node (64 bits that hash its size and two 64-bit sums over its members).
2. Shingles get a global order, rare ones first, from a table of counts of fixed size.
3. A node's incidence row is cut to its first n - ceil(t n) + 1 shingles in that order: two nodes that meet
   the threshold share one of them. Blocks of the product are ranges of shingles by hash.
4. Linking every node of a column to the column's most central node (the one with most shared columns), and
   joining what exact counts confirm, makes components without multiplying a group of near copies with itself.
5. Columns that still hold several components are multiplied block by block, a block being the columns of one
   central node, cut further by rows when they are many: overlap counts are accumulated per pair of rows, and
   pairs whose count, with all that other blocks can add, misses the size-derived bound are discarded.
6. Pairs whose parity sketches of the whole sets differ in too many bits are discarded, before any text moves.
7. What is left is counted exactly over whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.llm.base import checkpointed, in_arrow, whole_text, written
from lodeseam.llm.graph import components
from lodeseam.llm.tokens import mixed, released, shingle_sets, slices

#: Two sets are linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
BIN_BITS = 20
TABLE_SLICES = 64
#: Tables of a few numbers a row are broadcast up to this many rows, else joined by a shuffle.
MOST_BROADCAST = 500_000
#: Pairs of one v that one task confirms.
PAIRS_EACH = 512
#: Rows of a block that one task multiplies with as many others.
BLOCK_ROWS = 4_096


def needed(a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
    """The least overlap of two sets of these sizes that meets the threshold."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -((-PERCENT * n) // 100) + 1 if n else 0


def node_of(s: np.ndarray) -> int:
    """The number of a shingle set: a hash of its size and two sums over its members."""
    one, two = s.sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return xxhash.xxh64_intdigest(b"%d %d %d" % (len(s), one, two)) - (1 << 63)


def sketch(s: np.ndarray) -> bytes:
    """Parities of how many members fall in each of 2 to 4 bits a member, by their low bits.

    Each member that only one of two sets has flips one bit, so sets differ in at least as many members as
    their sketches do in bits; a sketch folded in half by exclusive or is one of half the size.
    """
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, at the size of the smaller."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    least = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, least)) ^ np.bitwise_xor.reduce(y.reshape(-1, least))).sum())


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, one, two, n_shingles, node, sketch) of every row; node is one number for each distinct set."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3):
            sets = list(shingle_sets(part.column(3)))
            sizes, numbers = pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], sizes, numbers, pa.array([sketch(s) if len(s) else b"" for s in sets], pa.binary())], ["doc_id", "one", "two", "n_shingles", "node", "sketch"])

    return in_arrow(docs, run, f"doc_id {docs.schema[0].dataType.simpleString()}, one long, two long, n_shingles long, node long, sketch binary")


def shingle_order(docs: DataFrame) -> np.ndarray:
    """The rank of each of 2^BIN_BITS classes of shingles by how many shingles of the corpus fall in it.

    Partial counts are summed slice by slice on the executors; the driver gets one table of fixed size.
    """
    width = (1 << BIN_BITS) // TABLE_SLICES

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BIN_BITS, np.int64)
        for part in slices(batches, 0):
            sets = list(shingle_sets(part.column(0)))
            if sets:
                table += np.bincount((np.concatenate(sets) >> np.uint64(64 - BIN_BITS)).astype(np.int64), minlength=1 << BIN_BITS)
        if table.any():
            salt = int(table.sum() % 16)
            rows = [zstandard.compress(table[i * width : (i + 1) * width].tobytes()) for i in range(TABLE_SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(TABLE_SLICES), pa.int32()), pa.array([salt] * TABLE_SLICES, pa.int32()), pa.array(rows, pa.binary())], ["slice", "salt", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zstandard.decompress(c.as_buffer()), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([zstandard.compress(s.tobytes()) for s in sums.values()], pa.binary())], ["slice", "counts"])

    once = in_arrow(in_arrow(docs.select("text"), count, "slice int, salt int, counts binary").repartition(TABLE_SLICES, "slice", "salt").drop("salt"), add, "slice int, counts binary")
    table = np.zeros(1 << BIN_BITS, np.int64)
    for r in in_arrow(once.repartition(TABLE_SLICES, "slice"), add, "slice int, counts binary").collect():  # TABLE_SLICES rows
        table[r[0] * width : (r[0] + 1) * width] += np.frombuffer(zstandard.decompress(r[1]), np.int64)
    rank = np.empty(1 << BIN_BITS, np.uint32)
    rank[np.argsort(table, kind="stable")] = np.arange(1 << BIN_BITS, dtype=np.uint32)
    return rank


def _incidence(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """(shingle, node, n): the first shingles of every set in the global order, as numbers in that order.

    A set that several rows of one task have is emitted once, so copies hardly add to the shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank)
    low = np.uint64((1 << (64 - BIN_BITS)) - 1)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for part in slices(batches, 0):
            n, node, prefix = [], [], []
            for s in shingle_sets(part.column(0)):
                one = node_of(s)
                if not len(s) or one in seen:
                    continue
                seen.add(one)
                key = np.sort((order[(s >> np.uint64(64 - BIN_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(64 - BIN_BITS)) | (s & low))
                n.append(len(s))
                node.append(one)
                prefix.append(key[: prefix_length(len(s))].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["n", "node", "prefix"])

    return in_arrow(docs.select("text"), run, "n int, node long, prefix array<long>").select(F.explode("prefix").alias("shingle"), "node", "n")


def sized(small: DataFrame) -> DataFrame:
    """A table at hand, to be broadcast if it has at most MOST_BROADCAST rows of a few numbers, else as it is."""
    return F.broadcast(small) if small.count() <= MOST_BROADCAST else small


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of `pairs` whose sketches allow the overlap they need; `sets` has node, n_shingles and sketch once."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            keep = [differing(a, b) <= n + m - 2 * needed(n, m) for n, a, m, b in both]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    end = lambda x: sets.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.select("u", "v").join(end("u"), "u").join(end("v"), "v")
    return in_arrow(both.select("u", "v", "n_u", "sketch_u", "n_v", "sketch_v"), run, "u long, v long")


def _confirmed(pairs: DataFrame, docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The (u, v) of `pairs` whose whole sets meet the threshold.

    The text of each u goes to its v's once; a v of very many pairs is several, its text sent to each.
    """

    @released
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a row in one task
        for batch in batches:
            fresh = []
            for node in batch.column(0).to_pylist():
                fresh.append(node not in seen)
                seen.add(node)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(iter([batch]), 3):
                first, keep = list(shingle_sets(part.column(3))), []
                for i, b in enumerate(part.column(1).to_pylist()):
                    if b not in known:
                        known = {b: next(shingle_sets(part.column(2).slice(i, 1)))}
                    one, other = first[i], known[b]
                    keep.append(len(np.intersect1d(one, other, assume_unique=True)) >= needed(len(one), len(other)))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def texts(ends: DataFrame) -> DataFrame:
        given = sized(checkpointed(ends.join(firsts, "node")))
        return in_arrow(docs.join(given, ["one", "two"]).select("node", "text"), once, "node long, text string")

    hot = checkpointed(pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / PAIRS_EACH).cast("int").alias("cuts")).where("cuts > 1"))
    dealt = pairs.join(sized(hot), "v", "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("u"), F.col("cuts")), F.lit(0)).cast("int").alias("cut"))
    dealt = checkpointed(dealt)
    left = texts(dealt.select(F.col("u").alias("node")).distinct()).select(F.col("node").alias("u"), F.col("text").alias("u_text")).join(sized(dealt), "u")
    right = texts(dealt.select(F.col("v").alias("node")).distinct()).select(F.col("node").alias("v"), F.col("text").alias("v_text")).join(sized(hot), "v", "left")
    right = right.select("v", "v_text", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)).alias("cut"))
    return in_arrow(left.join(right, ["v", "cut"]).select("u", "v", "v_text", "u_text"), run, "u long, v long")


def _short(n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """How many shared prefix shingles a pair of sets of these sizes needs.

    All shared shingles up to the end of the prefix that ends first are among them, so of that set only the
    rest after its prefix is to come.
    """
    largest = np.maximum(n_u, n_v)
    return np.maximum(1, needed(n_u, n_v) - (-((-PERCENT * largest) // 100) - 1))


def _may_reach(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v, n_u, n_v, common) those whose overlap can still meet the size-derived bound."""
    rest = lambda n: F.ceil(F.lit(PERCENT) * n / 100) - 1
    bound = F.ceil(F.lit(PERCENT) * (F.col("n_u") + F.col("n_v")) / (100 + PERCENT))
    return pairs.where(F.col("common") + rest(F.greatest("n_u", "n_v")) >= bound)


def _block_product(rows: DataFrame) -> DataFrame:
    """Distinct (u, v) of different parts that may meet the threshold.

    `rows` has shingle, node, n, part, shared (how many columns the node has in all blocks), hub, which names
    the block, and central, whether the row is of the hub's part. Rows of that part are not multiplied with
    each other. The rows of a large block are cut into pieces by node, central ones and others apart, before
    they are dealt; a task holds two pieces at most, and its counts are complete for its pairs of rows.
    """
    sizes = rows.select("hub", "node", "central").distinct().groupBy("hub").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(c) / BLOCK_ROWS)).cast("int").alias(a) for a, c in (("inner", F.col("central")), ("outer", ~F.col("central")))])
    large = checkpointed(sizes.where("inner > 1 or outer > 1"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("central"), F.col("inner")).otherwise(F.col("outer")))
    cut = rows.join(sized(large), "hub", "left").withColumn("own", F.coalesce(own, F.lit(0)).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    at = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    outer = F.concat(F.transform(upto("outer"), lambda k: at(2, F.least(k, F.col("own")), F.greatest(k, F.col("own")))), F.transform(upto("inner"), lambda k: at(1, k, F.col("own"))))
    met = F.when(F.col("inner").isNull(), F.array(at(0, F.lit(0), F.lit(0)))).when(F.col("central"), F.transform(upto("outer"), lambda k: at(1, F.col("own"), k))).otherwise(outer)
    dealt = cut.select("shingle", "node", "n", "part", "shared", "central", "own", "hub", F.explode(met).alias("at"))
    dealt = dealt.select("shingle", "node", "n", "part", "shared", "central", "own", "hub", "at.kind", "at.i", "at.j")

    def multiply(block: pa.Table) -> pa.Table:
        shingle, node, n, part, shared, central, own, _, kind, i, j = (c.to_numpy() for c in block.columns)
        names, first, row = np.unique(node, return_index=True, return_inverse=True)
        n, part, own, central = n[first].astype(np.int64), part[first], own[first], central[first].astype(bool)
        others = shared[first] - np.bincount(row)
        by_column = np.argsort(shingle, kind="stable")
        column = np.unique(shingle, return_inverse=True)[1]
        starts, members = np.searchsorted(column[by_column], np.arange(column.max() + 2)), row[by_column]
        by_row = np.argsort(row, kind="stable")
        bounds = np.searchsorted(row[by_row], np.arange(len(names) + 1))
        u, v = [], []
        for a in np.flatnonzero(~central):
            hit = np.concatenate([members[starts[c] : starts[c + 1]] for c in column[by_row[bounds[a] : bounds[a + 1]]]])
            hit = hit[central[hit] if kind[0] == 1 else central[hit] | (hit > a)]
            if not len(hit):
                continue
            common = np.bincount(hit, minlength=len(names))
            b = np.flatnonzero(common)
            b = b[part[b] != part[a]]
            if kind[0] == 2 and i[0] != j[0]:
                b = b[own[b] != own[a]]
            b = b[100 * np.minimum(n[b], n[a]) >= PERCENT * np.maximum(n[b], n[a])]
            b = b[common[b] + np.minimum(others[b], others[a]) >= _short(n[b], n[a])]
            u.append(np.minimum(names[a], names[b]))
            v.append(np.maximum(names[a], names[b]))
        return pa.table({"u": np.concatenate(u) if u else np.zeros(0, np.int64), "v": np.concatenate(v) if v else np.zeros(0, np.int64)})

    return dealt.groupBy("hub", "kind", "i", "j").applyInArrow(multiply, "u long, v long").distinct()


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_shingles and component_id (least identifier reachable by links) of every row of `df`.

    Sets hold 5-word shingles of the lower-cased (A-Z) words between ASCII white space. A text of one to four
    words has one shingle, a null or wordless text none and no links: its component is its own identifier.
    Rows with an equal set are linked whatever their identifiers; a null identifier never is the least. An
    empty table gives no rows. Other columns are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    docs = docs.select("doc_id", *[F.xxhash64(F.lit(k), "doc_id", "text").alias(name) for k, name in enumerate(("one", "two"))], "text")
    rows = written(nodes(docs))
    block = Window.partitionBy("shingle")
    shared = _incidence(docs, shingle_order(docs)).select("shingle", "node", "n", F.min("node").over(block).alias("least"), F.max("node").over(block).alias("most"))
    shared = written(shared.where("least < most").select("shingle", "node", "n").dropDuplicates(["shingle", "node"]))
    shared = shared.join(shared.groupBy("node").agg(F.count(F.lit(1)).alias("shared")), "node")
    hubs = shared.groupBy("shingle").agg(F.max(F.struct("shared", "node", "n")).alias("hub")).select("shingle", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    shared = written(shared.join(hubs, "shingle"))
    sets = rows.where("n_shingles > 0").select("node", "n_shingles", "sketch").dropDuplicates(["node"])
    firsts = rows.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("one", "two")).alias("key")).select("node", "key.one", "key.two")

    stars = shared.where("node <> hub").groupBy(F.col("node").alias("u"), F.col("hub").alias("v")).agg(F.count(F.lit(1)).alias("common"), F.first("n").alias("n_u"), F.first("hub_n").alias("n_v"))
    stars = checkpointed(_may_reach(stars).select("u", "v"))
    links = checkpointed(_confirmed(checkpointed(_likely(stars, sets)), docs, firsts))
    parts = components(links).withColumnRenamed("root", "part")
    joined = shared.join(parts, "node", "left").select("shingle", "node", "n", "shared", "hub", F.coalesce("part", "node").alias("part"))
    spread = joined.groupBy("hub").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max(F.when(F.col("node") == F.col("hub"), F.col("part"))).alias("hub_part")).where("low < high").select("hub", "hub_part")
    block = written(joined.join(spread, "hub").select("shingle", "node", "n", "part", "shared", "hub", (F.col("part") == F.col("hub_part")).alias("central")))
    tried = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    cross = checkpointed(_likely(_block_product(block).join(tried, ["u", "v"], "left_anti"), sets))
    return _labelled(rows, components(links.union(_confirmed(cross, docs, firsts))), id_col)


def _labelled(rows: DataFrame, parts: DataFrame, id_col: str) -> DataFrame:
    """The rows with the least identifier of their component."""
    firsts = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = checkpointed(firsts.join(parts, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("first").alias("lowest"))
    named = placed.join(lowest, "root").select("node", "lowest")
    out = rows.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", F.col("lowest").alias("component_id"))
    out = out.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumnRenamed("doc_id", id_col)
