"""Operator 5, exact top-k search by no-random-access aggregation.

Components are integers, floor(256 * x). Vectors are dealt once into blocks, and each block is written with its sorted
lists, one a component. A list is read from its top where the query's component is positive and from its bottom where it
is negative. After each round of reading, a vector's score lies between a lower bound (unread components at the list's
far end) and an upper bound (unread components at the place read to). Vectors whose upper bound lies below the k-th best
lower bound are left alone in later rounds; reading stops for a query when few remain, whose scores are then resolved.

Bounds are carried between blocks: a query first meets one block, and its k-th best score there is a lower bound for all
others. A block whose lists' ends alone keep every score below it never meets the query; in the blocks that do, reading
starts from that bound. Vectors move once; a query moves once for each block that may matter to it.

Nulls and odd rows: vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part;
repeated rows are candidates each, and one query; a query's own row is every row of its id; vectors meet only vectors
of the same length; ties go to the smaller id; an empty table gives an empty result. Scores beyond 2**63 are out of
range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import load, materialize, shuffle_partitions

SCALE = 256
VECTORS, AT_ONCE = 8192, 256
#: How far the sorted lists are read by the end of each round; at their end both bounds are the score.
ROUNDS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 1)
FEW = 64
#: Blocks' list ends go to the executors by broadcast up to this many blocks (16 bytes a component each).
BROADCAST_BLOCKS = 20_000
NO_FLOOR = -(1 << 63)
BLOCKS = "dim int, vb int, ids binary, vectors binary, lists binary, low array<long>, high array<long>"


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part, as integers."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def sorted_lists(v: np.ndarray) -> np.ndarray:
    """Each component's values in ascending order."""
    return np.sort(v, axis=0)


def block_top_k(q: np.ndarray, query_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, lists: np.ndarray | None = None, floors: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the rows of v with its k best scores, ties to the smaller id, and these scores.

    Rows below a query's floor may be left out: k scores elsewhere reach it.
    """
    n = len(v)
    lists = sorted_lists(v) if lists is None else lists
    low, high = lists[0], lists[-1]
    smallest = np.iinfo(np.int64).min if v.dtype.kind == "i" else -np.inf
    out = []
    for a in range(0, len(q), AT_ONCE):
        part, own = q[a : a + AT_ONCE], query_ids[a : a + AT_ONCE, None] == ids[None, :]
        plus, minus = np.maximum(part, 0), np.minimum(part, 0)
        floor = np.full(len(part), smallest, v.dtype) if floors is None else floors[a : a + AT_ONCE].astype(v.dtype)
        open_ = np.flatnonzero(plus @ high + minus @ low >= floor)
        rows = np.arange(n)  # those within reach of an open query
        for share in ROUNDS:
            depth = n if share == 1 else int(n * share)
            if (depth <= k and depth < n) or not len(open_) or not len(rows):
                continue
            top, bottom = lists[n - depth], lists[depth - 1]
            x = v[rows]
            upper = plus[open_] @ np.maximum(x, top).T + minus[open_] @ np.minimum(x, bottom).T
            lower = plus[open_] @ np.where(x >= top, x, low).T + minus[open_] @ np.where(x <= bottom, x, high).T
            mine = own[np.ix_(open_, rows)]
            upper[mine] = smallest
            lower[mine] = smallest
            bar = floor[open_]
            if len(rows) > k:
                at = len(rows) - k
                bar = np.maximum(bar, np.partition(lower, at, axis=1)[:, at])
            floor[open_] = bar  # rows that are left alone lie below it
            reach = (upper >= bar[:, None]) & ~mine
            done = (reach.sum(1) <= max(FEW, k)) | (depth == n)
            for i in np.flatnonzero(done):
                out.append((a + int(open_[i]), rows[reach[i]]))
            open_ = open_[~done]
            rows = rows[reach[~done].any(0)]
    best = []
    for i, near in out:
        scores = v[near] @ q[i]
        if len(near) > k:
            bar = np.partition(scores, len(near) - k)[len(near) - k]
            near, scores = near[scores >= bar], scores[scores >= bar]
        order = np.lexsort((ids[near], -scores))[:k]
        best.append((i, near[order], scores[order]))
    return best


def blocks_of(every: DataFrame, n_blocks: int) -> DataFrame:
    """The written table of blocks: ids, vectors, sorted lists, and the lists' ends."""

    def pack(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        lists = sorted_lists(v)
        cols = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("dim", "vb")]
        cols += [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (table.column("vec_id").to_numpy(), v, lists)]
        cols += [pa.array([x.tolist()], pa.list_(pa.int64())) for x in ((lists[0], lists[-1]) if v.size else ([], []))]
        return pa.table(cols, names=[x.split()[0] for x in BLOCKS.split(", ")])

    dealt = every.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int").alias("vb"))
    return materialize(dealt.where("dim > 0").groupBy("dim", "vb").applyInArrow(pack, BLOCKS), "vector-blocks")


def _searched(k: int):
    """Rows sorted by block, a block's own row before the queries that meet it."""
    names = ["query_id", "vec_id", "score"]

    def search(block, asked: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, v, lists = block
        table = pa.Table.from_batches(asked)
        q = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
        kind = np.float64 if largest < 2**52 else np.int64
        query_ids = table.column("vec_id").to_numpy()
        found = block_top_k(q.astype(kind), query_ids, v.astype(kind), ids, k, lists.astype(kind), table.column("floor").to_numpy())
        rows = [(int(query_ids[i]), int(ids[j]), int(s)) for i, near, scores in found for j, s in zip(near, scores)]
        cols = list(zip(*rows)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, asked = None, None, []
        for batch in batches:
            where = np.stack([batch.column("dim").to_numpy(), batch.column("vb").to_numpy()], axis=1)
            packed = batch.column("ids").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(packed | np.concatenate(([True], (where[1:] != where[:-1]).any(1)))[: len(packed)]).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                rows, here = batch.slice(a, b - a), tuple(where[a])
                if asked and (packed[a] or here != place):
                    yield search(block, asked)
                    asked = []
                if packed[a]:
                    ids, v, lists = (np.frombuffer(rows.column(c)[0].as_buffer(), np.int64).copy() for c in ("ids", "vectors", "lists"))
                    block, place = (ids, v.reshape(-1, here[0]), lists.reshape(-1, here[0])), here
                    rows = rows.slice(1)
                if rows.num_rows and here == place:  # else no vector of this length is in the block
                    asked.append(rows.select(["vec_id", "v", "floor"]))
                if sum(x.num_rows for x in asked) >= AT_ONCE:
                    yield search(block, asked)
                    asked = []
        if asked:
            yield search(block, asked)

    return run


def _meet(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block for the queries(dim, vb, vec_id, v, floor) that meet it."""
    null = lambda kind: F.lit(None).cast(kind)
    left = blocks.select("dim", "vb", F.lit(0).alias("role"), null("long").alias("vec_id"), null("array<long>").alias("v"), null("long").alias("floor"), "ids", "vectors", "lists")
    right = queries.select("dim", "vb", F.lit(1).alias("role"), "vec_id", "v", "floor", *[null("binary").alias(c) for c in ("ids", "vectors", "lists")])
    both = left.unionByName(right).repartition(shuffle_partitions(blocks.sparkSession), "dim", "vb").sortWithinPartitions("dim", "vb", "role")
    return both.mapInArrow(_searched(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors(vec_id, embedding) for which the column `queries` holds."""
    every = quantised(vectors)
    n_blocks = max(1, -(-every.count() // VECTORS))
    blocks = blocks_of(every, n_blocks)
    asked = every.where(queries).distinct().withColumn("dim", F.size("v")).where("dim > 0")
    home = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n_blocks)).cast("int")
    first = materialize(_meet(blocks, asked.select("dim", home.alias("vb"), "vec_id", "v", F.lit(NO_FLOOR).alias("floor")), k), "first-block")
    found = first
    if n_blocks > 1:
        floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(NO_FLOOR).alias("floor"))
        ends = blocks.select("dim", "vb", "low", "high")
        ends = F.broadcast(ends) if n_blocks <= BROADCAST_BLOCKS else ends
        rest = asked.join(floors, F.col("query_id") == F.col("vec_id"), "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR))).withColumn("home", home).drop("query_id")
        most = F.aggregate(F.zip_with(F.zip_with("v", "high", lambda x, h: F.greatest(x, F.lit(0)) * h), F.zip_with("v", "low", lambda x, w: F.least(x, F.lit(0)) * w), lambda x, y: x + y), F.lit(0).cast("long"), lambda s, x: s + x)
        rest = rest.join(ends, "dim").where((F.col("vb") != F.col("home")) & (most >= F.col("floor")))
        found = first.unionByName(_meet(blocks, rest.select("dim", "vb", "vec_id", "v", "floor"), k))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP5_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
