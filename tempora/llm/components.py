"""Connected components of an edge table, all on the executors: runs of edges are thinned to star links, then large-star
and small-star rounds alternate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import materialize, release, tidy

MAX_ROUNDS = 60
#: Edges that a task thins at a time (some 100 bytes of memory each).
RUN = 1 << 18


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges point from the larger to the smaller end."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links with the same components as the links a-b."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(ids))
    return ids[off], ids[label[off]]


def _forests(edges: DataFrame, tasks: int, run_of: int) -> DataFrame:
    """Star links in place of each `run_of` edges that stand together; in place of all, if one task has no more."""

    def star(held):
        u, v = spanning(*(np.concatenate(c) for c in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches):
        held, size = [], 0
        for whole in batches:
            start = 0
            while start < whole.num_rows:
                batch = whole.slice(start, run_of - size)
                held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
                start, size = start + batch.num_rows, size + batch.num_rows
                if size == run_of:
                    yield star(held)
                    held, size = [], 0
        if size:
            yield star(held)

    return edges.coalesce(tasks).mapInArrow(tidy(run), "u long, v long")


def components(edges: DataFrame, run_of: int = RUN) -> DataFrame:
    """edges(u, v) of longs -> (u, v): every node but the least of its component, with that least node.

    Edges are first thinned, `run_of` of them at a time, to star links with the same components, as long as that halves
    them: so what many patterns or keys found again within one group goes before any join. Up to `run_of` edges that ends
    it; more of them go on in rounds. Each round writes its edges to the shared folder. A node with many links is a skewed
    join key at most, never one task's group. Self-links, repeated links and nulls are ignored; no edges give no rows.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    seen, before, thin = None, None, True  # seen: what a star round was given
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return now
        last = mark[0] <= run_of
        thin = last or (thin and (before is None or 2 * mark[0] <= before))
        seen, before = None if thin else mark, mark[0]
        old, now = now, materialize(_forests(now, -(-mark[0] // run_of), run_of) if thin else _small_star(_large_star(now)), "edges")
        release(old)
        if last:
            return now
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
