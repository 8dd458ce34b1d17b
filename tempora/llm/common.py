"""What the operators share: shared-folder tables, null-safe documents, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.sources.shared import new_path

#: Paths written by materialize() within the innermost scratch().
_SCRATCH: list[list[str]] = []


def _delete(spark: SparkSession, path: str, now: bool) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(place, True) if now else files.deleteOnExit(place)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver delete a written table when the application ends; until then every DataFrame over it holds."""
    _delete(spark, path, now=False)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    forget_at_exit(spark, path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tempora_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the table that materialize() wrote for df, which no plan needs any more."""
    path = getattr(df, "tempora_path", None)
    if path:
        _delete(df.sparkSession, path, now=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """Tables written within go at its end, but for those given to the function that it yields."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        path = df.tempora_path
        paths.remove(path)
        if len(_SCRATCH) > 1:
            _SCRATCH[-2].append(path)
        return df

    _SCRATCH.append(paths)
    try:
        yield keep
    finally:
        _SCRATCH.pop()
        for path in paths:
            _delete(spark, path, now=True)


#: Rows an Arrow batch between Spark and Python, at most: whole documents are large rows.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text of each row; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run):
    """`run`, a function over Arrow batches, giving back to the system what it leaves free: workers outlive their tasks."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def as_bytes(column) -> list:
    """The UTF-8 bytes of an Arrow string column (no decoding); null stays None."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
