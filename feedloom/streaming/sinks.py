"""Sinks of streams that replace what a key had: captured tags by entry, and a feed's window wholesale."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.entries import top_per_group
from feedloom.operators.state import replaced

#: Buckets of keys; a batch rewrites only those that its keys fall into.
BUCKETS = 64


def _children(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return {}
    names = [x.getPath().getName() for x in fs.listStatus(where)]
    return {int(n.removeprefix(prefix)): f"{path}/{n}" for n in names if n.startswith(prefix)}


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[str]]:
    """The folders of each bucket, the oldest first, of batches before the given one."""
    out: dict[int, list[str]] = {}
    for batch, folder in sorted(_children(spark, path, "batch=").items()):
        if before is None or batch < before:
            for bucket, at in _children(spark, folder, "bucket=").items():
                out.setdefault(bucket, []).append(at)
    return out


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as the last batch left it: the newest folder of every bucket."""
    folders = [v[-1] for v in _versions(spark, path).values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def replacing(path: str, key: Sequence[str], unique: Sequence[str], order: Sequence[Column], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the rows of a batch replace all that their ``key`` had; ``current`` reads the table.

    Rows are unique by ``unique``, the first by ``order`` staying. Keys lie in buckets by a hash, and a batch writes new versions of those
    that it touches only. A version depends on the one before and its batch, so a batch that runs again writes the
    same; versions older than the one before go.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket")
        new = top_per_group(batch, unique, order).drop("rank")
        touched = {r.bucket for r in batch.select(bucket).distinct().collect()}  # at most ``buckets``
        versions = {b: v for b, v in _versions(spark, path, batch_id).items() if b in touched}
        if versions:
            new = replaced(spark.read.schema(new.schema).parquet(*[v[-1] for v in versions.values()]), new, key)
        new.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")
        for folders in versions.values():
            for old in folders[:-1]:
                where = spark._jvm.org.apache.hadoop.fs.Path(old)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return write
