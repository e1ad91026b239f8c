"""What the training-data operators share: tables, a shared work folder, hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker expands into numpy arrays at once.
SLICE_BYTES = 1 << 20
MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(33)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='feedloom-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session within one process (tests) uses a temporary folder; a cluster has no folder of its own
    that all its machines see, and must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return own_dir(spark.conf.get("spark.app.id"))


class Workspace:
    """Intermediate tables of one query, written as Parquet in the shared folder.

    A saved table cuts the lineage and survives the loss of any executor; ``drop`` frees it as soon as
    nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> SHIFT)) * MIX_1
    h = (h ^ (h >> SHIFT)) * MIX_2
    return h ^ (h >> SHIFT)


class RollingHash:
    """Hashes of any substring of a buffer from one prefix sum: sum of T[byte] * B**i, modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 7):
        self.bytes = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.empty(0, np.uint64)

    def powers(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * SLICE_BYTES)
            inverse = pow(self.BASE, -1, 2**64)
            step = np.full(n, self.BASE, np.uint64)
            step[0] = 1
            self.up = np.cumprod(step, dtype=np.uint64)
            step = np.full(n, inverse, np.uint64)
            step[0] = 1
            self.down = np.cumprod(step, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.bytes[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] ^ (end - start).astype(np.uint64) * MIX_2)


def slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to about ``most``; a larger row comes alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts in UTF-8; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def released() -> None:
    """Gives memory that a task has used back to the system: Python workers outlive their tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def connected_components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b long), for each id that has an edge.

    Contraction: every vertex moves to whichever of itself and its neighbours has the least hash, and the edges between
    what is left, without loops and repeats, are the next round's. A star is gone after two rounds and half of a path after
    each, so the joins of all rounds make a small multiple of the edges' rows. A hub's edges stay separate rows: minima
    are aggregated before the shuffle and the joins are plain equi-joins, so adaptive execution can split a hub.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = work.save(edges.where("a <> b").select(*pair).distinct(), f"{name}-edges-0")
    moves: list[DataFrame] = []
    while True:
        step = len(moves)
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min_by("b", F.xxhash64("b")).alias("near"))
        to = F.when(F.xxhash64("near") < F.xxhash64("id"), F.col("near")).otherwise(F.col("id"))
        moves.append(work.save(near.select("id", to.alias("to")), f"{name}-moves-{step}"))
        ends = [moves[-1].select(F.col("id").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab"]
        moved = left.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        left = work.save(moved.select(*pair).distinct(), f"{name}-edges-{step + 1}")
        work.drop(f"{name}-edges-{step}")
        if left.isEmpty():
            break
    last = moves[-1]
    for earlier in reversed(moves[:-1]):
        last = earlier.join(last.select(F.col("id").alias("to"), F.col("to").alias("last")), "to", "left").select("id", F.coalesce("last", "to").alias("to"))
    last = work.save(last, f"{name}-last")
    smallest = work.save(last.groupBy("to").agg(F.min("id").alias("component")), f"{name}-smallest")
    labels = work.save(last.join(smallest, "to").select("id", "component"), name)
    work.drop(f"{name}-last", f"{name}-smallest", f"{name}-edges-{step + 1}", *(f"{name}-moves-{k}" for k in range(step + 1)))
    return labels


#: Marks of a pre-filter, in words of 64: 131,072 words at most, however many keys.
MARKS = 1 << 23


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among ``keys``: those whose hash is marked in a table of bounded size, which is broadcast.

    It only spares a join the rows that can't match; the join itself decides.
    """
    mark = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(MARKS))
    words = keys.groupBy(F.floor(mark / 64).alias("marked_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (mark % 64).cast("int"))).alias("marked_bits"))
    word = F.floor(mark / 64)
    joined = rows.join(F.broadcast(words), word == F.col("marked_word"))  # at most MARKS / 64 rows
    return joined.where(F.getbit("marked_bits", (mark % 64).cast("int")) == 1).drop("marked_word", "marked_bits")


def places(rows: DataFrame, group: list[str], order: list[str], work: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``place``, their number from 0 within ``group`` by ``order`` (nulls first), and each group's size in ``n``.

    Rows are dealt by ranges of (group, order), so that a group of any size lies in many tasks; rows that agree in both
    get any order and lie in many tasks too. What a part of the ranges adds to its groups is one row for each of them. Group columns aren't null.
    """
    tie = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order, "tie"]]
    ranged = tie.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id())
    saved = work.save(ranged, name).withColumn("part", F.call_function("shiftright", F.col("at"), F.lit(33)))
    runs = work.save(saved.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), f"{name}-runs")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(*group, "part", (before - F.col("first")).alias("shift"))
    placed = saved.join(starts, [*group, "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")
    return placed, runs.groupBy(*group).agg(F.sum("n").alias("n"))


def dense(keys: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The distinct rows of ``keys`` with ``name``, numbers from 0 without gaps. What reaches the driver is one count for each partition."""
    saved = work.save(keys.distinct().withColumn("at", F.monotonically_increasing_id()), name)
    part = F.call_function("shiftright", F.col("at"), F.lit(33))
    counts = {r.part: r.n for r in saved.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    shifts, before = [], 0
    for p in sorted(counts):
        shifts.append((p, before - (p << 33)))
        before += counts[p]
    parts = work.spark.createDataFrame(shifts, "part long, shift long")
    return saved.join(F.broadcast(parts), part == F.col("part")).withColumn("name", F.col("at") + F.col("shift")).drop("at", "part", "shift")  # a row for each partition
