"""Nearest neighbours by stable low-dimensional projections, a kd-tree over them and a chi-square stopping test.

Largest inner product becomes smallest distance: a vector x gains sqrt(M^2 - |x|^2) as one more component, a
query is scaled to norm M and gains 0. A Gaussian projection to m dimensions is stable: the squared projected
distance over the squared distance follows chi-square with m degrees of freedom. So once the k-th best distance
found is r, a point nearer than r has a projected distance of at most r * sqrt(q) with probability p, q being the
p-quantile; cells of the kd-tree are opened, and points in them verified, in the order of projected distance until
that bound is passed.

How much that saves is the data's own: among vectors without any structure the 20th neighbour is nearly as far as
all others, and the test rightly stops late.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace, batch
from feedloom.llm.vectors import matrix, usable

SEED = 3
DIMENSIONS = 16
CONFIDENCE = 0.95
#: Rows of a cell; from ROOT**2 rows on, cells grow with the root of the rows, and so does their number.
CELL = 512
ROOT = 1000
#: The kd-tree's planes are fitted to the projections of so many rows, or of 8 a cell where that is more; every row is indexed.
SAMPLE = 40_000
#: Cells that each query opens before its bound is known.
FIRST_CELLS = 3
QUERIES_A_CHUNK = 128
#: Points of a cell that are verified before the bound may stop a query there, at first.
STEP = 64
#: Rounding of matrix products: candidates so near to the k-th best are summed again on their own.
SLACK = 1e-9
HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def chi_square_quantile(p: float, m: int) -> float:
    """For even m, the chi-square distribution function is 1 - exp(-x/2) * sum((x/2)**i / i!, i < m/2)."""
    low, high = 0.0, 40.0 * m
    for _ in range(80):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if below < p else (low, x)
    return high


class KdTree:
    """Median splits along the widest projected dimension, as arrays; cells are numbered leaves."""

    def __init__(self, points: np.ndarray, cells: int):
        self.depth = max(0, math.ceil(math.log2(max(1, cells))))
        self.axis = np.zeros(2**self.depth, np.int32)
        self.plane = np.zeros(2**self.depth)
        groups = {1: points}
        for _ in range(self.depth):
            below = {}
            for node, own in groups.items():
                if len(own):
                    self.axis[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                    self.plane[node] = np.median(own[:, self.axis[node]])
                right = own[:, self.axis[node]] > self.plane[node]
                below |= {2 * node: own[~right], 2 * node + 1: own[right]}
            groups = below

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.plane[node])
        return node - 2**self.depth


@dataclass
class Index:
    """The projection, the tree over it and the boxes of its cells."""

    gauss: np.ndarray
    top: float
    tree: KdTree
    quantile: float
    cells: np.ndarray
    lows: np.ndarray
    highs: np.ndarray

    @classmethod
    def of(cls, dim: int, top: float, confidence: float) -> Index:
        none = np.empty((0, DIMENSIONS))
        return cls(np.random.default_rng(SEED).standard_normal((dim + 1, DIMENSIONS)), top, KdTree(none, 1), chi_square_quantile(confidence, DIMENSIONS), np.empty(0, np.int64), none, none)

    def projected(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.top - np.einsum("id,id->i", x, x)))[:, None]]) @ self.gauss

    def projected_query(self, q: np.ndarray) -> np.ndarray:
        return (q * np.sqrt(self.top / np.einsum("id,id->i", q, q))[:, None]) @ self.gauss[:-1]

    def reach(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The squared projected distance beyond which nothing better than the score ``floor`` is expected."""
        norm = np.sqrt(np.einsum("id,id->i", q, q))
        return self.quantile * np.where(np.isfinite(floor), np.maximum(0, 2 * self.top - 2 * floor * math.sqrt(self.top) / norm), np.inf)

    def opened(self, q: np.ndarray, floor: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) pairs: the nearest few cells, or ``later`` the others within reach."""
        p = self.projected_query(q)
        distance = np.zeros((len(p), len(self.cells)))
        for i in range(DIMENSIONS):
            gap = np.maximum(0, np.maximum(self.lows[None, :, i] - p[:, i : i + 1], p[:, i : i + 1] - self.highs[None, :, i]))
            distance += gap * gap
        some = min(FIRST_CELLS, len(self.cells))
        first = np.zeros(distance.shape, bool)
        np.put_along_axis(first, np.argpartition(distance, some - 1, axis=1)[:, :some], True, axis=1)
        i, j = np.nonzero(~first & (distance <= self.reach(q, floor)[:, None]) if later else first)
        return i, self.cells[j]

    def search(self, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, v: np.ndarray, ids: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place in v, score) of the k best of a cell's points for each query that aren't below its floor.

        Points come in the order of projected distance, in steps that double, until the next is out of reach of the
        k-th best so far. A step is verified for all queries that still go on by one product; ``exact`` sums the
        best of them again, each alike, so that equal vectors tie exactly.
        """
        asked = self.projected_query(q)
        away = (p * p).sum(axis=1)[None, :] - 2 * asked @ p.T + (asked * asked).sum(axis=1)[:, None]
        away[ids[None, :] == q_ids[:, None]] = np.inf  # never its own id
        score = np.full(away.shape, -np.inf)
        going, step, at = np.arange(len(q)), max(STEP, 2 * k), 0
        turn = np.argsort(away, axis=1, kind="stable")
        while len(going) and at < len(ids):
            own = turn[going, at : at + step]
            rows, places = np.repeat(going, own.shape[1]), own.ravel()
            needed = np.unique(places)
            product = q[going] @ v[needed].T
            found = product[np.repeat(np.arange(len(going)), own.shape[1]), np.searchsorted(needed, places)]
            score[rows, places] = np.where(np.isfinite(away[rows, places]), found, -np.inf)
            at, step = at + step, 2 * step
            if at < len(ids):
                best = floor[going]
                if k <= len(ids):
                    best = np.maximum(best, -np.partition(-score[going], k - 1, axis=1)[:, k - 1])
                going = going[away[going, turn[going, at]] <= self.reach(q[going], best)]
        least = floor - SLACK
        if k <= len(ids):
            least = np.maximum(least, -np.partition(-score, k - 1, axis=1)[:, k - 1] - SLACK)
        i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
        exact = np.einsum("kd,kd->k", q[i], v[j])
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = (rank < k) & (exact >= floor[i])
        return i[keep], j[keep], exact[keep]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, confidence: float = CONFIDENCE, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows by inner product, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all other rows. Vectors that are
    null, zero, or hold null or non-finite components, and null ids, take no part. Vectors are compared only with
    those of as many components. Rows that repeat a vec_id count as one candidate each but never match a query of
    their own id; of those that are queries, any one asks. An empty table gives no rows; further columns aren't read.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "ann")
    clean = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    clean = work.save(clean.withColumn("dim", F.size("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), "clean")
    parts = []
    for dim, rows, top in [(r.dim, r.n, r.top) for r in clean.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("top")).collect()]:
        parts.append(_nearest(clean.where(F.col("dim") == dim), work, dim, rows, top, k, every, confidence, cell))
    work.drop("clean")
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def _nearest(clean: DataFrame, work: Workspace, dim: int, rows: int, top: float, k: int, every: int, confidence: float, cell: int) -> DataFrame:
    size = max(cell, cell * math.isqrt(rows) // ROOT)
    cells = math.ceil(rows / size)
    index = Index.of(dim, top, confidence)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(index.projected(matrix(x.column("v")))), pa.list_(pa.float64()))], names=["p"])

    wanted = max(SAMPLE, 8 * cells)
    some = clean.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_000)) < math.ceil(min(1.0, wanted / rows) * 1_000_000)).select("v").limit(2 * wanted)
    got = some.mapInArrow(project, "p array<double>").toArrow()
    index.tree = KdTree(matrix(got.column("p").combine_chunks()) if got.num_rows else np.zeros((1, DIMENSIONS)), cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                p = index.projected(matrix(x.column("v")))
                names = ["cell", "vec_id", "v", "p"]
                yield pa.RecordBatch.from_arrays([pa.array(index.tree.cell(p).astype(np.int32)), x.column("vec_id"), x.column("v"), pa.array(list(p), pa.list_(pa.float64()))], names=names)

    placed = work.save(clean.select("vec_id", "v").mapInArrow(place, "cell int, vec_id long, v array<double>, p array<double>"), f"placed-{dim}")
    low = [F.min(F.col("p")[i]).alias(f"l{i}") for i in range(DIMENSIONS)]
    high = [F.max(F.col("p")[i]).alias(f"h{i}") for i in range(DIMENSIONS)]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *low, *high).toPandas()  # a row for each cell
    index.cells = boxes["cell"].to_numpy()
    index.lows, index.highs = (boxes[[f"{x}{i}" for i in range(DIMENSIONS)]].to_numpy() for x in "lh")
    # A cell that ties keep large is cut into parts by a hash; all of them are searched.
    large = work.save(placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * size)).cast("int").alias("parts")), f"parts-{dim}")
    salted = placed.join(large, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(SEED + 1)), F.col("parts")).cast("int"))
    salted = salted.repartition("cell", "part")  # or a large cell would be gathered in the one task of its join
    blocks = work.save(salted.groupBy("cell", "part").agg(F.collect_list(F.struct("vec_id", "v", "p")).alias("rows")), f"blocks-{dim}")
    work.drop(f"placed-{dim}")

    def opening(later: bool):
        schema = pa.schema([("cell", pa.int32()), ("query_id", pa.int64()), ("q", pa.list_(pa.float64())), ("floor", pa.float64())])

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 64):
                    x = whole.slice(at, 64)
                    i, cells = index.opened(matrix(x.column("q")), x.column("floor").to_numpy(), later)
                    own = x.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), own.column("query_id"), own.column("q"), own.column("floor")], schema=schema)

        return visits

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for n in range(whole.num_rows):
                row = whole.slice(n, 1)
                own, asked = row.column("rows").flatten(), row.column("queries").flatten()
                ids, q_ids = own.field("vec_id").to_numpy(), asked.field("query_id").to_numpy()
                i, j, score = index.search(matrix(asked.field("q")), q_ids, asked.field("floor").to_numpy(), matrix(own.field("v")), ids, matrix(own.field("p")), k)
                yield batch(HITS, query_id=q_ids[i], vec_id=ids[j], score=score)

    def searched(queries: DataFrame, later: bool) -> DataFrame:
        visits = queries.select("query_id", "q", "floor").mapInArrow(opening(later), "cell int, query_id long, q array<double>, floor double")
        visits = work.save(visits, f"visits-{dim}-{later}")
        chunks = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES_A_CHUNK).cast("int").alias("chunks"))
        asked = visits.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")))
        asked = asked.repartition("cell", "chunk").groupBy("cell", "chunk").agg(F.collect_list(F.struct("query_id", "q", "floor")).alias("queries"))
        asked = asked.join(large, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "queries")
        return blocks.join(asked, ["cell", "part"]).select("rows", "queries").mapInArrow(search, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    queries = clean.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.first("v").alias("q"))
    found = work.save(searched(queries.withColumn("floor", F.lit(float("-inf"))), False), f"first-{dim}")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kth = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    later = searched(queries.join(kth, "query_id", "left").withColumn("floor", F.coalesce("kth", F.lit(float("-inf")))), True)
    both = ranked.select("query_id", "vec_id", "score").unionByName(later.select("query_id", "vec_id", "score"))
    out = work.save(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), f"result-{dim}")
    work.drop(f"blocks-{dim}", f"parts-{dim}", f"first-{dim}", f"visits-{dim}-False", f"visits-{dim}-True")
    return out
