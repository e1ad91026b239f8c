"""Near-duplicate embeddings by random-hyperplane sign hashing, exact cosine and connected components.

Vectors that are equal form one class, and only classes are compared. Each table hashes a vector to the signs
of its products with some random hyperplanes. Their number follows from the rows of the vector's label, so that
few unrelated vectors share a bucket, and the number of tables from that, so that a pair exactly at the cosine
threshold shares a bucket with the wanted probability. Only classes that share a bucket travel with their vectors.
Large buckets are cut into blocks, and pairs of blocks are compared by matrix products: they give link counts and
a spanning forest, never pairs. A pair counts in the first table whose bucket both share, so several tables never
count it twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import MIX_1, Workspace, batch, connected_components, mix, signed
from feedloom.llm.vectors import matrix, usable

SEED = 5
RECALL = 0.999
#: Members of a block of a large bucket.
BLOCK = 256
#: Bits beyond one bucket for each vector: an unrelated vector shares a given bucket with a chance of 1 in 2**SPARE.
SPARE = 3
#: Numbers that a worker holds in one product of many small buckets.
TOGETHER = 2_000_000
#: Rounding of matrix products; pairs so near to the threshold are summed again on their own.
SLACK = 1e-9
KEYS = pa.schema([("key", pa.int64()), ("t", pa.int32()), ("id", pa.int64())])
FOUND = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def table_plan(rows: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many vectors of a label: few unrelated vectors a bucket, and ``recall`` at the threshold."""
    bits = min(62, max(6, round(math.log2(max(2, rows))) + SPARE))  # a code is one long
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


@cache
def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim, bits)).standard_normal((dim, tables * bits))


def codes(v: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables): the signs in each table as a number."""
    side = (v @ planes(v.shape[1], bits, tables) > 0).reshape(len(v), tables, bits)
    return side @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def reaching(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs a[i], b[j] reach the cosine in double precision; each pair is summed alike."""
    x, y = a[i], b[j]
    size = np.sqrt(np.einsum("kd,kd->k", x, x)) * np.sqrt(np.einsum("kd,kd->k", y, y))
    return np.einsum("kd,kd->k", x, y) / size >= cosine


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the edges (a[k], b[k]) that connect what all of them connect: smallest labels spread, each by one edge."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = np.concatenate([place[: len(a)], place[len(a) :]]), np.concatenate([place[len(a) :], place[: len(a)]])
    label, chosen = np.arange(len(nodes)), []
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        edge = np.flatnonzero((label[j] == least[i]) & (least[i] < label[i]))
        if not len(edge):
            break
        _, once = np.unique(i[edge], return_index=True)
        chosen.append(edge[once])
        label = least
    kept = np.concatenate(chosen) if chosen else np.empty(0, np.int64)
    return nodes[i[kept]], nodes[j[kept]]


class Members:
    """Bucket members of one batch: ids, weights and vectors of one length."""

    def __init__(self, rows: pa.Array):
        self.ids, self.weight = (rows.field(x).to_numpy(zero_copy_only=False) for x in ("id", "weight"))
        self.v = matrix(rows.field("v"))
        self.unit = self.v / np.sqrt(np.einsum("id,id->i", self.v, self.v))[:, None]


def first_shared(a: Members, b: Members, i: np.ndarray, j: np.ndarray, t: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Whether table t[k] is the first in which the pair i[k], j[k] shares a bucket."""
    of_i, at_i = np.unique(i, return_inverse=True)
    of_j, at_j = np.unique(j, return_inverse=True)
    same = codes(a.v[of_i], bits, tables)[at_i] == codes(b.v[of_j], bits, tables)[at_j]
    return same.any(axis=1) & (same.argmax(axis=1) == t)


def near_vectors(vectors: DataFrame, cosine: float = 0.93, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) over columns vec_id, embedding and label; one row for each input row.

    Only vectors with equal labels, not null, and equal numbers of components are compared. Vectors that are
    null, zero, or hold null or non-finite components link with nothing, and so do rows with a null vec_id.
    Each row is a vector of its own, also where rows repeat a vec_id: ``n_links`` counts the other rows that it
    is linked with, ``component_id`` is the smallest vec_id among the rows reachable by links. An empty table
    gives no rows; further columns aren't read.
    """
    work = Workspace(vectors.sparkSession, "vectors")
    good = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = vectors.select("vec_id", "label", "embedding", F.xxhash64("embedding").alias("h"), F.hash("embedding").alias("h2"), good.alias("good"))
    rows = work.save(keyed.select("vec_id", "label", "h", "h2", "good"), "rows")
    classes = keyed.where("good").groupBy("label", "h", "h2").agg(F.min("vec_id").alias("least"), F.first("embedding").alias("v"), F.count("*").alias("weight"))
    classes = work.save(classes.select(F.monotonically_increasing_id().alias("id"), "label", "h", "h2", "least", "weight", F.size("v").alias("dim"), "v"), "classes")
    labels = classes.groupBy("label").agg(F.count("*").alias("n")).withColumn("of", F.monotonically_increasing_id())
    labels = work.save(labels, "labels")
    sized = classes.join(labels, "label").select("id", "of", "n", "dim", "weight", "v")

    def plan(n: int) -> tuple[int, int]:
        return table_plan(n, cosine, recall)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                n, dim = (part.column(x).to_numpy() for x in ("n", "dim"))
                bits = np.array([plan(x)[0] for x in n.tolist()])
                for b, d in sorted(set(zip(bits.tolist(), dim.tolist(), strict=True))):
                    mine = part.filter(pa.array((bits == b) & (dim == d)))
                    tables = max(plan(x)[1] for x in mine.column("n").to_pylist())
                    found = codes(matrix(mine.column("v")), b, tables).astype(np.uint64)
                    where = mix(mine.column("of").to_numpy().astype(np.uint64)[:, None] * MIX_1 + np.arange(tables, dtype=np.uint64) + np.uint64(d << 32))
                    t = np.broadcast_to(np.arange(tables, dtype=np.int32), found.shape).ravel()
                    yield batch(KEYS, key=signed(mix(found + where)).ravel(), t=t, id=np.repeat(mine.column("id").to_numpy(), tables))

    hashed = sized.select("id", "of", "n", "dim", "v").mapInArrow(keys, "key long, t int, id long")
    shared = hashed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    member = work.save(hashed.join(shared, "key").withColumn("parts", F.ceil(F.col("members") / block).cast("int")), "members")
    full = member.join(sized, "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("parts")).cast("int"))
    bucket = ["key", "t", "of", "dim", "n"]
    packed = full.groupBy(*bucket, "parts", "part").agg(F.collect_list(F.struct("id", "weight", "v")).alias("m"))  # about ``block`` members
    packed = work.save(packed.where("parts > 1 or size(m) > 1"), "blocks")
    # The blocks of a large bucket meet themselves and the later ones; rows are blocks, not vectors.
    small = packed.where("parts = 1").select("t", "dim", "n", "m")
    large = packed.where("parts > 1")
    one = large.select(*bucket, "part", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("with"), "m")
    two = large.select(*bucket, F.explode(F.sequence(F.lit(0), F.col("part"))).alias("part"), F.col("part").alias("with"), F.col("m").alias("other"))
    meets = one.join(two, [*bucket, "part", "with"]).select("t", "n", (F.col("part") == F.col("with")).alias("same"), "m", "other")

    def links(a: Members, b: Members, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        ends, place = np.unique(np.concatenate([a.ids[i], b.ids[j]]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([b.weight[j], a.weight[i]]), len(ends)).astype(np.int64)
        first, second = spanning(a.ids[i], b.ids[j])
        return batch(FOUND, id=np.concatenate([ends, first]), other=np.concatenate([ends, second]), links=np.concatenate([counts, np.zeros(len(first), np.int64)]))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside small buckets, those of one size in one product."""
        for rows in batches:
            lists = rows.column("m")
            n, t, dim = (rows.column(x).to_numpy() for x in ("n", "t", "dim"))
            size, start, items = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), lists.flatten()
            for s, d, of in sorted(set(zip(size.tolist(), dim.tolist(), n.tolist(), strict=True))):
                own = np.flatnonzero((size == s) & (dim == d) & (n == of))
                step = max(1, TOGETHER // (s * max(s, d)))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    m = Members(items.take(pa.array((start[some][:, None] + np.arange(s)).ravel())))
                    unit = m.unit.reshape(len(some), s, d)
                    near = np.triu(unit @ unit.transpose(0, 2, 1) >= cosine - SLACK, 1)
                    k, i, j = np.nonzero(near)
                    i, j = k * s + i, k * s + j
                    yield from confirmed(m, m, i, j, t[some][k], of)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between two blocks of a large bucket, or inside one."""
        for whole in batches:
            for k in range(whole.num_rows):
                row = whole.slice(k, 1)
                a, b = (Members(row.column(x).flatten()) for x in ("m", "other"))
                near = a.unit @ b.unit.T >= cosine - SLACK
                if row.column("same")[0].as_py():
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                yield from confirmed(a, b, i, j, np.full(len(i), row.column("t")[0].as_py()), row.column("n")[0].as_py())

    def confirmed(a: Members, b: Members, i: np.ndarray, j: np.ndarray, t: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(i), 8192):
            x, y, z = (c[at : at + 8192] for c in (i, j, t))
            good = reaching(a.v, b.v, x, y, cosine)
            x, y, z = x[good], y[good], z[good]
            if len(x):
                new = first_shared(a, b, x, y, z, *plan(n))
                if new.any():
                    yield links(a, b, x[new], y[new])

    how = "id long, other long, links long"
    found = work.save(small.mapInArrow(within, how).unionByName(meets.mapInArrow(across, how)), "found")
    work.drop("blocks", "members")
    component = connected_components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")), work, "components")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    state = classes.select("id", "label", "h", "h2", "least", "weight").join(counted, "id", "left").join(component, "id", "left")
    state = state.select("label", "h", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    smallest = state.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = state.join(smallest, "component").select("label", "h", "h2", F.lit(True).alias("good"), "n_links", "component_id")
    return (
        rows.join(placed, ["label", "h", "h2", "good"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
