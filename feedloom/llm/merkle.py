"""A Merkle manifest of a dataset: one tree of fan-out 8 for each language, and one over their roots.

Leaves are hashed in the JVM, numbered within their language by ranges, and cut into runs of consecutive leaves. Each run is
read once into a stack of unfinished sibling lists, one a level: eight siblings carry into one node of the next
level, as digits carry in a counter. What a run can't finish, because its siblings lie in the run before or behind,
is an open node; open nodes are merged level by level with DataFrame operations. A last list of siblings
may be short and is hashed as it is, without padding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace, places

FANOUT = 8
#: Leaves that one task holds at once.
RUN = 5_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "key string, total long, level int, index long, hash string, open boolean"
PATHS = "doc_id long, leaf string, subroot string, root string, proof string, folded string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """SHA-256 of all fields, each with its length, so that no two rows share an input."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def widths(total: int) -> list[int]:
    """How many nodes each level has, from the leaves to the single top."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


def mountains(hashes: Iterable[str], start: int, total: int) -> Iterator[tuple[int, int, str, bool]]:
    """(level, index, hash, open) of every node above consecutive leaves from number ``start``, and of leaves that stay open.

    ``waiting[k]`` are the siblings of level k whose list isn't full yet. A full list gives its parent only if it began here.
    """
    width = widths(total)
    waiting: list[list[tuple[int, str]]] = [[] for _ in width]
    for place, leaf in enumerate(hashes, start):
        level, index, node = 0, place, leaf
        while level < len(width) - 1:
            waiting[level].append((index, node))
            if (index + 1) % FANOUT and index + 1 < width[level]:
                break
            own, waiting[level] = waiting[level], []
            whole = own[0][0] % FANOUT == 0
            yield from ((level, i, h, not whole) for i, h in own if level or not whole)
            if not whole:
                break
            level, index, node = level + 1, index // FANOUT, digest("".join(h for _, h in own))
        else:
            if level:
                yield level, index, node, False
    for level, own in enumerate(waiting):
        yield from ((level, i, h, True) for i, h in own)


def stacked(leaves: DataFrame) -> DataFrame:
    """The nodes above each run of leaves (key, total, place, leaf), NODES."""

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by("place")
        key, total = own["key"][0].as_py(), own["total"][0].as_py()
        found = list(mountains(own["leaf"].to_pylist(), own["place"][0].as_py(), total))
        level, index, hashes, open_ = zip(*found, strict=True) if found else ((), (), (), ())
        n = len(found)
        return pa.table({"key": pa.array([key] * n, pa.string()), "total": pa.array([total] * n, pa.int64()), "level": pa.array(level, pa.int32()), "index": pa.array(index, pa.int64()), "hash": pa.array(hashes, pa.string()), "open": pa.array(open_, pa.bool_())})

    return leaves.select("key", "total", "place", "leaf", "run").groupBy("key", "run").applyInArrow(run, NODES)


def nodes(leaves: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(key, total, level, index, hash) of every node but the leaves; of the leaves those that runs share a list with."""
    saved = work.save(stacked(leaves), f"{name}-stacks")
    most = leaves.agg(F.max("total")).first()[0]
    depth = len(widths(most)) - 1 if most else 0
    merged, out = None, saved
    for level in range(depth):
        here = saved.where((F.col("level") == level) & F.col("open"))
        if merged is not None:
            here = here.unionByName(merged)
        top = F.col("total") <= F.lit(FANOUT**level).cast("decimal(20,0)")
        lists = here.where(~top).groupBy("key", "total", F.floor(F.col("index") / FANOUT).alias("index")).agg(F.sort_array(F.collect_list(F.struct(F.col("index").alias("i"), "hash"))).alias("own"))  # at most 8
        merged = work.save(lists.select("key", "total", F.lit(level + 1).alias("level"), "index", F.sha2(F.array_join("own.hash", ""), 256).alias("hash"), F.lit(True).alias("open")), f"{name}-merged-{level + 1}")
        out = out.unionByName(merged)
    return out.drop("open")


def indexed(leaves: DataFrame, order: list[str], work: Workspace, name: str, run: int) -> DataFrame:
    """Leaves with their place, the run it lies in, and how many their key has."""
    placed, sizes = places(leaves, ["key"], order, work, name)
    return work.save(placed.join(sizes.withColumnRenamed("n", "total"), "key").withColumn("run", F.floor(F.col("place") / run)), f"{name}-placed")


def spread(level: Column) -> Column:
    """Leaves below a whole node of ``level``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (level * 3).cast("int"))


def above(place: Column, level: Column) -> Column:
    """The number of the node of ``level`` above a leaf."""
    return F.call_function("shiftright", place, (level * 3).cast("int"))


def tops(leaves: DataFrame, made: DataFrame) -> DataFrame:
    """(key, total, hash) of each tree's top: its only leaf, or the node that spans all."""
    return made.where(spread(F.col("level")) >= F.col("total")).select("key", "total", "hash").unionByName(leaves.where("total = 1").select("key", "total", F.col("leaf").alias("hash")))


def top_paths(subroots: DataFrame, work: Workspace, run: int) -> DataFrame:
    """(key, subroot, root, path) of each language: ``path`` has a list of siblings a level, with the own place in it."""
    leaves = indexed(subroots.select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("hash").alias("leaf")), ["of"], work, "roots", run)
    made = nodes(leaves, work, "root")
    root = tops(leaves, made).select("key", F.col("hash").alias("root"))
    depth = len(widths(leaves.count())) - 1
    known = made.select("level", "index", "hash").unionByName(leaves.select(F.lit(0).alias("level"), F.col("place").alias("index"), F.col("leaf").alias("hash"))).distinct()
    lists = known.groupBy("level", above(F.col("index"), F.lit(1)).alias("parent")).agg(F.sort_array(F.collect_list(F.struct(F.col("index").alias("i"), "hash"))).alias("own"))  # at most 8
    steps = leaves.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(depth)]).cast("array<int>"))).withColumn("parent", above(F.col("place"), F.col("level") + 1)).join(lists, ["level", "parent"])
    step = F.struct("level", F.pmod(above(F.col("place"), F.col("level")), F.lit(FANOUT)).cast("int").alias("at"), F.col("own.hash").alias("hashes"))
    paths = steps.groupBy("of").agg(F.sort_array(F.collect_list(step)).alias("path"))  # one step a level
    none = F.array().cast("array<struct<level:int,at:int,hashes:array<string>>>")
    return leaves.join(root, "key").select("of", F.col("leaf").alias("subroot"), "root").join(paths, "of", "left").select(F.col("of").alias("key"), "subroot", "root", F.coalesce("path", none).alias("path"))


def manifest(docs: DataFrame, changed_text: Column | None = None, run: int = RUN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded): each row's place in the manifest, and the root that its leaf folds to.

    ``proof`` is the SHA-256 of its siblings on the way to the root. ``folded`` starts from the leaf of the row whose text is
    ``changed_text`` where that isn't null, else from the leaf itself, and goes up by the same siblings.
    Nulls in any field have their own sign; null languages are a tree of their own, before the others. Within a language rows
    ascend by doc_id, nulls first, then by leaf, so that repeated rows are leaves side by side. Empty and very long texts are
    hashed whole; no rows give none. Further columns aren't read.
    """
    work = Workspace(docs.sparkSession, "merkle")
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # nulls first, then by bytes
    forged = F.when(changed_text.isNotNull(), leaf_hash(text=changed_text)) if changed_text is not None else F.lit(None).cast("string")
    hashed = docs.select(key.alias("key"), "doc_id", leaf_hash().alias("leaf"), forged.alias("forged"))
    leaves = indexed(hashed, ["doc_id", "leaf"], work, "leaves", run)
    made = work.save(nodes(leaves, work, "nodes"), "nodes")
    paths = top_paths(tops(leaves, made), work, run)
    # every run gets the lists of siblings above its leaves: a node goes to the runs below its parent
    child = above(F.col("index"), F.lit(1)) * spread(F.col("level") + 1)
    last = F.least(child + spread(F.col("level") + 1), F.col("total")) - 1
    below = F.explode(F.sequence(F.floor(child / run), F.floor(last / run)))
    near = made.where(spread(F.col("level")) < F.col("total")).select("key", below.alias("run"), "level", "index", "hash")
    runs = leaves.select("key", "run").distinct().join(paths, "key")
    context = near.withColumns({"subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string"), "path": F.lit(None).cast("array<struct<level:int,at:int,hashes:array<string>>>")}).unionByName(
        runs.withColumns({"level": F.lit(None).cast("int"), "index": F.lit(None).cast("long"), "hash": F.lit(None).cast("string")}))
    own = leaves.select("key", "run", "total", "place", "doc_id", "leaf", "forged")
    return own.groupBy("key", "run").cogroup(context.groupBy("key", "run")).applyInArrow(proved, PATHS)


def proved(own: pa.Table, context: pa.Table) -> pa.Table:
    """PATHS of one run's leaves."""
    own = own.sort_by("place")
    places_, leaves = own["place"].to_pylist(), own["leaf"].to_pylist()
    width = widths(own["total"][0].as_py())
    known: list[dict[int, str]] = [{} for _ in width]
    known[0] = dict(zip(places_, leaves, strict=True))
    top = None
    for level, index, h, subroot, root, path in zip(*[context[c].to_pylist() for c in ("level", "index", "hash", "subroot", "root", "path")], strict=True):
        if level is None:
            top = (subroot, root, [("".join(s["hashes"][: s["at"]]), "".join(s["hashes"][s["at"] + 1 :])) for s in path])
        else:
            known[level][index] = h
    subroot, root, upper = top

    def beside(level: int, index: int) -> tuple[str, str]:
        first = index - index % FANOUT
        hashes = [known[level][k] for k in range(first, min(first + FANOUT, width[level]))]
        return "".join(hashes[: index - first]), "".join(hashes[index - first + 1 :])

    def steps() -> Iterator[list[tuple[str, str]]]:
        """Left and right siblings of each level above each leaf; those above the first level stay the same for 8 leaves and more."""
        kept: list[tuple[int, tuple[str, str]]] = [(-1, ("", ""))] * len(width)
        for place in places_:
            for level in range(len(width) - 1):
                index = place // FANOUT**level
                if kept[level][0] != index:
                    kept[level] = index, beside(level, index)
            yield [pair for _, pair in kept[:-1]] + upper

    proofs, folded = [], []
    for leaf, forged, way in zip(leaves, own["forged"].to_pylist(), steps(), strict=True):
        proofs.append(digest("".join(a + b for a, b in way)))
        node = forged or leaf
        for a, b in way:
            node = digest(a + node + b)
        folded.append(node)
    n = len(leaves)
    return pa.table({"doc_id": own["doc_id"], "leaf": own["leaf"], "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()), "proof": pa.array(proofs, pa.string()), "folded": pa.array(folded, pa.string())})
