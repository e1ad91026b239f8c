"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents lie in blocks dealt by a hash. A source's draws are its blocks in a permuted
order, pass after pass, until its target is met. The exact number of draws of every source is split among
the output shards by a binary tree of multivariate-hypergeometric draws; a shard then owns a disjoint run of
each source's permuted draws and shuffles locally by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Output shards at least, and words of one beyond that; blocks of a source at most, for each of so many shards.
SHARDS, SHARD_WORDS = 64, 50_000_000
BLOCKS, BLOCK_SHARE = 2048, 4
#: Draws that numpy samples from at once, and tasks that split the tree's lower nodes.
DRAWS, TASKS = 10**9, 256
SEED = 20240229


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def target_words(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> list[float]:
    """Shares of all words by weight; what exceeds ``most`` times a source's words is shared again among the rest."""
    total = float(sum(sizes))
    shares = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(shares) if i not in full)
        out = [float(most * sizes[i]) if i in full else rest * shares[i] / weight for i in range(len(sizes))]
        over = {i for i, x in enumerate(out) if i not in full and x > most * sizes[i]}
        if not over:
            return out
        full |= over


def portion(counts: np.ndarray, share: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``share`` draws without replacement come from each source of ``counts``.

    Beyond the sampler's limit sources are drawn in groups below it: a group gets its exact part of the share, and chance
    decides within the group.
    """
    total = int(counts.sum())
    if total < DRAWS:
        return rng.multivariate_hypergeometric(counts, share, method="marginals") if total else counts
    groups, size = [[]], 0
    for i, n in enumerate(counts.tolist()):
        if groups[-1] and size + n >= DRAWS:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += n
    out, before, given = np.zeros_like(counts), 0, 0
    for own in groups:
        before += int(counts[own].sum())
        part = before * share // total - given
        given += part
        out[own] = portion(counts[own], part, rng) if len(own) > 1 else part
    return out


def halves(first: int, last: int, starts: np.ndarray, counts: np.ndarray, seed: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The two nodes below that of shards ``first`` to ``last``: each with its sources' first draws and how many it has of each."""
    half = (first + last) // 2
    left = portion(counts, int(counts.sum()) * (half - first) // (last - first), np.random.default_rng([seed, first, last]))
    return [(first, half, starts, left), (half, last, starts + left, counts - left)]


def quotas_below(first: int, last: int, starts: np.ndarray, counts: np.ndarray, seed: int, least: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The nodes of at most ``least`` shards below a node, in order."""
    stack = [(first, last, starts, counts)]
    while stack:
        node = stack.pop()
        if node[1] - node[0] <= least:
            yield node
        else:
            stack += halves(*node, seed)[::-1]


def split_quotas(draws: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): how many draws of each source go to each shard, exactly summing to ``draws``."""
    counts = np.asarray(draws, np.int64)
    return np.array([own for *_, own in quotas_below(0, shards, np.zeros_like(counts), counts, seed)]).reshape(shards, len(draws))


def shard_runs(spark: SparkSession, draws: list[int], shards: int, seed: int = SEED) -> DataFrame:
    """(number, bucket, shard, start, end) of each shard's run of each source's draws, once for each bucket that it reaches into.

    The tree's upper nodes are split here, TASKS of them at most; what is below each is split by a task. A bucket is as wide as a run is on
    average, so that all runs together reach into few more buckets than there are runs.
    """
    counts = np.asarray(draws, np.int64)
    top = [(f, n, s.tolist(), c.tolist()) for f, n, s, c in quotas_below(0, shards, np.zeros_like(counts), counts, seed, max(1, -(-shards // TASKS)))] if len(draws) else []
    widths = [max(1, -(-n // shards)) for n in draws]

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f, n, s, c in batch.itertuples(index=False):
                for shard, _, starts, own in quotas_below(f, n, np.asarray(s, np.int64), np.asarray(c, np.int64), seed):
                    some = np.flatnonzero(own)
                    yield pd.DataFrame({"number": some, "shard": shard, "start": starts[some], "end": starts[some] + own[some], "width": np.asarray(widths, np.int64)[some]})

    nodes = spark.createDataFrame(top, "f int, n int, s array<long>, c array<long>").repartition(max(1, min(len(top), TASKS)))
    runs = nodes.mapInPandas(below, "number int, shard int, start long, end long, width long")
    return runs.select("number", F.explode(F.sequence(F.floor(F.col("start") / F.col("width")), F.floor((F.col("end") - 1) / F.col("width")))).alias("bucket"), "shard", "start", "end")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, shards: int | None = None, seed: int = SEED, carry: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, draws): every row and what the mix takes of it.

    ``carry`` comes along as a column of that name. ``draws`` has a struct (shard, place) for each time that the row is taken; sorting a
    shard by place is its local shuffle. Sizes are words; null and empty texts have none, null is a source of its own, and
    a source without words has target 0. Repeated rows draw alike, each counted; a null doc_id is one more id. A source's taken words
    miss its target by less than one document (and its repeats). An empty table gives no rows, texts are counted whole at any length, and
    further columns aren't read. Only totals by source reach the driver; documents learn their shards from a table of blocks, and blocks theirs
    from runs of draws that tasks split.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    key = F.xxhash64("doc_id", F.lit(seed))
    carried = [] if carry is None else [carry.alias("carry")]
    sized = work.save(docs.select(*carried, "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    totals = sorted(totals, key=lambda r: (r.source is None, r.source or ""))  # Python compares by code point
    shards = shards or max(SHARDS, -(-sum(r.words for r in totals) // SHARD_WORDS))
    targets = target_words([r.words for r in totals], weights, most)
    bound = max(BLOCKS, BLOCK_SHARE * shards)
    known = [(r.source, r.words, t, min(bound, max(1, r.n // 64)), min(most, int(t // r.words)) if r.words else 0) for r, t in zip(totals, targets, strict=True)]
    sources = spark.createDataFrame(known, "name string, source_size long, target double, blocks int, passes int").coalesce(1)
    dealt = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("block", F.pmod(key, F.col("blocks")).cast("int"))
    counts = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("passes").alias("passes"), F.first("source_size").alias("source_size"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(seed)), "block")
    counts = counts.withColumn("rank", F.row_number().over(order) - 1).withColumn("before", F.sum("words").over(order) - F.col("words"))
    counts = work.save(counts.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size") - F.col("before")).select("source", "block", "rank", "words", "rest"), "blocks")
    partial = counts.groupBy("source").agg(F.count("*").alias("blocks"), F.count_if(F.col("rest") > 0).alias("drawn")).collect()
    found = {r.source: r for r in partial}
    present = [(r[0], found[r[0]].blocks, r[4] * found[r[0]].blocks + (found[r[0]].drawn if r[4] < most else 0)) for r in known if r[0] in found]
    # The shard of each of a block's draws: its slot in the source's permuted passes falls into the run that a shard owns.
    numbered = spark.createDataFrame([(s, i, b, max(1, -(-n // shards))) for i, (s, b, n) in enumerate(present)], "name string, number int, present int, width long").coalesce(1)
    slots = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.struct(p.alias("turn"), (p * F.col("present") + F.col("rank")).cast("long").alias("slot")))
    named = counts.join(numbered, F.col("source").eqNullSafe(F.col("name"))).select(F.col("source").alias("of"), F.col("block").alias("at"), "words", "rest", "rank", "number", "present", "width")
    asked = named.select("number", "rank", "width", F.explode(slots).alias("s")).select("number", "rank", F.floor(F.col("s.slot") / F.col("width")).alias("bucket"), "s.turn", "s.slot")
    runs = work.save(shard_runs(spark, [n for *_, n in present], shards, seed), "runs")
    owned = asked.join(runs, ["number", "bucket"]).where((F.col("slot") >= F.col("start")) & (F.col("slot") < F.col("end")))
    owners = owned.groupBy("number", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "shard"))), lambda x: x["shard"]).alias("owners"))  # at most ``most``
    placed = named.join(owners, ["number", "rank"], "left").select("of", "at", "words", "rest", F.coalesce("owners", F.array().cast("array<int>")).alias("owners"))
    joined = dealt.join(work.save(placed, "placed"), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at")
    #: Of the last pass, blocks before the boundary are taken whole; the one block across it only up to the target.
    across = (F.col("rest") > 0) & (F.col("rest") < F.col("words")) & (F.col("passes") < most)
    whole = F.when((F.col("rest") >= F.col("words")) & (F.col("rest") > 0) & (F.col("passes") < most), 1).otherwise(0)
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    edge = joined.where(across).withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    edge = edge.withColumn("extra", F.when((F.col("rest") - F.col("before")) * 2 >= F.col("size"), 1).otherwise(0)).drop("before")
    taken = joined.where(~across).withColumn("extra", whole).unionByName(edge).withColumn("times", F.col("passes") + F.col("extra"))
    draws = F.transform(F.slice("owners", F.lit(1), F.col("times")), lambda owner, p: F.struct(owner.alias("shard"), F.xxhash64("doc_id", p, F.lit(seed + 2)).alias("place")))
    return taken.select(*(["carry"] if carried else []), "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), draws.alias("draws"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` once for each of its draws, dealt to shards and shuffled within them."""
    rows = mix_sources(docs, carry=F.struct(*[F.col(f"`{c}`") for c in docs.columns]), **how).select("carry", F.explode("draws").alias("draw"))
    return rows.repartition("draw.shard").sortWithinPartitions("draw.shard", "draw.place").select("carry.*")
