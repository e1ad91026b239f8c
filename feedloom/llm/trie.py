"""The prefix trie of conversations, by prefix doubling and without walking it.

Blocks of 1, 2, 4, ... turns that start at multiples of their length get dense names, each from the names of its two
halves, in as many rounds as the longest conversation's length has binary digits. The first d turns are the blocks of d's
binary digits, largest first, so that equal lists of names are equal prefixes: nodes are groups of them. Every node is known
by its smallest member. A conversation is the smallest member of the nodes at the end of its path only, so sums over
subtrees become sums over members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace, dense, places

#: Conversation ids that are joined into one string at once.
IDS = 512
SPLICED = 6


def spliced(conv_id: Column) -> Column:
    """How many turns at the beginning come from another conversation."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(SPLICED))


def donor(conv_id: Column) -> Column:
    return conv_id - conv_id % 100


def rebuilt(conversations: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(conv_id, j, digest, tokens) of every turn of the rebuilt conversations, j from 0, and (conv_id, size) of each one."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.unhex(F.sha2(F.concat(part(role), text), 256)).alias("digest"), F.length(text).cast("long").alias("tokens"))
    placed, sizes = places(turns, ["conv_id"], ["turn", "digest"], work, "turns")
    placed = work.save(placed.select("conv_id", "place", "digest", "tokens"), "placed")
    own = work.save(sizes, "sizes")
    heads = own.select("conv_id", "n", spliced(F.col("conv_id")).alias("h"), donor(F.col("conv_id")).alias("donor")).join(own.select(F.col("conv_id").alias("donor"), F.col("n").alias("there")), "donor", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = work.save(heads.select("conv_id", "donor", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size")), "convs")
    first = convs.select("conv_id", "donor", "taken").join(placed.where(F.col("place") < SPLICED - 1).withColumnRenamed("conv_id", "donor"), "donor").where("place < taken").select("conv_id", F.col("place").alias("j"), "digest", "tokens")
    rest = placed.where(F.col("place") >= spliced(F.col("conv_id"))).join(convs.select("conv_id", "h", "taken"), "conv_id").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("j"), "digest", "tokens")
    return first.unionByName(rest), convs.select("conv_id", "size")


def blocks(turns: DataFrame, longest: int, work: Workspace) -> list[DataFrame]:
    """(conv_id, j, name, tokens) of the j-th block of each power of two; names are equal where a level's blocks are."""
    turns = work.save(turns, "rebuilt")
    names = dense(turns.select("digest"), work, "names-0")
    out = [work.save(turns.join(names, "digest").select("conv_id", "j", "name", "tokens"), "blocks-0")]
    while 2 ** len(out) <= longest:
        below, k = out[-1], len(out)
        half = (F.col("j") / 2).cast("long").alias("half")
        left = below.where("j % 2 = 0").select("conv_id", half, F.col("name").alias("a"), F.col("tokens").alias("before"))
        right = below.where("j % 2 = 1").select("conv_id", half, F.col("name").alias("b"), "tokens")
        pairs = work.save(left.join(right, ["conv_id", "half"]).select("conv_id", F.col("half").alias("j"), "a", "b", (F.col("before") + F.col("tokens")).alias("tokens")), f"pairs-{k}")
        out.append(work.save(pairs.join(dense(pairs.select("a", "b"), work, f"names-{k}"), ["a", "b"]).select("conv_id", "j", "name", "tokens"), f"blocks-{k}"))
    return out


def prefixes(convs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, names, tokens) of every prefix, that without turns too: the names of its blocks, and what all its turns hold.

    From the largest blocks down, each prefix stays as it is and, where one more block follows, gives one that is longer by it.
    """
    found = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.array().cast("array<long>").alias("names"), F.lit(0).cast("long").alias("tokens"))
    for level in reversed(levels):
        more = level.where("j % 2 = 0").select("conv_id", (F.col("j") / 2).cast("long").alias("depth"), "name", F.col("tokens").alias("more"))
        same = F.struct((F.col("depth") * 2).alias("depth"), F.concat("names", F.array(F.lit(-1).cast("long"))).alias("names"), F.col("tokens").alias("tokens"))
        longer = F.struct((F.col("depth") * 2 + 1).alias("depth"), F.concat("names", F.array("name")).alias("names"), (F.col("tokens") + F.col("more")).alias("tokens"))
        both = F.explode(F.when(F.col("name").isNull(), F.array(same)).otherwise(F.array(same, longer)))
        found = found.join(more, ["conv_id", "depth"], "left").select("conv_id", both.alias("p")).select("conv_id", "p.*")
    return found


def joined_ids(ends: DataFrame, work: Workspace) -> DataFrame:
    """(node, depth, ends_sha256): SHA-256 of the ids (node, depth, conv_id) in order, joined by commas.

    One digest is one sequence of bytes: ids are put in order and joined in many tasks, and only their strings, each of
    many ids, pass one after another through the task that hashes a node, which holds one batch of them at a time.
    """
    placed, sizes = places(ends, ["node", "depth"], ["conv_id"], work, "ends")
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")  # at most IDS
    strings = work.save(placed.join(sizes, ["node", "depth"]).groupBy("node", "depth", "n", F.floor(F.col("place") / IDS).alias("part")).agg(ids.alias("ids")), "strings")
    short = strings.where(F.col("n") <= IDS).select("node", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    hashed = strings.where(F.col("n") > IDS).select("node", "depth", "part", "ids").repartition("node", "depth").sortWithinPartitions("node", "depth", "part").mapInArrow(streamed, "node long, depth long, ends_sha256 string")
    return short.unionByName(hashed)


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each (node, depth) of sorted rows."""
    current, state = None, hashlib.sha256()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": pa.array([current[0]], pa.int64()), "depth": pa.array([current[1]], pa.int64()), "ends_sha256": [state.hexdigest()]})

    for rows in batches:
        for node, depth, part, ids in zip(*[c.to_pylist() for c in rows.columns], strict=True):
            if (node, depth) != current:
                if current is not None:
                    yield out()
                current, state = (node, depth), hashlib.sha256()
            state.update(("," if part else "").encode() + ids.encode())
    if current is not None:
        yield out()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the rebuilt conversations.

    A null role or text is an empty one, null turns come first, and turns of equal number are ordered by the SHA-256 of role
    and text; repeated rows are turns like others. Rows with a null conv_id belong to no conversation. Texts may be of any length: only
    their digest and length travel. Conversations without turns are members of the root; without conversations there is no
    root. Further columns aren't read.
    """
    work = Workspace(conversations.sparkSession, "trie")
    turns, convs = rebuilt(conversations, work)
    longest = convs.agg(F.max("size")).first()[0] or 0
    levels = blocks(turns, longest, work)
    every = work.save(prefixes(convs, levels), "prefixes")
    ended = every.join(convs, "conv_id").withColumn("ends", F.col("depth") == F.col("size"))
    known = work.save(ended.groupBy("depth", "names").agg(F.min("conv_id").alias("node"), F.max("size").alias("deepest")), "known")
    rows = work.save(ended.join(known, ["depth", "names"]).select("conv_id", "depth", "tokens", "ends", "node", (F.col("deepest") == F.col("depth")).alias("childless")), "rows")
    # what a conversation adds to each node above it: itself where it ends as a leaf's first member, and the turns that others share with it
    shares = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(F.col("node") != F.col("conv_id"), F.col("tokens"))), F.lit(0)).alias("shared"),
        F.max(F.when(F.col("ends") & F.col("childless") & (F.col("node") == F.col("conv_id")), 1).otherwise(0)).alias("leaf"),
    )
    before = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("tokens").alias("above"))
    told = rows.join(before, ["conv_id", "depth"], "left").join(shares, "conv_id")
    own = F.col("node") == F.col("conv_id")
    nodes = work.save(told.groupBy("node", "depth").agg(
        F.max(F.when(own, F.col("parent"))).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(own, F.lit(0)).otherwise(F.col("shared") - F.coalesce("above", F.lit(0)))).alias("saved_tokens"),
    ), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = joined_ids(rows.where("ends").select("node", "depth", "conv_id"), work)
    whole = nodes.join(children, ["node", "depth"], "left").join(ends, ["node", "depth"], "left")
    return whole.select(
        F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
