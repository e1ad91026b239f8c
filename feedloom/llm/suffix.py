"""Repeated passages by suffix arrays and longest-previous-factor arrays.

A position starts a repeat if the longest factor that it shares with an earlier or a later position has at least
``length`` bytes. Winnowing picks anchors so that every passage of that length holds one, and equal passages
hold the same: only the surroundings of anchors that occur more than once can hold repeats. Surroundings that
are equal as a whole repeat throughout; the others of one anchor, where matches end, meet where they share the core of
a block of columns, in one suffix order of the bytes beside it: the neighbours there are the previous and next positions
that longest-previous-factor arrays look for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import MIX_1, RollingHash, Workspace, batch, mix, signed, slices, utf8

LENGTH = 200
GRAM = 50
SEED = 23
#: Columns of a block: passages that start in one share all but 2 * (COLUMNS - 1) bytes, their core and their tails.
COLUMNS = 19
#: Surroundings with one core that one suffix order takes at most, about a million positions, and rows of a chunk of
#: smaller groups; beyond it passages are counted by their hash, in any number.
HOT = 50_000
ANCHORS = pa.schema([("f", pa.int64()), ("around", pa.int64()), ("row", pa.int64()), ("at", pa.int32())])
CORES = pa.schema([("core", pa.int64()), ("row", pa.int64()), ("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("tails", pa.binary()), ("done", pa.bool_())])
REGIONS = pa.schema([("row", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


# --- suffix arrays of one buffer -------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by prefix doubling."""
    n = len(data)
    rank = data.astype(np.int64) + 1
    k = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - k)] = rank[k:]
        order = np.lexsort((behind, rank))
        new = np.zeros(n, np.int64)
        changed = (np.diff(rank[order]) != 0) | (np.diff(behind[order]) != 0)
        new[order] = np.concatenate(([1], 1 + np.cumsum(changed))) if n else new
        rank, k = new, 2 * k
        if n == 0 or rank.max() == n or k >= 2 * n:
            return order


def lcp_array(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[i]: the common prefix of the suffixes at places i - 1 and i of the order."""
    n, text = len(data), data.tobytes()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out, h = np.zeros(n, np.int64), 0
    at, sa = place.tolist(), order.tolist()
    for i in range(n):
        if at[i]:
            j = sa[at[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[at[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """lpf[p]: the longest match of the suffix at p with one at a smaller position.

    The best earlier match lies at the previous or the next smaller position in suffix order; both are found
    with one stack of increasing positions, carrying the smallest lcp on the way.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    stack: list[tuple[int, int]] = []  # position, lcp with the entry below
    sa, common = order.tolist(), lcp.tolist()
    for i in range(n + 1):
        position = sa[i] if i < n else -1
        reach = common[i] if i < n else 0
        while stack and stack[-1][0] > position:
            top, to_previous = stack.pop()
            out[top] = max(to_previous, reach)  # of the previous smaller and of this, the next smaller
            reach = min(reach, to_previous)
        stack.append((position, reach))
    return out


def repeats_in(data: bytes, length: int = LENGTH, keep_first: bool = False) -> np.ndarray:
    """For each byte whether a passage of ``length`` covers it that occurs elsewhere (with keep_first: earlier)."""
    text = np.frombuffer(data, np.uint8)
    covered = np.zeros(len(text) + 1, np.int64)
    order = suffix_array(text)
    lcp = lcp_array(text, order)
    if keep_first:
        starts = longest_previous_factor(order, lcp) >= length
    else:
        starts = np.zeros(len(text), bool)
        starts[order] = np.maximum(lcp, np.append(lcp[1:], 0)) >= length
    at = np.flatnonzero(starts)
    np.add.at(covered, at, 1)
    np.add.at(covered, np.minimum(at + length, len(text)), -1)
    return np.cumsum(covered)[:-1] > 0


# --- suffix order of many short surroundings, to a depth of ``length`` -------------------------------------


def prefix_ranks(rows: np.ndarray, length: int, wanted: int) -> np.ndarray:
    """Ranks of the ``length``-byte passages that start in the first ``wanted`` columns; equal ones share a rank.

    Prefix doubling over all rows together: 8-byte words first, then pairs of ranks.
    """
    m = rows.shape[1]
    word = np.zeros((rows.shape[0], m - 7), np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | rows[:, k : m - 7 + k].astype(np.uint64)
    rank, have = dense(word), 8
    while have < length:
        step = min(have, length - have)
        keep = rank.shape[1] - step
        rank = dense(rank[:, :keep].astype(np.uint64) << np.uint64(32) | rank[:, step:].astype(np.uint64))
        have += step
    return rank[:, :wanted]


def dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys.ravel(), return_inverse=True)[1].reshape(keys.shape)


def previous_and_next(ranks: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, whether its passage occurs at an earlier and at a later one.

    In suffix order, equal passages are adjacent and ordered by position, so the previous smaller position with
    a factor of full length is the neighbour before, and the next larger the neighbour behind.
    """
    at = np.flatnonzero(valid.ravel())
    flat = ranks.ravel()[at]
    order = at[np.argsort(flat, kind="stable")]
    same = ranks.ravel()[order[1:]] == ranks.ravel()[order[:-1]]
    earlier, later = np.zeros(ranks.size, bool), np.zeros(ranks.size, bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier.reshape(ranks.shape), later.reshape(ranks.shape)


# --- anchors ----------------------------------------------------------------------------------------------


def sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window h[i : i + width], by doubling; the result is shorter by width - 1."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


class Winnow:
    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.roll = length, gram, RollingHash(SEED)

    def anchors(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text number, place, fingerprint, hash of the surroundings) for slices of the texts."""
        length, gram, width = self.length, self.gram, self.length - self.gram + 1
        sizes = np.array([len(x) for x in texts], np.int64)
        for first, last in slices(sizes):
            own = sizes[first:last]
            ends = np.cumsum(own)
            data = np.frombuffer(b"".join(texts[first:last]), np.uint8)
            n = len(data)
            if n < length:
                continue
            prefix = self.roll.prefix(data)
            start = np.arange(n - gram + 1)
            h = self.roll.of(prefix, start, start + gram)
            least = sliding(h, width, np.minimum)  # of the passage that starts here; n - length + 1 of them
            fits = np.zeros(len(least), bool)
            for end, size in zip(ends.tolist(), own.tolist(), strict=True):
                if size >= length:
                    fits[end - size : end - length + 1] = True
            # A gram is an anchor if it is the least of some passage that holds it.
            padded = np.concatenate([np.zeros(width - 1, np.uint64), np.where(fits, least, 0), np.zeros(width - 1, np.uint64)])
            at = np.flatnonzero(sliding(padded, width, np.maximum)[: len(h)] == h)
            doc = np.searchsorted(ends, at, side="right")
            begin, end = ends[doc] - own[doc], ends[doc]
            left, right = np.maximum(begin, at - (length - gram)), np.minimum(end, at + length)
            around = mix(self.roll.of(prefix, left, right) + (at - left).astype(np.uint64) * MIX_1)
            yield doc + first, (at - begin).astype(np.int32), h[at], around


def binaries(rows: np.ndarray) -> pa.Array:
    """Each row of bytes as a binary value."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(row, regions): for each row number, runs [first, last] of positions whose passage occurs elsewhere too.

    ``docs`` has row (long, not null, the same for equal texts only) and text. Nothing is said of rows without repeats.
    """
    work = Workspace(docs.sparkSession, "suffix")
    before = length - gram

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnow(length, gram)
        for whole in batches:
            for part in range(0, whole.num_rows, 500):
                rows = whole.slice(part, 500)
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                for doc, at, f, around in winnow.anchors(utf8(rows.column(1))):
                    yield batch(ANCHORS, f=signed(f), around=signed(around), row=ids[doc], at=at)

    anchors = work.save(docs.select("row", "text").mapInArrow(anchor, "f long, around long, row long, at int"), "anchors")
    # Anchors that occur more than once, by surroundings: their number, and the first occurrence.
    groups = anchors.groupBy("f", "around").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("one"))
    shared = groups.groupBy("f").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    kept = work.save(groups.join(shared, "f").select("f", "around", "n", "one", "kinds"), "groups")
    # Equal surroundings repeat as a whole: every passage that they hold.
    alike = kept.where("n > 1").select("f", "around")
    whole = work.save(anchors.join(alike, ["f", "around"]).select("row", (F.greatest(F.col("at") - before, F.lit(0))).alias("first"), F.col("at").alias("last")), "whole")
    work.drop("anchors")
    # Where an anchor has several surroundings, one of each is compared: equal passages start in the same column, so
    # they lie in one block of columns and share its core, the bytes that all passages starting in it have in common.
    unlike = kept.where("kinds > 1").select("f", F.col("one.row").alias("row"), F.col("one.at").alias("at"), (F.col("n") > 1).alias("done"))
    asked = unlike.groupBy("row").agg(F.collect_list(F.struct("f", "at", "done")).alias("asked"))  # at most the anchors of one text
    texts = docs.select("row", "text").join(asked, "row")
    columns = before + 1
    span = min(COLUMNS, columns)
    low = np.arange(0, columns, span)
    first = np.minimum(low, columns - span)  # the last block starts earlier, so that all have one width
    wide = span - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each surroundings and block with a whole passage: core, columns of passages, bytes beside the core."""
        roll = RollingHash(SEED + 1)
        beside = np.concatenate([np.arange(wide), np.arange(wide) + length])
        for whole in batches:
            for part in range(0, whole.num_rows, 50):
                rows = whole.slice(part, 50)
                lists = rows.column(2)
                ends, items = np.diff(lists.offsets.to_numpy()).cumsum().tolist(), lists.flatten()
                f, at, done = (items.field(x).to_numpy(zero_copy_only=False) for x in ("f", "at", "done"))
                begin = 0
                for row, text, end in zip(rows.column(0).to_pylist(), utf8(rows.column(1)), ends, strict=True):
                    data = np.frombuffer(text, np.uint8)
                    base = at[begin:end].astype(np.int64)[:, None] - before
                    lowest, highest = np.maximum(low, -base), np.minimum(first + wide, len(data) - length - base)
                    k, block = np.nonzero(lowest <= highest)
                    place = base[k, 0] + first[block]  # of the block's first column in the text
                    prefix = roll.prefix(data)
                    core = roll.of(prefix, place + wide, place + length)
                    core = mix(core + f[begin:end].view(np.uint64)[k] * MIX_1 + block.astype(np.uint64))
                    padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(2 * length, np.uint8)])
                    tails = padded[(place + before)[:, None] + beside]
                    own = done[begin:end][k]
                    begin = end
                    yield batch(CORES, core=signed(core), row=np.full(len(k), row), place=place.astype(np.int32), low=(lowest[k, block] - first[block]).astype(np.int32), high=(highest[k, block] - first[block]).astype(np.int32), tails=binaries(tails), done=own)

    cores = work.save(texts.mapInArrow(cut, "core long, row long, place int, low int, high int, tails binary, done boolean"), "cores")
    alike = cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core", (F.col("n") > hot).alias("hot"))
    cores = work.save(cores.join(alike, "core"), "alike")
    work.drop("cores")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by core; whole groups are gathered to chunks, each in one suffix order."""
        held: list[pa.Table] = []
        size = 0
        for rows in batches:
            held.append(pa.Table.from_batches([rows]))
            size += rows.num_rows
            if size >= HOT:
                rows = pa.concat_tables(held).combine_chunks()
                core = rows.column("core").to_numpy()
                last = int(np.flatnonzero(core != core[-1])[-1]) + 1 if core[0] != core[-1] else 0
                if last:
                    yield ordered(rows.slice(0, last))
                held, size = [rows.slice(last)], len(core) - last
        if size:
            yield ordered(pa.concat_tables(held).combine_chunks())

    def ordered(rows: pa.Table) -> pa.RecordBatch:
        """Runs of positions whose passage has a previous or a next one in the suffix order of the bytes beside equal cores.

        A passage that starts in column j is its core and ``wide`` bytes from place j of the tails.
        """
        core, row, place, low, high, done = (rows.column(x).to_numpy() for x in ("core", "row", "place", "low", "high", "done"))
        tails = np.frombuffer(b"".join(rows.column("tails").to_pylist()), np.uint8).reshape(len(core), 2 * wide)
        column = np.arange(span)
        valid = (column >= low[:, None]) & (column <= high[:, None])
        group = np.cumsum(np.concatenate(([0], core[1:] != core[:-1]))).astype(np.uint64)[:, None] * np.uint64(span) + column.astype(np.uint64)
        ranks = prefix_ranks(tails, wide, span) if wide >= 8 else np.zeros((len(core), span), np.int64)
        earlier, later = previous_and_next(dense(group << np.uint64(32) | ranks.astype(np.uint64)), valid)
        hit = (earlier | later) & ~done[:, None]
        turn = np.diff(np.pad(hit.view(np.int8), ((0, 0), (1, 1))), axis=1)
        (k, start), (_, stop) = np.nonzero(turn == 1), np.nonzero(turn == -1)
        return batch(REGIONS, row=row[k], first=(place[k] + start).astype(np.int32), last=(place[k] + stop - 1).astype(np.int32))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, at, h, done) of each passage of the given blocks, hashed by core, column and bytes beside the core."""
        roll = RollingHash(SEED + 1)
        schema = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("h", pa.int64()), ("done", pa.bool_())])
        column = np.arange(span)
        for whole in batches:
            for part in range(0, whole.num_rows, 2000):
                rows = whole.slice(part, 2000)
                core, row, place, low, high, done = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("core", "row", "place", "low", "high", "done"))
                prefix = roll.prefix(np.frombuffer(b"".join(rows.column("tails").to_pylist()), np.uint8))
                k, j = np.nonzero((column >= low[:, None]) & (column <= high[:, None]))
                start = k * 2 * wide + j
                h = mix(roll.of(prefix, start, start + wide) + core.view(np.uint64)[k] * MIX_1 + j.astype(np.uint64))
                yield batch(schema, row=row[k], at=(place[k] + j).astype(np.int32), h=signed(h), done=done[k])

    cold = cores.where("not hot").select("core", "row", "place", "low", "high", "tails", "done")
    ends = cold.repartition("core").sortWithinPartitions("core").mapInArrow(compare, "row long, first int, last int")
    at = work.save(cores.where("hot").drop("hot").mapInArrow(passages, "row long, at int, h long, done boolean"), "passages")
    twice = at.groupBy("h").agg(F.min(F.struct("row", "at")).alias("a"), F.max(F.struct("row", "at")).alias("b")).where("a <> b").select("h")
    hot_ends = at.where("not done").join(twice, "h").select("row", F.col("at").alias("first"), F.col("at").alias("last"))
    regions = whole.unionByName(ends).unionByName(hot_ends)
    return regions.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("regions"))  # each once, however often a row is repeated


def covered(regions: list[dict], length: int, size: int) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) of a text of ``size`` bytes."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((x["first"], x["last"]) for x in regions):
        start, end = first, min(last + length, size)
        if end - start < length:  # surroundings cut short at the text's end hold no passage there
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document without its repeated bytes.

    Every byte of a passage of ``length`` bytes that starts anywhere else too goes. A null text counts as
    empty; each row is a text of its own, also where rows repeat a doc_id or have none. Texts may be of any length; an
    empty table gives no rows; further columns aren't read.
    """
    # Equal rows share a number, and as each of them repeats the other, they lose the same bytes.
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 500):
                own = whole.slice(part, 500)
                out: list[list] = [[], [], [], []]
                for text, regions in zip(utf8(own.column(1)), own.column(2).to_pylist(), strict=True):
                    spans = covered(regions or [], length, len(text))
                    digest, at = hashlib.sha256(), 0
                    for a, b in spans:
                        digest.update(text[at:a])
                        at = b
                    digest.update(text[at:])
                    for column, value in zip(out, (len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest()), strict=True):
                        column.append(value)
                yield batch(REMOVED, doc_id=own.column(0), **dict(zip(REMOVED.names[1:], out, strict=True)))

    regions = repeated_passages(rows, length, gram, hot)
    return rows.join(regions, "row", "left").select("doc_id", "text", "regions").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
