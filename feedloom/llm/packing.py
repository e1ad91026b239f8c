"""Best-fit packing of token sequences by minimum bin slack.

Only the number of pieces of each length (at most ``capacity`` numbers, whatever the corpus) decides the
plan, so the driver plans over that histogram and the pieces meet their places in distributed joins.
"""

from __future__ import annotations

import contextlib
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace, batch, released, slices

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Distinct chunks of text whose ids a worker remembers; forgetting only costs time.
REMEMBERED = 400_000
#: Bytes of text that a worker splits and looks up at once; a longer text comes alone.
TOGETHER = 4 << 20
#: Chunks of one word that are encoded in one line, and the marks that are known apart from the word before them.
LINE = 64
MARKS = ",.;:!?"


class ChunkTokenizer:
    """Token ids of whole texts from remembered chunks.

    The vocabulary's pre-tokenizer always ends a token before a space that a non-space follows, so the
    chunks between such places are encoded on their own, each distinct one once. Splitting, numbering and gathering
    work on whole batches: Python sees only the distinct chunks of one.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.end_id = Tokenizer.from_file(path), end_id
        # Each distinct chunk comes once, so that the model's own cache of words never answers and only costs.
        with contextlib.suppress(AttributeError):  # only where the tokenizers' version has it
            self.model.model._resize_cache(0)
        vocabulary = self.model.get_vocab()
        space = self.model.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for x, i in vocabulary.items() if x.startswith(space)]] = True
        self.forget()

    def forget(self) -> None:
        """Only the end of a text is known: chunk 0, the end id alone; chunk 1 is empty."""
        self.known: dict[str, int] = {"": 1}
        self.starts, self.lengths, self.flat, self.used = np.array([0, 1]), np.array([1, 0]), np.full(1 << 16, self.end_id, "<u4"), 1

    def encoded(self, chunks: list[str], words: bool) -> tuple[np.ndarray, list[int]]:
        """The ids of all chunks, and how many each has.

        Chunks of a space and one word are encoded in lines of many: there only a chunk's first token begins with a space.
        """
        if words:
            lines = ["".join(chunks[i : i + LINE]) for i in range(0, len(chunks), LINE)]
            ids = np.fromiter(chain.from_iterable(x.ids for x in self.model.encode_batch_fast(lines, add_special_tokens=False)), "<u4")
            first = np.flatnonzero(self.spaced[ids])
            if len(first) == len(chunks):
                return ids, np.diff(first, append=len(ids)).tolist()
        found = [x.ids for x in self.model.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), list(map(len, found))

    def learn(self, chunks: list[str], words: bool) -> None:
        lengths = []
        for at in range(0, len(chunks), 20_000):
            ids, sizes = self.encoded(chunks[at : at + 20_000], words)
            lengths += sizes
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(ids), self.used), "<u4")])
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        self.known.update(zip(chunks, range(len(self.starts), len(self.starts) + len(chunks)), strict=True))
        ends = self.starts[-1] + self.lengths[-1] + np.cumsum(lengths, dtype=np.int64)
        self.lengths = np.concatenate([self.lengths, np.asarray(lengths, np.int64)])
        self.starts = np.concatenate([self.starts, ends - self.lengths[len(self.starts) :]])

    def numbers(self, chunks: list[str], word: np.ndarray | None = None) -> np.ndarray:
        """The number of each chunk; ``word`` says which are a space and one word."""
        get = self.known.get
        out = np.fromiter((get(x, -1) for x in chunks), np.int64, len(chunks))
        new = np.flatnonzero(out < 0)
        is_word = np.zeros(len(new), bool) if word is None else word[new]
        for words in (True, False):
            some = list(dict.fromkeys(chunks[i] for i in new[is_word == words].tolist()))
            if some:
                self.learn(some, words)
        out[new] = [self.known[chunks[i]] for i in new.tolist()]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): text i has ids[bounds[i]:bounds[i + 1]], little-endian unsigned 32-bit, the end id last."""
        parts = pc.split_pattern(texts, " ")
        first = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        found = parts.flatten().dictionary_encode()
        code, names = found.indices.to_numpy().astype(np.int64), found.dictionary
        if len(self.known) + len(names) > REMEMBERED:
            self.forget()
        # Marks behind a letter or digit are known apart from it: the pre-tokenizer ends a token there too.
        bare = pc.utf8_rtrim(names, MARKS)
        divided = pc.match_substring_regex(bare, r"[\p{L}\p{N}]$")
        bodies = pc.if_else(divided, bare, names).dictionary_encode()
        tails = pc.if_else(divided, pc.replace_substring_regex(names, f"(?s)^.*[^{MARKS}]", ""), "").dictionary_encode()
        words = pc.match_substring_regex(bodies.dictionary, r"^[\p{L}\p{N}]+$").to_numpy(zero_copy_only=False)
        body = self.numbers([" " + x for x in bodies.dictionary.to_pylist()], words)[bodies.indices.to_numpy()]
        tail = self.numbers(tails.dictionary.to_pylist())[tails.indices.to_numpy()]
        # A space before white space ends nothing; such words join the one before them.
        open_ = pc.match_substring_regex(names, r"^(?:$|[\s\x0B\x1C-\x1F\x{85}\p{Z}])").to_numpy(zero_copy_only=False)
        joined = open_[code]
        joined[first] = False
        begin = np.flatnonzero(~joined)
        at_first = np.searchsorted(begin, first)
        odd = np.union1d(np.flatnonzero(np.diff(begin, append=len(code)) > 1), at_first)
        leads, ends = np.ones(len(begin), bool), np.append(begin, len(code))
        leads[at_first] = False
        whole = [" " * int(leads[k]) + " ".join(names.take(pa.array(code[begin[k] : ends[k + 1]])).to_pylist()) for k in odd.tolist()]
        place = np.stack([body[code[begin]], tail[code[begin]]], axis=1)
        place[odd, 0], place[odd, 1] = self.numbers(whole), 1
        chunk_ends = 2 * np.append(at_first[1:], len(begin))
        place = np.insert(place.ravel(), chunk_ends, 0)
        chunk_ends = chunk_ends + np.arange(1, len(chunk_ends) + 1)
        size = np.cumsum(self.lengths[place])
        at = np.arange(size[-1]) + np.repeat(self.starts[place] - np.concatenate(([0], size[:-1])), self.lengths[place])
        return np.concatenate(([0], size[chunk_ends - 1])), self.flat[at]


@cache
def remembered(path: str, end_id: int) -> ChunkTokenizer:
    """One for all tasks of a worker, which each begin without chunks."""
    return ChunkTokenizer(path, end_id)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids, cut only where they exceed ``capacity``.

    The remainder of a cut document comes first. A null or empty text is the end id alone.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = remembered(tokenizer_path, end_id)
        for rows in batches:
            texts = pc.fill_null(rows.column(1).cast(pa.large_string()), "")
            for a, b in slices(pc.binary_length(texts).to_numpy(), TOGETHER):
                bounds, ids = tokenizer.ids(texts.slice(a, b - a))
                out: list[list] = [[], [], [], [], []]
                for doc, low, high in zip(rows.column(0).slice(a, b - a).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    n = high - low
                    cut = n % capacity or capacity
                    cuts = [0, n] if n <= capacity else [0, *range(cut, n + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for column, value in zip(out, (doc, k, x, y - x, zlib.crc32(ids[low + x : low + y])), strict=True):
                            column.append(value)
                yield batch(PIECES, **dict(zip(PIECES.names, out, strict=True)))
        tokenizer.forget()
        released()

    return docs.select("doc_id", "text").mapInArrow(tokenize, "doc_id long, piece int, start long, length long, ids_crc32 long")


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (number of such bins, {length: items of it in one bin}).

    Each round seeds a bin with the longest item left and fills the rest by subset sum: bit s of a
    Python integer says that some items sum to s, with items of one length added in binary portions. The
    fullest reachable sum is taken back into items, and that bin is made as often as the items last.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    plan = []
    while left:
        seed = max(left)
        room = capacity - seed
        inside = (1 << room + 1) - 1
        reach, steps = 1, []
        for n in sorted(left, reverse=True):
            most = min(left[n] - (n == seed), room // n)
            portion = 1
            while most > 0 and not reach >> room & 1:
                take = min(portion, most)
                steps.append((n, take, reach))
                reach |= reach << n * take & inside
                most -= take
                portion *= 2
            if reach >> room & 1:
                break
        total, bin_ = reach.bit_length() - 1, {seed: 1}
        for n, take, before in reversed(steps):
            if not before >> total & 1:
                bin_[n] = bin_.get(n, 0) + take
                total -= n * take
        times = min(left[n] // k for n, k in bin_.items())
        plan.append((times, bin_))
        for n, k in bin_.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first bin, items a bin, offset in the bin): where items of a length go by rank."""
    used: dict[int, int] = {}
    out, bins = [], 0
    for times, items in plan:
        offset = 0
        for n, k in sorted(items.items(), reverse=True):
            rank = used.get(n, 0)
            out.append((n, rank, rank + times * k - 1, bins, k, offset))
            used[n] = rank + times * k
            offset += n * k
        bins += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, rows_a_block: int = 4096) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    Returns PIECES' columns with sequence_id and offset. Repeated rows are packed once each; a null
    doc_id is kept. A null or empty text is the end id alone, texts of any length are encoded whole, no rows give none, and
    further columns aren't read. The number of a piece among those of its length comes from counts of (length,
    block) and its rank in its block; blocks are dealt by a hash and grow in number with the rows,
    so that no length, however frequent, meets in one task.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    cut = work.save(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = places(minimum_bin_slack(histogram, capacity))
    blocks = max(1, sum(histogram.values()) // rows_a_block)
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    before = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("r", F.row_number().over(order) - 1).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("r"))
    schema = "length long, first long, last long, bin long, k long, place long"
    there = spark.createDataFrame(plan, schema).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "last", "bin", "k", "place"))).alias("runs"))  # a few runs for each of at most ``capacity`` lengths
    run = F.element_at(F.filter("runs", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") <= x["last"])), 1)
    nth = F.col("rank") - F.col("run.first")
    return (
        ranked.join(F.broadcast(there), "length")
        .withColumn("run", run)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.bin") + F.expr("(rank - run.first) div run.k")).alias("sequence_id"), (F.col("run.place") + F.col("length") * (nth % F.col("run.k"))).cast("long").alias("offset"))
    )
