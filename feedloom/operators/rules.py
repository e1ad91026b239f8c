"""Rules over entries: scopes, chains, categories, fuzzy titles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import scratch

#: Failure categories in order, each with the words of an error that put it there.
FAILURES = {
    "blocked": ("403", "forbidden"),
    "rate_limited": ("429", "rate-limit", "too many requests"),
    "auth": ("401", "unauthorized", "requires authentication"),
    "gone": ("410", "gone"),
    "not_found": ("404", "not found"),
    "dns": ("dns", "resolve the feed host", "name resolution", "name or service not known"),
    "tls": ("tls", "ssl", "certificate"),
    "timeout": ("timed out", "timeout"),
    "not_feed": ("html", "parsed as a valid rss", "unknown feed type", "no parser", "parseerror", "not a feed"),
}


def first_category(text: Column, categories: dict[str, Sequence[str]], default: str | None = None) -> Column:
    """The first category with any of its words in the text; words are in lower case, the text's case doesn't matter."""
    hay = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(default)
    for name, words in reversed(categories.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | hay.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def failure_category(error: Column) -> Column:
    return first_category(error, FAILURES, "other")


def rule_feeds(rules: DataFrame, feeds: DataFrame) -> DataFrame:
    """(rule_id, feed) of every rule (rule_id, scope, scope_id) over feeds (feed, folder): one equi-join on scope keys.

    Scopes are global, folder, feed, and feeds (a list, one a line); a list without entries resolves to nothing.
    """
    listed = F.transform(F.filter(F.split("scope_id", "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("feed:"), F.trim(x)))
    keys = (
        F.when(F.col("scope") == "global", F.array(F.lit("*"))).when(F.col("scope") == "feeds", listed)
        .otherwise(F.array(F.concat("scope", F.lit(":"), "scope_id")))
    )
    of_feed = F.array(F.lit("*"), F.concat(F.lit("feed:"), "feed"), F.concat(F.lit("folder:"), "folder"))
    left = rules.select("rule_id", F.explode(keys).alias("key"))
    return left.join(feeds.select("feed", F.explode(of_feed).alias("key")).where("key is not null"), "key").select("rule_id", "feed").distinct()


def chained(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows with the first rule, in order, that takes them; null where none does. Later rules see what earlier ones left."""
    return df.withColumn("rule", F.coalesce(*[F.when(hit, name) for name, hit in rules], F.lit(None).cast("string")))


def toggled(spec: str, tag: str, sign: str) -> str:
    """A tag filter's text after a click: the same sign removes the tag, the other flips it, a new tag joins the end."""
    tokens = [x.strip() for x in spec.split(",") if x.strip()]
    bare = [x.lstrip("+-") for x in tokens]
    if tag not in bare:
        return ", ".join([*tokens, sign + tag])
    at = bare.index(tag)
    same = tokens[at] == sign + tag
    return ", ".join(tokens[:at] + ([] if same else [sign + tag]) + tokens[at + 1 :])


def redundant(rules: DataFrame, key: Sequence[str]) -> DataFrame:
    return rules.groupBy(*key).agg(F.count("*").alias("n"), F.min("rule_id").alias("keep")).where("n > 1")


#: Words in a block of sets, where a set counts as OWN words more for what is held of it; sets in a saved file at most; cells of a matrix that a task holds at once.
BLOCK, OWN, ROWS, CELLS = 1 << 21, 32, 1 << 12, 1 << 22
#: The percentage from which an index of rare words in Spark is quicker, and the share of a matrix that a word may fill to be counted pair by pair.
FEW, RARE = 50, 1 / 500
#: Matrices that the index goes through at once, and shares of their cells beyond which all are counted: sets that meet by a rare word, candidates among
#: them, candidates with close signatures.
STRIP, MUCH = 16, (1, 1 / 4, 1 / 16)
#: The most frequent words by 64, of which sets keep a bit each; bits of a set's signature, by 1,024; meetings, and candidates' signatures, that are held at once.
TOP, BITS, MEET, SOME = 2, 2048, 1 << 16, 1 << 12
LOW, EIGHT, ONES, UPPER = np.uint64(0x00FF00FF00FF00FF), np.uint64(8), np.uint64(0x0001000100010001), np.uint64(48)
#: What rounding may take from a bound.
SLACK = 1e-6


def fuzzy_pairs(df: DataFrame, ident: str, words: Column, percent: int = 80, least: int = 5) -> DataFrame:
    """(a, b, shared, united) of word sets with at least ``least`` words and Jaccard similarity of ``percent`` or more.

    Equal sets form one class by its smallest id, and pairs are between classes. From FEW percent on they are found by an index of
    rare words in Spark. Below, too many sets share a word of it for candidates to be rows. So sets are written once to the shared
    folder, in files that make up blocks of a bounded number of words, and a task reads two blocks from there at a time: nothing is dealt out a copy for each pair
    of blocks, and disk grows with the input. Pairs of blocks grow with its square. Only similar pairs become rows.
    """
    none = F.array(F.lit(""), F.lit(None).cast("string"))
    sets = df.select(F.col(ident).alias("id"), F.sort_array(F.array_except(words, none)).alias("w")).where(F.size("w") >= least)
    sets = sets.groupBy("w").agg(F.min("id").alias("id"))
    if percent >= FEW:
        return indexed_pairs(sets, percent)
    spark, path = df.sparkSession, scratch(df.sparkSession, "sets")
    sets.withColumn("n", F.size("w") + OWN).write.option("maxRecordsPerFile", ROWS).option("compression", "zstd").parquet(path)
    sized = spark.read.schema("n int").parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.sum("n").alias("n"))
    blocks = dealt([(r.file, r.n) for r in sized.collect()])
    meetings = len(blocks) * (len(blocks) + 1) // 2

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = -1, None
        for batch in batches:
            for k in batch["id"].to_pylist():
                high = (math.isqrt(8 * k + 1) - 1) // 2
                low = k - high * (high + 1) // 2
                if at != high:  # numbers of one block follow each other
                    at, left = high, sets_of(*blocks[high])
                both = [(low, left if low == high else sets_of(*blocks[low])), *([(high, left)] if low < high else [])]
                block = pa.concat_tables([x.append_column("part", pa.repeat(pa.scalar(p, pa.int32()), len(x))) for p, x in both])
                for name, value in (("low", low), ("high", high)):
                    block = block.append_column(name, pa.repeat(pa.scalar(value, pa.int32()), len(block)))
                for found in similar_by_tiles(block, percent):
                    yield from found.to_batches(max_chunksize=1 << 16)

    kind = sets.schema["id"].dataType.simpleString()
    return spark.range(0, meetings, 1, max(1, min(meetings, 4096))).mapInArrow(met, f"a {kind}, b {kind}, shared int, united int")


def dealt(files: Sequence[tuple[str, int]]) -> list[tuple[list[str], int, int]]:
    """Blocks (files, n, k) of files with what they count: every n-th set of the files, from the k-th on. Small files share a block, larger ones are dealt to several."""
    blocks, total = [], BLOCK
    for file, n in sorted(files):
        if n > BLOCK:
            parts = math.ceil(n / BLOCK)
            blocks += [([file], parts, k) for k in range(parts)]
            total = BLOCK
        elif total + n > BLOCK:
            blocks.append(([file], 1, 0))
            total = n
        else:
            blocks[-1][0].append(file)
            total += n
    return blocks


def sets_of(files: Sequence[str], n: int, k: int) -> pa.Table:
    """The sets (id, w) of a block, their words numbered by file; parts of a large file are read in small batches."""
    out = []
    for file in files:
        store, where = FileSystem.from_uri(file)
        with store.open_input_file(where) as f:
            if n == 1:
                out.append(pq.ParquetFile(f, read_dictionary=["w.list.element"]).read(["id", "w"]))
                continue
            at, part = 0, []
            for batch in pq.ParquetFile(f).iter_batches(1024, columns=["id", "w"]):
                part.append(batch.take(pa.array(np.arange((k - at) % n, len(batch), n))))
                at += len(batch)
            out.append(pa.Table.from_batches(part))
    return pa.concat_tables([t.set_column(1, "w", pa.chunked_array([numbered(x) for x in t["w"].chunks])) for t in out])


def numbered(words: pa.ListArray) -> pa.ListArray:
    """The same lists, with words as numbers in a dictionary."""
    flat, upto = words.flatten(), np.cumsum(np.append(0, pc.list_value_length(words).to_numpy()))
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat if pa.types.is_dictionary(flat.type) else flat.dictionary_encode())


def indexed_pairs(sets: DataFrame, percent: float) -> DataFrame:
    """Similar pairs of the sets (id, w): one of n words indexes its n - ceil(n * percent / 100) + 1 rarest; similar ones share one of them, so frequent words join nothing."""
    of_word = sets.select("id", F.size("w").alias("n"), F.explode("w").alias("word"))
    ranked = of_word.join(of_word.groupBy("word").agg(F.count("*").alias("df")), "word")
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "word"))
    index = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("id", "n", "word")
    other = index.select(F.col("id").alias("b"), F.col("n").alias("m"), "word")
    sized = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    pairs = index.withColumnRenamed("id", "a").join(other, "word").where((F.col("a") < F.col("b")) & sized).select("a", "b").distinct()
    j = pairs.join(sets.select(F.col("id").alias("a"), F.col("w").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("w").alias("y")), "b")
    both = j.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), F.size(F.array_union("x", "y")).alias("united"))
    return both.where(F.col("shared") * 100 >= F.col("united") * percent)


def similar(block: pa.Table, percent: float) -> pa.Table:
    """The similar pairs of the sets (low, high, part, id, w) of two blocks, one from each; of one block with itself, each once."""
    kind = block["id"].type
    none = pa.schema([("a", kind), ("b", kind), ("shared", pa.int32()), ("united", pa.int32())]).empty_table()
    return pa.concat_tables([none, *similar_by_tiles(block, percent)])


def similar_by_tiles(block: pa.Table, percent: float) -> Iterator[pa.Table]:
    """The same, for some sets of the left block at a time.

    Sets are lists of words from the rarest on. Of two with n and m words that are similar, (n + m) * percent / (100 + percent) are shared, so
    the first that is shared has as many left behind it in both. By an index of such words, with the sizes that can meet there, sets are
    candidates; signatures bound what they share, and those left are counted. Where so many meet that counting all is quicker, all is counted.
    """
    if not block.num_rows:
        return
    of, ids, words = block["part"].to_numpy(), block["id"].combine_chunks(), [x for x in block["w"].chunks if len(x)]
    sizes = np.concatenate([pc.list_value_length(x).to_numpy() for x in words]).astype(np.int64)
    words = pa.chunked_array([(x if pa.types.is_dictionary(x.type.value_type) else numbered(x)).flatten() for x in words]).unify_dictionaries()
    codes = np.concatenate([x.indices.to_numpy() for x in words.chunks])
    rows = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    same = block["low"][0].as_py() == block["high"][0].as_py()
    left = np.flatnonzero(of == block["low"][0].as_py())
    right = left if same else np.flatnonzero(of == block["high"][0].as_py())
    place = [np.full(len(ids), -1), np.full(len(ids), -1)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    most = int(codes.max(initial=-1)) + 1
    held = [np.bincount(codes[p[rows] >= 0], minlength=most) for p in place]
    # Words of one side alone are no one's to share.
    shared = (held[0] > 1) if same else (held[0] > 0) & (held[1] > 0)
    kept = shared[codes]
    weight = np.where(shared, held[0] * held[1], 0)
    order = np.argsort(weight, kind="stable")
    rank = np.empty(most, np.int64)
    rank[order] = np.arange(most)
    key = np.sort((rows[kept].astype(np.int64) << 32) + rank[codes[kept]])
    rows, codes = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
    del key, kept, words, block
    frequent = int(np.searchsorted(weight[order], RARE * len(left) * len(right), "right"))
    older = np.empty(len(ids), np.int64)
    older[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    tall = max(1, min(len(left), CELLS // max(1, len(right)), 1024))
    sets = Sets(rows, codes, sizes, left, right, place, same, most, frequent, percent)
    index, counts = Index(sets, STRIP * tall) if percent > 0 else None, None
    for strip in range(0, len(left), STRIP * tall):
        found = index.similar(strip, STRIP * tall) if index else None
        if found is None:
            counts = counts or Counts(sets)
        for i, j, both in [found] if found else (counts.similar(top, tall) for top in range(strip, min(strip + STRIP * tall, len(left)), tall)):
            x, y = left[i], right[j]
            x, y = np.where(older[x] < older[y], (x, y), (y, x))
            united = sizes[x] + sizes[y] - both
            yield pa.table({"a": ids.take(pa.array(x)), "b": ids.take(pa.array(y)), "shared": both.astype(np.int32), "united": united.astype(np.int32)})


class Sets(NamedTuple):
    """Words (rows, codes) of sets that both sides have, in order; codes from the rarest on, from ``frequent`` on such as fill much of a matrix."""

    rows: np.ndarray
    codes: np.ndarray
    sizes: np.ndarray
    left: np.ndarray
    right: np.ndarray
    place: list[np.ndarray]
    same: bool
    most: int
    frequent: int
    percent: float

    def once(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of places are to be reported: of a block with itself those that lead to a larger set, or to a later one as large."""
        if not self.same:
            return np.ones(len(i), bool)
        x, y = self.sizes[self.left[i]], self.sizes[self.right[j]]
        return (x < y) | (x == y) & (i < j)


class Words(NamedTuple):
    """Words that could be the first of two sets to be shared: place and size of their sets, the largest size that these can meet there; half of the
    words behind that aren't among the most frequent, less the set's part of what must be shared; bits of the most frequent words, and of those behind."""

    place: np.ndarray
    size: np.ndarray
    reach: np.ndarray
    spare: np.ndarray
    often: list[np.ndarray]
    rest: list[np.ndarray]

    @classmethod
    def of(cls, sets: Sets, rows: np.ndarray, place: np.ndarray, reach: np.ndarray, spare: np.ndarray, often: list[np.ndarray], rest: list[np.ndarray]) -> Words:
        return cls(*[x.astype(np.int32) for x in (place[rows], sets.sizes[rows], reach)], spare, [x[rows] for x in often], rest)


class Index:
    """Similar pairs by words that could be the first, from the rarest on, that two similar sets share."""

    def __init__(self, sets: Sets, tall: int):
        self.sets, p = sets, sets.percent
        rows, codes, sizes = sets.rows, sets.codes, sets.sizes
        self.own = np.bincount(rows, minlength=len(sizes))
        self.start = np.cumsum(self.own) - self.own
        behind = (self.start + self.own).astype(np.int32)[rows] - np.arange(len(rows), dtype=np.int32)
        # The sizes of what a set can be similar to at all, and at most where a word is the first that they share.
        least, largest = np.ceil(sizes * p / 100 - SLACK).astype(np.int64), np.floor(sizes * 100 / p + SLACK).astype(np.int64)
        both = np.floor(np.arange(int(self.own.max(initial=0)) + 1) * (100 + p) / p + SLACK).astype(np.int64)
        first = np.flatnonzero(both[behind] >= (least + sizes)[rows])
        # Sets by their most frequent words, a bit each; at each word, those behind it of the others, by sums without carry.
        top = max(0, sets.most - 64 * TOP)
        self.often = [self.folded(codes - (top + 64 * k))[1] for k in range(TOP)]
        rest = [self.folded(np.where(codes < top, codes % (64 * TOP) - 64 * k, -1))[0][first] for k in range(TOP)]
        rows, codes, behind = rows[first], codes[first].astype(np.int64), behind[first]
        reach = np.minimum(both[behind] - sizes[rows], largest[rows])
        behind = np.maximum(behind - sum(np.bitwise_count(x).astype(np.int32) for x in self.often)[rows], 0)
        # Of two sets (n + m) * part must be shared: half of what each has, less its part, bounds what may differ.
        part = sizes * (p / (100 + p)) - SLACK
        self.spare, spare = self.own / 2 - part, behind / 2 - part[rows]
        self.step = int(sizes.max(initial=0)) + 1
        at = np.flatnonzero(sets.place[1][rows] >= 0)
        key = codes[at] * self.step + sizes[rows[at]]
        order = np.argsort(key)
        key, at = key[order], at[order]
        self.right = Words.of(sets, rows[at], sets.place[1], reach[at], spare[at], self.often, [x[at] for x in rest])
        at = np.flatnonzero(sets.place[0][rows] >= 0)
        at = at[np.argsort(codes[at] * self.step + sizes[rows[at]])]
        codes, n = codes[at] * self.step, sizes[rows[at]]
        begin = np.searchsorted(key, codes + (n if sets.same else np.minimum(least[rows[at]], self.step - 1)))
        times = np.maximum(np.searchsorted(key, codes + np.minimum(reach[at], self.step - 1), "right") - begin, 0)
        tile = sets.place[0][rows[at]] // tall
        order = np.argsort(tile.astype(np.uint16) if len(sets.left) // tall < 1 << 16 else tile, kind="stable")
        self.tile, self.begin, self.times, at = tile[order], begin[order], times[order], at[order]
        self.left = Words.of(sets, rows[at], sets.place[0], reach[at], spare[at], self.often, [x[at] for x in rest])
        self.bits = self.signatures()

    def folded(self, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with a bit from 0 to 63, as sums without carry: from each word on to its set's end, and of each set."""
        upto = np.zeros(len(bit) + 1, np.uint64)
        has = np.flatnonzero((bit >= 0) & (bit < 64))
        upto[1 + has] = np.uint64(1) << bit[has].astype(np.uint64)
        np.bitwise_xor.accumulate(upto, out=upto)
        end = upto[self.start + self.own]
        return end[self.sets.rows] ^ upto[:-1], end ^ upto[self.start]

    def signatures(self) -> list[np.ndarray]:
        """Each set with a bit for each word, of which words may share one: half of the bits, each for two of the others, and all."""
        rows, bit = self.sets.rows, self.sets.codes % BITS
        out = np.empty((len(self.own), BITS // 64), np.uint64)
        upto = np.append(self.start, len(rows))
        for k in range(0, len(out), 1 << 12):
            span = slice(upto[k], upto[min(k + (1 << 12), len(out))])
            flags = np.zeros((min(1 << 12, len(out) - k), BITS), bool)
            flags[rows[span] - k, bit[span]] = True
            out[k : k + (1 << 12)] = np.packbits(flags, axis=1).view(np.uint64)
        half = BITS // 128
        return [out[:, :half] | out[:, half:], out]

    def similar(self, top: int, tall: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(place left, place right, shared) for sets on the left from ``top`` on; None where too many meet."""
        s = self.sets
        left, right, sizes = s.left, s.right, s.sizes
        span = slice(*np.searchsorted(self.tile, (top // tall, top // tall + 1)))
        times = self.times[span]
        total, cells = int(times.sum()), min(tall, len(left) - top) * len(right)
        if total > MUCH[0] * cells:
            return None
        upto, first = np.cumsum(times), span.start
        cuts = np.searchsorted(upto, np.arange(0, total, MEET), "right")
        close, met, near = [np.empty(0, np.int64)], 0, 0
        for begin, end in pairwise([*cuts, len(times)]):
            i, j = self.met(slice(first + begin, first + end))
            met += len(i)
            for k in range(0, len(i), SOME):
                close.append(self.close(i[k : k + SOME].astype(np.int64), j[k : k + SOME].astype(np.int64)))
                near += len(close[-1])
            if met > MUCH[1] * cells or near > MUCH[2] * cells:
                return None
        pairs = np.unique(np.concatenate(close))
        i, j = np.divmod(pairs, len(right))
        both = np.zeros(len(i), np.int64)
        words = np.cumsum(self.own[left[i]] + self.own[right[j]])
        for k in range(0, int(words[-1]) if len(i) else 0, CELLS):
            part = slice(np.searchsorted(words, k, "right"), np.searchsorted(words, k + CELLS, "right"))
            both[part] = self.shared(left[i[part]], right[j[part]])
        hit = both * 100 >= (sizes[left[i]] + sizes[right[j]] - both) * s.percent
        return i[hit], j[hit], both[hit]

    def met(self, span: slice) -> tuple[np.ndarray, np.ndarray]:
        """Candidates by some words on the left, with each of those on the right that it meets."""
        x, y = Words(*[v[span] for v in self.left[:4]], *[[v[span] for v in w] for w in self.left[4:]]), self.right
        begin, times = self.begin[span], self.times[span]
        at = np.repeat(begin - (np.cumsum(times) - times), times)
        at += np.arange(len(at))
        ok = np.flatnonzero(y.reach[at] >= np.repeat(x.size, times))
        at, of = at[ok], np.repeat(np.arange(len(times)), times)[ok]
        # Of the most frequent words as many are shared as both have; of the others behind, half of what both have less what differs.
        differ, most = np.zeros(len(at), np.float32), x.spare[of] + y.spare[at]
        for a, b in zip(x.rest, y.rest, strict=True):
            differ += np.bitwise_count(a[of] ^ b[at])
        for a, b in zip(x.often, y.often, strict=True):
            most += np.bitwise_count(a[of] & b[at])
        ok = np.flatnonzero(most >= differ / 2)
        i, j = x.place[of[ok]], y.place[at[ok]]
        once = self.sets.once(i, j)
        return i[once], j[once]

    def close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers of the pairs whose signatures don't differ in more than similar sets' can: a bit that differs is a word that isn't shared."""
        s = self.sets
        for bits in self.bits:
            x, y = s.left[i], s.right[j]
            differ = np.bitwise_count(bits.take(x, 0) ^ bits.take(y, 0)).view(np.uint64)
            # Eight counts in each number, none of which passes a byte before they are added by two.
            differ = (differ & LOW) + (differ >> EIGHT & LOW)
            differ = sum(differ[:, k] for k in range(1, differ.shape[1])) + differ[:, 0]
            ok = self.spare[x] + self.spare[y] >= (differ * ONES >> UPPER) / 2
            i, j = i[ok], j[ok]
        return i * len(s.right) + j

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the sets of each pair share: those that come twice among its words."""
        rows = np.concatenate([x, y])
        n = self.own[rows]
        at = np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key = np.sort(np.repeat(np.tile(np.arange(len(x)), 2), n) * self.sets.most + self.sets.codes[at])
        return np.bincount(key[1:][key[1:] == key[:-1]] // max(1, self.sets.most), minlength=len(x))


class Counts:
    """Similar pairs by counting all shared words: frequent ones by products of matrices, rare ones pair by pair."""

    def __init__(self, sets: Sets):
        self.sets = sets
        order = np.argsort(sets.codes, kind="stable")
        codes, rows = sets.codes[order].astype(np.int64), sets.rows[order]
        rare = int(np.searchsorted(codes, sets.frequent))
        self.rare, self.rare_rows = codes[:rare], rows[:rare]
        self.codes, self.rows = codes[rare:] - sets.frequent, rows[rare:]
        of_right = sets.place[1][self.rare_rows] >= 0
        self.right_codes, self.right_place = self.rare[of_right], sets.place[1][self.rare_rows][of_right]
        self.known = sets.most - sets.frequent

    def similar(self, top: int, tall: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = self.sets
        sizes, right, place = s.sizes, s.right, s.place
        wide = max(64, CELLS // max(1, len(right), tall))
        here = s.left[top : top + tall]
        both = np.zeros((len(here), len(right)), np.float32)
        for first in range(0, self.known, wide):
            span = slice(*np.searchsorted(self.codes, (first, first + wide)))
            at, row = self.codes[span] - first, self.rows[span]
            shape = min(wide, self.known - first)
            a, b = np.zeros((len(here), shape), np.float32), np.zeros((len(right), shape), np.float32)
            i, j = place[0][row] - top, place[1][row]
            inside = (i >= 0) & (i < len(here))
            a[i[inside], at[inside]] = 1
            b[j[j >= 0], at[j >= 0]] = 1
            both += a @ b.T
        # Rare words pair by pair: each holder on the left with all holders on the right.
        i = place[0][self.rare_rows] - top
        inside = (i >= 0) & (i < len(here))
        i, begin = i[inside], np.searchsorted(self.right_codes, self.rare[inside])
        times = np.searchsorted(self.right_codes, self.rare[inside], "right") - begin
        upto = np.cumsum(times)
        for k in range(0, int(upto[-1]) if len(upto) else 0, CELLS):
            some = slice(np.searchsorted(upto, k, "right"), np.searchsorted(upto, k + CELLS, "right"))
            n, before = times[some], upto[some] - times[some]
            j = self.right_place[np.repeat(begin[some] - before, n) + np.arange(n.sum()) + (before[0] if len(n) else 0)]
            both += np.bincount(np.repeat(i[some], n) * len(right) + j, minlength=both.size).reshape(both.shape)
        united = sizes[here][:, None] + sizes[right][None, :] - both
        i, j = np.nonzero((both > 0) & (both * 100 >= united * s.percent))
        hit = s.once(i + top, j)
        i, j = i[hit], j[hit]
        return i + top, j, both[i, j].astype(np.int64)


def clamp_percent(value: float | str | None) -> float:
    """A fuzzy threshold between 0.5 and 1; anything that isn't a number is 0.8."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return 0.8
    return 0.8 if math.isnan(number) else min(1.0, max(0.5, number))
