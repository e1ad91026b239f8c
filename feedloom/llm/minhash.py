"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A signature has SLOTS numbers of BITS bits, each the low bits of a minimum over the document's shingles.
Two signatures differ in at most ``d`` slots for all but a negligible share of pairs at the wanted similarity
(mean plus four standard deviations). The slots are split into d // 2 + 1 chunks, so by pigeonhole two such
signatures differ in at most one slot of some chunk; leaving out each slot of each chunk in turn enumerates
the allowed error, and any pair within distance ``d`` shares one of the resulting SLOTS keys for certain.
Candidates are confirmed on full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import MIX_1, RollingHash, Workspace, batch, connected_components, marked, mix, released, signed, slices, utf8

SLOTS = 40
BITS = 16
SHINGLE = 5
SEED = 11
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_1", pa.int64()), ("set_2", pa.int64()), ("signature", pa.binary())])
KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64())])
CHECKED = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Leaders that a class is compared with at most in each round; the exhaustive comparison follows.
LEADERS = (1, 4)
#: Shingles in a block of the exhaustive comparison.
BLOCK = 60_000
#: Pairs of 64 members and a block beyond which one product over all shared shingles is quicker than pair by pair.
MANY = 500


class Shingler:
    """Distinct hashes of word shingles: ASCII lower case, words apart at ASCII white space."""

    def __init__(self, width: int = SHINGLE):
        self.roll, self.width = RollingHash(SEED), width
        self.by_place = np.random.default_rng(SEED).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Each text's sorted distinct hashes; no words, none. With fewer words than ``width``, one of them all."""
        for first, last in slices(np.array([len(x) for x in texts], np.int64)):
            part = texts[first:last]
            ends = np.cumsum([len(x) + 1 for x in part])
            data = np.frombuffer((b" ".join(part) + b" ").lower(), np.uint8)
            space = SPACE[data]
            inside = np.concatenate(([False], ~space)).view(np.int8)
            turn = np.diff(inside)
            start = np.flatnonzero(turn == 1)
            if len(start) and space[-1]:
                stop = np.flatnonzero(turn == -1)
            else:
                stop = np.append(np.flatnonzero(turn == -1), len(data))[: len(start)]
            words = self.roll.of(self.roll.prefix(data), start, stop) if len(start) else np.empty(0, np.uint64)
            bounds = np.searchsorted(start, ends).tolist()
            n = len(words) - self.width + 1
            if n > 0:
                runs = words[:n] * self.by_place[0]
                for k in range(1, self.width):
                    runs += words[k : k + n] * self.by_place[k]
                runs = mix(runs)
            at = 0
            for end in bounds:
                if end - at >= self.width:
                    yield np.unique(runs[at : end - self.width + 1])
                elif end > at:
                    yield mix((words[at:end] * self.by_place[: end - at]).sum(keepdims=True) ^ np.array([end - at], np.uint64) * MIX_1)
                else:
                    yield np.empty(0, np.uint64)
                at = end


def set_hash(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets of hashes apart."""
    return (int(found.sum().astype(np.int64)), int(mix(found + MIX_1).sum().astype(np.int64))) if len(found) else (0, 0)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_1, set_2, signature): one row for each document, repeated rows too."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rng = Shingler(width), np.random.default_rng(SEED + 1)
        times = (rng.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        for rows in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, found in zip(rows.column(0).to_pylist(), shingler.sets(utf8(rows.column(1))), strict=True):
                least = None
                if len(found):
                    least = np.full(SLOTS, np.uint64(2**64 - 1))
                    for at in range(0, len(found), 4096):
                        np.minimum(least, (found[at : at + 4096] * times).min(axis=1), out=least)
                    least = (mix(least) & np.uint64(2**BITS - 1)).astype("<u2").tobytes()
                for column, value in zip(out, (doc, len(found), *set_hash(found), least), strict=True):
                    column.append(value)
            yield batch(SETS, **dict(zip(SETS.names, out, strict=True)))
        released()

    return docs.select(id_col, text_col).mapInArrow(sign, "doc_id long, n_shingles long, set_1 long, set_2 long, signature binary")


def allowed_errors(similarity: tuple[int, int]) -> int:
    """The signature distance that pairs at this similarity exceed about once in 30,000."""
    miss = 1 - similarity[0] / similarity[1]
    return min(SLOTS - 2, math.ceil(SLOTS * miss + 4 * math.sqrt(SLOTS * miss * (1 - miss))))


def chunk_keys(signed_sets: DataFrame, errors: int) -> DataFrame:
    """(key, id): for each chunk of the signature and each slot in it, the chunk without that slot."""
    chunks = np.array_split(np.arange(SLOTS), errors // 2 + 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED + 2)
        odd = rng.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                rows = whole.slice(at, 2048)
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                slots = np.frombuffer(b"".join(rows.column(1).to_pylist()), "<u2").reshape(-1, SLOTS).astype(np.uint64) + np.uint64(1)
                out = []
                for chunk in chunks:
                    terms = mix(slots[:, chunk] * odd[chunk])
                    total = terms.sum(axis=1)
                    out += [mix(total - terms[:, j] + np.uint64(1000 + k)) for j, k in enumerate(chunk)]
                yield batch(KEYS, key=signed(np.concatenate(out)), id=np.tile(ids, SLOTS))

    return signed_sets.select("id", "signature").mapInArrow(keys, "key long, id long")


def packed_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, width: int = SHINGLE) -> DataFrame:
    """(id, shingles): the full set of each class in ``classes`` (id, doc_id, set_1, set_2, n_shingles), one row each.

    Texts come by doc_id; of rows that repeat one, only those with the class's own set count, and only once.
    """

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        schema = pa.schema([("set_1", pa.int64()), ("set_2", pa.int64()), ("n_shingles", pa.int64()), ("shingles", pa.binary())])
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                sets = list(shingler.sets(utf8(whole.slice(at, 500).column(0))))
                sums = [set_hash(x) for x in sets]
                yield batch(schema, set_1=[a for a, _ in sums], set_2=[b for _, b in sums], n_shingles=[len(x) for x in sets], shingles=[x.tobytes() for x in sets])
        released()

    ids = classes.select("doc_id").distinct()
    source = marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ids, "doc_id").join(ids, "doc_id")
    sets = source.select("text").mapInArrow(shingle, "set_1 long, set_2 long, n_shingles long, shingles binary")
    key = ["set_1", "set_2", "n_shingles"]
    return sets.groupBy(*key).agg(F.first("shingles").alias("shingles")).join(classes.select("id", *key), key).select("id", "shingles")


def confirm(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity: den * intersection >= num * union."""
    num, den = similarity

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                rows = whole.slice(at, 512)
                keep = []
                for x, y in zip(rows.column("set_a").to_pylist(), rows.column("set_b").to_pylist(), strict=True):
                    short, long = sorted((len(x) // 8, len(y) // 8))
                    both = 0
                    if den * short >= num * long:
                        both = shared_hashes(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                    keep.append(both > 0 and den * both >= num * (short + long - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([rows.column("a").filter(keep), rows.column("b").filter(keep)], schema=CHECKED)
        released()

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def exhaustive(open_: DataFrame, sets: DataFrame, work: Workspace, similarity: tuple[int, int], block: int = BLOCK) -> DataFrame:
    """Links (a, b) between members that share a bucket but no component yet: (key, id, component, signature) of open buckets.

    Members that share buckets, also by way of others, form one group. A group is cut into blocks of a bounded
    number of shingles, and each pair of blocks meets in one task: signatures within the allowed distance by one
    matrix comparison, and of those pairs the full sets. It gives a spanning forest of its links, so pairs are never rows.
    """
    num, den = similarity
    errors = allowed_errors(similarity)
    nearest = open_.groupBy("key").agg(F.min("id").alias("a"))
    group = connected_components(open_.join(nearest, "key").select("a", F.col("id").alias("b")), work, "groups")
    member = open_.groupBy("id").agg(F.first("component").alias("component"), F.first("signature").alias("signature")).join(group.withColumnRenamed("component", "group"), "id")
    rows = member.join(sets, "id").select("group", "id", "component", "signature", "shingles", (F.octet_length("shingles") / 8).alias("n"))
    rows = work.save(rows, "members")
    parts = rows.groupBy("group").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
    blocks = rows.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = blocks.repartition("group", "part")  # or a large group would be gathered in the one task of its join
    blocks = work.save(blocks.groupBy("group", "part", "parts").agg(F.collect_list(F.struct("id", "component", "signature", "shingles")).alias("m")), "blocks")
    # Each pair of a group's blocks is a key of its own, so that a large group is dealt to many tasks.
    first = blocks.select("group", "part", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("with"), "m")
    second = blocks.select("group", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("part"), F.col("part").alias("with"), F.col("m").alias("n"))
    meets = first.join(second, ["group", "part", "with"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                m, n = (whole.slice(k, 1).column(x).flatten() for x in ("m", "n"))
                (ids_a, of_a, sign_a, own), (ids_b, of_b, sign_b, other) = parted(m), parted(n)
                size_b = np.array([len(x) for x in other])
                joined = Forest()
                size_a = np.array([len(x) for x in own])
                shared: tuple[np.ndarray, np.ndarray] | None = None
                for at in range(0, len(own), 64):
                    far = np.zeros((len(own[at : at + 64]), len(other)), np.int16)
                    for slot in range(SLOTS):
                        far += sign_a[at : at + 64, slot][:, None] != sign_b[:, slot][None, :]
                    size = size_a[at : at + 64][:, None]
                    near = (far <= errors) & (of_a[at : at + 64][:, None] != of_b[None, :]) & (den * np.minimum(size, size_b) >= num * np.maximum(size, size_b))
                    i, j = np.nonzero(near)
                    if len(i) > MANY:
                        if shared is None:
                            columns = np.intersect1d(np.concatenate(own), np.concatenate(other))
                            shared = incidence(own, columns), incidence(other, columns).T
                        both = (shared[0][at : at + 64] @ shared[1])[i, j]
                    else:
                        both = np.array([shared_hashes(own[at + x], other[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], float)
                    linked = (both > 0) & (den * both >= num * (size_a[at + i] + size_b[j] - both))
                    for x, y in zip((at + i[linked]).tolist(), j[linked].tolist(), strict=True):
                        if not joined.together(int(of_a[x]), int(of_b[y])):
                            joined.join(int(of_a[x]), int(of_b[y]), (int(ids_a[x]), int(ids_b[y])))
                yield batch(CHECKED, a=[x for x, _ in joined.links], b=[y for _, y in joined.links])
        released()

    return meets.select("m", "n").mapInArrow(compare, "a long, b long")


def shared_hashes(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the sorted distinct hashes are in both."""
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    return int(np.count_nonzero(b[place] == a))


def incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """(sets, columns): which set holds which of the sorted columns."""
    out = np.zeros((len(sets), len(columns)), np.float32)
    if len(columns):
        row, every = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        place = np.searchsorted(columns, every)
        place[place == len(columns)] = 0
        held = columns[place] == every
        out[row[held], place[held]] = 1
    return out


def parted(block: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, components, signatures and sets of a block's members."""
    ids, of = (block.field(x).to_numpy(zero_copy_only=False) for x in ("id", "component"))
    signed_ = np.frombuffer(b"".join(block.field("signature").to_pylist()), "<u2").reshape(len(block), SLOTS)
    return ids, of, signed_, [np.frombuffer(x, np.uint64) for x in block.field("shingles").to_pylist()]


class Forest:
    """Which components are joined so far, and the links that did it."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def together(self, x: int, y: int) -> bool:
        return self.root(x) == self.root(y)

    def join(self, x: int, y: int, link: tuple[int, int]) -> None:
        self.parent[self.root(x)] = self.root(y)
        self.links.append(link)


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (85, 100), id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked where Jaccard similarity >= num / den.

    One row for each input row, each a document of its own. Equal shingle sets form one class, which takes part in the
    join once. As only components are asked for, members already connected need no further comparison: at first each
    class meets one leader, the member of its buckets that meets the most others; then those in buckets of several
    components meet a few leaders of other components; the last, exhaustive round compares every pair that shares a
    bucket and isn't connected yet, block by block. So no link is left out, and no group of copies, however large, is
    expanded into its pairs. Documents without words (null, empty or blank texts) and rows with a null id link with
    nothing; their component is their own id. Rows that repeat an id are linked by their own texts only. Very long
    texts are shingled whole. An empty table gives no rows; further columns of ``docs`` aren't read.
    """
    work = Workspace(docs.sparkSession, "minhash")
    sets = work.save(signatures(docs, id_col, text_col, width), "sets")
    key = ["set_1", "set_2", "n_shingles"]
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min(F.struct("doc_id", "signature")).alias("m"))
    classes = work.save(classes.select(F.monotonically_increasing_id().alias("id"), *key, "m.doc_id", "m.signature"), "classes")
    keys = chunk_keys(classes, allowed_errors(similarity))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = work.save(keys.join(shared, "key"), "buckets")
    # The members that meet the most others lead: the text that a group's copies were made from meets all of them.
    members = work.save(buckets.groupBy("id").agg(F.sum("n").alias("weight")).join(classes, "id"), "members-of-buckets")
    packed = work.save(packed_sets(docs, members, id_col, text_col, width), "packed")
    buckets = work.save(buckets.join(members.select("id", "weight"), "id").select("key", "id", "weight"), "weighted")
    work.drop("buckets")
    found = component = None
    for round_, most in enumerate((*LEADERS, 0)):
        if component is None:
            held = buckets.withColumn("component", F.col("id"))
        else:
            held = buckets.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
            open_ = held.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
            held = work.save(held.join(open_, "key", "left_semi"), f"open-{round_}")
        if most:
            edges = confirm(work.save(with_leaders(held, most), f"pairs-{round_}"), packed, similarity)
        else:
            edges = exhaustive(held.join(members.select("id", "signature"), "id"), packed, work, similarity, block)
        edges = work.save(edges, f"edges-{round_}")
        work.drop(f"open-{round_}", f"pairs-{round_}", "members", "blocks")
        found = edges if found is None else found.unionByName(edges)
        if component is None or not edges.isEmpty():
            component = connected_components(found, work, f"round-{round_}")
    work.drop("packed", "weighted", "members-of-buckets")
    placed = classes.join(component, "id", "left").select(*key, "doc_id", F.coalesce("component", "id").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = placed.join(smallest, "component").select(*key, "component_id")
    linked = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return (
        sets.select("doc_id", *key).join(known, key, "left")
        .select("doc_id", "n_shingles", F.coalesce(linked, "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def with_leaders(held: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b): each member (key, id, weight, component) with at most ``most`` leaders of other components.

    Each bucket names the heaviest of its members and, for ``most`` > 1, members of arbitrary components.
    """
    own = F.struct("weight", "id", "component")
    some = [F.min_by(own, F.xxhash64("component", "id", F.lit(k))).alias(f"l{k}") for k in range(1, most)]
    leaders = held.groupBy("key").agg(F.max(own).alias("l0"), *some)
    leaders = leaders.select("key", F.array_distinct(F.array(*[f"l{k}" for k in range(most)])).alias("leaders"))
    met = held.join(leaders, "key").select("id", F.filter("leaders", lambda x: x["component"] != F.col("component")).alias("leaders")).where(F.size("leaders") > 0)
    if most == 1:
        met = met.groupBy("id").agg(F.array(F.max(F.element_at("leaders", 1))).alias("leaders"))
    else:
        met = met.groupBy("id").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set("leaders"))), asc=False), 1, most).alias("leaders"))  # of at most SLOTS buckets
    return met.select("id", F.explode("leaders").alias("x")).select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b")).distinct()
