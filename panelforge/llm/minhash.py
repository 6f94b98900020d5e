"""MinHash near-duplicate detection with tensored banding.

Method: a set's minima under 2 * HALVES * ROWS hash functions give two collections of HALVES half keys, each of
ROWS minima; every pair of half keys from the two collections forms the key of one table. HALVES ** 2 tables thus
need about the square root of the hash functions that as many independent bands would. Sets that share a key
are candidates; links are confirmed on the whole sets.

Rows with equal sets are one class, kept by a 64-bit digest of its set (and words, pairs and sets by 64-bit hashes
likewise: with 10**6 different sets, the chance that any two digests meet is about 10**-7). Classes joined by keys
are a group. Its classes are dealt to blocks, those that share a smallest neighbour to the same one, and any two blocks
that share a key are compared as a whole, by matrix products; a spanning forest of the links is kept. So every pair
that shares a key is compared on its whole sets, whatever the size and the shape of its group.

A pair of similarity s shares a key with probability (1 - (1 - s ** ROWS) ** HALVES) ** 2: 0.9994 at 0.8, over
0.99993 from 0.85.

Defined results: null, empty and blank texts have the empty set and link with nothing; with fewer words than a
shingle has, the whole sequence is the one shingle; repeated rows are one class, and a repeated id with other
text belongs to the class of each text; a null id is the smallest of its component only where no other id is in it;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import cut, slices, stored
from panelforge.llm.graph import components

ROWS, HALVES, PERCENT, WORDS, BLOCK = 2, 8, 80, 5, 1024
#: Places that the classes of a large group, or of a frequent neighbour, meet its size in.
SALTS = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bits of the filter of candidate ids that goes to all tasks: 1 MB, whatever the input.
FILTER_BITS = 1 << 23


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().translate(LOWER).split()  # bytes split at ASCII white space only
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if not words:
        return hashes
    width_here = min(width, len(words))
    rolled = np.full(len(words) - width_here + 1, width_here, np.uint64)
    for i in range(width_here):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(words) - width_here + 1 + i])
    return np.unique(rolled)


def constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n], seeds[n:] | np.uint64(1)


def table_keys(hashes: np.ndarray, rows: int, halves: int) -> np.ndarray:
    flip, times = constants(2 * halves * rows)
    least = np.full(len(flip), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024, None]
        np.minimum(least, ((part ^ flip) * times).min(0), out=least)
    half = np.zeros((2, halves), np.uint64)
    for column in np.moveaxis(least.reshape(2, halves, rows), 2, 0):
        half = mixed(half * np.uint64(0x9E3779B97F4A7C15) + column)
    number = np.arange(halves * halves, dtype=np.uint64).reshape(halves, halves)
    return mixed(mixed(half[0][:, None] + number) * np.uint64(31) + half[1][None, :]).ravel()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketch(docs: DataFrame, width: int, rows: int, halves: int) -> DataFrame:
    """doc_id, n_shingles, cls (the digest of the set; null if empty), keys (array<long>)."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for batch in slices(batches):
            n, cls, keys = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width)
                n.append(len(found))
                cls.append(np.uint64(xxh3_64_intdigest(found.tobytes())).astype(np.int64) if len(found) else None)
                keys.append(signed(table_keys(found, rows, halves)) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "cls", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, cls long, keys array<long>")


def bit_of(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits, in which the bits of all ids of the column doc_id are set."""
    position = bit_of(F.col("doc_id")) + 1  # these functions count from 1
    maps = ids.select(position.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in maps:
        part = np.frombuffer(row["bits"], np.uint8)
        at = (row["bucket"] - 1) * len(part)
        bits[at : at + len(part)] = part
    return bits


def sets_of(docs: DataFrame, representatives: DataFrame, width: int) -> DataFrame:
    """cls, set (binary) and what else representatives (doc_id, cls, ...) have. Texts are neither kept nor exchanged: the second pass over docs leaves out most others by a bitmap of bounded size, and what it lets through by chance goes with the join."""
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(representatives.select("doc_id")))

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for batch in slices(batches):
            place = batch.column(2).to_numpy()
            chosen = np.flatnonzero((sent.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            ids, cls, sets = [], [], []
            for i in chosen.tolist():
                found = shingles(batch.column(1)[i].as_py(), width)
                if len(found):
                    ids.append(batch.column(0)[i].as_py())
                    cls.append(np.uint64(xxh3_64_intdigest(found.tobytes())).astype(np.int64))
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "cls", "set"])

    found = docs.select("doc_id", "text", bit_of(F.col("doc_id")).alias("bit")).mapInArrow(run, "doc_id long, cls long, set binary")
    wanted = representatives.withColumnRenamed("doc_id", "of")
    joined = found.join(wanted, "cls").where(F.col("doc_id").eqNullSafe(F.col("of"))).drop("doc_id", "of")
    return joined.dropDuplicates(["cls"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # what only one set holds is in no intersection
    shared = times[item] > 1
    owner, item = owner[shared], place[item[shared]]
    columns, counts = int(item.max(initial=-1)) + 1, np.zeros((n, n), np.float32)
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    width = max(1, 2_000_000 // n)
    for at in range(0, columns, width):
        first, last = np.searchsorted(item, [at, at + width])
        dense = np.zeros((n, min(width, columns - at)), np.float32)
        dense[owner[first:last], item[first:last] - at] = 1
        counts += dense @ dense.T
    return counts


def stars(cls: list[int], a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The classes of each component that the pairs (a, b) of places make, but the smallest, with the smallest."""
    parent = list(range(len(cls)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(u), root(v)
        if x != y:
            low, high = (x, y) if cls[x] < cls[y] else (y, x)
            parent[high] = low
    return [(c, cls[root(i)]) for i, c in enumerate(cls) if root(i) != i]


def salted(rows: DataFrame, few: DataFrame, key: str, value: str) -> DataFrame:
    """rows (cls, key, ...) with the value that few (key, value) have, null for others. Rows of one key meet few in SALTS places."""
    spread = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(spread, [key, "__salt"], "left").drop("__salt")


def in_blocks(members: DataFrame, groups: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """cls, block (long), alone (whether its group is one block); and the pairs (i, j) of blocks that share a key, i <= j, of other groups."""
    homes = members.groupBy("cls").agg(F.min("low").alias("home"))
    placed = groups.join(homes, "cls")
    large = groups.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > block).select("g", F.ceil(F.col("n") / block).alias("bins"))
    frequent = placed.groupBy("home").agg(F.count("*").alias("n")).where(F.col("n") > block).select("home", F.ceil(F.col("n") / block).alias("places"))
    sized = salted(salted(placed, large, "g", "bins"), frequent, "home", "places")
    place = F.xxhash64("g", F.pmod(F.xxhash64("home"), F.coalesce("bins", F.lit(1))), F.pmod(F.xxhash64("cls", F.lit(1)), F.coalesce("places", F.lit(1))))
    placed = cut(sized.select("cls", place.alias("block"), F.col("bins").isNull().alias("alone")))
    held = members.join(placed.where("not alone").select("cls", "block"), "cls").select("key", "block").distinct()
    pairs = held.withColumnRenamed("block", "i").join(held.withColumnRenamed("block", "j"), "key").where("i <= j").select("i", "j").distinct()
    return placed, cut(pairs)


def confirm_blocks(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), as many as keep their components. sets: cls, set, block, alone; pairs: i, j.

    The sets of two blocks meet in one place, where all intersections are counted by matrix products over what at
    least two sets hold.
    """
    ends = pairs.select(F.col("i").alias("block"), "i", "j").union(pairs.where("i <> j").select(F.col("j").alias("block"), "i", "j"))
    single = sets.where("alone").select(F.col("block").alias("i"), F.col("block").alias("j"), "block", "cls", "set")
    dealt = single.union(sets.where("not alone").join(ends, "block").select("i", "j", "block", "cls", "set"))
    dealt = dealt.repartition("i", "j").sortWithinPartitions("i", "j")

    def links(key, rows):
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(x, np.uint64) for _, _, x in rows]
        size, block = np.array([len(x) for x in sets]), np.array([o for o, _, _ in rows])
        both = common_counts(sets)
        ends = []
        for at in range(0, len(rows), 256):  # exact in doubles, a few rows at a time
            part = both[at : at + 256].astype(float)
            linked = np.triu(100 * part >= percent * (size[at : at + 256, None] + size[None, :] - part), at + 1)
            if key[0] != key[1]:
                linked &= block[at : at + 256, None] != block[None, :]
            a, b = np.nonzero(linked)
            ends.append((a + at, b))
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        return stars([cls for _, cls, _ in rows], a, b)

    def run(batches):
        key, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(4)]
            raw = batch.column(4)
            found = []
            for at, (i, j, own, cls) in enumerate(zip(*columns, strict=True)):
                if (i, j) != key:
                    found += links(key, rows)
                    key, rows = (i, j), []
                rows.append((own, cls, raw[at].as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        if found := links(key, rows):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def confirmed(members: DataFrame, candidates: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links of the classes that share keys. members: key, cls, low; candidates: pairs that join all classes of a key; classes: cls, doc_id.

    Groups and blocks are known before the sets are made, so that a set is exchanged with its block and then dealt to those that it meets.
    """
    groups = cut(components(candidates).select(F.col("node").alias("cls"), F.col("component").alias("g")))
    placed, pairs = in_blocks(members, groups, block)
    chosen = cut(classes.join(placed, "cls"))
    return cut(confirm_blocks(sets_of(docs, chosen, width), pairs, percent))


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, rows: int = ROWS, halves: int = HALVES, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = sketch(docs, width, rows, halves)
    rows_of = stored(sketched)
    classes = rows_of.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.any_value("keys").alias("keys"))
    filed = classes.select(F.explode("keys").alias("key"), "cls")
    shared = filed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").drop("high")
    members = stored(filed.join(shared, "key"))
    pairs = members.where("cls <> low").select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct()
    links = confirmed(members, pairs, classes.select("cls", "doc_id"), docs, width, percent, block)
    known = components(links)
    return labelled(rows_of, classes.select("cls", "doc_id"), known)


def labelled(rows_of: DataFrame, classes: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with the smallest id of their component."""
    placed = classes.join(known.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = placed.join(smallest, "component").select("cls", "component_id")
    rows = rows_of.select("doc_id", "n_shingles", "cls").join(of_class, "cls", "left")
    found = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
