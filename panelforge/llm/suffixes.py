"""Benchmark decontamination by suffix arrays of the training texts.

Method: a task's documents, some SHARD words at a time, are a shard: their words are numbered, and the suffixes of the
shard are sorted by doubling (pairs of ranks and places sorted as single longs), as deep as the longest benchmark item needs.
Every suffix of the benchmark from which a window can start is looked up by binary search, all at once; the neighbours of its
place give its longest verbatim match in the shard and where that is. Where a match has a whole window, the range of suffixes that
begin with the window gives all its occurrences; their words are hit. Documents never match across their ends.

The benchmark comes to the tasks in blocks of at most BLOCK words (an item longer than that is a block of its own), each
broadcast. One block is the usual case; if there are more, the shards are searched for each, and a document's hits are merged.

Defined results: null or blank texts have no words, so that they are never hit, and blank items never match; an item of
fewer words than a window is one window; repeated rows count each; an id that several items have is listed once; items
without an id make words hit and documents contaminated, but aren't listed; empty tables give no hits or no rows; other columns
are ignored by search(), and kept by decontaminate().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import stored

WINDOW = 10
#: Words of a shard, and of a block of the benchmark.
SHARD, BLOCK = 1 << 20, 1 << 21
#: Bytes of a word: digits, letters, those of A-Z lower-cased, and all beyond ASCII; others become blanks.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: What a word of the benchmark is that a shard doesn't have, and what ends an item; a shard's words are from 1, and 0 ends a document.
UNKNOWN, END = -1, -2


@dataclass(frozen=True)
class Block:
    """Items of the benchmark: the different words, the words by number with END after each item, the items' ids and starts."""

    vocabulary: list[bytes]
    words: np.ndarray
    ids: list
    starts: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts, append=len(self.words)) - 1


def words_of(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(WORDS).split()


def block_of(items: list[tuple]) -> Block:
    numbers: dict[bytes, int] = {}
    flat, starts = [], []
    for _, found in items:
        starts.append(len(flat))
        flat += [numbers.setdefault(w, len(numbers)) for w in found]
        flat.append(END)
    return Block(list(numbers), np.array(flat, np.int64), [i for i, _ in items], np.array(starts, np.int64))


def blocks_of(benchmark: DataFrame, most: int = BLOCK):
    """The benchmark in blocks; the driver holds one at a time."""
    items, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        found = words_of(row["text"])
        if items and size + len(found) > most:
            yield block_of(items)
            items, size = [], 0
        if found:
            items.append((row["item_id"], found))
            size += len(found)
    if items:
        yield block_of(items)


def ranks_of(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By place, the rank of its key, given the places in the order of keys; equal keys rank equal, from 1."""
    sorted_keys = keys[order]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else 0
    return ranks


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of a text (numbers from 0) sorted by the words that follow, at least depth of them."""
    n = len(text)
    bits = max(n, 1).bit_length()
    ranks, known = text + 1, 1
    order = np.argsort(ranks, kind="stable")
    while known < max(depth, 2):
        after = np.zeros(n, np.int64)
        after[: max(n - known, 0)] = ranks[known:]
        if 3 * bits <= 63 and ranks.max(initial=0) < 1 << bits:
            packed = (ranks << 2 * bits) | (after << bits) | np.arange(n)
            packed.sort()
            order = packed & ((1 << bits) - 1)
            keys = (ranks << bits) | after
        else:  # a single text of more than two million words
            order = np.lexsort((after, ranks))
            keys = ranks * (int(after.max(initial=0)) + 1) + after
        ranks, known = ranks_of(keys, order), 2 * known
        if ranks.max(initial=0) == n:
            break
    return order


def compared(text: np.ndarray, at: np.ndarray, words: np.ndarray, of: np.ndarray, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of a place in a text and one in the benchmark: how many words are equal, and the sign of (benchmark - text) at the next; 0 where limit words are equal."""
    equal, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    live = np.flatnonzero(at < len(text))
    sign[at >= len(text)] = -1
    while len(live):
        if limit is not None:
            live = live[equal[live] < limit[live]]
        apart = np.sign(words[of[live] + equal[live]] - text[at[live] + equal[live]])
        sign[live] = apart
        live = live[apart == 0]
        equal[live] += 1
    return equal, sign


def searched(text: np.ndarray, order: np.ndarray, words: np.ndarray, of: np.ndarray, limit: np.ndarray | None = None, beyond: bool = False) -> np.ndarray:
    """For each place in the benchmark, how many suffixes of the text are before it; with a limit, before its first words, or (beyond) before what doesn't begin with them."""
    low, high = np.zeros(len(of), np.int64), np.full(len(of), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        _, sign = compared(text, order[middle], words, of[open_], None if limit is None else limit[open_])
        later = sign > 0 if not beyond else sign >= 0
        low[open_[later]] = middle[later] + 1
        high[open_[~later]] = middle[~later]
    return low


class Shard:
    """The words of some documents, and their suffix array."""

    def __init__(self, texts: list[list[bytes]], depth: int):
        self.numbers: dict[bytes, int] = {}
        flat, self.starts = [], np.zeros(len(texts), np.int64)
        number = self.numbers.setdefault
        for i, found in enumerate(texts):
            self.starts[i] = len(flat)
            flat += [number(w, len(self.numbers) + 1) for w in found]
            flat.append(0)
        self.text = np.array(flat, np.int64)
        self.sizes = np.diff(self.starts, append=len(flat)) - 1
        self.order = suffix_array(self.text, depth)

    def longest(self, block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's words by this shard's numbers, its suffixes from which a window starts, the words of each one's longest match, and where in the text that is."""
        known = np.array([self.numbers.get(w, UNKNOWN) for w in block.vocabulary] + [END], np.int64)
        words = known[np.where(block.words == END, len(known) - 1, block.words)]
        starting = np.maximum(block.sizes - window + 1, 1)
        suffixes = np.repeat(block.starts, starting) + np.arange(starting.sum()) - np.repeat(np.cumsum(starting) - starting, starting)
        place = searched(self.text, self.order, words, suffixes)
        best, where = np.zeros(len(suffixes), np.int64), np.zeros(len(suffixes), np.int64)
        for side in (place - 1, place):
            fine = (side >= 0) & (side < len(self.order))
            at = np.where(fine, self.order[np.clip(side, 0, max(len(self.order) - 1, 0))], len(self.text)) if len(self.order) else np.full(len(side), len(self.text))
            equal, _ = compared(self.text, at, words, suffixes)
            best, where = np.where(equal > best, equal, best), np.where(equal > best, at, where)
        return words, suffixes, best, where

    def hits(self, block: Block, window: int) -> tuple[np.ndarray, list[list]]:
        """Which places of the text are hit, and, by document, the numbers of the items with occurring windows."""
        words, suffixes, best, _ = self.longest(block, window)
        item = np.repeat(np.arange(len(block.sizes)), np.maximum(block.sizes - window + 1, 1))
        limit = np.minimum(block.sizes[item], window)
        found = np.flatnonzero(best >= limit)
        suffixes, item, limit = suffixes[found], item[found], limit[found]
        first = searched(self.text, self.order, words, suffixes, limit)
        past = searched(self.text, self.order, words, suffixes, limit, beyond=True)
        change, of_docs = np.zeros(len(self.text) + 1, np.int64), [set() for _ in self.starts]
        # equal windows have equal ranges, and are taken once for all items that have them
        ranges: dict[tuple, set] = {}
        for a, b, w, i in zip(first.tolist(), past.tolist(), limit.tolist(), item.tolist(), strict=True):
            ranges.setdefault((a, b, w), set()).add(i)
        for (a, b, w), items in ranges.items():
            at = self.order[a:b]
            np.add.at(change, at, 1)
            np.add.at(change, at + w, -1)
            for d in np.unique(np.searchsorted(self.starts, at, "right") - 1).tolist():
                of_docs[d] |= items
        return np.cumsum(change[:-1]) > 0, [sorted(x) for x in of_docs]


def shards(batches, depth: int, most: int):
    """Keys (the first column) and shard of so many words of the texts in the second."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            found = words_of(text.as_py())
            if texts and size + len(found) >= most:
                yield keys, Shard(texts, depth)
                keys, texts, size = [], [], 0
            keys.append(key.as_py())
            texts.append(found)
            size += len(found) + 1
    if texts:
        yield keys, Shard(texts, depth)


def searched_block(docs: DataFrame, block: Block, window: int, most: int) -> DataFrame:
    """row, doc_id, n_words, spans (array<long>: starts and ends of hit stretches of words), items (array<string>), hit: a block of the benchmark against all documents."""
    broadcast = docs.sparkSession.sparkContext.broadcast(block)
    depth = int(block.sizes.max(initial=1))

    def run(batches):
        here = broadcast.value
        for keys, shard in shards((pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["key", "text"]) for b in batches), depth, most):
            hit, items = shard.hits(here, window)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8)]), append=0))
            spans = []
            for start, size in zip(shard.starts, shard.sizes, strict=True):
                a, b = np.searchsorted(edges, [start, start + size + 1])
                spans.append(edges[a:b] - start)
            named = [[str(here.ids[i]) for i in x if here.ids[i] is not None] for x in items]
            columns = [pa.array([k["row"] for k in keys], pa.int64()), pa.array([k["doc_id"] for k in keys], pa.int64()), pa.array(shard.sizes, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_words", "spans", "items"])

    return docs.select(F.struct("row", "doc_id").alias("key"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "row long, doc_id long, n_words long, spans array<long>, items array<string>")


def united(spans):
    """Column: disjoint stretches of an array of (start, end)."""
    joined = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), joined)


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """row (a number of the document's row), doc_id, n_words, spans (array<struct<start, end>> of hit words, disjoint), items (array<string>, sorted)."""
    docs = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    pairs = F.transform(F.sequence(F.lit(0), F.expr("int(size(spans) div 2) - 1")), lambda i: F.struct(F.get("spans", (2 * i).cast("int")).alias("start"), F.get("spans", (2 * i + 1).cast("int")).alias("end")))
    pairs = F.when(F.size("spans") > 0, pairs).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    found = []
    blocks = blocks_of(benchmark, block)
    first = next(blocks, block_of([]))
    second = next(blocks, None)
    if second is not None:
        docs = stored(docs)  # so that a row's number is the same for all blocks
    for some in (first, *([second] if second is not None else ()), *blocks):
        one = searched_block(docs, some, window, shard).withColumns({"spans": pairs, "items": F.array_sort(F.array_distinct("items"))})
        found.append(stored(one) if second is not None else one)
    if second is None:
        return found[0]
    every = found[0]
    for one in found[1:]:
        every = every.union(one)
    merged = every.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"), united(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("row", "doc_id", "n_words", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no window of the benchmark occurs in, with all their columns."""
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*docs.columns).alias("__doc")))
    hit = search(numbered.select(F.col("__row").alias("doc_id"), "__doc.text"), benchmark, **options).where(F.size("spans") > 0)
    return numbered.join(hit.select(F.col("doc_id").alias("__row")), "__row", "left_anti").select("__doc.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """item_id, n_words and, of its longest verbatim match in the documents: words, doc_id, doc_at and item_at (numbers of words before it); of equally long ones it is one. Items without a common word have none."""
    found = None
    for some in blocks_of(benchmark, block):
        broadcast = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches, broadcast=broadcast):
            here = broadcast.value
            item = np.repeat(np.arange(len(here.sizes)), np.maximum(here.sizes - window + 1, 1))
            for keys, part in shards(batches, int(here.sizes.max(initial=1)), shard):
                _, suffixes, best, where = part.longest(here, window)
                top = np.lexsort((suffixes, -best, item))
                top = top[np.concatenate([[True], item[top][1:] != item[top][:-1]])]
                top = top[best[top] > 0]
                of = np.searchsorted(part.starts, where[top], "right") - 1
                columns = [[here.ids[i] for i in item[top]], here.sizes[item[top]], best[top], [keys[d] for d in of], where[top] - part.starts[of], suffixes[top] - here.starts[item[top]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "n_words", "words", "doc_id", "doc_at", "item_at"])

        names = "item_id long, n_words long, words long, doc_id long, doc_at long, item_at long"
        one = stored(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, names))
        found = one if found is None else found.union(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, n_words long, words long, doc_id long, doc_at long, item_at long")
    best = found.groupBy("item_id", "n_words").agg(F.min(F.struct((-F.col("words")).alias("m"), "doc_id", "doc_at", "item_at")).alias("b"))
    return best.select("item_id", "n_words", (-F.col("b.m")).alias("words"), "b.doc_id", "b.doc_at", "b.item_at")
