"""n-gram language-model scoring with Elias-Fano tries.

Method: a trie of order 3. Words of a shard are its first level, a rising sequence of hashes; the successors of each word are
a range of the second, in which a successor is kept relative to its context (place of the context * 2**32 + hash), so that
the level rises too; the successors of each pair are a range of the third, kept relative to the pair's place in the second;
monotone pointers give the ranges. All are Elias-Fano coded in a memory-mapped file, beside one byte for the quantised
probability of every successor and one for the quantised back-off weight of every context; a search starts from the range of
its context. Smoothing is Witten-Bell's interpolation with add-one unigrams: P(w|uv) = (c(uvw) + T(uv) * P(w|v)) /
(c(uv) + T(uv)), likewise P(w|v) from P(w) = (c(w) + 1) / (N + V + 1), where T is the number of different successors; an
unknown context gives the probability of the shorter one. A text's first word has the start as its only context.

The model never is in one place. Documents fall into chunks and words into shards, by hashes. A chunk sends each
shard its distinct words, the pairs and the triples that begin with them, once, with their counts in training documents, as
one packed row; the shard sums the counts of all chunks, builds its trie and answers each chunk by one packed row; the chunk
then adds up its documents' scores. What is exchanged grows with the distinct triples of chunks; nothing goes to the driver.
Chunks hold about CHUNK bytes of text, but there are at least as many as the session's shuffles have partitions and at most
MOST, as the packed rows are chunks * shards; shards are as many. All triples of a word are in one shard.

Defined results: null and empty texts are the end alone; a null id is never held out; repeated rows count as often;
with no training text every count is 0 and P(w) = 1; extra columns are ignored. Words are equal if their 64-bit hashes are, and
successors of one context if 32 bits of theirs are: of a context with n of them, n / 2**32 share another's count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.eliasfano import EliasFano, Levels

START, END = np.uint64(1), np.uint64(2)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CODES = 255
#: Bytes of text of a chunk, and the most chunks.
CHUNK, MOST = 8 << 20, 4096


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, and the end."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    found = np.empty(len(words) + 1, np.uint64)
    found[:-1] = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    found[-1] = END
    return found


class Chunk:
    """The distinct words, pairs and triples of some documents, in an order that doesn't depend on theirs: by shard, word, successors."""

    def __init__(self, texts: list, training: np.ndarray, shards: int):
        each = [word_hashes(x) for x in texts]
        self.sizes = np.array([len(x) for x in each])
        tokens = np.concatenate(each)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        before[self.starts] = START
        words = np.unique(np.append(tokens, START))
        words = words[np.argsort(words % np.uint64(shards), kind="stable")]
        rank = np.argsort(words)
        where = lambda x: rank[np.searchsorted(words, x, sorter=rank)]
        self.words, self.token, self.of_token = words, where(tokens), where(before)
        learn = np.repeat(training, self.sizes)
        self.counts = np.bincount(self.token[learn], minlength=len(words)).astype(np.uint32)
        self.counts[where(np.array([START]))] = training.sum()
        tail = (words >> np.uint64(32)).astype(np.int64)[self.token]
        self.pairs = Successors(self.of_token, tail, learn)
        self.inner = np.ones(len(tokens), bool)
        self.inner[self.starts] = False
        # the context of a token that isn't its text's first is the pair that ends before it
        self.pair_before = np.roll(self.pairs.of_token, 1)[self.inner]
        self.triples = Successors(self.pair_before, tail[self.inner], learn[self.inner])
        edge = np.searchsorted(words % np.uint64(shards), np.arange(shards + 1).astype(np.uint64))
        self.edges = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))

    def requests(self):
        """The packed request to each shard."""
        for low, high in self.edges:
            n, first, last, *pairs = self.pairs.of(low, high)
            m, _, _, *triples = self.triples.of(first, last)
            yield pack(self.words[low:high], self.counts[low:high], n, *pairs, m, *triples)


class Successors:
    """Distinct (context, tail), by context, with the number of tokens to learn from, and which one each token is."""

    def __init__(self, context: np.ndarray, tail: np.ndarray, learn: np.ndarray):
        keys, self.of_token = np.unique((context.astype(np.int64) << 32) | tail, return_inverse=True)
        self.tails, self.contexts = (keys & 0xFFFFFFFF).astype(np.uint32), keys >> 32
        self.counts = np.bincount(self.of_token[learn], minlength=len(keys)).astype(np.uint32)

    def of(self, low: int, high: int):
        """Of the contexts from low to high: how many each has, where they lie, tails and counts."""
        first, last = np.searchsorted(self.contexts, [low, high]).tolist()
        n = np.bincount(self.contexts[first:last] - low, minlength=high - low).astype(np.uint32)
        return n, first, last, self.tails[first:last], self.counts[first:last]


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], "<i8")
    return zstandard.compress(head.tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for (item, length), kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, length, at))
        at += item * length
    return out


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes from 1 and the code book: equal steps of the logarithm, so that no value is off by more than half a step."""
    book = np.zeros(CODES + 1, np.float32)
    if not len(values):
        return np.empty(0, np.uint8), book
    logs = np.log10(values)
    bounds = np.linspace(logs.min(), logs.max(), CODES + 1)[1:-1]
    codes = np.searchsorted(bounds, logs, "left").astype(np.int64)
    n = np.bincount(codes, minlength=CODES)
    mean = np.bincount(codes, logs, minlength=CODES) / np.maximum(n, 1)
    book[1:] = np.where(n > 0, 10.0**mean, 0)
    return (codes + 1).astype(np.uint8), book


class Level:
    """Successors of contexts: keys (place of the context * 2**32 + hash), pointers, and codes of probabilities and of the contexts' back-off weights."""

    def __init__(self, totals: np.ndarray, keys: np.ndarray, counts: np.ndarray, levels: Levels):
        contexts = (keys >> np.uint64(32)).astype(np.int64)
        n = np.bincount(contexts, minlength=len(totals))
        weights = np.where(totals > 0, n / np.maximum(totals + n, 1), 1.0)
        back_codes, self.back_book = quantised(np.maximum(weights, 1e-12))
        codes, self.book = quantised(counts / (totals[contexts] + n[contexts])) if len(contexts) else quantised(np.empty(0))
        self.back_book[0] = 1.0  # of a context that isn't known
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(n)]), len(contexts) + 1, levels)
        self.keys = EliasFano(keys, (len(totals) + 1) << 32, levels)
        self.places = levels.add(back_codes.tobytes()), levels.add(codes.tobytes())

    def open(self, mapped) -> None:
        self.pointers.open(mapped)
        self.keys.open(mapped)
        self.back_codes, self.codes = (np.frombuffer(mapped, np.uint8, size, at) for at, size in self.places)

    def find(self, rank: np.ndarray, n: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of successors, n of each context (-1: it or its context isn't known), and their codes (0)."""
        context, known = np.repeat(rank, n), np.repeat(rank >= 0, n)
        asked = np.flatnonzero(known)
        low, high = self.pointers.value(np.maximum(rank, 0)), self.pointers.value(np.maximum(rank, 0) + 1)
        place, equal = self.keys.successors((context[asked].astype(np.uint64) << np.uint64(32)) | tails[asked].astype(np.uint64))
        equal &= (place >= np.repeat(low, n)[asked]) & (place < np.repeat(high, n)[asked])
        places, codes = np.full(len(tails), -1, np.int64), np.zeros(len(tails), np.uint8)
        places[asked[equal]] = place[equal]
        codes[asked[equal]] = self.codes[place[equal]]
        return places, codes

    def back(self, rank: np.ndarray) -> np.ndarray:
        return np.where(rank >= 0, self.back_codes[np.maximum(rank, 0)], 0).astype(np.uint8) if len(self.back_codes) else np.zeros(len(rank), np.uint8)


class Trie:
    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray):
        """words, pairs (rank of the word * 2**32 + hash) and triples (place of the pair * 2**32 + hash) rise."""
        levels = Levels()
        self.words = EliasFano(words, 1 << 64, levels)
        self.second, self.third = Level(counts, pairs, pair_counts, levels), Level(pair_counts, triples, triple_counts, levels)
        mapped = levels.open()
        for level in (self.words, self.second, self.third):
            level.open(mapped)

    def find(self, words: np.ndarray, n: np.ndarray, tails: np.ndarray, m: np.ndarray, third_tails: np.ndarray):
        """Ranks of words; of their successors, n of each, the codes and the codes of back-off weights; codes of the successors of these, m of each."""
        rank, _ = self.words.successors(words)
        places, codes = self.second.find(rank, n, tails)
        _, third_codes = self.third.find(places, m, third_tails)
        return rank, codes, self.third.back(places), third_codes


def merged(contexts: list[np.ndarray], n: list[np.ndarray], tails: list[np.ndarray], counts: list[np.ndarray]):
    """Rising keys of all parts' successors, their summed counts, and where each part's are."""
    keys, at = np.unique((np.repeat(np.concatenate(contexts), np.concatenate(n)).astype(np.uint64) << np.uint64(32)) | np.concatenate(tails), return_inverse=True)
    sums = np.bincount(at, np.concatenate(counts), minlength=len(keys)).astype(np.int64)
    return keys, sums, np.split(at, np.cumsum([len(x) for x in tails])[:-1])


def answers(requests: list[bytes]) -> list[bytes]:
    """A shard's answers to all chunks."""
    parts = [unpack(x, "<u8", *["<u4"] * 7) for x in requests]
    words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]), minlength=len(words)).astype(np.int64)
    pairs, pair_counts, at = merged(np.split(inverse, np.cumsum([len(p[0]) for p in parts])[:-1]), *([p[i] for p in parts] for i in (2, 3, 4)))
    known = np.cumsum(pair_counts > 0) - 1  # a triple to learn from has a pair to learn from
    triples, triple_counts, _ = merged([known[x] for x in at], *([p[i] for p in parts] for i in (5, 6, 7)))
    seen, third = pair_counts > 0, triple_counts > 0
    trie = Trie(words, counts, pairs[seen], pair_counts[seen], triples[third], triple_counts[third])
    del pairs, triples, at
    tokens = words != START
    totals = np.array([counts[tokens].sum(), (counts[tokens] > 0).sum()], "<i8")
    out = []
    for p in parts:
        rank, codes, back, third_codes = trie.find(p[0], p[2], p[3], p[5], p[6])
        out.append(pack(totals, counts[rank], trie.second.back_codes[rank], codes, back, third_codes, trie.second.book, trie.second.back_book, trie.third.book, trie.third.back_book))
    return out


def scores(chunk: Chunk, replies: dict[int, bytes]) -> dict[str, np.ndarray]:
    total, kinds, columns = 0, 0, []
    for shard in range(len(chunk.edges)):
        totals, c, back, codes, pair_back, third_codes, *books = unpack(replies[shard], "<i8", "<i8", *["u1"] * 4, *["<f4"] * 4)
        total, kinds = total + int(totals[0]), kinds + int(totals[1])
        columns.append((c, books[1][back], books[0][codes], books[3][pair_back], books[2][third_codes]))
    counts, back, seen, pair_back, third_seen = map(np.concatenate, zip(*columns, strict=True))
    single = (counts + 1) / (total + kinds + 1)
    words = single[chunk.token]
    whole = seen[chunk.pairs.of_token].astype(float) + back[chunk.of_token].astype(float) * words
    whole[chunk.inner] = third_seen[chunk.triples.of_token].astype(float) + pair_back[chunk.pair_before].astype(float) * whole[chunk.inner]
    add = lambda x: np.add.reduceat(x, chunk.starts)
    return {"n_tokens": chunk.sizes, "n_known": add((counts[chunk.token] > 0).astype(np.int64)), "train_tokens": np.full(len(chunk.sizes), total), "base_score": add(np.log10(words)), "score": add(np.log10(np.minimum(whole, 1.0)))}


def score(docs: DataFrame, training: Column, parts: int | None = None) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    training: whether the model learns from a row. parts: chunks, and shards.
    """
    if not parts:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = min(MOST, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // CHUNK)))
    rows = docs.select("doc_id", F.coalesce(training, F.lit(False)).alias("training"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("chunk"))

    def ask(table: pa.Table) -> pa.Table:
        chunk = Chunk(table["text"].to_pylist(), table["training"].to_numpy(), parts)
        of = pa.array([table["chunk"][0].as_py()] * parts, pa.int32())
        return pa.table([of, pa.array(range(parts), pa.int32()), pa.array(chunk.requests(), pa.binary())], ["chunk", "shard", "request"])

    def reply(table: pa.Table) -> pa.Table:
        return pa.table([table["chunk"], table["shard"], pa.array(answers(table["request"].to_pylist()), pa.binary())], ["of_chunk", "shard", "answer"])

    def settle(table: pa.Table, replies: pa.Table) -> pa.Table:
        given = dict(zip(replies["shard"].to_pylist(), replies["answer"].to_pylist(), strict=True))
        found = scores(Chunk(table["text"].to_pylist(), table["training"].to_numpy(), parts), given)
        columns = [table["doc_id"], table["training"], *(pa.array(found[c]) for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))]
        return pa.table(columns, ["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = rows.groupBy("chunk").applyInArrow(ask, "chunk int, shard int, request binary")
    answered = asked.groupBy("shard").applyInArrow(reply, "of_chunk int, shard int, answer binary")
    schema = "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(answered.groupBy("of_chunk")).applyInArrow(settle, schema)
