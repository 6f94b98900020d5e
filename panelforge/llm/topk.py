"""Exact top-k search by inner product, with pivot-table elimination.

Method: distances of every vector to many pivots are a table, computed once; for a query, the largest difference of its own
pivot distances to a candidate's is a lower bound of their distance, and so an upper bound of their inner
product, 2 * score = |q|^2 + |x|^2 - distance^2. A query starts from the k-th score that it has in a sample of the
candidates, below which nothing can be among its best; candidates are evaluated in the order of the bound until the
next bound is below that, or below the k-th score found since: nothing is lost. Queries and candidates meet in blocks, each two
of them in a place of their own; a block of candidates returns its best k for each query, and the best of those are ranked
at the end. Pivots are far apart from each other: each next one of the sample is the farthest from those before.

The sample (SAMPLE vectors, those with the smallest hashes of their ids) is bounded; it only gives pivots and first thresholds.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows
without an id; vectors of different length are never compared; a repeated row is one query, but a candidate as
often as it occurs, except to queries of its own id; scores beyond a long stop at its ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries of one block, pivots of the table, vectors of the sample.
CANDIDATES, QUERIES, PIVOTS, SAMPLE, SCALE = 8192, 512, 64, 4096, 1024.0
#: A score that every candidate reaches.
LEAST = -(2**63)


def usable(embeddings: DataFrame) -> DataFrame:
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False))).select("vec_id", x.cast("array<double>").alias("x"))


def far_apart(x: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of x, each the farthest from those before it, the first from the mean of all."""
    if not len(x):
        return x
    apart = lambda y: ((x - y) ** 2).sum(1)
    chosen = [int(apart(x.mean(0)).argmax())]
    nearest = apart(x[chosen[0]])
    while len(chosen) < min(pivots, len(x)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, apart(x[chosen[-1]]))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The table: a row for each vector."""
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def floors(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query among the sample."""
    out = np.full(len(q), LEAST, np.int64)
    for i in range(len(q)):
        s = exact_scores(q[i], sample[ids != q_ids[i]])
        if len(s) >= k:
            out[i] = np.partition(s, len(s) - k)[len(s) - k]
    return out


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles while every partial sum is an exact integer there."""
    most = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * q.shape[-1]
    if most < 2.0**53:
        return (x @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(q, row, strict=True)) for row in x]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in whole], dtype=np.int64)


def block_top(q_ids, q, floor, own, c_ids, c, table, k: int) -> tuple[list, list, list, int]:
    """Best k of the block for each query, as far as they reach its floor: query ids, candidate ids, scores; the number of evaluated candidates. own, table: distances to the pivots, of queries and candidates."""
    norms, q_norms = (c * c).sum(1), (q * q).sum(1)
    table = np.ascontiguousarray(table.T)
    out_q, out_c, out_s, evaluated = [], [], [], 0
    for i in range(len(q)):
        low, gap = np.zeros(len(c)), np.empty(len(c))
        for row, d in zip(table, own[i], strict=True):
            np.subtract(row, d, out=gap)
            np.maximum(low, np.abs(gap, out=gap), out=low)
        low = np.maximum(low * (1 - 1e-9) - 1e-3, 0)  # rounding of the distances never hides a candidate
        bound = (q_norms[i] + norms - low * low) / 2
        bound += np.abs(bound) * 1e-9 + 1
        possible = np.flatnonzero(bound >= float(floor[i]))
        order = possible[np.argsort(-bound[possible], kind="stable")]
        best_s, best_c, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 256
        while at < len(order) and (len(best_s) < k or bound[order[at]] >= best_s[-1]):
            part = order[at : at + step]
            at += step
            part = part[c_ids[part] != q_ids[i]]
            evaluated += len(part)
            s = exact_scores(q[i], c[part])
            fine = s >= floor[i]
            s, ids = np.concatenate([best_s, s[fine]]), np.concatenate([best_c, c_ids[part][fine]])
            first = np.lexsort((ids, -s.astype(object) if (s == LEAST).any() else -s))[:k]
            best_s, best_c = s[first], ids[first]
        out_q += [q_ids[i]] * len(best_s)
        out_c += best_c.tolist()
        out_s += best_s.tolist()
    return out_q, out_c, out_s, evaluated


def meetings(embeddings: DataFrame, k: int, every: int, candidates: int, queries: int, pivots: int, sample: int) -> DataFrame:
    """query_id, vec_id, score of each block's best, and on a row of their own, with a null query_id, how many candidates a meeting had (vec_id) and evaluated (score)."""
    rows = usable(embeddings).withColumn("dim", F.size("x"))
    spark = embeddings.sparkSession
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(sample).toPandas()
    for dim, part in few.groupby("dim"):
        x = np.floor(SCALE * np.stack(part["x"].to_numpy()).astype(float))
        known[int(dim)] = part["vec_id"].to_numpy(), x, far_apart(x, pivots)
    sent = spark.sparkContext.broadcast(known)  # sample vectors at most

    def pack(group: pd.DataFrame, asked: bool) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        ids, x, dim = group["vec_id"].to_numpy("<i8"), np.floor(SCALE * np.stack(group["x"].to_numpy()).astype(float)), int(group["dim"].iloc[0])
        sample_ids, sampled, chosen = sent.value.get(dim, (np.empty(0, np.int64), np.empty((0, dim)), np.empty((0, dim))))
        least = floors(ids, x, sample_ids, sampled, k) if asked else np.empty(0, np.int64)
        return pd.DataFrame({"dim": [dim], "block": [group["block"].iloc[0]], "ids": [ids.tobytes()], "x": [x.astype("<f8").tobytes()], "table": [distances(x, chosen).astype("<f8").tobytes()], "floor": [least.astype("<i8").tobytes()]})

    c_blocks, q_blocks = max(1, -(-counts["n"] // candidates)), max(1, -(-counts["q"] // queries))
    schema = "dim int, block int, ids binary, x binary, table binary, floor binary"
    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    packed = rows.withColumn("block", dealt(c_blocks, 1)).groupBy("dim", "block").applyInPandas(lambda g: pack(g, False), schema)
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "x"]).withColumn("block", dealt(q_blocks, 2)).groupBy("dim", "block").applyInPandas(lambda g: pack(g, True), schema)
    # each packed block of candidates meets every block of queries of its length: a query set against all rows, in blocks
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    places = min(2 * c_blocks * q_blocks, 20_000)
    left = packed.drop("floor").withColumn("q_block", numbers(q_blocks)).repartition(places, "dim", "block", "q_block")
    right = asked.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("table").alias("q_table"), "floor").withColumn("block", numbers(c_blocks)).repartition(places, "dim", "block", "q_block")
    met = left.hint("shuffle_hash").join(right, ["dim", "block", "q_block"])

    def search(frames):
        for frame in frames:
            for row in frame.itertuples():
                c_ids, q_ids, floor = (np.frombuffer(v, "<i8") for v in (row.ids, row.q_ids, row.floor))
                c, q = (np.frombuffer(v, "<f8").reshape(-1, row.dim) for v in (row.x, row.q_x))
                table, own = (np.frombuffer(v, "<f8").reshape(len(x), -1) for v, x in ((row.table, c), (row.q_table, q)))
                out_q, out_c, out_s, evaluated = block_top(q_ids, q, floor, own, c_ids, c, table, k)
                yield pd.DataFrame({"query_id": pd.array([*out_q, None], "Int64"), "vec_id": [*out_c, len(c) * len(q)], "score": [*out_s, evaluated]})

    return met.select("dim", "ids", "x", "table", "q_ids", "q_x", "q_table", "floor").mapInPandas(search, "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, candidates: int = CANDIDATES, queries: int = QUERIES, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score. Queries: the rows whose id is divisible by every."""
    found = meetings(embeddings, k, every, candidates, queries, pivots, sample).where("query_id is not null")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def evaluated_share(embeddings: DataFrame, k: int = 10, every: int = 100, candidates: int = CANDIDATES, queries: int = QUERIES, pivots: int = PIVOTS, sample: int = SAMPLE) -> float:
    """The share of (query, candidate) that the bounds didn't eliminate."""
    row = meetings(embeddings, k, every, candidates, queries, pivots, sample).where("query_id is null").agg((F.sum("score") / F.sum("vec_id")).alias("share")).first()
    return row["share"] or 0.0
