"""Near-duplicate vectors by spherical k-means cells.

Method: spherical k-means, fitted on a bounded sample of the distinct vectors, deals every distinct vector to its
nearest cell (its home), once: vectors are not copied. The vectors of a few cells are packed into blocks, one row each, that
know which others their vectors may be linked with, and blocks are joined without an exchange: tasks read the blocks of two
files, and of two cells they compare the vectors that may be linked with the other's. That leaves out no
link of any data (the bound is a plane's distance, see may_link()). Given deviations, a vector only meets the cells whose
centroid's cosine is below its home's by at most that many deviations of the cosine between linked vectors that differ in a
random direction: fewer comparisons, but links that differ in other directions get lost. No query does so.

Every pair of vectors is compared once, first by a product of few dimensions that is never below the cosine (see lead()), in
single precision with slack; what it leaves is decided by the cosine in double precision. A task returns a row for each vector
with links: their number and the smallest id of those that its links join it with, not pairs. Equal vectors are collapsed first and counted.

The rows that are written or exchanged grow with the input: each vector, and a row for each linked vector and file of blocks that
has links of it. The comparisons that the bound on cells leaves grow with the square of the vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and
are kept as their own components, as are rows with a null id; vectors of different length never link; repeated
ids are separate vectors for n_links and one for components; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import stored
from panelforge.llm.graph import components

THRESHOLD = 0.95
#: Vectors that the centroids are fitted on at most; vectors of a cell aimed at; rows of a block; deviations that find most links.
SAMPLE, CELL, BLOCK, DEVIATIONS = 20_000, 1024, 16384, 2.5
#: Vectors of the sample for each centroid at least: so many cells at most, of more than CELL vectors where there are very many. Vectors that are placed at a time.
EACH, ROWS = 16, 512
#: Dimensions of the first product; more than its error in single precision; the share of pairs that it leaves from which a whole product is faster.
LEAD, SLACK, MANY = 16, 1e-5, 1 / 32
#: Links of a strip that are kept as they are; links that a task keeps before it joins them.
FEW, LINKS = 4096, 1 << 20


def usable(vec_id: Column, x: Column) -> Column:
    """Whether a row takes part; never null."""
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vec_id.isNotNull() & F.coalesce(fine, F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


#: Numbers of cells for each length of vectors.
CELLS = 1 << 24


def short(x: np.ndarray) -> bytes:
    """Components, in 4 bytes each where these hold them all exactly."""
    with np.errstate(over="ignore"):
        single = x.astype("<f4")
    return single.tobytes() if (single == x).all() else x.astype("<f8").tobytes()


def opened(packed: bytes, count: int, dim: int) -> np.ndarray:
    """The vectors of which short() made packed."""
    return np.frombuffer(packed, "<f4" if len(packed) == 4 * count * dim else "<f8").reshape(count, dim).astype(float)


def fit(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means, started from evenly spaced rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(sample[at : at + 2048] @ centres.T).argmax(1) for at in range(0, len(sample), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def runs(sorted_values: np.ndarray):
    """Of a sorted array each value with the places where it starts and ends."""
    values, at = np.unique(sorted_values, return_index=True)
    return zip(values.tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_values)], strict=True)


def may_link(x: np.ndarray, home: np.ndarray, cells: np.ndarray, threshold: float, deviations: float | None) -> np.ndarray:
    """A table of the cells with whose vectors those of x, of the cell of home, must be compared.

    A vector z of cell c within angle t of y has z.(c - h) >= 0, where h is y's home; as z = y cos t + u sin t with
    u orthogonal to y, y.(h - c) <= tan t * |the part of c - h that is orthogonal to y|.
    """
    gap = x @ (home - cells).T
    if deviations is not None:  # of a difference sqrt(1 - t^2) long, against two centroids about at right angles
        return gap <= deviations * np.sqrt((1 - threshold**2) * 2 / x.shape[1])
    across = np.maximum(((home - cells) ** 2).sum(1) - gap**2, 0)
    return gap <= np.sqrt(max(0.0, 1 - threshold**2)) / threshold * np.sqrt(across) + 1e-9


def axes(sample: np.ndarray, rounds: int = 6) -> np.ndarray:
    """At most LEAD orthonormal directions, as columns, about those in which the sample is longest."""
    found = np.linalg.qr(np.random.default_rng(0).normal(size=(sample.shape[1], min(LEAD, sample.shape[1]))))[0]
    for _ in range(rounds):
        found = np.linalg.qr(sample.T @ (sample @ found))[0]
    return found


def lead(x: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Vectors whose products are not below those of the unit vectors x: their parts along the axes, and the length of the rest."""
    part = x @ along
    rest = np.sqrt(np.maximum(1 - (part * part).sum(1, keepdims=True), 0))
    return np.hstack([part, rest]).astype("<f4")


def linked_pairs(x: np.ndarray, x_lead: np.ndarray, rows: np.ndarray, y: np.ndarray, y_lead: np.ndarray, others: np.ndarray, threshold: float):
    """Of the given rows of x and others of y those whose cosine is at least the threshold, a strip of rows after another."""
    other_lead = y_lead[others].T
    for strip in (rows[at : at + ROWS] for at in range(0, len(rows), ROWS)):
        left = np.flatnonzero(x_lead[strip] @ other_lead >= np.float32(threshold - SLACK))
        if len(left) > MANY * len(strip) * len(others):
            r, s = np.nonzero(x[strip] @ y[others].T >= threshold)
            r, s = strip[r], others[s]
        else:
            r, s = np.divmod(left, max(1, len(others)))
            r, s = strip[r], others[s]
            fine = np.einsum("ij,ij->i", x[r], y[s]) >= threshold
            r, s = r[fine], s[fine]
        yield r, s


def joined(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of count rows the first of those that the links (a, b) join it with."""
    of = np.arange(count)
    while len(a):
        low, high = np.minimum(of[a], of[b]), np.maximum(of[a], of[b])
        apart = low < high
        np.minimum.at(of, high[apart], low[apart])
        while ((up := of[of]) != of).any():
            of = up
        a, b = a[apart], b[apart]
    return of


class Found:
    """The links that a task finds between rows of blocks: how many each row has, and what they join."""

    def __init__(self):
        self.place, self.count, self.waiting = {}, 0, 0
        self.ids, self.linked, self.ends = [np.empty((3, 0), np.int64)], [np.empty(0, np.int64)], []

    def block(self, key: tuple[int, int], ids: np.ndarray) -> None:
        """Makes a block known: the v, first and n of its rows."""
        if key not in self.place:
            self.place[key] = len(self.ids), self.count
            self.ids.append(ids)
            self.linked.append(np.zeros(ids.shape[1], np.int64))
            self.count += ids.shape[1]

    def add(self, one: tuple[int, int], r: np.ndarray, two: tuple[int, int], s: np.ndarray) -> None:
        """Links of the rows r of one block with the rows s of another."""
        (i, at), (j, at_) = self.place[one], self.place[two]
        np.add.at(self.linked[i], r, self.ids[j][2][s])
        np.add.at(self.linked[j], s, self.ids[i][2][r])
        a, b, size = at + r, at_ + s, len(self.linked[i])
        if len(r) > FEW:
            of = joined(size + len(self.linked[j]), r, size + s)
            apart = np.flatnonzero(of != np.arange(len(of)))
            a, b = (np.where(e < size, at + e, at_ + e - size) for e in (apart, of[apart]))
        self.ends.append((a, b))
        self.waiting += len(a)
        if self.waiting > LINKS + self.count:
            self.join()

    def join(self) -> np.ndarray:
        of = joined(self.count, *(np.concatenate([e[k] for e in self.ends] or [np.empty(0, np.int64)]) for k in (0, 1)))
        apart = np.flatnonzero(of != np.arange(self.count))
        self.ends, self.waiting = [(apart, of[apart])], 0
        return of

    def table(self) -> pd.DataFrame:
        """Of each row with links their number, its first id and the least of those that it is joined with."""
        of, (v, first, _), linked = self.join(), np.concatenate(self.ids, axis=1), np.concatenate(self.linked)
        least = np.full(self.count, np.iinfo(np.int64).max)
        np.minimum.at(least, of, first)
        return pd.DataFrame({"v": v, "linked": linked, "a": first, "b": least[of]})[linked > 0]


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, deviations: float | None = None, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding)."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    takes_part = usable(F.col("vec_id"), F.col("embedding"))
    keyed = rows.where(takes_part).select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn("v", F.xxhash64("x"))
    distinct = stored(keyed.groupBy("v", "x").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")))
    fitted: dict[int, tuple[np.ndarray, np.ndarray, int, np.ndarray]] = {}
    for dim, count in distinct.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect():
        of_dim = distinct.where(F.size("x") == dim)
        few = of_dim if count <= sample else of_dim.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(1_000_000 * sample / count))
        some = unit(np.stack([r[0] for r in few.select("x").orderBy("v").limit(sample).collect()] or [np.ones(dim)]).astype(float))
        cells = min(max(1, len(some) // EACH), max(1, round(count / cell)))
        centres, together = fit(some, cells), max(1, block * cells // count // 2)  # so many cells to a block fill half of it
        held = np.bincount((some @ centres.T).argmax(1) // together, minlength=(cells - 1) // together + 1) + 1
        fitted[dim] = centres, axes(some), together, np.ceil(held * (count / len(some) / block)).astype(int)  # and so many blocks hold them
    sent = spark.sparkContext.broadcast(fitted)  # at most sample / EACH vectors, and LEAD

    def deal(frames):
        for frame in frames:
            for dim, part in ((dim, rows[at : at + ROWS]) for dim, rows in frame.groupby(frame["x"].map(len)) for at in range(0, len(rows), ROWS)):
                given = np.stack(part["x"].to_numpy()).astype(float)
                centres, _, together, parts = sent.value[dim]
                home = (unit(given) @ centres.T).argmax(1)
                place = home // together
                yield pd.DataFrame({"place": dim * CELLS + place, "part": part["v"].to_numpy() % parts[place], "home": home, "v": part["v"], "first": part["first"], "n": part["n"], "x": [short(r) for r in given]})

    def pack(key, group):
        group = group.sort_values("home", kind="stable")
        dim, home = int(key[0]) // CELLS, group["home"].to_numpy()
        given, (centres, _, together, _) = np.concatenate([opened(r, 1, dim) for r in group["x"]]), sent.value[dim]
        met = np.zeros(len(centres), bool)
        for h, at, end in runs(home):
            for strip in (given[k : min(k + ROWS, end)] for k in range(at, end, ROWS)):
                met |= may_link(unit(strip), centres[h], centres, threshold, deviations).any(0)
        keys = group[["v", "first", "n", "home"]].to_numpy("<i8").T.tobytes()
        return pd.DataFrame({"place": [key[0]], "part": [key[1]], "met": [np.unique(dim * CELLS + np.flatnonzero(met) // together)], "keys": [keys], "x": [short(given)]})

    dealt = distinct.mapInPandas(deal, "place long, part long, home long, v long, first long, n long, x binary")
    packed = dealt.groupBy("place", "part").applyInPandas(pack, "place long, part long, met array<long>, keys binary, x binary")
    # rows of some MB: small row groups, as a reader opens one as a whole
    blocks = stored(packed, **{"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1})

    def compare(frames):
        found, last = Found(), (None, None)

        def read_block(key, keys, packed):
            ids, (centres, along, _, _) = np.frombuffer(keys, "<i8").reshape(4, -1), sent.value[key[0] // CELLS]
            found.block(key, ids[:3])
            x = unit(opened(packed, ids.shape[1], len(along)))
            return centres, list(runs(ids[3])), x, lead(x, along)

        for frame in frames:
            for row in frame.itertuples():
                one, two = (row.place, row.part), (row.place_, row.part_)
                if last[0] != one:  # it meets many in turn
                    last = one, read_block(one, row.keys, row.x)
                centres, mine, x, x_lead = last[1]
                _, others, y, y_lead = last[1] if one == two else read_block(two, row.keys_, row.x_)
                goes, comes = ([may_link(z[at:end], centres[h], centres[[o for o, _, _ in far]], threshold, deviations) for h, at, end in near] for z, near, far in ((x, mine, others), (y, others, mine)))
                for (i, (h, at, end)), (j, (h_, at_, end_)) in itertools.product(enumerate(mine), enumerate(others)):
                    if one == two and h > h_:
                        continue
                    rows_x, rows_y, go, come = np.arange(at, end), np.arange(at_, end_), goes[i][:, j], comes[j][:, i]
                    if h == h_:
                        meetings = [(rows_x, rows_y)]
                    else:
                        meetings = [(rows_x[go], rows_y[come])] if deviations is None else [(rows_x[go], rows_y), (rows_x[~go], rows_y[come])]
                    for these, those in meetings:
                        for r, s in linked_pairs(x, x_lead, these, y, y_lead, those, threshold):
                            fresh = r < s if one == two and h == h_ else slice(None)
                            if len(r[fresh]):
                                found.add(one, r[fresh], two, s[fresh])
        yield found.table()

    # each pair of blocks once, and only where either has vectors that may be linked with the other's cells; no exchange: tasks read the blocks
    cols = ["place", "part", "keys", "x"]
    other = blocks.select(*[F.col(c).alias(f"{c}_") for c in blocks.columns])
    once = (F.col("place") < F.col("place_")) | ((F.col("place") == F.col("place_")) & (F.col("part") <= F.col("part_")))
    goes, comes = F.array_contains("met", F.col("place_")), F.array_contains("met_", F.col("place"))
    pairs = blocks.join(other.hint("shuffle_replicate_nl"), once & (goes & comes if deviations is None else goes | comes))
    met = stored(pairs.select(*cols, *[f"{c}_" for c in cols]).mapInPandas(compare, "v long, linked long, a long, b long"))
    counts = met.where("linked > 0").groupBy("v").agg(F.sum("linked").alias("linked"))
    known = components(met.where("a <> b").select("a", "b"))
    per_vector = distinct.select("v", "n", "first").join(counts, "v", "left").join(known.withColumnRenamed("node", "first"), "first", "left")
    per_vector = per_vector.select("v", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    found = keyed.select("vec_id", "v").join(per_vector, "v").select("vec_id", "n_links", "component_id")
    rest = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
