"""Vector code compression: product codebooks of integers, learned and applied exactly.

Method: vectors become integers, floor(scale * x), and are cut into equal consecutive parts; each part position has a codebook
of a few entries. The codebooks are broadcast (parts x entries x width integers, whatever the table's size). Arrow batches
compute all distances of their parts by |x|^2 - 2 x.c + |c|^2 with exact int64 matrix products and take the first smallest;
each task sums the parts of every entry and sends these sums on, a grouped shuffle merges them, and the new codebooks are
their componentwise floor(sum / count). Sums travel in digits of 30 bits, so that no sum of any number of rows overflows;
components too large for int64 products are handled as whole numbers of any size by the same steps.

Defined results: rows whose vector is null or holds null or non-finite components are left out; shorter vectors count as if
filled up with zeros to the longest length, and to equal parts; the codebooks start from the smallest distinct ids, a null id
being the last, and of an id's repeated vectors from the smallest one; fewer ids give fewer entries; repeated rows are
rows of their own; errors beyond a long stop at its end; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import attach, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a digit of a sum; components of a slice of rows.
DIGIT, SLICE = 30, 1 << 18
LONG = 2**63 - 1


@dataclass(frozen=True)
class Codebooks:
    """entries[part][entry] are the integer components of an entry."""

    entries: list[list[list[int]]]
    scale: int

    @property
    def width(self) -> int:
        return len(self.entries[0][0]) if self.entries[0] else 0

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def array(self) -> np.ndarray:
        """Parts x entries x width: int64, or objects if a component is larger."""
        shape = len(self.entries), len(self.entries[0]), self.width
        flat = [x for part in self.entries for entry in part for x in entry]
        return np.array(flat, dtype=np.int64 if all(-LONG <= x <= LONG for x in flat) else object).reshape(shape)


def usable(embeddings: DataFrame) -> DataFrame:
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(x.isNotNull() & F.coalesce(fine, F.lit(False)))


def integers(column: pa.Array, parts: int, width: int, scale: int) -> np.ndarray:
    """Rows x parts x width of floor(scale * x); missing components are 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if np.abs(flat).max(initial=0.0) * scale < 2.0**52:
        whole = np.floor(flat * scale).astype(np.int64)
    else:
        whole = np.array([Fraction(v) * scale // 1 for v in flat.tolist()], dtype=object)
    out = np.zeros((len(sizes), parts * width), whole.dtype)
    if len(sizes) and (sizes == parts * width).all():
        out[:] = whole.reshape(out.shape)
    else:
        ends = np.cumsum(sizes)
        for i, (end, size) in enumerate(zip(ends, sizes, strict=True)):
            out[i, :size] = whole[end - size : end]
    return out.reshape(len(sizes), parts, width)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each part, and its squared distance."""
    most = max((int(abs(y).max()) if y.size else 0) for y in (x, books))
    if x.dtype != object and (books.dtype == object or 4 * books.shape[0] * max(books.shape[2], 1) * most * most > LONG):
        x = x.astype(object)
    if x.dtype == object:
        books = books.astype(object)
    by_part = x.transpose(1, 0, 2)
    apart = (by_part * by_part).sum(2)[:, :, None] - 2 * (by_part @ books.transpose(0, 2, 1)) + (books * books).sum(2)[:, None, :]
    codes = apart.argmin(2) if apart.dtype != object else np.array([[min(range(len(y)), key=y.__getitem__) for y in z] for z in apart.tolist()], dtype=np.int64).reshape(apart.shape[:2])
    return codes.T, np.take_along_axis(apart, codes[:, :, None], 2)[:, :, 0].T


def pieces(batches, parts: int, width: int):
    """Slices of a bounded number of components."""
    rows = max(1, SLICE // max(parts * width, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def digits(value: int):
    """value = the sum of digit << (DIGIT * place); the last digit has the sign."""
    place = 0
    while not -(1 << DIGIT) < value < (1 << DIGIT):
        yield place, value & ((1 << DIGIT) - 1)
        value, place = value >> DIGIT, place + 1
    if value:
        yield place, value


def sums_of(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, position (-1: the count), place, value: the sums of each entry's parts, in digits."""
    broadcast = vectors.sparkSession.sparkContext.broadcast(books.array())
    parts, width, scale = len(books.entries), books.width, books.scale

    def run(batches):
        entries = broadcast.value
        total = np.zeros((parts, entries.shape[1], width), object)
        counts = np.zeros((parts, entries.shape[1]), np.int64)
        for batch in pieces(batches, parts, width):
            x = integers(batch.column(0), parts, width, scale)
            codes, _ = nearest(x, entries)
            for p in range(parts):
                chosen = (codes[:, p, None] == np.arange(entries.shape[1])).astype(np.int64)
                counts[p] += chosen.sum(0)
                total[p] += chosen.T.astype(x.dtype) @ x[:, p]
        rows = [(p, e, i, place, digit) for (p, e, i), value in np.ndenumerate(total) for place, digit in digits(int(value))]
        rows += [(p, e, -1, 0, int(n)) for (p, e), n in np.ndenumerate(counts) if n]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "entry", "position", "place", "value"])

    found = vectors.select("embedding").mapInArrow(run, "part int, entry int, position int, place int, value long")
    return found.groupBy("part", "entry", "position", "place").agg(F.sum("value").alias("value"))


def moved(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Each used entry becomes the componentwise floor of its mean; what comes to the driver is of the codebooks' size."""
    total: dict[tuple[int, int, int], int] = {}
    for r in sums.collect():
        key = r["part"], r["entry"], r["position"]
        total[key] = total.get(key, 0) + (r["value"] << (DIGIT * r["place"]))
    entries = [[[total.get((p, e, i), 0) // total[p, e, -1] for i in range(books.width)] if (p, e, -1) in total else entry for e, entry in enumerate(part)] for p, part in enumerate(books.entries)]
    return Codebooks(entries, books.scale)


def first_books(vectors: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """Codebooks of the smallest distinct ids; only these few vectors come to the driver."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts)
    ids = vectors.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    chosen = vectors.join(F.broadcast(ids.withColumnRenamed("vec_id", "__id")), F.col("vec_id").eqNullSafe(F.col("__id")), "left_semi")
    rows = chosen.groupBy("vec_id").agg(F.min("embedding").alias("x")).orderBy(F.col("vec_id").asc_nulls_last()).collect()
    whole = integers(pa.array([r["x"] for r in rows], pa.list_(pa.float64())), parts, width, scale)
    return Codebooks([[[int(v) for v in x[p]] for x in whole] for p in range(parts)], scale)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of usable vectors (vec_id, embedding)."""
    books = first_books(vectors, parts, entries, scale)
    for _ in range(rounds if books.entries[0] else 0):
        books = moved(books, sums_of(vectors, books))
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (the squared distances of the parts, summed)."""
    broadcast = vectors.sparkSession.sparkContext.broadcast(books.array())
    parts, width, scale = len(books.entries), books.width, books.scale

    def run(batches):
        for batch in pieces(batches, parts, width):
            codes, apart = nearest(integers(batch.column(2), parts, width, scale), broadcast.value)
            written = [bytes(row).hex() for row in codes.astype(np.uint8)]
            errors = [min(int(e), LONG) for e in apart.sum(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(written, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {label}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, into: str = "embedding") -> DataFrame:
    """The vectors that codes stand for, in a column of that name; a null code gives null."""
    flat = F.lit([[[float(Fraction(x, books.scale)) for x in entry] for entry in part] for part in books.entries])
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn(into, F.concat(*[F.get(F.get(flat, p), at(p)) for p in range(len(books.entries))]))


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error (the errors of equal labels summed), codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits stands for at most 256 entries")
    vectors = stored(usable(embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))))
    books = fit(vectors, parts, entries, rounds, scale)
    coded = stored(encode(vectors, books))
    of_label = coded.groupBy("label").agg(F.count("*").alias("n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error"))
    return attach(coded, of_label, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
