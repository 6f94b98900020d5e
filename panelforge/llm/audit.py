"""Divergence of sources: how unlike the groups (lang, source) of a corpus are in their use of terms.

Method: Spark counts the terms of every group (a task's Python counts its own texts first, within a bound), keeps the terms
of enough documents of their lang, and deals each lang's kept terms into vocabulary chunks, in which a term has a place. The
counts of a block of groups in a chunk are one packed vector: longs of count, group and place. Each packed vector is sent to
the tiles of its block with every other block of its lang; a tile takes successive chunks of a stretch of the vocabulary, and
adds up the submatrix of its pairs, both ways. The submatrices of all stretches are summed by (lang, group, group). So a task
holds the dense vectors of two blocks in one chunk, whatever the vocabulary and the number of groups are.

All arithmetic is that of whole numbers: p = 1 + floor(UNIT * (count + 1) / (N + V)), f = floor((p - q)^2 / q); products that
could pass a long are decimals in SQL and whole numbers of any size in Python.

Defined results: a null text, lang or source is ''; texts without terms make their group exist; a lang without kept terms
has pairs of value 0; repeated rows count each; equal values rank by UTF-8 bytes of the item; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import attach, cut, stored

UNIT, DOCUMENTS, RANKS = 1_000_000_000, 3, 200
#: Distinct (group, term) that a task counts before it sends them on.
MEMO = 400_000
#: Groups of a block, terms of a chunk on average, chunks of a stretch; bits of a place in a chunk and of a group in its block.
BLOCK, CHUNK, STRETCH, PLACE, OF_BLOCK = 32, 4096, 8, 13, 5
#: Bytes of a term: letters, those of A-Z lower-cased, and all beyond ASCII; others become blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame, memo: int = MEMO) -> DataFrame:
    """lang, source, term, c (occurrences), docs (documents with it); of a key there may be several rows."""

    def sent(found):
        rows = [(lang, source, term, c, of[1][term]) for (lang, source), of in found.items() for term, c in of[0].items()]
        for at in range(0, len(rows), 50_000):
            columns = list(zip(*rows[at : at + 50_000], strict=True))
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns[2] = [x.decode() for x in columns[2]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "source", "term", "c", "docs"])

    def run(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                terms = text.as_py().translate(LETTERS).split()
                counts, docs_with = found.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before = len(counts)
                counts.update(terms)
                docs_with.update(set(terms))
                held += len(counts) - before
                if held > memo:
                    yield from sent(found)
                    found, held = {}, 0
        yield from sent(found)

    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "lang string, source string, term string, c long, docs long")


def kept_terms(docs: DataFrame, least: int = DOCUMENTS, memo: int = MEMO) -> DataFrame:
    """lang, source, term, c, total (of the lang), first (on one row of each term of a lang): of terms in at least so many of their lang's documents."""
    # one exchange: a term's rows of a lang are together, for the sums by source and for those over sources
    summed = counted(docs, memo).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term").orderBy("source")
    over = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = summed.withColumns({"total": F.sum("c").over(over), "of": F.sum("docs").over(over), "first": F.row_number().over(own) == 1})
    return known.where(F.col("of") >= least).drop("of", "docs")


def groups_of(docs: DataFrame, kept: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """A row for each (lang, source): i (its number), block, of (what its counts are divided by), of_lang, chunks and blocks of the lang, and n (its kept terms)."""
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_source = kept.groupBy("lang", "source").agg(F.sum("c").alias("counts"), F.count("*").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.sum("c").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("vocabulary"))
    all_groups = named.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["counts", "n", "lang_total", "vocabulary"])
    numbered = all_groups.withColumns({"i": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, "size": F.count("*").over(Window.partitionBy("lang"))})
    return cut(numbered.select("lang", "source", "i", F.floor(F.col("i") / block).cast("int").alias("block"), (F.col("counts") + F.col("vocabulary")).alias("of"), (F.col("lang_total") + F.col("vocabulary")).alias("of_lang"),
                               F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / chunk)).cast("int").alias("chunks"), F.ceil(F.col("size") / block).cast("int").alias("blocks"), "n"))


def share(count: str, of: str):
    """1 + floor(UNIT * (count + 1) / of); the product may pass a long."""
    return F.expr(f"1L + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div CAST({of} AS DECIMAL(20,0))")


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
    out = rows.withColumn("rank", rank)
    out = out if most is None else out.where(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))


def telling_terms(placed: DataFrame, most: int = RANKS) -> DataFrame:
    """The terms that a group uses more than its lang does, by value, up to that rank."""
    shares = placed.select("lang", "source", F.col("term").alias("item"), share("c", "of").alias("p"), share("total", "of_lang").alias("q"))
    above = shares.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    return ranked(above, "term", most)


def packed_vectors(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, block, chunk, terms (of the chunk, as far as the block has them), cells (array<long>)."""
    dealt = placed.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("place", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    fits = (F.col("place") < 1 << PLACE) & (F.col("c") < 1 << 62 - PLACE - OF_BLOCK)
    cell = F.when(fits, (F.col("c") * (1 << OF_BLOCK) + F.col("i") % block) * (1 << PLACE) + F.col("place")).otherwise(F.raise_error(F.lit("a count or a chunk passes what a packed cell holds")).cast("long"))
    return dealt.groupBy("lang", "block", "chunk").agg((F.max("place") + 1).alias("terms"), F.collect_list(cell).alias("cells"))


def tiles(packed: DataFrame, groups: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Every block of groups in every chunk of its lang, once for each tile that it is in: lang, a, b, stretch, chunk, block, terms, of_block, cells."""
    terms = packed.groupBy("lang", "chunk").agg(F.max("terms").alias("terms"))
    blocks = groups.groupBy("lang", "block", "blocks", "chunks").agg(F.sort_array(F.collect_list(F.struct("i", "source", "of"))).alias("of_block"))
    whole = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    whole = whole.join(terms, ["lang", "chunk"], "left").join(packed.drop("terms"), ["lang", "block", "chunk"], "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    sent = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return sent.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), F.floor(F.col("chunk") / stretch).cast("int").alias("stretch"), "chunk", "block", "terms", "of_block", "cells")


def shares(terms: int, of_block: list[dict], cells: np.ndarray) -> np.ndarray:
    """Groups x terms: p of every term of the chunk in every group of the block."""
    counts = np.zeros((len(of_block), terms), np.int64)
    counts[(cells >> PLACE) & ((1 << OF_BLOCK) - 1), cells & ((1 << PLACE) - 1)] = cells >> (PLACE + OF_BLOCK)
    of = np.array([g["of"] for g in of_block], np.int64)
    if counts.max(initial=0) < 2**63 // UNIT - 1:
        return 1 + UNIT * (counts + 1) // np.maximum(of, 1)[:, None]
    return 1 + (UNIT * (counts.astype(object) + 1) // np.maximum(of, 1)[:, None]).astype(np.int64)


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sums over terms of floor((p - q)^2 / q), for every row of p against every row of q."""
    out = np.empty((len(p), len(q)), np.int64)
    for i, own in enumerate(p):
        apart = own - q
        out[i] = (apart * apart // q).sum(1)
    return out


def pair_sums(tiled: DataFrame) -> DataFrame:
    """lang, source, item, value."""

    def run(batches):
        tile, sides, total = None, {}, None

        def sent():
            for (one, other), values in total.items():
                for g, row in zip(one, values.tolist(), strict=True):
                    yield from ((tile[0], g, h, v) for h, v in zip(other, row, strict=True) if g != h)

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = [pa.string()] * 3 + [pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "source", "item", "value"])

        for batch in batches:
            for at in range(batch.num_rows):
                lang, a, b, stretch, chunk, block, terms = (batch.column(i)[at].as_py() for i in range(7))
                if (lang, a, b, stretch) != tile:
                    if tile:
                        yield batch_of(list(sent()))
                    tile, sides, total = (lang, a, b, stretch), {}, {}
                of_block, cells = batch.column(7)[at].as_py(), batch.column(8)[at].values
                cells = np.empty(0, np.int64) if cells is None else cells.to_numpy()
                sides[block] = tuple(g["source"] for g in of_block), shares(terms, of_block, cells)
                if len(sides) == len({a, b}):
                    for x, y in {(a, b), (b, a)}:
                        (one, p), (other, q) = sides[x], sides[y]
                        total[one, other] = total.get((one, other), 0) + divergences(p, q)
                    sides = {}
        if tile:
            yield batch_of(list(sent()))

    keys = ["lang", "a", "b", "stretch"]
    dealt = tiled.repartition(*keys).sortWithinPartitions(*keys, "chunk", "block")
    return dealt.mapInArrow(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = DOCUMENTS, most: int = RANKS, block: int = BLOCK, chunk: int = CHUNK, stretch: int = STRETCH, memo: int = MEMO) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    if not (0 < block <= 1 << OF_BLOCK and 0 < chunk <= 1 << PLACE - 1):
        raise ValueError("blocks or chunks larger than a packed cell can name")
    kept = stored(kept_terms(docs, least, memo))
    groups = groups_of(docs, kept, block, chunk)
    placed = attach(kept, groups, ["lang", "source"])
    pairs = pair_sums(tiles(stored(packed_vectors(placed, block)), groups, stretch))
    return ranked(pairs, "pair").unionByName(telling_terms(placed, most))
