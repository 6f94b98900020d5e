"""A corpus pipeline: quality, near-duplicates, personal data, source weights, token ids.

Every stage takes the session, documents and the folder of the tables, and works on all rows that it is given. All
but the last return the columns of documents. The near-duplicate stage decides by text, so that a repeated or null
doc_id loses no text and keeps no copy; blank texts are copies only of those with their doc_id. There is no SQL for the
whole: the classifier, the candidate search and the tokenizer can't be written in it (ORACLE_SQL is None; tests hold each
stage against brute force).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import minhash, mixing, pii, queries, quality
from panelforge.llm.common import SPACE, read, stored

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = quality.score(docs, queries.quality_model(spark, sf_dir), "__score")
    return scored.where(F.col("__score") >= 0.3).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays, null last."""
    digested = docs.withColumn("__digest", F.xxhash64("text"))
    blank = ~F.coalesce("text", F.lit("")).rlike(f"[^{SPACE}]")
    found = minhash.near_duplicates(digested.where(~blank).select(F.col("__digest").alias("doc_id"), "text"))
    component = found.groupBy(F.col("doc_id").alias("__digest")).agg(F.min("component_id").alias("component"))
    of_text = digested.where(~blank).groupBy("__digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "__digest")).alias("first"))
    first = of_text.join(component, "__digest").groupBy("component").agg(F.min("first").alias("first"))
    first = first.select(F.col("first.doc_id").alias("__of"), F.col("first.__digest").alias("__text"))
    chosen = digested.where(~blank).join(first, (F.col("__digest") == F.col("__text")) & F.col("doc_id").eqNullSafe(F.col("__of")), "left_semi")
    blanks = digested.where(blank)
    single = chosen.union(blanks.where("doc_id is not null")).dropDuplicates(["doc_id", "__digest"])
    return single.union(blanks.where("doc_id is null")).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; n_chars follows."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else redacted


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources have it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and the digests of ids and decoded bytes."""
    return queries.op3_byte_bpe(spark, sf_dir, docs)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what each keeps is stored, so that none is computed again for a later one."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
