"""The queries of the training-data operators, by the contract of each, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import audit, bpe, codes, embdedup, html, lm, minhash, mixing, pii, quality, suffixes, tokens, topk
from panelforge.llm.common import read


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written("base").cast("binary"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    ranks = tokenizer("byte_bpe_multi_50k.tiktoken")
    docs = read(spark, sf_dir, "documents") if docs is None else docs
    return bpe.round_trip(docs, ranks, pattern()).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level
      FROM c WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l) * weight) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      CAST('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || md5(coalesce(d.text, ''))), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""


def remainder(doc_id, by: int):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def quality_model(spark: SparkSession, sf_dir: str):
    docs = read(spark, sf_dir, "documents").where(remainder(F.col("doc_id"), 5) != 0)
    return quality.fit(docs, read(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, sf_dir))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    scored = lm.score(read(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(read(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS n FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE p.n > 0 AND q.n > 0 AND list_dot_product(p.x, q.x) / (p.n * q.n) >= 0.95),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT c.vec_id, coalesce(k.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k ON k.a = c.vec_id
"""

def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read(spark, sf_dir, "embeddings"))


def codes_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    """Six rounds and the last assignment, each two tables; floors of negative quotients by hand, as // cuts."""
    assigned = """a{k} AS (SELECT v.i, v.part, arg_min(c.entry, (d, c.entry)) AS entry, min(d) AS d FROM (SELECT v.i, v.part, c.entry,
  CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: CAST(z[1] - z[2] AS HUGEINT) * (z[1] - z[2]))) AS HUGEINT) AS d FROM v JOIN c{k} c ON c.part = v.part) v JOIN c{k} c ON c.part = v.part AND c.entry = v.entry GROUP BY v.i, v.part)"""
    moved = """s{n} AS (SELECT part, entry, p, CAST(sum(x) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT v.part, a.entry, unnest(v.x) AS x, unnest(range(len(v.x))) AS p FROM v JOIN a{k} a ON a.i = v.i AND a.part = v.part) GROUP BY ALL),
m{n} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS x FROM s{n} GROUP BY part, entry),
c{n} AS (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{n} m ON m.part = c.part AND m.entry = c.entry)"""
    steps = [text.format(k=k, n=k + 1) for k in range(rounds) for text in (assigned, moved)] + [assigned.format(k=rounds)]
    return f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT i, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS x FROM e, (SELECT unnest(range({parts})) AS part)),
c0 AS (SELECT part, i - 1 AS entry, x FROM v WHERE i <= {entries}),
{", ".join(steps)},
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT e.vec_id, e.label, string_agg(printf('%02x', CAST(a.entry AS INTEGER)), '' ORDER BY a.part) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM e JOIN a{rounds} a ON a.i = e.i GROUP BY e.i, e.vec_id, e.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, b
"""


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
n AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
s AS (SELECT n.lang, n.source, sum(n.c) AS n FROM n JOIN k USING (lang, term) GROUP BY n.lang, n.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(n.c, 0) + 1)) // (coalesce(s.n, 0) + v.v)::HUGEINT AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.total + 1)) // (v.n + v.v)::HUGEINT AS BIGINT) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS x FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
o AS (SELECT i, p, k, array_to_string(w[p:p + k - 1], ' ') AS x FROM (SELECT i, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM n) WHERE len(w) >= k)),
h AS (SELECT o.i, o.p, o.k, n.item_id FROM o JOIN n ON n.k = o.k AND n.x = o.x),
c AS (SELECT i, count(DISTINCT p) AS n_hit FROM (SELECT i, unnest(range(p, p + k)) AS p FROM h) GROUP BY i),
t AS (SELECT i, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT i, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY i)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.i = d.i LEFT JOIN t ON t.i = d.i
"""

QUERIES = {
    "op1_pii": op1_pii,
    "op2_html_text": op2_html_text,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_source_mix": op4_source_mix,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op8_ngram_score": op8_ngram_score,
    "op9_exact_topk": op9_exact_topk,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_source_audit": op12_source_audit,
    "op13_decontaminate": op13_decontaminate,
}
ORACLE = {"op11_vector_codes": codes_sql(), "op12_source_audit": OP12_SQL, "op13_decontaminate": OP13_SQL, "op7_embedding_dedup": OP7_SQL, "op10_minhash_dedup": OP10_SQL, "op4_source_mix": OP4_SQL, "op9_exact_topk": OP9_SQL}
