"""Vector codes, source divergences and benchmark decontamination against brute force and SQL."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import audit, codes, common, queries, suffixes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_source_audit", "op13_decontaminate"])
def test_queries_agree_with_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_attach_joins_hot_and_other_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 7) for i in range(200)], "i long, k long")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("total"))
    want = collections.Counter()
    for r in rows.collect():
        want[r["k"]] += r["i"]
    for hot in (0.001, 0.2, 2.0):
        monkeypatch.setattr(common, "HOT", hot)
        got = common.attach(rows, groups, ["k"]).collect()
        assert len(got) == 200 and all(r["total"] == want[r["k"]] for r in got)
    assert common.attach(rows.limit(0), groups.limit(0), ["k"]).count() == 0


# -- 11


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """By whole numbers of any size: codes, errors and final codebooks of (vec_id, label, vector)."""
    kept = [(i, label, x) for i, label, x in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    width = -(-max((len(x) for *_, x in kept), default=0) // parts)
    whole = [[math.floor(Fraction(v) * scale) for v in x] + [0] * (parts * width - len(x)) for *_, x in kept]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    firsts = {}
    for (i, _, x), w in sorted(zip(kept, cut, strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[0][2])):
        firsts.setdefault(i, w)
    books = [[w[p] for w in list(firsts.values())[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e, p=p, w=w: (apart(w[p], books[p][e]), e)) for p in range(parts)] for w in cut]
    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                if own := [w[p] for w, c in zip(cut, chosen, strict=True) if c[p] == e]:
                    books[p][e] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    chosen = assign()
    out = [(i, label, bytes(c).hex(), min(sum(apart(w[p], books[p][c[p]]) for p in range(parts)), 2**63 - 1)) for (i, label, _), w, c in zip(kept, cut, chosen, strict=True)]
    total = collections.Counter()
    for _, label, _, error in out:
        total[label] += error
    digest = hashlib.sha256(",".join(str(v) for part in books for entry in part for v in entry).encode()).hexdigest()
    return sorted(((i, c, e, min(total[label], 2**63 - 1), digest) for i, label, c, e in out), key=repr)


def vectors(rng, n, size):
    return [[float(v) for v in rng.choice([-1.0, -0.5, -1e-4, 0.0, 0.25, 0.7, 3.0], size)] for _ in range(n)]


CASES = {
    "many": lambda rng: [(i, i % 3, x) for i, x in enumerate(vectors(rng, 60, 16))],
    "few": lambda rng: [(i, None, x) for i, x in enumerate(vectors(rng, 5, 8))],
    "odd": lambda rng: [(1, 1, None), (2, 2, [1.0, None] * 4), (3, 3, [float("nan")] * 8), (4, 4, [float("inf")] * 8), (None, None, [0.1] * 8), (7, None, []), (8, 1, [0.5, -0.3]), *((9, 1, [0.25] * 8) for _ in range(5)), (9, 2, [-0.25] * 8), (10, 2, [0.25] * 12)],
    "unequal": lambda rng: [(i, i % 2, x[: 1 + i % 11]) for i, x in enumerate(vectors(rng, 30, 11))],
    "large": lambda rng: [(i, i % 2, [v * 10.0 ** (i % 5 * 9) for v in x]) for i, x in enumerate(vectors(rng, 30, 8))],
    "empties": lambda rng: [(i, 0, []) for i in range(3)],
    "none": lambda rng: [],
}


@pytest.mark.parametrize("case", CASES)
def test_codes(spark, case):
    rows = CASES[case](np.random.default_rng(5))
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("code", F.lit("clash")).repartition(3)
    got = codes.compress(table).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_codes(rows)


def test_decoded_codes_are_near(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 16))
    rows = [(i, 0, [float(v) for v in centres[i % 4] + rng.normal(size=16) * 1e-3]) for i in range(200)]
    table = codes.usable(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    books = codes.fit(table, parts=4, entries=8)
    back = {r["vec_id"]: r["embedding"] for r in codes.decode(codes.encode(table, books), books).collect()}
    assert max(np.abs(np.array(back[i]) - x).max() for i, _, x in rows) < 0.01


def test_sums_in_digits():
    for value in (0, 5, -5, 2**30, -(2**30), 2**200 + 12345, -(2**200) - 1, 2**63):
        assert sum(d << (codes.DIGIT * place) for place, d in codes.digits(value)) == value
        assert all(abs(d) < 2**31 for _, d in codes.digits(value))


# -- 12


def brute_audit(rows, least=3, most=200):
    terms = lambda text: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    docs = [(lang or "", source or "", terms(text)) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        with_term = collections.Counter(t for *_, found in own for t in set(found))
        kept = [t for t, n in with_term.items() if n >= least]
        count = {s: collections.Counter(t for _, source, found in own if source == s for t in found if with_term[t] >= least) for s in {x[1] for x in own}}
        whole = sum(count.values(), collections.Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        for s in count:
            pairs = [(o, sum((share(count[s], t) - share(count[o], t)) ** 2 // share(count[o], t) for t in kept)) for o in count if o != s]
            above = [(t, share(count[s], t), share(whole, t)) for t in kept if count[s][t]]
            for part, items in (("pair", pairs), ("term", [(t, (p - q) ** 2 // q) for t, p, q in above if p > q])):
                placed = sorted(items, key=lambda x: (-x[1], x[0].encode()))[: most if part == "term" else None]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(placed)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"block": 2, "chunk": 4, "stretch": 1, "memo": 3}, {"block": 1, "chunk": 2, "stretch": 2, "most": 2}])
def test_audit(spark, options):
    rng = random.Random(1)
    words = ["The", "the", "of", "Äpfel", "äpfel", "a1b", "日本", "x", "y-z", "Q", "ü"]
    rows = [(" ".join(rng.choices(words, weights=range(1, 12), k=rng.randint(0, 9))), rng.choice(["en", "en", "en", None, "fr"]), rng.choice(["s1", "s2", "é", None, "s3", ""])) for _ in range(120)]
    rows += [(None, "de", "only"), ("12 34 -", "de", "other"), ("once", "it", "s"), ("x " * 5000, "en", "s1"), rows[0], rows[0]]
    table = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "c": F.lit("clash"), "n": F.lit(2)}).repartition(3)
    got = audit.audit(table, **options)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, most=options.get("most", 200))


def test_audit_of_nothing(spark):
    assert audit.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_of_counts_beyond_a_long():
    big = 2**44
    cells = np.array([((big << audit.OF_BLOCK) + 0) << audit.PLACE | 1], np.int64)
    p = audit.shares(2, [{"of": big + 2}], cells)
    assert p.tolist() == [[1 + 10**9 // (big + 2), 1 + 10**9 * (big + 1) // (big + 2)]]


# -- 13


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_hits(docs, items, window):
    windows = collections.defaultdict(set)
    for item_id, text in items:
        found = plain_words(text)
        w = min(len(found), window)
        for p in range(len(found) - w + 1 if w else 0):
            windows[tuple(found[p : p + w])].add(item_id)
    out = []
    for doc_id, text in docs:
        found, hit, named = plain_words(text), set(), set()
        for key, ids in windows.items():
            for p in range(len(found) - len(key) + 1):
                if tuple(found[p : p + len(key)]) == key:
                    hit.update(range(p, p + len(key)))
                    named |= ids
        out.append((doc_id, len(found), len(hit), sorted(str(x) for x in named if x is not None)))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    text = lambda n, k=4: " ".join(rng.choices(["A", "b", "ü", "c3", "日本", "d"][:k], k=n))
    items = [(i, text(rng.randint(1, 14))) for i in range(12)] + [(None, text(12, 2)), (3, text(11)), (20, None), (21, " - "), (22, "zz " * 40)]
    docs = [(i, text(rng.randint(0, 60), 6) + ". " + (rng.choice(items)[1] or "") + "! " + text(5)) for i in range(40)]
    docs += [(None, None), (5, ""), (6, "b " * 3000), (6, "b " * 3000), (7, "zz " * 50), (41, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard": 64}, {"shard": 200, "block": 30}, {"shard": 1, "block": 1}])
@pytest.mark.parametrize("window", [3, 10])
def test_search(spark, window, options):
    docs, items = made(window)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("clash"), "items": F.lit(1)}).repartition(2)
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    got = suffixes.search(table, benchmark, window, **options).collect()
    found = [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in got]
    assert sorted(found, key=repr) == brute_hits(docs, items, window)
    for r in got:
        ends = [x for s in r["spans"] for x in s]
        assert ends == sorted(set(ends)) or len(ends) == 0


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert suffixes.search(none, items).count() == 0
    assert [(r["n_words"], r["spans"], r["items"]) for r in suffixes.search(one, items).collect()] == [(3, [], [])]
    assert suffixes.longest_matches(one, items).count() == 0


def test_documents_go_and_columns_stay(spark):
    docs, items = made(10)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("clash"), "words": F.lit(1)})
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = suffixes.decontaminate(table, benchmark)
    assert kept.columns == table.columns
    want = sorted(((d, t) for (d, t), hit in zip(docs, [brute_hits([x], items, 10)[0] for x in docs], strict=True) if not hit[2]), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == want


@pytest.mark.parametrize("options", [{}, {"shard": 64, "block": 30}])
def test_longest_matches(spark, options):
    docs, items = made(4)
    items = [x for x in items if x[0] not in (None, 3)]
    found = suffixes.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3, **options).collect()
    texts = collections.defaultdict(list)
    for doc_id, text in docs:
        texts[doc_id].append(plain_words(text))
    longest = {}
    for item_id, text in items:
        own = plain_words(text)
        for p in range(max(1, len(own) - 2)):
            for d in (w for x in texts.values() for w in x):
                for q in range(len(d)):
                    k = 0
                    while p + k < len(own) and q + k < len(d) and own[p + k] == d[q + k]:
                        k += 1
                    longest[item_id] = max(longest.get(item_id, 0), k)
    assert {r["item_id"]: r["words"] for r in found} == {i: n for i, n in longest.items() if n}
    for r in found:
        own = plain_words(dict(items)[r["item_id"]])[r["item_at"] :][: r["words"]]
        assert any(d[r["doc_at"] :][: r["words"]] == own for d in texts[r["doc_id"]])


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n, k in ((0, 1), (1, 1), (50, 2), (300, 3), (200, 1)):
        text = rng.integers(0, k, n)
        order = suffixes.suffix_array(text, max(n, 1))
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
