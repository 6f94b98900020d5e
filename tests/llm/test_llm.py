"""The training-data operators against brute force, on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import bpe, embdedup, graph, html, lm, minhash, mixing, pii, quality, queries, tokens, topk
from panelforge.llm.eliasfano import EliasFano, Levels

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   \n", "one", "a b", "Ein Übermut – 日本語 🙂 x", "x" * 3000, "a b c " * 3000, "A b\tC\nd", "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, x, None if i % 3 == 0 else f"s{i % 2}", 1.5, "clash", 7) for i, x in enumerate(ODD)] + [(None, "no id", "s1", 0.0, None, 1), (3, "one", "s1", 2.0, "c", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, cls string, size int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def ascii_words(text):
    return (text or "").encode().translate(minhash.LOWER).split()


# -- 1


LOOSE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(LOOSE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(x) < 256 for x in m.group().split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


HARD = ["a@b.c_x@y.z and q@@r.s", "1.2.3.4.5.6.7.8", "999.1.1.1 01.002.0003.255", "4111 1111-1111 1111, 4111111111111112", "+1 (555) 010-9999. +12 3", "é🙂 me.x+y@ex-am.ple.com.", "9" * 5000, "a" * 20000 + "@", "1.1.1.1" * 50, "+1" + " " * 3000]


def test_base_spans(spark, odd):
    rows = [(i, x) for i, x in enumerate([*HARD, *ODD])]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in got.collect():
        assert [tuple(s) for s in r["base"]] == base(r["text"]), r["text"][:50]
    assert pii.find(odd.limit(0)).count() == 0
    assert pii.find(odd).count() == odd.count()


def test_patterns_discover_identifiers(spark):
    cards = [c for c in (f"41111111111{i:05d}" for i in range(400)) if luhn(c)][:8]
    rows = [f"please charge {c} now" for c in cards] + ["please charge 4111111111119998x now", "he saw 123456 birds", "version 2.0.1-rc1 is out"]
    found = {r["text"]: r for r in pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    more = found["please charge 4111111111119998x now"]
    assert not more["base"] and [(s["start"], s["k"], s["end"]) for s in more["spans"]] == [(14, 2, 31)]
    assert not found["he saw 123456 birds"]["spans"] and not found["version 2.0.1-rc1 is out"]["spans"]
    redacted = {r["text"] for r in pii.redact(spark.createDataFrame([(1, rows[0], 3), (2, None, 4)], "doc_id long, text string, base int")).collect()}
    assert redacted == {"please charge <CARD> now", None}


def discovered(spark, rows):
    found = pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    return {r["text"]: [(pii.KINDS[s["k"]], r["text"][s["start"] : s["end"]]) for s in r["spans"] if s not in r["base"]] for r in found}


def test_spans_with_blanks_or_without_digits_are_seeds(spark):
    cards = [c for c in (f"4111 1111 1111 {i:04d}" for i in range(400)) if luhn(c.replace(" ", ""))][:8]
    names = ["ann", "ben", "cem", "dan", "eva", "fay", "gus", "hal"]
    rows = [f"please charge {c} now" for c in cards] + ["please charge 4111 1111 1111 999x now", "please charge 4111111111119998x 2 times"]
    rows += [f"reach me on +1 (555) 010-77{i} today" for i in range(10, 18)] + ["reach me on (555) 010-78 today", "mail jo@x.org +1 555 reach me on 55 - 01 078, today"]
    rows += [f"write to ({x}.doe@example.com), please" for x in names] + ["write to jane.roe@localhost please", "we met 2019 300 times"]
    more = discovered(spark, rows)
    assert ("card", "4111 1111 1111 999x") in more["please charge 4111 1111 1111 999x now"]
    assert ("card", "4111111111119998x") in more["please charge 4111111111119998x 2 times"]
    assert more["reach me on (555) 010-78 today"] == [("phone", "(555) 010-78")]
    assert more["mail jo@x.org +1 555 reach me on 55 - 01 078, today"] == [("phone", "55 - 01 078")]
    assert more["write to jane.roe@localhost please"] == [("email", "jane.roe@localhost")]
    assert not more["we met 2019 300 times"] and not any(more[x] for x in rows[:8])


def test_discovered_identifiers_bring_patterns_until_none_is_added(spark):
    words = ["ask", "ring", "page", "hail", "wake"]
    groups = [[f"u{i}@x.org" for i in range(900)], *([f"Q{g}X{i:05d}" for i in range(n)] for g, n in enumerate((180, 34, 6, 1)))]
    rows = [f"{word} {word}er {x} again" for word, *both in zip(words, groups, groups[1:]) for x in itertools.chain(*both)] + ["ring ringer lunch Q9X00001 again"]
    more = discovered(spark, rows)
    assert [more[f"{word} {word}er {x} again"] for word, group in zip(words, groups[1:]) for x in group] == [[("email", x)] for group in groups[1:] for x in group]
    assert not more["ring ringer lunch Q9X00001 again"]


@pytest.mark.parametrize("one", ["1.2.3.{}", "write to u{}@ex.org,", "+1 (555) 010-77{} and"])
def test_pii_of_a_text_with_many_identifiers(spark, one):
    text = " ".join(one.format(i % 256) for i in range(20_000)) + " ü🙂 end"
    df = spark.createDataFrame([(1, text, 5, "kept", 6, 7, 8)], "doc_id long, text string, base int, spans string, digest int, more int, masked int")
    r = pii.find(df).first()
    assert [tuple(s) for s in r["base"]] == base(text) and (r["digest"], r["more"], r["masked"]) == (6, 7, 8)
    redacted = pii.redact(df).first()
    assert (redacted["base"], redacted["spans"], redacted["digest"]) == (5, "kept", 6)
    at, want = 0, []
    for a, k, b in base(text):
        if a >= at:
            want += [text[at:a], f"<{pii.KINDS[k].upper()}>"]
        at = max(at, b)
    assert redacted["text"] == "".join(want) + text[at:]


def test_words_of_a_pattern_may_be_far_and_long(spark):
    cards = [c for c in (f"41111111111{i:05d}" for i in range(400)) if luhn(c)][:6]
    far, long = " " * 5000, "w" * 700
    rows = [f"{long} charge{far}{c} now" for c in cards] + [f"x {long} charge 4111111111119998x now"]
    assert discovered(spark, rows)[rows[-1]] == [("card", "4111111111119998x")]


def test_pii_query(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op1_pii(spark, SF).collect():
        want = base(texts[r["doc_id"]])
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert r["base_sha256"] == digest and r["n_card"] == sum(k == 2 for _, k, _ in want)


# -- 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p>One<br>two <b>bold</b>.<p>Three &lt;3<script>var a="<p>no</p>"</script></article>
<section id="comments"><p>nice</p></section><footer>&copy; x</footer>"""


def test_main_text():
    assert html.main_text(PAGE, None)[0] == "Head & more\nOne two bold.\nThree <3"
    for page, text in ((None, ""), ("", ""), ("<p", ""), ("a < b", "a < b"), ("<div>x" * 3000, "\n".join(["x"] * 3000)), ("<!-- x", ""), ("<ul><li>a<li>b</ul>", "a\nb")):
        assert html.main_text(page, None)[0] == text == html.main_text(page, set())[0]


def test_names_keep_most_of_a_page():
    long = f"<p>{'word ' * 200}</p>"
    for mark in ('class="post related-work"', 'id="content" class="login-guide"', 'class="search results"', 'class="banner-history"'):
        text, _ = html.main_text(f"<nav><a>x</a></nav><div {mark}>{long}</div><footer>f</footer>", None)
        assert text == "word " * 199 + "word"
    for mark in ('class="comments"', 'class="ad"', "hidden", 'style="display: none"'):
        assert html.main_text(f"<p>story</p><div {mark}>{long}</div>", None)[0] == "story" == html.main_text(f"<p>story</p><div {mark}>{long}</div>", set())[0]


def test_broken_markup_takes_linear_time():
    for broken in ("<font>" * 20_000 + "</i>" * 20_000, "<font>" * 20_000 + "<div></div>" * 20_000, "<p><b>" * 20_000, "<li><i>" * 20_000 + "</ul>" * 20_000, "<table>" * 20_000 + "<td>" * 20_000):
        start = time.perf_counter()
        assert html.main_text(broken + "<p>end</p>", None)[0].endswith("end")
        assert time.perf_counter() - start < 5  # a second on an idle core


def test_site_templates_go(spark):
    shell = "<html><body><div>Welcome to our site</div><div><p>{}</p></div><div><span>All rights</span></div></body></html>"
    rows = [(i, "http://h.example/x", shell.format(f"story {i}"), "t") for i in range(8)] + [(9, None, "<p>alone</p>", "t"), (10, "http://other.example", None, "t")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got == {**{i: f"story {i}" for i in range(8)}, 9: "alone", 10: ""}


def test_inline_elements_of_running_text_stay(spark):
    marked = "<html><body><article><div><i>Share</i></div><h1>T{0}</h1><p>Story {0} is <code>None</code>, read <a href=/{0}>here</a>.</p><p><b>Same words.</b></p><ul><li><div>Item</div> {0}</ul><div>Bare {0} <em>text</em></div></article></body></html>"
    plain = "<html><body><div><i>Share</i></div><p>Story {0} is <code>None</code>.</p><div>Bare {0} <em>text</em></div><p><b>Gone</b></p></body></html>"
    rows = [(i, f"http://{host}.example/{i}", page.format(i)) for host, page, at in (("m", marked, 0), ("p", plain, 10)) for i in range(at, at + 6)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"T{i}\nStory {i} is None, read here.\nSame words.\nItem\n{i}\nBare {i} text"
        assert got[10 + i] == f"Story {10 + i} is None.\nBare {10 + i} text"


def article_lines(page):
    import html as entities

    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S).group(1)
    blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inside)]
    return [b for b in blocks if b]


def test_html_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op2_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == "\n".join(article_lines(pages[r["page_id"]])) and r["n_chars"] == len(r["text"])


def test_templates_decide(spark):
    """With them the text is the articles', by names or without; without them no page has its text. Hosts have four pages at least."""
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id < 700").withColumn("host", html.host_of(F.col("url")))
    table = table.join(table.groupBy("host").count().where("count >= 4"), "host").cache()
    want = {r["page_id"]: "\n".join(article_lines(r["html"])) for r in table.collect()}
    for options, right in (({}, 1.0), ({"names": False}, 1.0), ({"counts": False}, 0.0)):
        got = {r["page_id"]: r for r in html.extract(table, **options).collect()}
        assert len(got) == len(want) and np.mean([r["text"] == want[i] for i, r in got.items()]) == right
        assert all(r["n_deleted"] >= 3 for r in got.values()) or not right


def test_pages_of_a_large_host_are_dealt_out(spark, monkeypatch):
    shell = "<div class=top>Top</div><div class=x><p>{0}</p></div><div class=y>Tail</div>"
    rows = [(i % 50, "http://h.example/x", shell.format(f"story {i % 50}")) for i in range(60)] + [(None, None, None), (3, None, shell.format("alone"))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "turn": F.lit("clash")})
    for place in (250, 7):
        monkeypatch.setattr(html, "PLACE", place)
        got = sorted(((r["page_id"], r["text"]) for r in html.extract(table).collect()), key=repr)
        assert got == sorted([(i % 50, f"story {i % 50}") for i in range(60)] + [(None, ""), (3, "Top\nalone\nTail")], key=repr)
    assert html.extract(table.limit(0)).count() == 0


def test_slots_and_words_in_classes(spark):
    shell = "<body><div class='menu-{1}'><a href=/>m{0}</a></div><div class=body>{0} story without blocks, long enough to be most of the page's text<br>and more {0}</div><div class=tail>Tail {0}</div></body>"
    rows = [(i, "http://s.example/x", shell.format(i, "top")) for i in range(8)]
    inside = "<article><p class=search>A</p><div class=related-work><p>B</p></div><div class=related><a href=/>C</a></div><section id=alert><h2>D</h2></section><div class='ad'>E</div><ol class=comments><li>F</li></ol><p>G</p></article>"
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame([*rows, (9, "http://t.example", inside)], "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"{i} story without blocks, long enough to be most of the page's text and more {i}" for i in range(8)}, 9: "A\nB\nD\nG"}


# -- 3, 6


def test_bpe_round_trip(odd, empty):
    ranks, pattern = queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pattern()
    encoder = bpe.encoding(ranks, pattern)
    for r in bpe.decode(bpe.encode(odd, ranks, pattern), ranks, pattern).collect():
        text = next((x for i, x in enumerate(ODD) if i == r["doc_id"]), "no id")
        assert bytes(r["decoded"]).decode() == (text or "")
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == encoder.encode_ordinary(text or "") and r["n_tokens"] == len(r["ids"]) // 4
    assert bpe.encode(empty, ranks, pattern).count() == 0


def test_parts_keep_ids(docs):
    encoder = bpe.encoding(queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pattern())
    for text in [r["text"] for r in docs.limit(40).collect()] + ["a  b   c's d\n\n e " * 40, "x" * 500]:
        assert [i for p, _ in bpe.parts(text, 50) for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)


def by_pretokens(text, encoder):
    """Ids of each match of the pattern by itself."""
    import regex

    space = bpe.BLANK
    pattern = queries.pattern().replace(r"[^\s\p{L}", rf"[^{space}\p{{L}}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    return [i for match in regex.findall(pattern, text) for i in encoder._encode_single_piece(match)]


def test_parts_of_mixed_signs():
    encoder = bpe.encoding(queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pattern())
    rng = np.random.default_rng(0)
    signs = np.array([*"ab1 2\n\t 'st.!漢字、é\u3000🙂,_-\xa0", "'s", "  "])
    for _ in range(1500):
        text = "".join(rng.choice(signs, rng.integers(0, 60)))
        want = encoder.encode_ordinary(text)
        assert by_pretokens(text, encoder) == want
        assert [i for p, _ in bpe.parts(text, int(rng.integers(2, 9))) for i in encoder.encode_ordinary(p)] == want


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "\xa0" * 1_000_001 + " y\t\t", "漢字。仮名" * 400_000, " \n" * 600_000 + "'s", "x" * 1_000_000])
def test_bpe_of_long_texts(text):
    encoder = bpe.encoding(queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pattern())
    packed = bpe.packed_ids(text, encoder)
    assert np.frombuffer(packed, "<u4").tolist() == by_pretokens(text, encoder)
    assert bpe.unpacked_bytes(packed, encoder) == text.encode()


def test_runs_of_some_thousand_blanks_take_linear_time():
    text = ("\t" * 9_999 + "x") * 50
    encoder = bpe.encoding(queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pattern())
    start = time.perf_counter()
    ids = bpe.packed_ids(text, encoder)
    assert time.perf_counter() - start < 10 and bpe.unpacked_bytes(ids, encoder) == text.encode()
    short = ("\t" * 999 + "x") * 3
    assert bpe.packed_ids(short, encoder) == np.array(encoder.encode_ordinary(short), "<u4").tobytes()


def test_bpe_query_takes_long_white_space(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_500_000 + "b"), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in queries.op3_byte_bpe(spark, SF, docs).collect()}
    assert got[1]["decoded_sha256"] == hashlib.sha256(b"a" + b" " * 1_500_000 + b"b").hexdigest() and got[None]["n_tokens"] == 0


def test_token_counts(odd, docs, empty):
    path = queries.tokenizer("piece_bpe_32k.model")
    model = tokens.vocabulary_of(path).model
    for table in (odd, docs):
        texts = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        want = collections.Counter((i, len((x or "").encode()), len(model.encode(x or ""))) for i, x in texts)
        assert collections.Counter(tuple(r) for r in tokens.count_tokens(table, path).collect()) == want
    for text in ["▁a ▁▁ b", "\n\n  x", " \n \n", "<s> a</s>\n<unk>", "\x00 a", "a\r\nb", "🙂 🙂a", "  ", "\n"]:
        vocabulary = tokens.vocabulary_of(path)
        frequency = collections.Counter(vocabulary.pattern.findall(tokens.MARK + text.replace(" ", tokens.MARK)))
        counts = tokens.piece_counts(vocabulary, list(frequency))
        assert sum(n * counts[x] for x, n in frequency.items()) == len(model.encode(text)), repr(text)
    assert tokens.count_tokens(empty, path).count() == 0


# -- 4


def shares(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] >= most * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(spark, odd, docs, empty):
    for table in (odd, docs):
        got = mixing.plan_mix(table).collect()
        sizes = collections.defaultdict(int)
        for r in table.collect():
            sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        want = shares(sizes)
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12, abs=1e-9)
            assert 0 <= r["copies"] <= 2
        assert sum(r["copies"] for r in got) == mixing.mix(table).count()
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.plan_mix(empty).count() == 0
    one, other = (sorted(tuple(r) for r in mixing.mix(docs.select("doc_id", "text", "source")).select("doc_id").collect()) for _ in range(2))
    assert one == other


def test_mix_keeps_values_of_clashing_columns_and_null_ids_apart(spark):
    rows = [(None, f"w{i} " * 10, "s", -7, "x", 3, 9) for i in range(400)] + [(i, "b " * 10, "t", -7, "x", 3, 9) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string, source_size int, copies int")
    got = mixing.mix(docs).collect()
    assert {tuple(r)[3:] for r in got} == {(-7, "x", 3, 9)} and set(r["doc_id"] for r in got) <= {None, *range(50)}
    taken = mixing.plan_mix(docs).where("source = 's'").groupBy().agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).first()
    assert taken["taken"] == pytest.approx(taken["target"], rel=0.1)


# -- 5


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    chains = [(rng.integers(0, 2, (n, 3)).astype(float), y) for n, y in ((4, 1), (3, 0), (1, 1), (7, 0))]
    w, step = rng.normal(size=3), rng.normal(size=(2, 2))

    def likelihood(w, step):
        total = 0.0
        for x, y in chains:
            emit = np.stack([np.zeros(len(x)), x @ w], 1)
            of = lambda p: sum(emit[i, s] for i, s in enumerate(p)) + sum(step[a, b] for a, b in itertools.pairwise(p))
            total += of([y] * len(x)) - math.log(sum(math.exp(of(p)) for p in itertools.product((0, 1), repeat=len(x))))
        return total

    of_w, of_step = np.zeros(3), np.zeros((2, 2))
    for part in quality.batches_of(chains):
        a, b = quality.gradient(*part, w, step)
        of_w, of_step = of_w + a, of_step + b
    for i in range(3):
        move = np.eye(3)[i] * 1e-5
        assert (likelihood(w + move, step) - likelihood(w - move, step)) / 2e-5 == pytest.approx(of_w[i], abs=1e-6)
    for i in range(4):
        move = np.eye(4)[i].reshape(2, 2) * 1e-5
        assert (likelihood(w, step + move) - likelihood(w, step - move)) / 2e-5 == pytest.approx(of_step.ravel()[i], abs=1e-6)


def test_document_scores_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    w, step = rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2))
    text = "One line of words.\nTWO ||| # $\n\nthree three three three\nlast 12345 678"
    x, sizes = quality.line_features(text)
    paths = list(itertools.product((0, 1), repeat=len(x)))
    weight = np.array([math.exp(sum(s * (x[i] @ w) for i, s in enumerate(p)) + sum(step[a, b] for a, b in itertools.pairwise(p))) for p in paths])
    good = [(weight * np.array([p[i] == 1 for p in paths])).sum() / weight.sum() for i in range(len(x))]
    assert len(x) == 4 and quality.document_score(text, w, step) == pytest.approx((good * sizes).sum() / sizes.sum())


def test_quality_query(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op5_quality(spark, SF).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in labels]) > 0.8  # 19 documents; test_quality holds more


def test_a_labelled_id_with_many_rows_counts_once(spark):
    rows = [(i, f"good line {i}") for i in range(40)] + [(100 + i, f"bad {i} bad") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows] + [(3, 1)], "doc_id long, quality int")
    once = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = quality.fit(spark.createDataFrame([*rows, *[rows[3]] * 500], "doc_id long, text string"), labels)
    np.testing.assert_array_equal(once[0], many[0])


def test_the_fitting_sample_has_bounded_lines(spark):
    docs = spark.createDataFrame([(i, "a line.\n" * 50) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    seen = []
    train, quality.train = quality.train, lambda chains, **_: seen.append(chains)
    try:
        quality.fit(docs, labels, lines=120)
    finally:
        quality.train = train
    assert [len(x) for x, _ in seen[0]] == [50, 50]


def test_crf_marginals_and_gradient():
    rng = np.random.default_rng(0)
    emit, step = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    paths = list(itertools.product((0, 1), repeat=5))
    weight = np.array([math.exp(sum(emit[i, s] for i, s in enumerate(p)) + sum(step[a, b] for a, b in itertools.pairwise(p))) for p in paths])
    want = [(weight * np.array([p[i] == 1 for p in paths])).sum() / weight.sum() for i in range(5)]
    np.testing.assert_allclose(quality.forward_backward(emit, step)[:, 1], want)


def test_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit(docs.where(queries.remainder(F.col("doc_id"), 5) != 0), labels)
    held = quality.score(docs.where(queries.remainder(F.col("doc_id"), 5) == 0), model).join(labels, "doc_id").select("score", "quality").toPandas()
    assert ((held["score"] >= 0.3).astype(int) == held["quality"]).mean() > 0.95
    scored = quality.score(odd, model)
    assert scored.count() == odd.count() and set(scored.columns) == set(odd.columns)
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    assert quality.score(empty, model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert quality.document_score("any", *none) == 0.5


# -- 7


def brute_links(rows, threshold=0.95):
    fine = {i: np.array(x, float) for i, x in rows if x and all(v is not None and math.isfinite(v) for v in x) and any(x)}
    link = collections.defaultdict(set)
    for a, b in itertools.combinations(fine, 2):
        x, y = fine[a], fine[b]
        if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
            link[a].add(b)
            link[b].add(a)
    return link


def reach(ids, link):
    found = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in found:
                found[j] = i
                todo += link[j]
    return found


@pytest.mark.parametrize("deviations", [None, embdedup.DEVIATIONS])
def test_vectors(spark, deviations):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(scale=0.12 if i % 5 else 0.35, size=16)).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (301, None), (302, []), (303, [0.0] * 16), (304, [float("nan")] * 16), (305, [None] * 16), (306, [1e200] * 16), (307, [1.0, 2.0]), (308, [2.0, 4.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, label int")
    link = brute_links(rows)
    component = reach([i for i, _ in rows], link)
    got = embdedup.near_duplicates(df, deviations=deviations, cell=40, block=16).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(link[r["vec_id"]]), component[r["vec_id"]], component[r["vec_id"]] == r["vec_id"])
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


def test_vector_recall(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    link = brute_links(rows)
    got = {r["vec_id"]: r["n_links"] for r in embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=32).collect()}
    assert sum(got.values()) >= 0.99 * sum(map(len, link.values()))


def test_links_in_few_directions_are_all_found(spark):
    rng = np.random.default_rng(3)
    x = np.zeros((3000, 64))
    x[:, :8] = rng.normal(size=(3000, 8))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    u = np.zeros_like(x)
    u[:, :8] = rng.normal(size=(3000, 8))
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    cosine = rng.uniform(0.951, 0.96, size=(3000, 1))
    both = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * u])
    near = both @ both.T >= 0.95
    np.fill_diagonal(near, False)
    component = reach(range(len(both)), [np.flatnonzero(r).tolist() for r in near])
    df = spark.createDataFrame(list(enumerate(both.tolist())), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_duplicates(df, cell=64).collect()}
    assert got == {i: (int(near[i].sum()), component[i]) for i in range(len(both))}


def test_vectors_are_not_copied_to_the_cells_that_they_are_compared_with(spark):
    from pathlib import Path

    import pyarrow.parquet as pq

    x = np.random.default_rng(5).normal(size=(4000, 64))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    tables = lambda: set(Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet"))
    before = tables()
    assert embdedup.near_duplicates(df, cell=20).count() == len(x)
    assert sum(pq.ParquetFile(p).metadata.num_rows for p in tables() - before if p.is_file()) < 4 * len(x)


def test_short_products_lose_no_pair():
    rng = np.random.default_rng(7)
    low = np.zeros((700, 64))
    low[:, 20:24] = rng.normal(size=(700, 4))
    kinds = [rng.normal(size=(700, 64)), low, rng.normal(size=(700, 3)), rng.normal(size=(700, 64)) + 3, np.repeat(rng.normal(size=(7, 64)), 100, 0) + rng.normal(scale=0.05, size=(700, 64))]
    for x in map(embdedup.unit, kinds):
        at = np.arange(len(x))
        for sample in (x, x[:3], np.eye(x.shape[1])):
            short = embdedup.lead(x, embdedup.axes(sample))
            assert short.shape[1] <= embdedup.LEAD + 1 and (short @ short.T >= x @ x.T - embdedup.SLACK).all()
            found = list(embdedup.linked_pairs(x, short, at[::2], x, short, at, 0.95))
            got = set(zip(np.concatenate([r for r, _ in found]).tolist(), np.concatenate([s for _, s in found]).tolist(), strict=True))
            assert got == {(2 * r, s) for r, s in zip(*np.nonzero(x[::2] @ x.T >= 0.95), strict=True)}


def test_each_pair_of_cells_meets_once(spark, monkeypatch):
    """A pair of vectors is compared at one place, whatever the blocks."""
    x = np.random.default_rng(8).normal(size=(1200, 32))
    df = spark.createDataFrame(list(enumerate(np.repeat(x, 2, 0).tolist())), "vec_id long, embedding array<double>")
    compared = spark.sparkContext.accumulator(0)
    plain = embdedup.linked_pairs

    def counted(x, x_lead, rows, y, y_lead, others, threshold):
        compared.add(len(rows) * len(others))
        return plain(x, x_lead, rows, y, y_lead, others, threshold)

    monkeypatch.setattr(embdedup, "linked_pairs", counted)
    assert embdedup.near_duplicates(df, cell=60, block=200).where("n_links = 1").count() == 2400
    assert 0 < compared.value <= 0.6 * len(x) ** 2


def test_dense_groups_over_blocks_of_cells(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([[c + rng.normal(scale=0.03, size=(250, 24)) for c in rng.normal(size=(2, 24))][k] for k in (0, 1)] + [rng.normal(size=(100, 24))])
    x = np.concatenate([x, x[:40]])
    rows = [(i % 590, v) for i, v in enumerate(x.tolist())]  # copies, and repeated ids
    unit = embdedup.unit(x)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    ids = np.array([i for i, _ in rows])
    link = collections.defaultdict(set)
    for a, b in zip(*np.nonzero(near), strict=True):
        link[ids[a]].add(ids[b])
    component = reach(ids.tolist(), link)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embdedup.near_duplicates(df, cell=100, block=32).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted((int(i), int(n), component[i]) for i, n in zip(ids, near.sum(1), strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(999, i) for i in range(1000, 2200)] + [(7, 7), (5, 4)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys(range(999, 2200), 999)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 8


def test_elias_fano():
    rng = np.random.default_rng(0)
    for universe, n in ((1 << 64, 500), (1 << 64, 2), (1 << 40, 1000), (50, 20), (10, 0), (1, 1)):
        values = np.unique(rng.integers(0, universe, n, dtype=np.uint64)) if universe > 1 else np.zeros(n, np.uint64)
        levels = Levels()
        coded = EliasFano(values, universe, levels)
        coded.open(levels.open())
        asked = np.concatenate([values, rng.integers(0, universe, 300, dtype=np.uint64)]) if universe > 1 else values
        place, equal = coded.successors(asked)
        np.testing.assert_array_equal(place, np.searchsorted(values, asked))
        np.testing.assert_array_equal(equal, np.isin(asked, values))
        if universe < 1 << 63:
            np.testing.assert_array_equal(coded.value(np.arange(len(values))), values.astype(np.int64))


def test_elias_fano_is_searched_as_coded():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 50, 200_000)).astype(np.uint64)
    levels = Levels()
    coded = EliasFano(values, 1 << 50, levels)
    coded.open(levels.open())
    resident = sum(x.nbytes for x in vars(coded).values() if isinstance(x, np.ndarray) and x.base is None)
    assert levels.size < 0.55 * values.nbytes and resident < 0.2 * levels.size
    place, equal = coded.successors(values[::7])
    assert equal.all() and (place == np.arange(0, len(values), 7)).all()


@pytest.mark.parametrize("parts", [1, 5])
def test_lm(spark, odd, docs, parts):
    for table in (odd, docs.limit(60)):
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        rows = [(r["doc_id"], [*ascii_words(r["text"]), None]) for r in table.collect()]
        grams = collections.Counter()
        for i, words in rows:
            if not held(i):
                padded = ["<s>", *words]
                grams.update((w,) for w in words)
                for size in (2, 3):
                    grams.update(tuple(padded[k : k + size]) for k in range(len(padded) - size + 1))
        single = {g[0]: k for g, k in grams.items() if len(g) == 1}
        n, kinds = sum(single.values()), len(single)
        context, follow = collections.Counter(), collections.Counter()
        for g, k in grams.items():
            context[g[:-1]] += k
            follow[g[:-1]] += 1

        def p(history, w):
            if not history:
                return (single.get(w, 0) + 1) / (n + kinds + 1)
            shorter = p(history[1:], w)
            return (grams[*history, w] + follow[history] * shorter) / (context[history] + follow[history]) if context[history] else shorter

        def score(words):
            padded = ["<s>", *words]
            return sum(math.log10(p((), w)) for w in words), sum(math.log10(p(tuple(padded[max(0, k - 2) : k]), padded[k])) for k in range(1, len(padded)))

        got = lm.score(table, ~F.coalesce(queries.remainder(F.col("doc_id"), 7) == 2, F.lit(False)), parts).collect()
        want = collections.defaultdict(list)
        for i, words in rows:
            want[i].append((len(words), sum(single.get(w, 0) > 0 for w in words), *score(words)))
        assert len(got) == len(rows)
        for r in got:
            n_tokens, n_known, plain, total = min(want[r["doc_id"]], key=lambda x: abs(x[2] - r["base_score"]))
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, n) and r["training"] != held(r["doc_id"])
            assert r["base_score"] == pytest.approx(plain) and r["score"] == pytest.approx(total, abs=0.02 * n_tokens)
    assert lm.score(odd.limit(0), F.lit(True), parts).count() == 0


def test_ngram_query(spark, docs):
    texts = {r["doc_id"]: [*ascii_words(r["text"]), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    single = collections.Counter(w for i, words in texts.items() if not held[i] for w in words)
    n = sum(single.values())
    got = queries.op8_ngram_score(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        words = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(words), sum(single[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((single[w] + 1) / (n + len(single) + 1)) for w in words)) and r["score"] <= 0
    better = [r["score"] > r["base_score"] for r in got if not r["held_out"] and r["n_tokens"] > 20]
    assert np.mean(better) > 0.95


# -- 9


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(450)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (600, None), (700, [float("inf")] * 8), (800, [1.0, 2.0]), (801, [3.0, 1.0]), (900, [None] * 8), (950, [])]
    fine = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows if x and all(v is not None and math.isfinite(v) for v in x)]
    want = set()
    for q, x in fine:
        if q % 100 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in fine if i != q and len(y) == len(x))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked[:10])}
    df = spark.createDataFrame([(i, x, "c") for i, x in rows], "vec_id long, embedding array<double>, score string")
    for options in ({}, {"candidates": 50, "queries": 2, "pivots": 3}, {"sample": 20, "candidates": 100}):
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, **options).collect()}
        assert got == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_pivots_eliminate_candidates_where_vectors_form_groups(spark):
    """Most candidates of grouped vectors are never evaluated; of vectors in random directions nearly all are, whatever the pivots."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    grouped = centres[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 32))
    for x, most in ((grouped, 0.1), (rng.normal(size=(3000, 32)), 1.0)):
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
        assert topk.evaluated_share(df, candidates=1000) < most
        q = np.floor(1024 * x).astype(int)
        got = {(r["query_id"], r["rank"]): r["score"] for r in topk.top_k(df, candidates=1000).collect()}
        assert got == {(i, k + 1): s for i in range(0, 3000, 100) for k, s in enumerate(np.sort(np.delete(q @ q[i], i))[::-1][:10])}


def test_top_k_stops_early_and_big_numbers():
    rng = np.random.default_rng(0)
    c = np.floor(1024 * np.concatenate([rng.normal(size=(3000, 4)) * 0.01, rng.normal(size=(20, 4)) * 50]))
    pivots = topk.far_apart(c, 32)
    table = topk.distances(c, pivots)
    q = c[-1:]
    floor = topk.floors(np.array([-1]), q, np.arange(0, len(c), 7), c[::7], 10)
    *_, evaluated = topk.block_top(np.array([-1]), q, np.array([topk.LEAST]), table[-1:], np.arange(len(c)), c, table, 10)
    _, ids, found, fewer = topk.block_top(np.array([-1]), q, floor, table[-1:], np.arange(len(c)), c, table, 10)
    assert fewer <= evaluated < len(c) / 4 and found == sorted((c @ q[0]).astype(int), reverse=True)[: len(found)] and len(found) == 10
    assert topk.exact_scores(np.array([2.0**40, 1.0]), np.array([[2.0**20, 3.0], [2.0**40, 0.0]])).tolist() == [2**60 + 3, 2**63 - 1]


# -- 10


def jaccard_components(rows, width, percent=80):
    sets = []
    for i, text in rows:
        w = ascii_words(text)
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    link = collections.defaultdict(set)
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            link[a].add(b)
            link[b].add(a)
    return {i: len(s) for i, s in sets}, reach([i for i, _ in rows], link)


@pytest.mark.parametrize("options", [{}, {"block": 3}])
@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, width, options):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(w if rng.random() > 0.05 else "new" for w in words) for _ in range(25)]
    rows = [(i, x) for i, x in enumerate([*ODD, *near])] + [(1000 + r["doc_id"], r["text"]) for r in docs.limit(120).collect()]
    n, component = jaccard_components(rows, width)
    df = spark.createDataFrame([(i, x, 1, "k") for i, x in rows], "doc_id long, text string, cls int, keys string")
    got = minhash.near_duplicates(df, width=width, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (n[r["doc_id"]], component[r["doc_id"]], component[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_the_tables(spark):
    """Pairs of a known similarity that share a key, against the share that the tensored tables promise."""
    rng = np.random.default_rng(0)
    for similarity, least in ((0.8, 0.995), (0.85, 0.999)):
        common, own = round(200 * similarity), round(200 * (1 - similarity) / 2)
        shared = 0
        for _ in range(400):
            x = rng.integers(0, 2**63, common + 2 * own).astype(np.uint64)
            one, other = (set(minhash.table_keys(np.sort(part), 2, 8).tolist()) for part in (x[: common + own], np.concatenate([x[:common], x[common + own :]])))
            shared += bool(one & other)
        assert shared / 400 >= least


def test_blocks_of_a_group_with_a_frequent_neighbour(spark):
    """More copies of one text than a block holds, and another group: all links are found in several blocks."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if k != i % 120 else f"n{i}" for k, w in enumerate(words))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"z{k}" for k in range(i, i + 60))) for i in range(0, 120, 3)]
    _, component = jaccard_components(rows, 2)
    for block in (7, 64, 1024):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2, block=block).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == component


def test_loose_groups(spark):
    """A chain of sets, each like the next only: a group much larger than its buckets."""
    texts = [" ".join(f"v{k}" for k in range(i * 3, i * 3 + 40)) for i in range(80)]
    rows = list(enumerate(texts))
    n, component = jaccard_components(rows, 1)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1, block=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == component


def test_repeated_rows(spark, odd):
    got = minhash.near_duplicates(odd, width=2).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (9, 10)} == {9}


# -- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.keep_good(spark, docs, SF).cache()
    kept = {r["doc_id"] for r in good.collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.95
    single = corpus_pipeline.drop_near_duplicates(spark, good, SF).cache()
    _, component = jaccard_components([(r["doc_id"], r["text"]) for r in good.collect()], 5)
    assert {r["doc_id"] for r in single.collect()} == {i for i, c in component.items() if i == c}
    private = corpus_pipeline.redact_personal_data(spark, single, SF).cache()
    assert private.columns == docs.columns and not any(base(r["text"]) for r in private.collect())
    mixed = corpus_pipeline.mix_sources(spark, private, SF)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 2 and set(copies) <= {r["doc_id"] for r in private.collect()}
    encoder = bpe.encoding(queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pattern())
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    last = corpus_pipeline.encode(spark, mixed, SF).collect()
    assert collections.Counter(r["doc_id"] for r in last) == copies
    for r in last[:20]:
        ids = encoder.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_dedup_decides_by_text(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, one), (1, two), (2, two + " end"), (None, one), (None, three), (None, three), (5, one), (6, ""), (7, " "), (6, ""), (None, None), (None, "")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([(1, one), (1, two), (None, three), (6, ""), (7, " "), (None, None), (None, "")])


def test_stages_keep_values_of_clashing_columns(spark, docs):
    names = ("base", "spans", "digest", "more", "size", "target", "score", "copies", "component", "key")
    table = docs.limit(80).withColumns({name: F.lit(i) for i, name in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, table, SF)
        assert got.columns == table.columns, name
        assert {tuple(r[c] for c in names) for r in got.select(*names).collect()} == {tuple(range(len(names)))}, name


def test_pipeline_takes_odd_rows(spark, odd):
    table = odd.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, SF).count() >= 0
        assert stage(spark, table.limit(0), SF).count() == 0
