"""Personal data: base patterns, and contextual extraction bootstrapped from them. DataFrame functions only.

Method: the base patterns' finds are seed entities. Each of them, blanks included, is an occurrence of an identifier;
others are the runs of non-blanks with a digit or an at sign and the rows of such numbers between blanks, beside base
spans. An occurrence has lexical patterns: the two words before it, and the word before with the word after. Patterns and
identifiers are the two sides of a graph. In each round a pattern's confidence for a kind is the score of its
identifiers known as that kind, over all its identifiers; confident patterns with enough known identifiers, of the base
or discovered, give unknown identifiers a score, 1 - product of (1 - confidence); those above a bound are known in the
next round, as long as any are added. Occurrences
of identifiers so discovered, beside a confident pattern, are added; base spans always stay.

An occurrence's words are sought between it and the base or digit-bearing match before or after it, that one included,
however far away it is. All steps are linear in a text's length and in the number of its matches.

Defined results: null and empty texts have no spans; repeated rows have equal spans; rows with a null id keep it;
ties between kinds go to the first listed; extra columns are kept, but find() has its own base and spans in place of
columns so called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import SPACE, cut

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Possessive repeats and the conditions on a start change no match: they only keep the engine from trying what can't match again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stands for the characters of base spans where other identifiers are sought.
MASK = "\uffff"
IDENTIFIER = rf"(?<![^{SPACE}])[^{SPACE}0-9@{MASK}]*+[0-9@][^{SPACE}{MASK}]*+(?![^{SPACE}])"
NUMBER = rf"[^{SPACE}0-9{MASK}]*+[0-9][^{SPACE}{MASK}]*+(?![^{SPACE}])"
#: Two or more runs with a digit, with blanks between; a plus sign starts a new one.
NUMBERS = rf"(?<![^{SPACE}]){NUMBER}(?:\x20++(?:[().-]++\x20++)*+(?!\+){NUMBER})++"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Confidence of a pattern, its distinct known identifiers, score of an identifier, all at least.
CONFIDENCE, SEEDS, SCORE = 0.8, 5, 0.8
#: Values that are scanned in one go, characters of a piece of a text: only matters of speed.
BLOCK, PIECE = 128, 128
SPAN = "array<struct<start:int,k:int,end:int>>"


def luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def worth(i):
        d = F.substring(backwards, i, 1).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def let(body, **columns: Column) -> Column:
    """body of a struct of the columns, each of which is evaluated once per row, even where body uses it within a loop."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])), body), 0)


def scanned(values: Column, combine) -> Column:
    """For each of some integers, all before it combined, from 0 on. Blocks of BLOCK, and then their totals, are folded by themselves: a fold copies what it has at every step."""
    fresh = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))
    fold = lambda x: F.aggregate(x, fresh, lambda s, v: F.struct(combine(s["last"], v).alias("last"), F.array_append(s["out"], s["last"]).alias("out")))

    def join(s):
        offsets = fold(F.transform(s["blocks"], lambda b: b["last"]))["out"]
        return F.flatten(F.zip_with(s["blocks"], offsets, lambda b, o: F.transform(b["out"], lambda x: combine(o, x))))

    def scan(s):
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(s["values"]), F.lit(1)), F.lit(BLOCK)), lambda at: fold(F.slice(s["values"], at, F.lit(BLOCK))))
        return let(join, blocks=blocks)

    return let(scan, values=values)


def located(found: Column, gaps: Column) -> Column:
    """array<struct<start, end, found, left, right>> of matches, from the matches and the text between them, in code points; left and right reach to the matches before and after, inclusively."""

    def place(s):
        def span(x, i):
            start = F.get(s["before"], i) + F.length(F.get(s["gaps"], i))
            left, right = F.concat(F.coalesce(F.get(s["found"], i - 1), F.lit("")), F.get(s["gaps"], i)), F.concat(F.get(s["gaps"], i + 1), F.coalesce(F.get(s["found"], i + 1), F.lit("")))
            return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("found"), left.alias("left"), right.alias("right"))

        return F.transform(s["found"], span)

    def measure(s):
        lengths = F.transform(s["found"], lambda x, i: F.length(F.get(s["gaps"], i)) + F.length(x))
        return let(place, found=s["found"], gaps=s["gaps"], before=scanned(lengths, lambda a, b: a + b))

    none = F.array().cast("array<struct<start:int,end:int,found:string,left:string,right:string>>")
    return F.when(F.size(found) > 0, let(measure, found=found, gaps=gaps)).otherwise(none)


def matches(df: DataFrame, name: str, pattern: str, guard: Column, text: str) -> DataFrame:
    """Adds name: the located matches of pattern in the column text."""
    found, gaps = f"{name}_found", f"{name}_gaps"
    none = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(guard, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(none))
    return df.withColumn(name, located(F.col(found), F.col(gaps))).drop(found, gaps)


def of_kind(name: str, k: int) -> Column:
    """The valid matches of the kind numbered k, as spans."""
    kept = F.filter(name, lambda s: valid(KINDS[k], s["found"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end")))


def base_spans(docs: DataFrame, text: str = "text", base: str = "base") -> DataFrame:
    """docs with base (SPAN: start, number of the kind, end), sorted."""
    value = F.col(text)
    guards = {"email": value.contains("@"), "phone": value.contains("+")}
    for kind in KINDS:
        docs = matches(docs, f"__{kind}", PATTERNS[kind], guards.get(kind, value.rlike("[0-9]")), text)
    parts = [of_kind(f"__{kind}", k) for k, kind in enumerate(KINDS)]
    return docs.withColumn(base, F.array_sort(F.concat(*parts)).cast(SPAN))


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with by(span, n, fresh) for the n characters of each sorted span that no span before it covers; fresh: it begins a run of overlapping spans.

    The text is cut in pieces of PIECE characters, and what is between spans is put together from those it touches: a
    substring far into a long text would be sought from its start each time.
    """

    def piece(s, start, size):
        first, last = F.floor(start / PIECE).cast("int"), F.floor((start + size - 1) / PIECE).cast("int")
        return F.when(size > 0, F.substring(F.array_join(F.slice(s["pieces"], first + 1, last - first + 1), ""), start % PIECE + 1, size)).otherwise(F.lit(""))

    def put(s):
        def one(span, i):
            at = F.get(s["reached"], i)
            return F.concat(piece(s, at, span["start"] - at), by(span, F.greatest(span["end"] - F.greatest(at, span["start"]), F.lit(0)), span["start"] >= at))

        end = F.array_max(F.transform(s["spans"], lambda x: x["end"]))
        return F.concat(F.array_join(F.transform(s["spans"], one), ""), piece(s, end, s["size"] - end))

    cut_up = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1))
    reached = scanned(F.transform(spans, lambda x: x["end"]), F.greatest)
    return F.when(F.size(spans) > 0, let(put, pieces=cut_up, spans=spans, reached=reached, size=F.length(text))).otherwise(text)


def before(left: Column) -> Column:
    """The end of a text with its last two words, the whole of it where they don't end early."""
    return F.when(F.size(F.split(F.right(left, F.lit(200)), f"[{SPACE}]+", 5)) > 3, F.right(left, F.lit(200))).otherwise(left)


def after(right: Column) -> Column:
    return F.when(F.size(F.split(F.left(right, F.lit(100)), f"[{SPACE}]+", 4)) > 2, F.left(right, F.lit(100))).otherwise(right)


def occurrence(start, found, left, right, kind, main) -> Column:
    return F.struct(start.alias("start"), (start + F.length(found)).alias("end"), found.alias("identifier"), kind.alias("kind"), main.alias("main"), before(left).alias("left"), after(right).alias("right"))


def candidate(s: Column, lead: str, main: Column) -> Column:
    """A match without punctuation around it, of no known kind."""
    opening = F.regexp_extract(s["found"], lead, 1)
    inner = F.substring(s["found"], F.length(opening) + 1, F.length(s["found"]))
    bare = F.regexp_replace(inner, r"""[)"'>\]}.,;:!?]++$""", "")
    rest = F.substring(inner, F.length(bare) + 1, F.length(inner))
    return occurrence(s["start"] + F.length(opening), bare, F.concat(s["left"], opening), F.concat(rest, s["right"]), F.lit(None).cast("int"), main)


def seeds_of(k: int) -> Column:
    kept = F.filter(f"__{KINDS[k]}", lambda s: valid(KINDS[k], s["found"]))
    return F.transform(kept, lambda s: occurrence(s["start"], s["found"], s["left"], s["right"], F.lit(k), F.lit(True)))


def occurrences(spanned: DataFrame) -> DataFrame:
    """doc_id, digest, start, end, identifier, kind (null: unknown), main, pattern: a row for each pattern of each identifier.

    A row of numbers whose first run is an identifier by itself isn't main: it doesn't count as another of the pattern.
    """
    spanned = spanned.withColumn("masked", replaced(F.col("text"), F.col("base"), lambda s, n, fresh: F.repeat(F.lit(MASK), n)))
    spanned = matches(spanned, "runs", IDENTIFIER, F.col("masked").rlike("[0-9@]"), "masked")
    spanned = matches(spanned, "numbers", NUMBERS, F.col("masked").rlike("[0-9]"), "masked")
    seeds = [seeds_of(k) for k in range(len(KINDS))]
    runs = F.transform("runs", lambda s: candidate(s, r"""^([("'<\[{]*)""", F.lit(True)))
    first = lambda s: F.regexp_replace(F.regexp_extract(s["found"], rf"^([^{SPACE}]+)", 1), r"""^[("'<\[{]+|[)"'>\]}.,;:!?]++$""", "")
    rows = F.transform("numbers", lambda s: candidate(s, r"""^([("'<\[{]*?)(?:\([0-9]+\)|[^("'<\[{])""", F.length(first(s)) < 6))
    free = F.filter(F.concat(runs, rows), lambda s: F.length(s["identifier"]) >= 6)
    each = spanned.select("doc_id", "digest", F.explode(F.concat(*seeds, free)).alias("s")).select("doc_id", "digest", "s.*")
    # the last part before it and the first one after it are glued to it, or empty
    left, right = (F.split(F.lower(F.regexp_replace(x, f"{MASK}+", MASK)), f"[{SPACE}]+", -1) for x in ("left", "right"))
    each = each.select("doc_id", "digest", "start", "end", "identifier", "kind", "main", F.try_element_at(left, F.lit(-3)).alias("w2"), F.try_element_at(left, F.lit(-2)).alias("w1"), F.try_element_at(right, F.lit(2)).alias("next"))
    both = F.when((F.col("w1") != "") & (F.col("w2") != ""), F.concat_ws(" ", F.lit("<"), "w2", "w1"))
    around = F.when((F.col("w1") != "") & (F.col("next") != ""), F.concat_ws(" ", F.lit("|"), "w1", "next"))
    return each.select("doc_id", "digest", "start", "end", "identifier", "kind", "main", F.explode(F.filter(F.array(both, around), lambda p: p.isNotNull())).alias("pattern"))


def discover(spanned: DataFrame, confidence: float = CONFIDENCE, seeds: int = SEEDS, score: float = SCORE) -> DataFrame | None:
    """doc_id, digest, more (SPAN) of the documents in which the patterns find what the base does not; None if there are none."""
    found = cut(occurrences(spanned))
    edges = found.groupBy("pattern", "identifier").agg(F.min("kind").alias("kind"), F.max("main").alias("main"))
    # what has fewer identifiers than a pattern needs known ones can't become confident in any round
    totals = cut(edges.groupBy("pattern").agg(F.count_if("main").alias("total")).where(F.col("total") >= seeds))
    edges = cut(edges.join(totals.select("pattern"), "pattern"))
    known = cut(edges.where("kind is not null").groupBy("identifier").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)))
    while True:
        scored = edges.where("main").select("pattern", "identifier").join(known, "identifier").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("of_kind"))
        enough = scored.groupBy("pattern").agg(F.sum("of_kind").alias("known")).where(F.col("known") >= seeds)
        trusted = cut(scored.join(enough, "pattern").join(totals, "pattern").select("pattern", "kind", (F.col("mass") / F.col("total")).alias("confidence")).where(F.col("confidence") >= confidence))
        fresh = edges.where("kind is null").join(trusted.withColumnRenamed("kind", "of"), "pattern").groupBy("identifier", "of").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12)))))).alias("score"))
        best = fresh.where(F.col("score") >= score).groupBy("identifier").agg(F.max_by("of", F.struct("score", -F.col("of"))).alias("kind"), F.max("score").alias("score"))
        added = cut(best.join(known.select("identifier"), "identifier", "left_anti"))
        if added.isEmpty():
            break
        known = cut(known.union(added.select(*known.columns)))
    unknown = found.where("kind is null").join(known.select("identifier", F.col("kind").alias("of")), "identifier")
    beside = unknown.join(trusted.select("pattern", F.col("kind").alias("of")), ["pattern", "of"])
    spans = F.array_sort(F.collect_set(F.struct(F.col("start"), F.col("of").alias("k"), F.col("end")))).cast(SPAN)
    more = cut(beside.groupBy("doc_id", "digest").agg(spans.alias("more")))
    return None if more.isEmpty() else more


def find(docs: DataFrame, **options) -> DataFrame:
    """docs with base and spans (SPAN), both sorted by start, then kind, in place of columns of these names."""
    columns = [c for c in docs.columns if c not in ("base", "spans")]
    own = docs.select(F.col("doc_id").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row")).withColumn("digest", F.xxhash64("text"))
    spanned = base_spans(own)
    more = discover(spanned.drop("__row"), **options)
    given = [F.col("__row")[c].alias(c) for c in columns]
    if more is None:
        return spanned.select(*given, "base", F.col("base").alias("spans"))
    more = more.select(F.col("doc_id").alias("__of"), F.col("digest").alias("__digest"), "more")
    joined = spanned.join(more, F.col("doc_id").eqNullSafe(F.col("__of")) & (F.col("digest") == F.col("__digest")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))))
    return joined.select(*given, "base", every.alias("spans"))


def written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs, with every span of text, overlapping ones together, replaced by the kind of the first in angle brackets. All columns keep their values, whatever their names."""
    names = F.array(*[F.lit(f"<{kind.upper()}>") for kind in KINDS])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = find(docs.select("doc_id", "text", row.alias("__given")), **options)
    text = replaced(F.col("text"), F.col("spans"), lambda s, n, fresh: F.when(fresh, F.get(names, s["k"])).otherwise(F.lit("")))
    return found.withColumn("__text", text).select(*[F.col("__text").alias(c) if c == "text" else F.col("__given")[c].alias(c) for c in docs.columns])
