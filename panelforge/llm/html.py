"""Main text of web pages by removal of site templates.

Method: every element's subtree is hashed; Spark counts, per host, the pages on which a subtree occurs; subtrees that
recur across many pages of their host are deleted. A hash has the names, class, id and role of a subtree's elements, and
its text where it holds running text or nothing but its tag tells what it is. Of other elements (menus, adverts, footers:
named, and without a paragraph or a heading of their own words) the text is left out and repeated children count once, so
that one slot of a site's layout is one subtree, whatever it shows on a page. A slot goes only if on average it holds less
than MOST of the text of the pages that have it: the slot with the story, where stories have no paragraphs, stays.

Many pages are PAGES of a host, and SHARE of them for a slot; for a subtree with its text, a share that falls with the
square root of the host's pages. Inside a marked article only a recurring block that is no text block, holds none and is
in none goes: a passage that many articles of a host share is still text, and so are links and marks inside of passages.
Elsewhere no inline element goes out of the middle of running text.

On hosts whose pages share templates, what is left of the whole page is the text, but for what is hidden and what others write
(comments, adverts by their class). Counts can't tell on hosts of fewer than PAGES pages, or where nothing recurs: there,
elements whose name, role or class says that they are no main text (menus, footers, forms, ...) go, and if a page marks
its article or main part, only that is kept. Inside an article a class tells only as a whole word, and words with other
meanings (search, related, social, ...) only where there is no running text; nowhere does a class drop an element that
holds most of its page's text.

Templates of a host are at most (subtrees of a page) / SHARE plus those with text, of which a page has few. They are sent
once to each place that has pages of the host, ahead of these: a place takes about PLACE pages of the largest host.

Defined results: null or empty html gives an empty text; an url without a host belongs to the host ""; unclosed and
misnested tags are closed where HTML would; an unfinished tag or comment at the end is dropped; repeated rows
count as pages of their own and give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import cut, slices

#: A subtree is a template if it is on so many pages of its host, and on this share of them (see many()); a slot only if it has less than MOST of their text.
SHARE, PAGES, MOST = 0.3, 4, 0.35
#: Pages of a large host that one place takes, about.
PLACE = 250

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed iframe noframes".split())
#: Elements that hold no main text wherever they are.
NEVER = frozenset("head script style textarea title noscript template nav footer aside form iframe svg math canvas object button select datalist dialog menu audio video map xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Blocks of running text: a shared passage.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr table caption figcaption".split())
#: An element whose start closes an open one of these, up to a boundary.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
BOUNDARY = frozenset("ul ol dl table article section div main body nav aside footer header form blockquote".split())
#: Elements that say nothing of what they hold.
PLAIN = frozenset("html body div span section main article center table tbody tr td ul ol dl b i em strong a font small u".split())
#: Elements whose text is never read: markup, not text.
MARKUP = frozenset("head script style textarea title noscript template svg math canvas object audio video map iframe xmp noembed noframes".split())
#: Whole classes that are no main text even in an article.
CHROME = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice notices newsletter subscribe subscription signup share sharing comment comments respond discussion disqus breadcrumb breadcrumbs nav navbar navigation menu sidebar footer pagination pager".split())
#: Parts of a class, id or role that mark what is no main text.
HINTS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup share sharing social related recommended comment comments respond discussion disqus popup modal overlay widget pagination pager login search complementary contentinfo".split())

#: What is others' text, however long.
OTHERS = frozenset("comment comments respond discussion disqus ad ads advert adverts advertisement advertising hidden".split())

PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/a-zA-Z][^>]*\Z|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"\s+")
WORD = re.compile(r"[^\W_]")


class Node:
    __slots__ = ("digest", "doubtful", "drop", "hinted", "marked", "named", "others", "parts", "running", "size", "slot", "tag", "text_blocks")

    def __init__(self, tag: str, signature: str, drop: bool, marked: bool, named: bool = False, doubtful: bool = False):
        self.tag, self.drop, self.marked, self.named, self.doubtful = tag, drop, marked, named, doubtful
        self.parts: list = [signature]  # then text and nodes, in order
        self.text_blocks = self.running = self.slot = self.hinted = self.others = False
        self.size = 0


def signature(tag: str, raw: str, in_article: bool) -> tuple[str, bool, bool, bool, bool]:
    """What an element's hash starts with, whether it is no main text by itself, whether it marks the main part, whether it has a name of its own, and whether it is no main text unless it has running text."""
    if not raw.strip():
        return tag, tag in NEVER or (tag == "header" and not in_article), tag in ("article", "main"), tag not in PLAIN, False
    found = {name.lower(): a or b or c for name, a, b, c in ATTRIBUTE.findall(raw)}
    known = [found.get(x, "") for x in ("class", "id", "role")]
    words = " ".join(known).lower()
    named = set(re.split(r"[^a-z0-9]+", words))
    whole = set(words.split()) & CHROME
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    hinted = bool(named & HINTS) and tag not in ("html", "body", "article", "main")
    drop = tag in NEVER or hidden or (hinted and (bool(whole) or not in_article)) or (tag == "article" and bool(named & {"comment", "comments", "ad", "ads"})) or (not in_article and (tag == "header" or (known[2] == "banner")))
    return f"{tag} {known}{' hidden' if hidden else ''}", drop, tag in ("article", "main") or known[2] in ("main", "article"), tag not in PLAIN or any(known), hinted and in_article


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("", "", False, False)
    stack, articles = [root], 0
    at, end = 0, len(html)
    # where in the stack the open elements of a name, the blocks and the boundaries are: no tag searches the stack
    places: dict[str, list[int]] = {}
    blocks, bounds = [-1], [-1]

    def close(depth: int) -> None:
        nonlocal articles
        while len(stack) > depth:
            gone = stack.pop()
            articles -= gone.marked
            places[gone.tag].pop()
            for kind in (blocks, bounds):
                if kind[-1] == len(stack):
                    kind.pop()

    def last(tag: str) -> int:
        return (places.get(tag) or [-1])[-1]

    while at < end:
        m = PIECE.match(html, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                stack[-1].parts.append(entities.unescape(piece) if "&" in piece else piece)
            continue
        tag = tag.lower()
        if m.group(1):
            if last(tag) > (-1 if tag in BOUNDARY or tag in ("html", "body") else bounds[-1]):
                close(last(tag))
            continue
        if tag in BLOCK and last("p") > -1 and last("p") == blocks[-1]:
            close(last("p"))
        if tag in CLOSES and (nearest := max(map(last, CLOSES[tag]))) > bounds[-1]:
            close(nearest)
        signed, drop, marked, named, doubtful = signature(tag, m.group(3), articles > 0)
        node = Node(tag, signed, drop, marked, named, doubtful)
        node.others = drop and bool(OTHERS & set(re.split(r"[^a-z0-9]+", signed.lower())))
        node.hinted = drop and not node.others and tag not in NEVER
        stack[-1].parts.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            if stop:
                at = html.find(">", stop.start()) + 1 or end
            else:
                at = end
        elif tag not in VOID and not m.group(3).endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            for kind, of in ((blocks, BLOCK), (bounds, BOUNDARY)):
                if tag in of:
                    kind.append(len(stack))
            stack.append(node)
            articles += marked
    return root


def hashed(root: Node) -> None:
    """Sets digest, size (characters of text), text_blocks (whether it is or holds a text block), running (whether a text block in it has text outside of links) and slot (whether its digest leaves text out) of all nodes; drops what is doubtful and has no running text, and keeps what only its name drops and holds most of the page's text."""
    from xxhash import xxh3_64

    named: list[Node] = []
    todo = [(root, False, False, False)]
    while todo:
        node, ready, linked, article = todo.pop()
        linked, article = linked or node.tag == "a", article or node.marked
        if not ready:
            todo.append((node, True, linked, article))
            todo += [(x, False, linked, article) for x in node.parts[1:] if isinstance(x, Node)]
            continue
        exact, shapes, own = xxh3_64(node.parts[0].encode("utf-8", "surrogatepass")), set(), False
        node.text_blocks = node.tag in TEXT
        for x in node.parts[1:]:
            if isinstance(x, Node):
                exact.update(b"<%d>" % x.digest)
                if x.size or x.named:
                    shapes.add(x.digest if x.slot else b"text" if x.running else x.parts[0])
                node.text_blocks |= x.text_blocks
                own |= x.running
                if x.tag not in MARKUP:
                    node.size += x.size
            elif words := " ".join(x.split()):
                exact.update(words.encode("utf-8", "surrogatepass"))
                if node.tag not in MARKUP:
                    node.size += len(words)
                own |= not linked
        # text of inline elements counts for the text block that they are in
        node.running = own and (node.text_blocks or node.tag not in BLOCK)
        node.slot = node.named and not article and not node.running
        if node.slot:
            exact = xxh3_64(node.parts[0].encode("utf-8", "surrogatepass") + repr(sorted(map(str, shapes))).encode("utf-8", "surrogatepass"))
        node.digest = exact.intdigest() - (1 << 63)
        node.drop |= node.doubtful and not node.running
        if node.hinted and node.text_blocks:
            named.append(node)
    for node in named:
        node.drop &= 2 * node.size <= root.size


def main_parts(root: Node) -> list[Node]:
    """The outermost marked parts with text outside dropped elements; else the whole page."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.drop:
            continue
        if node.marked and node.size:
            found.append(node)
        else:
            todo += [x for x in reversed(node.parts[1:]) if isinstance(x, Node)]
    articles = [x for x in found if x.tag != "main"]
    return articles if articles and len(articles) == len(found) else found or [root]


def deletable(root: Node, parts: list[Node]) -> list[Node]:
    """The elements with text that may be templates.

    In a marked part these are blocks that are no running text, hold none and are in none; elsewhere all but the
    inline elements inside of running text.
    """
    marked = {id(x) for x in parts if x is not root}
    found, todo = [], [(root, False, False, False)]
    while todo:
        node, inside, below, beside = todo.pop()
        part, text, block = id(node) in marked, node.tag in TEXT, node.tag in BLOCK or node.tag in TEXT
        kept = inside and (below or node.text_blocks or not block) or not block and (below or beside)
        if node.size and node.tag and node.tag not in ("html", "body") and not part and not kept:
            found.append(node)
        inside, below, beside = inside or part, not part and (below or text), beside and not block
        if not inside and not below:
            beside |= any(isinstance(x, str) and WORD.search(x) for x in node.parts[1:])
        todo += [(x, inside, below, beside) for x in node.parts[1:] if isinstance(x, Node)]
    return found


def subtrees(html: str | None) -> dict[int, tuple[bool, float]]:
    """By digest, the element subtrees of a page that may be templates: whether it is a slot, and its share of the page's text."""
    root = parse(html or "")
    hashed(root)
    found: dict[int, tuple[bool, float]] = {}
    for x in deletable(root, main_parts(root)):
        slot, share = found.get(x.digest, (x.slot, 0.0))
        found[x.digest] = slot, share + x.size / max(root.size, 1)
    return found


def main_text(html: str | None, templates: set[int] | None, names: bool = True) -> tuple[str, int]:
    """The main text, and how many subtrees, not counting those in others, are templates.

    templates: those of the page's host; what is left of the whole page is the text then, but for hidden elements and what
    others write. None: the host has too few pages to tell; names and the article's mark decide (unless names is False).
    """
    root = parse(html or "")
    hashed(root)
    marked = main_parts(root)
    parts = marked if names and templates is None else [root]
    gone = {id(x) for x in deletable(root, marked) if x.digest in templates} if templates else set()
    deleted, todo = 0, [root] if gone else []
    while todo:
        node = todo.pop()
        deleted += id(node) in gone
        todo += [x for x in node.parts[1:] if isinstance(x, Node)] if id(node) not in gone else []
    alone = names and templates is None
    dropped = lambda x: x.drop if alone else x.tag in MARKUP or names and x.others
    blocks: list[str] = []
    current: list[str] = []

    def flush() -> None:
        if words := SPACES.sub(" ", "".join(current)).strip():
            blocks.append(words)
        current.clear()

    for part in parts:
        todo: list = [part]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                current.append(x)
            elif x is not part and (dropped(x) or id(x) in gone):
                if x.tag in BLOCK:
                    flush()
            elif x.tag in VOID:
                flush() if x.tag == "hr" else current.append(" " if x.tag == "br" else "")
            else:
                block = x.tag in BLOCK
                if block:
                    flush()
                    todo.append(None)
                elif x.tag in ("td", "th"):
                    todo.append(" ")
                todo += x.parts[:0:-1]
        flush()
    return "\n".join(blocks), deleted


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def many(pages, slot, share: float, least: int):
    """On how many of a host's pages a template is: least, and share of them if it is a slot; with its text, a share that falls from that of least pages as their number rises."""
    return F.greatest(F.lit(least), F.when(slot, share * pages).otherwise(share * F.sqrt(F.lit(float(least)) * pages)))


def site_templates(pages: DataFrame, share: float = SHARE, least: int = PAGES, most: float = MOST) -> DataFrame:
    """host, of (its pages), digest: a row for each template of hosts with at least `least` pages, and one with a null digest for each of these hosts."""

    def run(batches):
        for batch in slices(batches):
            found = [subtrees(x.as_py()) for x in batch.column(1)]
            # the null digest stands for the page itself
            rows = [[{"digest": None, "slot": False, "share": 1.0}, *({"digest": d, "slot": slot, "share": of} for d, (slot, of) in sorted(x.items()))] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.struct([("digest", pa.int64()), ("slot", pa.bool_()), ("share", pa.float64())])))], names=["host", "found"])

    found = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, found array<struct<digest:long,slot:boolean,share:double>>")
    counted = found.select("host", F.inline("found")).groupBy("host", "digest", "slot").agg(F.count("*").alias("n"), F.avg("share").alias("share"))
    # cut, as the pages' own counts and the subtrees' would each parse all pages
    counted = cut(counted.where((F.col("n") >= least) & (F.col("digest").isNull() | ~F.col("slot") | (F.col("share") < most))))
    total = counted.where("digest is null").select("host", F.col("n").alias("of"))
    often = counted.where("digest is not null").join(total, "host").where(F.col("n") >= many(F.col("of"), F.col("slot"), share, least))
    return total.select("host", "of", F.lit(None).cast("long").alias("digest")).union(often.select("host", "of", "digest"))


def extract(pages: DataFrame, share: float = SHARE, least: int = PAGES, most: float = MOST, names: bool = True, counts: bool = True) -> DataFrame:
    """page_id, url, text, n_deleted (template subtrees of the page, not counting those in others). counts=False leaves the templates out."""
    pages = pages.select("page_id", "url", "html")
    templates = cut(site_templates(pages, share, least, most))
    known = templates if counts else templates.where("digest is null")
    # a host may have a third of all pages: those of more than PLACE pages, and of a share that at most a thousand hosts can have, are dealt to several places
    sizes = templates.where("digest is null").select("host", "of")
    total = sizes.agg(F.sum("of")).first()[0] or 0
    large = F.broadcast(sizes.where((F.col("of") > PLACE) & (F.col("of") * 1000 >= total)).select("host", F.ceil(F.col("of") / PLACE).cast("int").alias("places")))
    places = F.coalesce("places", F.lit(1))
    none = {name: F.lit(None).cast(kind).alias(name) for name, kind in (("page_id", "long"), ("url", "string"), ("html", "string"), ("digest", "long"))}
    sent = known.join(large, "host", "left").select("host", F.explode(F.sequence(F.lit(0), places - 1)).alias("salt"), F.lit(0).alias("turn"), "digest", none["page_id"], none["url"], none["html"])
    hosted = pages.withColumn("host", host_of(F.col("url"))).join(large, "host", "left")
    salted = hosted.select("host", F.pmod(F.xxhash64("page_id", "url"), places).cast("int").alias("salt"), F.lit(1).alias("turn"), none["digest"], "page_id", "url", "html")
    dealt = sent.union(salted).repartition("host", "salt").sortWithinPartitions("host", "salt", "turn")

    def run(batches):
        place, of_host = None, None
        for batch in slices(batches):
            out = []
            for host, salt, turn, digest, page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (host, salt) != place:
                    place, of_host = (host, salt), None
                if turn == 0:
                    of_host = set() if of_host is None else of_host
                    of_host |= {digest} - {None}
                else:
                    # a host whose pages share nothing is as one of too few pages
                    out.append((page_id, url, *main_text(html, of_host if of_host or not counts else None, names)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "text", "n_deleted"])

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_deleted long")
