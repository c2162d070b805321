"""Main text of HTML pages by removing site templates.

Each page is parsed into an element tree.  Two hashes are made of every block
element's subtree: one of tags, class, id and normalised text, and one of its
shape with the text masked: the tags, classes and ids from the root down and the
block tags below.  Both are counted per host in Spark over distinct pages, with
the words under a shape, those inside links, and the words of its pages.  The
counts decide for hosts of at least ``COUNTED_PAGES`` distinct pages:

* The content region of a page is found from the root down: the container whose
  shape holds at least half of the words of its host's pages, as far as there is
  one.  A page's article or main element around it belongs to it.
* Outside of it, a subtree goes if its shape or text recurs on many pages
  (``OUTSIDE_PAGES``, ``OUTSIDE_SHARE``): menus, adverts and footers do even where
  their words change.  Headings beside the region stay.
* Inside, a subtree goes if its text is on ``INSIDE_SHARE`` of the pages (in a page
  without a region below its body, as on the outside), or if its shape is on
  ``LINKED_SHARE`` of them, small and mostly links.
* What HTML names a menu, aside, form or footer by tag or role, hidden elements
  and reader comments go anywhere.

Where a host has too few pages to count, class and id words and the article or
main element decide instead.  What is left, in page order, is the article.

Exact copies of a page count once, so that a copied article is no template.  As a
template is on at least a tenth of its host's pages, a host has at most twenty
times as many as a page has elements, whatever the host's size.

Text rules: character references are decoded, white space inside a block is
one space, blocks are trimmed, empty ones dropped, the rest joined by one
newline; a line break element is white space.

Edge cases: null html gives the empty text; a null url counts as the host "";
repeated rows count once and each get their row; an empty table gives an empty
result; extra columns are ignored.  Parsing takes time in proportion to the page.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.llm.common import small_batches, stash

#: Distinct pages that a host needs for its counts to decide.
COUNTED_PAGES = 5
#: Least distinct pages, and least share of a host's distinct pages, of a template subtree.
OUTSIDE_PAGES, OUTSIDE_SHARE = 3, 0.1
INSIDE_PAGES, INSIDE_SHARE, LINKED_SHARE = 10, 0.8, 0.5
#: Share of the words of a content region's pages, and the most that a template of links inside it may have.
CONTENT_WORDS, LINKED_WORDS = 0.5, 0.25
#: Verdicts up to this many (a host name and 9 bytes each) are broadcast, more are joined by host; the pages of hosts
#: of more than ``HOT_PAGES`` are dealt over a task for each so many.
BROADCAST_TEMPLATES, HOT_PAGES = 1 << 19, 1 << 14
#: Bits of a verdict on a hash.
TEXT_OUTSIDE, TEXT_INSIDE, SHAPE_OUTSIDE, SHAPE_INSIDE, CONTENT = 1, 2, 4, 8, 16

# Element names of the HTML standard and usual words of class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
NEVER = frozenset("script style textarea title noscript iframe noframes xmp head template select option button input object embed svg math canvas audio video map datalist dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "legend", "summary"}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu search".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BOILERPLATE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs crumbs sidebar sidebars aside footer masthead banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager skip copyright".split())
CONTAINERS = frozenset("article main section div center td form body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
READER_WORDS = frozenset("comment comments commentlist disqus".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond responses replies reply discussion".split())
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Blocks that an implied end may reach through.
THROUGH = frozenset("p li dt dd tr td th tbody thead tfoot".split())

_TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[^<]++|<""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")  # after an unclosed quote: tags end at the first ">"
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "inside", "drop", "hash", "shape", "path", "words", "links")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []
        self.inside = self.drop = False
        self.hash = self.shape = self.path = self.words = self.links = 0

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Open:
    """The open elements.  Blocks are known by place, and inline elements by their number in each block, so that no
    end tag looks at elements that it does not close."""

    def __init__(self, root: Node):
        self.stack, self.blocks, self.inline = [root], [0], [Counter()]
        self.block_tags: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
            self.inline.append(Counter())
            self.block_tags[node.tag] += 1
        else:
            self.inline[-1][node.tag] += 1
        self.stack.append(node)

    def close(self, place: int) -> None:
        """Close all from ``place`` on."""
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()
                self.inline.pop()
                self.block_tags[tag] -= 1
            else:
                self.inline[-1][tag] -= 1

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            if self.block_tags[tag]:
                self.close(next(i for i in reversed(self.blocks) if self.stack[i].tag == tag and i))
        elif self.inline[-1][tag]:  # a stray inline end tag ends no block
            place = len(self.stack) - 1
            while self.stack[place].tag != tag:
                place -= 1
            self.close(place)

    def implied(self, tag: str) -> None:
        """Close what the start of this element ends."""
        if tag in CLOSES_P and self.stack[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag == "option":
            if self.inline[-1]["option"]:
                self.end("option")
        elif tag in IMPLIED_END:
            for i in reversed(self.blocks[1:]):
                if self.stack[i].tag in IMPLIED_END[tag]:
                    self.close(i)
                    break
                if self.stack[i].tag not in THROUGH:
                    break


def parse(html: str) -> Node:
    """The element tree; never fails, unclosed and stray tags are repaired as browsers do in the usual cases."""
    root = Node("html", {})
    opened = _Open(root)
    stack = opened.stack
    lower, at, size, loose = None, 0, len(html), False
    while at < size:
        m = (loose and _LOOSE.match(html, at)) or _TOKEN.match(html, at)
        if m[0] == "<" and html[at + 1 : at + 3].strip("/")[:1].isalpha():
            loose = True
            m = _LOOSE.match(html, at)
            if not m:  # the page ends inside a tag
                break
        at = m.end()
        if m.re is _TOKEN and not m[2]:
            text = m[0]
            if text[:2] not in ("<!", "<?"):
                stack[-1].children.append(_html.unescape(text) if "&" in text else text)
            continue
        tag = m[2].lower()
        if m[1]:
            opened.end(tag)
            continue
        opened.implied(tag)
        attrs = {}
        if m[3].strip("/ "):
            for a in _ATTR.finditer(m[3]):
                attrs.setdefault((a[1] or a[5]).lower(), _html.unescape(a[2] or a[3] or a[4] or ""))
        if tag == "html":
            root.attrs = root.attrs or attrs
            continue
        if tag == "body" and stack[-1].tag == "head":
            opened.close(len(stack) - 1)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            lower = lower or html.lower()
            end = lower.find("</" + tag, at) if len(lower) == size else -1
            if len(lower) != size:  # lower-casing may change the length of odd text
                found = re.compile("</" + tag, re.I).search(html, at)
                end = found.start() if found else -1
            stop = size if end < 0 else html.find(">", end)
            at = size if stop < 0 else min(size, stop + 1)
        elif tag not in VOID and not m[3].endswith("/"):
            opened.push(node)
    return root


def _words(node: Node) -> set[str]:
    both = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return {w.lower() for w in _WORD.findall(both)} if both != " " else set()


def _hidden(node: Node) -> bool:
    return "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or "display:none" in node.attrs.get("style", "").replace(" ", "").lower()


def _is_region(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role") == "main"


def _top_down(root: Node) -> list[Node]:
    order = [root]
    for node in order:
        order += node.elements()
    return order


def mark_by_words(root: Node) -> bool:
    """Without counts: set ``inside`` (of an article or main region) and ``drop`` (no content); true if there is a region."""
    regions: dict[int, bool] = {}
    for node in reversed(_top_down(root)):
        comment = _words(node) & COMMENT_WORDS and node.tag not in ("html", "body")
        regions[id(node)] = not comment and (_is_region(node) or any(regions[id(c)] for c in node.elements()))
    work = [(root, False)]
    while work:
        node, inside = work.pop()
        words = _words(node)
        own = _is_region(node) and not words & COMMENT_WORDS
        node.inside = inside or own
        if node.tag in NEVER or words & COMMENT_WORDS and node.tag not in ("html", "body"):
            node.drop = True
        elif not own and node.tag not in ("html", "body") and not regions[id(node)]:
            named = node.tag in BOILERPLATE_TAGS or node.attrs.get("role", "").lower() in BOILERPLATE_ROLES or bool(words & BOILERPLATE_WORDS) or _hidden(node)
            site_header = not node.inside and (node.tag == "header" or "header" in words)
            node.drop = named or site_header
        if not node.drop:
            work += [(c, node.inside) for c in node.elements()]
    return regions[id(root)]


def measure(root: Node) -> list[Node]:
    """Set hash, shape, words and links; the block elements below the body, without what is never content."""
    order = [root]
    for node in order:
        below = [c for c in node.elements() if c.tag not in NEVER]
        for c in below:
            # blocks in the path with class and id, digits left out as they number things
            own = f"{c.tag} {c.attrs.get('class', '')} {c.attrs.get('id', '')}" if c.tag in BLOCK and c.tag != "body" else ""
            c.path = xxhash.xxh3_64_intdigest(f"{node.path} {_DIGITS.sub('', own)}") if own else node.path
        order += below
    for node in reversed(order):
        parts = [f"<{node.tag} {node.attrs.get('class', '')} {node.attrs.get('id', '')}>"]
        blocks = set()
        for c in node.children:
            if isinstance(c, str):
                words = c.split()
                parts.append(" ".join(words))
                node.words += len(words)
            elif c.tag not in NEVER:
                parts.append(f"<{c.hash}>")
                node.words += c.words
                node.links += c.links
                if c.tag in BLOCK:
                    blocks.add(c.tag)
        if node.tag == "a":
            node.links = node.words
        node.hash = xxhash.xxh3_64_intdigest("".join(parts)) - (1 << 63)
        node.shape = xxhash.xxh3_64_intdigest(f"{node.path} {sorted(blocks)}") - (1 << 63)
    return [n for n in order if n.tag in BLOCK and n.tag not in ("html", "body") and n.children]


def mark_by_counts(root: Node, verdicts: dict[int, int]) -> None:
    """Set ``drop`` by the host's verdicts on the hashes of this page's subtrees."""
    measure(root)
    region, line = root, [root]
    while True:
        below = [c for c in region.elements() if c.tag == "body" or c.tag in CONTAINERS and verdicts.get(c.shape, 0) & CONTENT]
        if not below:
            break
        region = max(below, key=lambda c: (c.tag == "body", c.words))
        line.append(region)
    whole = next((n for n in line if _is_region(n)), region)  # an article or main element around the region
    above = {id(n) for n in line[: line.index(whole)]}
    below_body = whole.tag not in ("html", "body")
    work = [(root, False, False)]
    while work:
        node, inside, beside = work.pop()
        inside = inside or node is whole
        text_bit = TEXT_INSIDE if inside and below_body else TEXT_OUTSIDE
        found = verdicts.get(node.shape, 0) & (SHAPE_INSIDE if inside else SHAPE_OUTSIDE) | verdicts.get(node.hash, 0) & text_bit
        keeps = node is whole or id(node) in above
        if node.tag in NEVER or node.tag not in ("html", "body") and (_words(node) & READER_WORDS or _hidden(node)):
            node.drop = True
        elif not keeps and node.tag in BLOCK:
            named = node.tag in BOILERPLATE_TAGS or node.attrs.get("role", "").lower() in BOILERPLATE_ROLES
            title = beside and node.tag in HEADINGS and 2 * node.links < node.words and not verdicts.get(node.hash, 0)
            node.drop = named or bool(found) and not title
        if not node.drop:
            # headings beside the region, but not right below the body, are titles
            titled = id(node) in above and node.tag not in ("html", "body") or beside and node.tag in HEADINGS
            work += [(c, inside, titled) for c in node.elements()]


def text_of(root: Node, within: bool) -> str:
    """Blocks of what is left, of the regions only if there is one."""
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        line = " ".join("".join(now).split())
        if line:
            blocks.append(line)
        now.clear()

    work: list = [root]
    while work:
        item = work.pop()
        if item is None:
            flush()
        elif isinstance(item, tuple):
            now.append(item[0])
        elif not item.drop:
            block = item.tag in BLOCK
            if block:
                flush()
                work.append(None)
            if item.tag == "br":
                now.append(" ")
            shown = item.inside or not within
            work += [(c,) if isinstance(c, str) else c for c in reversed(item.children) if shown or not isinstance(c, str)]
    flush()
    return "\n".join(blocks)


def subtree_hashes(html: str) -> list[tuple[int, bool, int, int, int, bool]]:
    """Distinct (hash, whether it is of the shape, words, of them in links, the page's words, whether one container
    has the shape) of a page's block elements; elements of one shape count together."""
    root = parse(html)
    shapes: dict[int, list] = {}
    hashes = set()
    for n in measure(root):
        hashes.add(n.hash)
        one = shapes.setdefault(n.shape, [0, 0, 0, n.tag in CONTAINERS])
        one[0] += n.words
        one[1] += n.links
        one[2] += 1
    found = [(h, False, 0, 0, root.words, False) for h in sorted(hashes)]
    return found + [(h, True, words, links, root.words, container and n == 1) for h, (words, links, n, container) in sorted(shapes.items())]


def main_text(html: str | None, verdicts: dict[int, int] | None = None) -> str:
    """The page's text without what its host's verdicts, or for None (a host of few pages) words, say is no content."""
    if not html:
        return ""
    root = parse(html)
    if verdicts is None:
        return text_of(root, mark_by_words(root))
    mark_by_counts(root, verdicts)
    return text_of(root, False)


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_sizes(pages: DataFrame) -> DataFrame:
    """(host, pages): distinct pages of each host."""
    rows = pages.where(F.col("html").isNotNull()).select(_host().alias("host"), F.xxhash64("html").alias("page"))
    return rows.distinct().groupBy("host").agg(F.count("*").alias("pages"))


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, hash, verdict) of hosts with pages enough; each such host also has a row of hash 0 and verdict 0."""
    small_batches(pages.sparkSession)
    rows = pages.where(F.col("html").isNotNull()).select(_host().alias("host"), "html", F.xxhash64("html").alias("page"))
    sizes = host_sizes(pages).where(F.col("pages") >= COUNTED_PAGES)
    schema = "host string, page bigint, hash bigint, shape boolean, words bigint, links bigint, of bigint, one boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(8))
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host, text, page = row
                for found in subtree_hashes(text):
                    for column, x in zip(out, (host, page, *found), strict=True):
                        column.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["host", "page", "hash", "shape", "words", "links", "of", "one"])

    seen = rows.mapInArrow(run, schema).distinct()
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("words", "links", "of")], F.avg(F.col("one").cast("int")).alias("one")]
    counted = seen.groupBy("host", "hash", "shape").agg(*sums).where(F.col("n") >= OUTSIDE_PAGES).join(sizes, "host")
    outside = F.col("n") >= F.greatest(F.lit(float(OUTSIDE_PAGES)), OUTSIDE_SHARE * F.col("pages"))
    words = F.coalesce(F.try_divide("words", "of"), F.lit(0.0))
    linked = (2 * F.col("links") >= F.col("words")) & (F.col("words") > 0) & (words <= LINKED_WORDS)

    def bit(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    enough = F.col("n") >= INSIDE_PAGES
    of_shape = bit(outside, SHAPE_OUTSIDE) + bit(enough & (F.col("n") >= LINKED_SHARE * F.col("pages")) & linked, SHAPE_INSIDE) + bit(outside & (words >= CONTENT_WORDS) & (F.col("one") > 0.5), CONTENT)
    of_text = bit(outside, TEXT_OUTSIDE) + bit(enough & (F.col("n") >= INSIDE_SHARE * F.col("pages")), TEXT_INSIDE)
    found = counted.select("host", "hash", F.when(F.col("shape"), of_shape).otherwise(of_text).alias("verdict")).where("verdict > 0")
    return found.unionByName(sizes.select("host", F.lit(0).cast("bigint").alias("hash"), F.lit(0).alias("verdict")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages.sparkSession
    small_batches(spark)
    found = stash(host_templates(pages), "templates")
    rows = pages.select("page_id", "url", "html", _host().alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    small = found.count() <= BROADCAST_TEMPLATES
    if small:
        by_host: dict[str, dict[int, int]] = {}
        for row in found.toLocalIterator():
            by_host.setdefault(row["host"], {})[row["hash"]] = row["verdict"]
        shipped = spark.sparkContext.broadcast(by_host)
        joined = rows.select("page_id", "url", "html", "host")
    else:  # a hot host's pages are dealt over salts, its list is repeated for each; there is one hot host for HOT_PAGES pages at most
        hot = F.broadcast(pages.groupBy(_host().alias("host")).agg(F.ceil(F.count("*") / HOT_PAGES).alias("salts")).where("salts > 1"))
        many = F.coalesce("salts", F.lit(1))
        lists = found.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("hash", "verdict"))).alias("verdicts"))
        lists = lists.join(hot, "host", "left").select("host", "verdicts", F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1)).alias("salt"))
        rows = rows.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.length("html")), many))
        joined = rows.join(lists.hint("shuffle_hash"), ["host", "salt"], "left").select("page_id", "url", "html", "verdicts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(3).to_pylist()
            known = [shipped.value.get(h) for h in known] if small else [None if t is None else dict(t) for t in known]
            texts = [main_text(page, t) for page, t in zip(batch.column(2).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
