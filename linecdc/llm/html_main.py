"""HTML extraction by consensus host paths.

1. Every page is parsed into a tree; each container is scored by the paragraphs below it
   (length, commas, few links), and the page votes for the generalised tag-class path of
   its best container: the tags from the top with their classes, digits as ``#``.
2. Spark sums the votes per host and path; a host's paths are ranked, however many.
3. Every page is parsed again and its text taken from the elements at the first of the
   host's ranked paths that has text in that page; a page with none of them uses its own
   best container. A page on which, say, a long comment thread outweighs a short article
   thus still yields the article.

*Evidence.* Elements such as ``nav`` or ``aside`` and what is hidden are out. A class, id
or role that names an advert, a menu, comments and the like is evidence only: such an
element is kept if it holds an ``article``, ``main`` or ``h1``, if most of the page's
running text is in it, or if it is running text itself, inside the article: long blocks,
hardly a link (``FLUENT``). Words that name reader comments weigh more: they are kept only
around an article or where the page has hardly any other text.

Blocks are what block-level tags or ``br`` separate. Character references are
decoded, white space in a block becomes one space, blocks are trimmed and joined
by one line end in page order.

Nulls and edge cases: a null or empty html, or one without text, gives the empty
text; a url that is null or not absolute has no host, so its
page is read by its own best container; broken markup
(unclosed tags or comments, stray end tags, text without tags) is read as a
browser would, roughly; repeated rows give repeated rows; extra columns are not
looked at. A page is one row, so one page's memory is the bound; parsing takes time
and memory in proportion to the page, however deep or broken its markup.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecdc.session import materialize

MIN_VOTES = 2  # a path that one page alone votes for is that page's own container anyway
FLUENT = 200  # characters of an average block of running text
MOST_HOSTS, MOST_CHARS = 100_000, 32_000_000  # hosts and characters of paths up to which they go to the pages
SALTS = 32  # parts that a larger host table deals every host's pages into

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img math maction menclose merror mfrac mi mmultiscripts "
                   "mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr "
                   "munder munderover semantics annotation".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th")}
LISTS = frozenset("ul ol dl table select".split())
SCOPES = frozenset("html body ul ol dl table article section main div td th nav aside".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# What is not the article, by element and by words of class, id or role.
BOILER_TAGS = frozenset("nav footer aside form button dialog menu head fieldset".split())
BOILER_WORDS = frozenset("""
ad ads adbox adsense adsbygoogle advert adverts advertising advertisement alert aside banner breadcrumb breadcrumbs
byline comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer disqus footer
form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain
overlay pager pagination popup promo promos promotion recommend recommended recommendations related replies reply
respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe taboola teaser toolbar
widget widgets""".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond responses".split())


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    step: str = ""  # own part of the path
    crc: int = 0  # of the whole path, with its length
    length: int = 0
    boiler: bool = False  # by its own name
    strong: bool = False  # by element, or hidden: never taken back
    comment: bool = False  # named as reader comments
    out: bool = False  # it or something above it is boiler
    text: float = 0.0  # score of the paragraphs below
    chars: int = 0  # of the blocks below, and their number and link characters
    blocks: int = 0
    linked: float = 0.0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("", -1)])
    blocks: list[tuple[int, str, float]] = field(default_factory=list)  # node, text, share of link text

    def path(self, i: int) -> str:
        steps = []
        while i >= 0:
            steps.append(self.nodes[i].step)
            i = self.nodes[i].parent
        return "".join(reversed(steps))


class Stack:
    """The open elements, with the depths of those of each tag and of each set of scopes."""

    def __init__(self):
        self.nodes, self.tags = [0], [""]
        self.open: dict[str, list[int]] = {}
        self.scoped = {s: [] for s in (frozenset(), ENDS_P, SCOPES, LISTS)}

    def push(self, node: int, tag: str) -> None:
        depth = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.open.setdefault(tag, []).append(depth)
        for s, depths in self.scoped.items():
            if tag in s:
                depths.append(depth)

    def pop_to(self, depth: int) -> int:
        """Closes all elements from ``depth`` on; the number of links among them."""
        links = 0
        while len(self.nodes) > depth:
            self.nodes.pop()
            tag = self.tags.pop()
            self.open[tag].pop()
            links += tag == "a"
            for s, depths in self.scoped.items():
                if tag in s:
                    depths.pop()
        return links

    def find(self, tags: Sequence[str], scopes: frozenset[str]) -> int | None:
        """Depth of the innermost element of ``tags`` that no element of ``scopes`` hides."""
        depth = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        bound = self.scoped[scopes]
        return depth if depth and not (bound and bound[-1] > depth) else None


def _describe(attrs: str) -> tuple[str, bool, bool, bool]:
    """Generalised classes, whether they name boilerplate or comments, whether it is hidden."""
    if not attrs or attrs.isspace():
        return "", False, False, False
    classes, words, hidden = [], set(), False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), entities.unescape(a or b or c)
        if name == "class":
            classes = sorted(set(re.sub(r"\d+", "#", value).split()))
        if name in ("class", "id", "role"):
            words.update(w.lower() for w in WORDS.findall(value))
        hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(HIDDEN.search(value))
    return "".join("." + c for c in classes), not BOILER_WORDS.isdisjoint(words), not COMMENT_WORDS.isdisjoint(words), hidden


def parse(source: str) -> Page:
    page = Page()
    nodes, stack = page.nodes, Stack()
    find = stack.find
    buffer: list[str] = []
    linked = plain = 0
    links = 0  # open links
    unclosed: set[str] = set()  # raw elements that no end tag follows

    def flush() -> None:
        nonlocal linked, plain
        if buffer:
            if text := " ".join(entities.unescape("".join(buffer)).split()):
                page.blocks.append((stack.nodes[-1], text, linked / max(1, linked + plain)))
            buffer.clear()
        linked = plain = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        links -= stack.pop_to(depth)

    at, size = 0, len(source)
    while at < size:
        m = TOKEN.search(source, at)
        end = m.start() if m else size
        if end > at:
            piece = source[at:end]
            buffer.append(piece)
            if links:
                linked += end - at
            else:
                plain += end - at
        if not m:
            break
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "br":
                flush()
                continue
            depth = find((tag,), ENDS_P if tag in INLINE else frozenset())
            if depth is not None:
                if tag not in INLINE:
                    flush()
                pop_to(depth)
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in RAW:
            close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            if not close:
                unclosed.add(tag)
            at = close.end() if close else (size if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag not in INLINE:
            flush()
        if tag in ENDS_P and (depth := find(("p",), SCOPES)) is not None:
            pop_to(depth)
        if tag in SIBLINGS:
            while (depth := find(SIBLINGS[tag], LISTS)) is not None:
                pop_to(depth)
        if tag == "body" and (depth := find(("head",), frozenset())) is not None:
            pop_to(depth)
        classes, boiler, comment, hidden = _describe(m["attrs"])
        above = nodes[stack.nodes[-1]]
        step = "" if tag in ("html", "body") or tag in INLINE else f"/{tag}{classes}"
        strong, raw = tag in BOILER_TAGS or hidden, step.encode("utf-8", "surrogatepass")
        named = boiler and tag not in ("html", "body", "main")
        nodes.append(Node(tag, stack.nodes[-1], step, zlib.crc32(raw, above.crc), above.length + len(raw),
                          strong or named, strong, comment and named))
        stack.push(len(nodes) - 1, tag)
        links += tag == "a"
    flush()
    _mark(page)
    return page


def _mark(page: Page) -> None:
    """Which nodes are out, and the paragraph score below every node; see Evidence. A
    header is out but for its headings."""
    nodes = page.nodes
    parents = range(len(nodes) - 1, 0, -1)  # a node's children have higher numbers

    # What lies below every node, but for elements that are out by their tag.
    shut = [False] * len(nodes)
    for i, n in enumerate(nodes):
        shut[i] = n.strong or n.parent >= 0 and (shut[n.parent] or nodes[n.parent].tag == "header" and n.tag not in HEADINGS)
    for i, text, linked in page.blocks:
        if not shut[i]:
            n = nodes[i]
            n.chars, n.blocks, n.linked = n.chars + len(text), n.blocks + 1, n.linked + linked * len(text)
    holds = [n.tag in ("article", "main", "h1") and not n.boiler for n in nodes]
    story = [False] * len(nodes)  # an article, main or h1 lies below
    articles = [False] * len(nodes)  # the page's only article or main lies below
    fluent = [0] * len(nodes)  # characters of long blocks that are hardly links, below
    comments = [0] * len(nodes)  # those of them that lie in reader comments
    for i, text, linked in page.blocks:
        if not shut[i] and linked < 0.2 and len(text) >= FLUENT / 2:
            fluent[i] += len(text)
    for i in parents:
        n, up = nodes[i], nodes[nodes[i].parent]
        up.chars, up.blocks, up.linked = up.chars + n.chars, up.blocks + n.blocks, up.linked + n.linked
        fluent[n.parent] += fluent[i]
        comments[n.parent] += fluent[i] if n.comment else comments[i]
        story[n.parent] = story[n.parent] or story[i] or holds[i]
    whole = [i for i, n in enumerate(nodes) if n.tag in ("article", "main") and not n.boiler]
    if len(whole) == 1:
        i = nodes[whole[0]].parent
        while i > 0:
            articles[i] = True
            i = nodes[i].parent
    total, other = fluent[0], fluent[0] - comments[0]
    inside = [False] * len(nodes)  # in an article or main
    for i, n in enumerate(nodes):
        inside[i] = n.parent >= 0 and (inside[n.parent] or nodes[n.parent].tag in ("article", "main"))
        if not n.boiler or n.strong:
            continue
        if n.comment:
            n.boiler = not (articles[i] or total > 0 and 10 * other < total)
        elif story[i] or total > 0 and 2 * fluent[i] > total:
            n.boiler = False
        elif inside[i] and n.blocks and n.chars >= FLUENT * n.blocks and 5 * n.linked < n.chars:
            n.boiler = False
    for n in nodes[1:]:
        above = nodes[n.parent]
        n.out = n.boiler or above.out or above.tag == "header" and n.tag not in HEADINGS
    for i, text, linked in page.blocks:
        n = nodes[i]
        if not n.out and n.tag != "header":
            n.text += (len(text) / 100 + text.count(",") + (n.tag == "p")) * (1 - linked)
    for i in parents:
        nodes[nodes[i].parent].text += nodes[i].text


def best_path(page: Page) -> str | None:
    """Path of the deepest container with most of the page's paragraph score; an
    ``article`` or ``main`` needs less of it."""
    nodes = page.nodes
    total = nodes[0].text
    if total <= 0:
        return None
    depth = [0] * len(nodes)
    best, found = None, None
    for i, n in enumerate(nodes):
        depth[i] = depth[n.parent] + 1 if n.parent >= 0 else 0
        if i == 0 or n.out or n.tag in INLINE or n.tag in HEADINGS or n.tag in ("p", "li", "pre", "blockquote", "td", "tr", "ul", "ol"):
            continue
        need = 0.4 if n.tag in ("article", "main") else 0.75
        if n.text >= need * total and (best is None or (n.tag in ("article", "main"), depth[i]) > best or
                                       best[0] and depth[i] > best[1] and n.text >= 0.9 * nodes[found].text):
            best, found = (n.tag in ("article", "main") or bool(best and best[0]), depth[i]), i
    return page.path(found) if found is not None else ""


def text_at(page: Page, path: str | None) -> str:
    """Text below the elements at ``path`` (``""``: the whole body)."""
    nodes = page.nodes
    inside = [False] * len(nodes)
    raw = (path or "").encode("utf-8", "surrogatepass")
    crc, length = zlib.crc32(raw), len(raw)
    for i, n in enumerate(nodes):
        here = path == "" or n.length == length and n.crc == crc and n.tag not in INLINE and page.path(i) == path
        inside[i] = here or n.parent >= 0 and inside[n.parent]
    return "\n".join(t for node, t, _ in page.blocks
                     if inside[node] and not nodes[node].out and nodes[node].tag != "header")


def extract(source: str | None, ranked: list[str]) -> tuple[str, str | None]:
    """Text and the path that gave it."""
    if not source:
        return "", None
    page = parse(source)
    for path in [*ranked, best_path(page)]:
        if path is not None and (text := text_at(page, path)):
            return text, path
    return "", None


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        paths = [best_path(parse(h)) if h else None for h in pdf["html"]]
        yield pd.DataFrame({"host": pdf["host"], "path": paths}).dropna(subset=["path"])


def host_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def host_paths(pages: DataFrame, min_votes: int = MIN_VOTES) -> DataFrame:
    """(host, ranked): each host's paths by votes, ties by path; pages without a host have no vote."""
    votes = (pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
             .where("host <> ''").mapInPandas(_votes, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("votes")))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return votes.where(F.col("votes") >= min_votes).groupBy("host").agg(ranked.alias("r")).select("host", F.col("r.path").alias("ranked"))


def extract_pages(pages: DataFrame, min_votes: int = MIN_VOTES) -> DataFrame:
    """(page_id, url, text, path) of every page."""
    @F.pandas_udf("text string, path string")
    def take(html: pd.Series, ranked: pd.Series) -> pd.DataFrame:
        got = [extract(h, [] if r is None else list(r)) for h, r in zip(html, ranked)]
        return pd.DataFrame(got, columns=["text", "path"])

    hosts = materialize(host_paths(pages, min_votes), "host-paths")
    size = hosts.agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("ranked", " "))).alias("chars")).first()
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    if size["n"] <= MOST_HOSTS and (size["chars"] or 0) <= MOST_CHARS:
        joined = rows.join(F.broadcast(hosts), "host", "left")
    else:  # a hot host's pages go to many tasks
        salt = F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(
            hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    return joined.select("page_id", "url", take("html", "ranked").alias("x")).select("page_id", "url", "x.text", "x.path")


def op4_query(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
