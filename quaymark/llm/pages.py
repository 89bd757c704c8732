"""Main text of web pages by consensus of each host's pages on where the text lies."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .storage import whole_if_small, written

NAME = re.compile(r"""</?([a-zA-Z][^\s/>"']*)""")
EDGE = re.compile(r"""[>"']""")
ATTRIBUTES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# HTML's element kinds, and the words of class, id and role that name what is not the article.
RAW = {"script", "style", "title", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "dd", "dt", "figcaption", "caption", "td", "th", "address", "summary"}
NO_CONTENT = {"nav", "footer", "aside", "form", "button", "select", "option", "fieldset", "dialog", "menu", "head", "audio", "video", "canvas"}
JUNK = {
    "ad", "ads", "advert", "advertisement", "advertising", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup",
    "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget", "complementary", "contentinfo", "alert", "advertorial", "feedback",
}
#: Words that may follow one of those in a name (comment-list), and ones in a name that says what an element has or lacks (no-sidebar).
HOLDERS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "group", "inner", "item", "items", "left", "link", "links", "list", "main", "message", "n", "outer", "panel", "policy",
    "posts", "right", "row", "section", "slot", "text", "thread", "title", "top", "unit", "wrap", "wrapper", "zone",
}
SAYING = {"no", "not", "has", "with", "without", "is", "hide"}
#: What a container counts for in the vote if its name says that it isn't the article.
DOUBT = 0.1
GOOD = {"article", "body", "content", "entry", "main", "page", "post", "story", "text"}
#: Elements whose start ends an open one of the named kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What may stand in a head; any other element ends one whose end tag is left out.
IN_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
#: Levels of a path that are spelled out, from the innermost; those around them are one checksum.
LEVELS = 12


@dataclass
class Node:
    tag: str
    parent: int
    path: tuple[str, ...]
    names: set[str]
    hard: bool  # no article by its kind, or in one that is none
    doubtful: bool  # its own name says that it isn't the article
    holder: int  # the nearest one, itself included, that isn't a leaf
    first: int  # events from here ...
    last: int = -1  # ... to there lie inside
    inside: float = 0.0  # unlinked text in it
    junk: bool = False  # this one, or one around it
    text: float = 0.0
    links: float = 0.0


@dataclass
class Page:
    nodes: list[Node]
    events: list[tuple[int, str | None]] = field(default_factory=list)  # node and text, or None for the edge of a block
    linked: set[int] = field(default_factory=set)  # events whose text is a link's


def _words(names: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()))


def doubtful(names: str) -> bool:
    """Whether one of the names, as a whole, is that of something beside an article: `sidebar`, `site-footer`, `comment-list`; but
    not `no-sidebar`, `header-fixed` or `cookie-accepted`, which are named for what they have or what befell it."""
    for name in names.split():
        parts = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if p]
        while len(parts) > 1 and parts[-1] in HOLDERS:
            parts.pop()
        if parts and parts[-1] in JUNK and not SAYING & set(parts):
            return True
    return False


def _deeper(around: tuple[str, ...], step: str) -> tuple[str, ...]:
    path = (*around, step)
    return path if len(path) <= LEVELS else (f"~{zlib.crc32('>'.join(path[:2]).encode('utf-8', 'surrogatepass')):08x}", *path[2:])


class Tags:
    """The tags of a page in order. A place from which no end of a tag can be reached is remembered, so that looking for the ends of many
    tags that have none takes time in proportion to the page."""

    def __init__(self, source: str):
        self.source, self.dead = source, set()
        self.since, self.edge = 0, None  # the first of `>` and quotes from a place on, which holds for all places before it
        self.last = {c: source.rfind(c) for c in ">\"'"}

    def _end(self, at: int) -> int:
        """Place after the `>` outside of quotes; -1 if there is none, or a quote is left open before it."""
        passed = []
        while at <= self.last[">"]:
            if self.edge is None or not self.since <= at <= self.edge.start():
                self.since, self.edge = at, EDGE.search(self.source, at)
            m = self.edge
            if m[0] == ">":
                return m.end()
            if m.start() in self.dead or m.start() == self.last[m[0]]:
                passed.append(m.start())
                break
            passed.append(m.start())
            at = self.source.find(m[0], m.end()) + 1
        self.dead.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name, attributes) of the next tag; comments and declarations have no name."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                return at, len(source) if end < 0 else end + 3, False, "", ""
            if source.startswith(("<!", "<?"), at):
                end = source.find(">", at)
                return at, len(source) if end < 0 else end + 1, False, "", ""
            m = NAME.match(source, at)
            if m and (end := self._end(m.end())) >= 0:
                return at, end, source[at + 1] == "/", m[1].lower(), source[m.end() : end - 1]
            at += 1
        return None


def parse(source: str | None) -> Page:
    """Blocks and texts of a page in order. Tags need not match; what is left open ends with the page."""
    source = source or ""
    page = Page([Node("", -1, (), set(), False, False, 0, 0)])
    stack, at, linked, open_tags, tags, raw_left = [0], 0, False, Counter(), Tags(source), set()

    def text(piece: str) -> None:
        if piece:
            if linked:
                page.linked.add(len(page.events))
            page.events.append((stack[-1], html.unescape(piece)))

    def pop(depth: int) -> None:
        while len(stack) > depth:
            n = stack.pop()
            page.nodes[n].last = len(page.events)
            open_tags[page.nodes[n].tag] -= 1
            page.events.append((stack[-1] if stack else 0, None))

    while True:
        found = tags.next(at)
        text(source[at : found[0]] if found else source[at:])
        if not found:
            break
        _, at, closing, tag, attributes = found
        if not tag:
            continue
        if open_tags["head"] and not closing and tag not in IN_HEAD:
            pop(next(k for k, n in enumerate(stack) if page.nodes[n].tag == "head"))
        if tag == "br" or tag == "hr":
            page.events.append((stack[-1], None))
        elif tag == "a":
            linked = not closing
        elif tag in VOID or tag in INLINE:
            pass
        elif tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = None if tag in raw_left else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                if not end:
                    raw_left.add(tag)
                at = end.end() if end else len(source)
            page.events.append((stack[-1], None))
        elif closing:
            linked = False  # a link left open ends with its block
            for depth in range(len(stack) - 1, 0, -1) if open_tags[tag] > 0 else ():
                if page.nodes[stack[depth]].tag == tag:
                    pop(depth)
                    break
        else:
            while len(stack) > 1 and (open_ := page.nodes[stack[-1]].tag) and (open_ == "p" or open_ in CLOSES.get(tag, ())):
                pop(len(stack) - 1)
            linked = False
            named = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTES.findall(attributes)}
            around = page.nodes[stack[-1]]
            step = ".".join([tag, *sorted(re.sub(r"\d+", "N", named.get("class", "")).split())])
            hard = around.hard or tag in NO_CONTENT or (tag == "header" and not any(n.startswith(("article", "main")) for n in around.path))
            doubt = tag not in ("html", "body", "article", "main") and doubtful(" ".join(named.values()))
            page.events.append((stack[-1], None))
            me = len(page.nodes)
            page.nodes.append(Node(tag, stack[-1], _deeper(around.path, step), _words(" ".join(named.values())), hard, doubt, around.holder if tag in LEAVES else me, len(page.events)))
            stack.append(me)
            open_tags[tag] += 1
    pop(0)
    _weigh(page)
    return page


def _weigh(page: Page) -> None:
    """Tell what is junk, then how much text containers hold: a text counts whole for the container it stands in and half for the one around.

    A doubtful name is believed unless the element holds most of the page's text outside of links: so much is no sidebar.
    """
    nodes, sizes = page.nodes, {}
    for k, (n, piece) in enumerate(page.events):
        if piece is not None and not nodes[n].hard:
            sizes[k] = len(piece.strip())
            nodes[n].inside += sizes[k] * (k not in page.linked)
    for n in range(len(nodes) - 1, 0, -1):  # what is inside comes later
        nodes[nodes[n].parent].inside += nodes[n].inside
    for n, node in enumerate(nodes):
        around = nodes[node.parent].junk if n else False
        node.doubtful = node.doubtful and node.inside <= 0.5 * nodes[0].inside
        node.junk = node.hard or node.doubtful or around
    for k, size in sizes.items():
        c = nodes[page.events[k][0]].holder
        for share in (1.0, 0.5):
            nodes[c].text += size * share
            nodes[c].links += size * share * (k in page.linked)
            c = nodes[c].parent
            if c < 0:
                break


def ranked(page: Page, top: int = 3) -> list[tuple[float, int]]:
    """(score, node) of the containers that hold most text of their own, less what is linked. Doubtful ones count for little."""
    found = []
    for n, node in enumerate(page.nodes):
        if node.text > 0 and not node.hard and node.tag not in LEAVES:
            weight = 1.5 if node.tag in ("article", "main") else 1.25 if node.names & GOOD else 1.0
            found.append(((node.text - node.links) * weight * (DOUBT if node.junk else 1.0), n))
    return sorted((f for f in found if f[0] > 0), key=lambda f: (-f[0], f[1]))[:top]


def _within(page: Page, at: int, junk: dict[int, bool]) -> bool:
    """Whether a node is junk in the container that `junk` began with."""
    way = []
    while at not in junk:
        way.append(at)
        at = page.nodes[at].parent
    for inner in reversed(way):
        junk[inner] = junk[page.nodes[inner].parent] or page.nodes[inner].hard or page.nodes[inner].doubtful
    return junk[way[0] if way else at]


def content(page: Page, n: int) -> str:
    """Text of a container without what is junk in it: one space for white space and between blocks."""
    node, blocks, now = page.nodes[n], [], []
    junk: dict[int, bool] = {n: False}  # of what lies inside, whatever lies around
    for k in range(node.first, node.last):
        at, piece = page.events[k]
        if piece is None:
            blocks.append("".join(now))
            now = []
        elif not _within(page, at, junk):
            now.append(piece)
    blocks.append("".join(now))
    return " ".join(w for b in blocks for w in b.split())


def extract(source: str | None, paths: list[str]) -> tuple[str, str]:
    """(text, path): of the first of the host's paths that this page has with text, all containers there; else its own best."""
    page = parse(source)
    for path in paths:
        outer, end = [], -1
        for n, node in enumerate(page.nodes):
            if not node.hard and node.last > end and ">".join(node.path) == path:
                outer.append(n)
                end = node.last
        if text := " ".join(filter(None, (content(page, n) for n in outer))):
            return text, path
    best = ranked(page, 1)
    return (content(page, best[0][1]), ">".join(page.nodes[best[0][1]].path)) if best else ("", "")


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_paths(pages: DataFrame, top: int = 3, least: float = 0.2) -> DataFrame:
    """(host, paths): of the containers that a host's pages score best, the paths with most votes.

    Each page gives its best containers' paths one vote in all, in proportion to their scores; a name that makes a container doubtful
    makes its vote small, not void, so a host whose pages keep their text there can say so. Votes are added up per host and
    path in Spark, map tasks first, and at most `top` paths of a host stay, those with at least `least` of the leader's votes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, votes = [], [], []
            for host, source in zip(batch.column(0), batch.column(1)):
                page = parse(source.as_py())
                best = ranked(page)
                for score, n in best:
                    hosts.append(host.as_py())
                    paths.append(">".join(page.nodes[n].path))
                    votes.append(score / sum(s for s, _ in best))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.float64())], ["host", "path", "vote"])

    # Votes are counted in millionths, so that sums don't depend on their order.
    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, vote double").groupBy("host", "path").agg(F.sum(F.round(F.col("vote") * 1_000_000).cast("long")).alias("votes"))
    place = F.row_number().over(W.partitionBy("host").orderBy(F.desc("votes"), "path"))
    kept = votes.withColumn("place", place).where(F.col("place") <= top)
    listed = kept.groupBy("host").agg(F.max("votes").alias("most"), F.sort_array(F.collect_list(F.struct("place", "votes", "path"))).alias("l"))
    return listed.select("host", F.transform(F.filter("l", lambda x: x["votes"] >= least * F.col("most")), lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text of the article, n_chars and the path it was found at.

    A page without text in any container, an empty or a null html gives the empty text. Pages whose url is null or has no
    host vote together. Repeated rows and ids vote and are extracted each for itself; an empty table gives no rows; further
    columns are not read. Whole pages are read, and cut off ones end where they end.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))
    winners = written(host_paths(rows))
    # The hosts' paths are sent whole only if their files are small; else a hot host's partition is split by the adaptive join.
    joined = rows.join(whole_if_small(winners), "host", "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extract(h.as_py(), p.as_py() or []) for h, p in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([p for _, p in got], pa.string()),
            ], ["page_id", "url", "text", "n_chars", "path"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")
