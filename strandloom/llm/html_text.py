"""Main text of web pages by consensus paths of each host.

A page is cut into text blocks, each below a chain of elements. An element's path is its chain of tags with generalised
classes (digits dropped, sorted). Every page scores its containers (text that is not link text, given to the nearest
container and in part to the one above) and votes for the path of the best one; the votes are summed per host in Spark
and the path with the most votes wins. Pages are then extracted again: the articles around all containers with the host's
winning path if the page has any, else around the page's own best one, without menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments inside. Class and id words tell these; they drop blocks, never what stands
within a paragraph, and headings never. Votes are (host, path) sums, so a host with a third of all pages is a few rows.

Defined results: a null or empty html, or one without text, gives an empty text; a null or broken url votes under an
empty host; repeated rows vote and are extracted one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Hosts of this number at most have their paths broadcast; above it the join is shuffled.
BROADCAST_HOSTS = 200_000
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "math mi mo mn ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mspace semantics annotation".split()
)
BARRIERS = frozenset("table td th div section article main body ul ol dl blockquote".split())
SELF_CLOSING = frozenset("li dt dd tr h1 h2 h3 h4 h5 h6".split())
WORDY = frozenset("table tr figure".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr caption figcaption summary".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg select button textarea canvas object embed dialog menu".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu menubar breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice notices alert comment comments respond reply disqus share sharing social related recommended newsletter subscribe subscription signup login "
    "popup modal overlay pagination pager toolbar widget skip masthead topbar".split()
)
#: As a whole class or id: what readers wrote, which may be longer than the page.
READER_WORDS = frozenset("comment comments respond reply disqus disqus_thread".split())
#: Words that inside an article name parts of it, such as boxes with warnings.
ARTICLE_WORDS = frozenset("alert notice notices widget toolbar skip".split())
HEADER_WORDS = frozenset("header".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ATTRS = frozenset("class id role hidden aria-hidden".split())
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element. What depends on the elements above is told from the parent alone, so a page takes time by its length
    however deep it is nested.

    ``key`` stands for the path; ``within``: nearest article or main; ``block``: nearest that is not inline; ``box``: nearest
    container; ``dropped``: never text; ``doubt``: nearest element that goes by its words or place, unless it holds the page.
    """

    __slots__ = ("tag", "segment", "key", "depth", "parent", "within", "block", "box", "dropped", "doubt", "above", "readers", "link", "leaf", "p_open")

    def __init__(self, tag: str, segment: str, parent: Node | None, dropped: bool = False):
        inline = tag in INLINE
        self.tag, self.segment, self.parent, self.dropped, self.readers, self.above = tag, segment, parent, dropped, False, None
        if parent is None:
            self.key, self.depth, self.within, self.doubt, self.link, self.leaf, self.p_open = 0, 0, None, None, False, False, False
        else:
            self.key = parent.key if inline else xxhash.xxh3_64_intdigest(segment.encode("utf-8", "replace"), parent.key) - (1 << 63)
            self.depth, self.doubt, self.link = parent.depth + 1, parent.doubt, parent.link or tag == "a"
            self.within = self if tag in ("article", "main") else parent.within
            self.leaf = parent.leaf or tag in LEAVES
            self.p_open = tag == "p" or parent.p_open and tag not in BARRIERS
        self.block = parent.block if inline and parent else self
        self.box = parent.box if self.leaf or inline and parent else self


class Page:
    """Text blocks (text, characters that are link text, element) in page order, and the elements in order of their start."""

    def __init__(self, found: list[tuple[str, int, Node]], nodes: list[Node]):
        self.found, self.nodes = found, nodes


def _node(tag: str, attributes: str, parent: Node) -> Node:
    found: dict[str, str] = {}
    if attributes.strip():
        for m in _ATTR.finditer(attributes):
            if m[1].lower() in _ATTRS:
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    classes = sorted({_DIGITS.sub("", c) for c in found.get("class", "").split()} - {""})
    words = set(_SPLIT.split(_CAMEL.sub("-", f"{found.get('class', '')} {found.get('id', '')}").lower())) if found else set()
    structural = tag not in ("html", "body", "main", "article")
    dropped = parent.dropped or tag in DROPPED or structural and ("hidden" in found or found.get("aria-hidden") == "true")
    if tag in INLINE or tag in LEAVES or tag in WORDY:
        # What stands in a paragraph, and headings, go by the blocks around them; loose ones outside articles by a whole word.
        loose = parent.within is None and not parent.leaf and (tag in INLINE or tag == "p")
        doubtful = loose and not DROPPED_WORDS.isdisjoint(f"{found.get('class', '')} {found.get('id', '')}".lower().split())
    else:
        named = words & DROPPED_WORDS - (ARTICLE_WORDS if parent.within is not None else frozenset())
        doubtful = structural and bool(named) or parent.within is None and (tag == "header" or structural and bool(words & HEADER_WORDS))
    doubtful = doubtful or structural and found.get("role", "").lower() in DROPPED_ROLES
    node = Node(tag, f"{tag}{''.join('.' + c for c in classes)}", parent, dropped)
    if doubtful and tag in INLINE:
        node.dropped = True
    elif doubtful:
        node.above, node.doubt = parent.doubt, node
        node.readers = not READER_WORDS.isdisjoint(f"{found.get('class', '')} {found.get('id', '')}".lower().split())
    return node


def _undropped(page: Page, holders: set[Node]) -> list[tuple[str, int, Node]]:
    """The blocks that no doubtful element drops: one that holds an article or main (``holders``), or most of the text
    of a page without them, drops nothing; where no block is left all stay."""
    doubtful = [node for node in page.nodes if node.doubt is node]
    if not doubtful:
        return page.found
    held = dict.fromkeys(doubtful, 0)
    total = 0
    for text, links, block in page.found:
        worth = len(text) - min(links, len(text))
        total += worth
        if block.doubt is not None:
            held[block.doubt] += worth
    for node in reversed(doubtful):
        if node.above is not None:
            held[node.above] += held[node]
    spared = set(holders)
    # A page with an article has its text there, and comments may well be longer.
    if all(block.within is None for _, _, block in page.found):
        spared |= {node for node, n in held.items() if 2 * n > total and not node.readers}
    stays: dict[Node | None, bool] = {None: True}
    for node in doubtful:
        stays[node] = node in spared and stays[node.above]
    return [x for x in page.found if stays[x[2].doubt]] or page.found


def blocks(page: str) -> Page:
    """A page's text blocks, each with the nearest element that is not inline."""
    root = Node("", "", None)
    holders: set[Node] = set()
    nodes: list[Node] = []
    opened: Counter[str] = Counter()
    now, out, parts, links, at = root, [], [], 0, 0
    n = len(page)

    def cut() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append((text, links, now.block))
        parts, links = [], 0

    def say(text: str) -> None:
        nonlocal links
        if text and not now.dropped:
            parts.append(text)
            if now.link:
                links += len(text)

    def leave(to: Node) -> None:
        nonlocal now
        while now is not to:
            opened[now.tag] -= 1
            now = now.parent

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in VOID:
                say(" ")
                continue
            up = now if opened[tag] else root
            while up is not root and up.tag != tag:
                # An end tag of inline markup never closes blocks.
                if tag in INLINE and up.tag not in INLINE:
                    up = root
                    break
                up = up.parent
            if up is not root:
                if tag not in INLINE:
                    cut()
                leave(up.parent)
            continue
        if tag in VOID:
            if tag == "hr":
                cut()
            say(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = n if close < 0 else close + 1
            continue
        if tag not in INLINE:
            cut()
            up, stop = now, now
            while (now.p_open or tag in SELF_CLOSING) and up is not root and up.tag not in BARRIERS:
                if up.tag == "p" or up.tag in ("li", "dt", "dd") and tag in ("li", "dt", "dd") or up.tag == tag and tag in SELF_CLOSING:
                    stop = up.parent
                up = up.parent
            leave(stop)
        now = _node(tag, m[3], now)
        nodes.append(now)
        opened[tag] += 1
        if tag in ("article", "main") and now.doubt is not None and not now.dropped and now.parent.within is None:
            # Teasers and comments may be articles of an article; those tell nothing of what is around them.
            up = now.above if now.doubt is now else now.doubt
            while up is not None and up not in holders:
                holders.add(up)
                up = up.above
    cut()
    whole = Page(out, nodes)
    whole.found = _undropped(whole, holders)
    return whole


def best_path(page: Page) -> tuple[int, str, float] | None:
    """The best container's path, by its key and in words, and its score."""
    scores: dict[Node, float] = {}
    for text, links, block in page.found:
        worth = max(0.0, len(text) - 1.5 * links) * (1.0 if len(text) >= 40 else 0.4)
        share, node = 1.0, block.box
        for _ in range(3):
            if node is None or node.parent is None:
                break
            scores[node] = scores.get(node, 0.0) + worth * share * (1.5 if node.tag in ("article", "main") else 1.0)
            share, node = share / 2, node.parent.block
    if not scores:
        return None
    won = max(scores, key=lambda x: (scores[x], -x.depth, x.key))
    path, node = [], won
    while node is not None and node.parent is not None:
        path += [] if node.tag in INLINE else [node.segment]
        node = node.parent
    return won.key, "/".join(reversed(path)), scores[won]


def _whole(node: Node, held: dict[Node, list[int]]) -> Node:
    """The enclosing article or main; without one the highest element below the body that adds no more link text than text."""
    if node.within is not None:
        return node.within
    best, up = node, node.parent
    while up is not None and up.tag not in ("", "html", "body"):
        if up.tag not in INLINE:
            text, links = (x - y for x, y in zip(held[up], held[best], strict=True))
            if 2 * links > text:
                break
            best = up
        up = up.parent
    return best


def extract(page: Page, key: int | None) -> str:
    """The blocks of the articles around containers with the path ``key``, joined; the page's own best one where it has none."""
    held: dict[Node, list[int]] = {node: [0, 0] for node in page.nodes}
    for text, links, block in page.found:
        if block in held:
            held[block][0] += len(text)
            held[block][1] += min(links, len(text))
    for node in reversed(page.nodes):
        if node.parent in held:
            held[node.parent][0] += held[node][0]
            held[node.parent][1] += held[node][1]

    def below(key: int) -> list[str]:
        roots = {_whole(node, held) for node in page.nodes if node.key == key and node.tag not in INLINE and held[node][0]}
        inside: dict[Node | None, bool] = {}
        for node in page.nodes:
            inside[node] = node in roots or inside.get(node.parent, False)
        return [text for text, _, block in page.found if inside.get(block, False)]

    kept = below(key) if key is not None else []
    if not kept and page.found:
        own = best_path(page)
        kept = [text for text, _, _ in page.found] if own is None else below(own[0])
    return "\n\n".join(kept)


def host(url) -> F.Column:
    """A URL's host in lower case, without user, port and "www."; empty where there is none. Votes and extraction use this one."""
    found = F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(found, r"^www\.", "")


def votes(pages: DataFrame) -> DataFrame:
    """host, path_key, path, score: each page's vote."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [best_path(blocks(page.as_py() or "")) for page in batch.column(1)]
            columns = [pa.array([b and b[i] for b in best], k) for i, k in enumerate((pa.int64(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["host", "path_key", "path", "score"]).filter(pa.array([b is not None for b in best], pa.bool_()))

    return pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, path_key long, path string, score double")


def consensus(pages: DataFrame) -> DataFrame:
    """host, path_key, path: the winning path of each host: most pages, then the larger sum of the scores' logarithms, then the path."""
    summed = votes(pages).groupBy("host", "path_key").agg(F.min("path").alias("path"), F.sum(F.log1p("score")).alias("weight"), F.count("*").alias("pages"))
    best = F.max_by(F.struct("path_key", "path"), F.struct("pages", F.round("weight", 6), "path_key"))
    return staged(summed.groupBy("host").agg(best.alias("best")).select("host", "best.path_key", "best.path"), "host-paths")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    paths = consensus(pages).select("host", "path_key")
    known = F.broadcast(paths) if paths.count() <= BROADCAST_HOSTS else paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(blocks(page.as_py() or ""), key.as_py()) for page, key in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    return rows.join(known, "host", "left").select("page_id", "url", "html", "path_key").mapInArrow(run, "page_id long, url string, text string, n_chars long")
