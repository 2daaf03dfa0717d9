"""HTML main-text extraction by consensus host paths."""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import map_rows, written

#: Fixed lists of element names by their role in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = frozenset("nav footer aside form button select dialog menu svg math canvas object template head audio video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
#: Start tags that end an open element of these names, up to the nearest of the second list.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id and role that mark what isn't the article, alone or as a part of a name; within an article, of a
#: name whose other parts are marks or PARTS_OF_LAYOUT as well ("related-posts", but not "related-work").
MARKS = frozenset(
    "nav navbar navigation menu submenu sidebar sidenav ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr "
    "newsletter subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond pagination pager popup modal footer foot contentinfo".split()
)
#: Words that also name parts of articles: within one they count if they are the whole name. Any mark there counts if the part is mostly links.
WEAK_MARKS = frozenset("masthead banner topbar header notice notices alert overlay widget toolbar search form skip copyright complementary dialog".split())
#: Words that say what kind of box an element is and nothing of what it holds.
PARTS_OF_LAYOUT = frozenset(
    "area article articles author avatar bar block body bottom box btn button buttons card cards column container content count cta date entries entry feed field group holder icon icons inner item items label left line link links list "
    "main meta module outer panel post posts rail right row section slot stories story tab tabs tag tags thread title toggle top unit view widgets wrap wrapper".split()
)
#: Characters of a container path; what is above is then a digest.
PATH = 400
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_BREAK, _DIGITS, _WORD = re.compile(r"\s+"), re.compile(r"\d+"), re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    """A structural element: its name, its generalised path of tags and classes, and whether it is set aside.

    suspect: a mark within an article that may be of its subject. length, linked, kept, counted: characters of all blocks below it, of links
    there, of what isn't set aside, and of all but what an article itself sets aside.
    """

    tag: str
    path: str
    parent: Node | None
    aside: bool
    depth: int = 0
    article: bool = False
    suspect: bool = False
    length: int = 0
    linked: int = 0
    kept: int = 0
    counted: int = 0


@dataclass(slots=True)
class Block:
    """A run of text between block boundaries: its node, white space already folded, and how much of it is linked."""

    node: Node
    text: str
    linked: int


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)} if raw and "=" in raw or "hidden" in raw else {}


def _set_aside(tag: str, at: dict[str, str], inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is set aside, and whether that depends on what it holds."""
    if tag in SKIPPED or tag in ("header", "noscript") and not inside_article:
        return True, False
    if "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", ""):
        return True, False
    if not at or tag in ("html", "body", "article", "main"):
        return False, False
    names = f"{at.get('class', '')} {at.get('id', '')} {at.get('role', '')}".lower().split()
    words = [set(_WORD.findall(n)) for n in names]
    marked, weakly = not MARKS.isdisjoint(set().union(*words)), not WEAK_MARKS.isdisjoint(set().union(*words))
    if not inside_article:
        return marked or weakly, False
    layout = MARKS | WEAK_MARKS | PARTS_OF_LAYOUT
    named = not WEAK_MARKS.isdisjoint(names) or any(not MARKS.isdisjoint(w) and w <= layout for w in words)
    return named, not named and (marked or weakly)


def _below(path: str, name: str) -> str:
    if len(path) > PATH:
        path = "#" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    return f"{path}>{name}" if path else name


def parsed(page: str | None) -> tuple[list[Block], list[Node]]:
    """The page's text blocks in order, and its elements, each after its parent, with the sums of what is below them.

    Tolerates unclosed and stray tags; comments, scripts and styles have no text. Time is in proportion to the page,
    but for searches of open elements by stray end tags.
    """
    root = Node("", "", None, False)
    node, out, text, linked, anchors = root, [], [], 0, 0
    nodes = [root]
    source, at = page or "", 0

    def flush():
        nonlocal text, linked
        if text:
            flat = " ".join("".join(text).split())
            if flat:
                out.append(Block(node, flat, linked))
        text, linked = [], 0

    while at < len(source):
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                piece = entities.unescape(raw)
                text.append(piece)
                linked += len(piece) if anchors else 0
            continue
        if tag == "a":
            anchors = 0 if m[1] else 1
        if tag in INLINE or tag in VOID and tag not in ("br", "hr"):
            continue
        flush()
        if m[1]:
            found = node
            while found.parent is not None and found.tag != tag:
                found = found.parent
            if found.parent is not None:
                node, anchors = found.parent, 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in CLOSES_P and node.tag == "p":
            node = node.parent
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
            found = node
            while found.parent is not None and found.tag not in ends and found.tag not in until:
                found = found.parent
            if found.tag in ends:
                node = found.parent
        if tag in VOID:
            continue
        a = _attributes(m[3])
        classes = ".".join(sorted({_DIGITS.sub("#", c) for c in a.get("class", "").lower().split()}))
        name = f"{tag}.{classes}" if classes else tag
        inside = node.article or tag in ("article", "main")
        aside, suspect = _set_aside(tag, a, inside)
        node = Node(tag, _below(node.path, name), node, node.aside or aside, node.depth + 1, inside, suspect)
        nodes.append(node)
        anchors = 0
    flush()
    for b in out:
        b.node.length += len(b.text)
        b.node.linked += b.linked
    for x in reversed(nodes[1:]):
        x.parent.length += x.length
        x.parent.linked += x.linked
    for x in nodes[1:]:
        x.aside = x.aside or x.parent.aside or x.suspect and 2 * x.linked >= x.length
    for b in out:
        b.node.kept += 0 if b.node.aside else max(0, len(b.text) - 2 * b.linked)
        b.node.counted += 0 if b.node.aside and b.node.article else len(b.text)
    for x in reversed(nodes[1:]):
        x.parent.kept += x.kept
        x.parent.counted += x.counted
    return out, nodes


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order."""
    return parsed(page)[0]


#: Elements that hold text but are never an article's container.
_PARTS = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl dd dt tr tbody".split())


def container_scores(page: str | None) -> dict[str, tuple[float, int]]:
    """Score and depth of each container path of a page: the text below it that isn't set aside or linked, times its share squared.

    Containers with the same path count together. The score is a logarithm, so that one long page doesn't outvote a host.
    """
    good, everything, depth = defaultdict(int), defaultdict(int), {}
    for x in parsed(page)[1][1:]:
        if x.kept and x.tag not in _PARTS:
            good[x.path] += x.kept
            everything[x.path] += x.counted
            depth[x.path] = x.depth
    return {p: (math.log1p(n * (n / everything[p]) ** 2), depth[p]) for p, n in good.items()}


def best(scores: dict[str, tuple[float, int]]) -> str | None:
    """The path with the highest score; of nested containers with the same text, the deepest."""
    return max(scores, key=lambda p: (round(scores[p][0], 9), scores[p][1], p)) if scores else None


def extract(page: str | None, path: str | None) -> str:
    """Text of the containers with the path, or of the page's own best container where it has none."""
    found, nodes = parsed(page)

    def within(p: str) -> list[str]:
        inside = set()
        for x in nodes[1:]:
            if x.path == p or id(x.parent) in inside:
                inside.add(id(x))
        return [b.text for b in found if not b.node.aside and id(b.node) in inside]

    kept = within(path) if path else []
    if not kept:
        own = best(container_scores(page))
        kept = within(own) if own else [b.text for b in found if not b.node.aside]
    return " ".join(kept)


def host(url):
    """The host of an URL column, lower case, without www.; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """The winning container path of each host: (host, path), the path with most summed score, ties by depth, then name.

    Each page's scores are summed map-side before they are dealt out, so a host with a third of all pages costs its
    distinct paths only.
    """

    def make():
        return lambda h, page: [(h, p, s, d) for p, (s, d) in container_scores(page).items()]

    scored = map_rows(pages.select(host(F.col("url")).alias("host"), "html"), make, "host string, path string, score double, depth int")
    summed = scored.groupBy("host", "path").agg(F.sum(F.round("score", 6).cast("decimal(20,6)")).alias("score"), F.max("depth").alias("depth"))
    return summed.groupBy("host").agg(F.max(F.struct("score", "depth", "path")).alias("top")).select("host", "top.path")


#: Bytes of hosts and paths that are broadcast; with more, pages meet their host's path by page.
BROADCAST_BYTES = 32 << 20


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to (page_id, url, text, n_chars), the text of each host's winning container.

    Null html is empty; a page without the winning container uses its own best one; null urls vote together as one
    host; repeated rows stay; other columns are not read; an empty table gives an empty result. Pages are never dealt
    out by host: the winners are broadcast if they are small, as counted; else their keys alone meet the hosts, and the
    pages are joined by page and host, of which no value is frequent.
    """
    winners, _ = written(votes(pages))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        chosen = rows.join(F.broadcast(winners), "host", "left")
    else:
        keys = rows.select("page_id", "host").distinct().join(winners, "host").withColumnRenamed("page_id", "id").withColumnRenamed("host", "of")
        chosen = rows.join(keys, rows["page_id"].eqNullSafe(keys["id"]) & (rows["host"] == keys["of"]), "left")

    def make():
        def f(page_id, url, page, path):
            text = extract(page, path)
            return [(page_id, url, text, len(text))]

        return f

    return map_rows(chosen.select("page_id", "url", "html", "path"), make, "page_id long, url string, text string, n_chars long")
