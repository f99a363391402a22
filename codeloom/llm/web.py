"""Main text of web pages by container paths that the pages of a host agree on.

Every page scores its containers: text counts for its container and, less, for what that
lies in; links, menus, adverts and the like count nothing. A name in a class or id does not
drop what holds an article or most of the page's text; that counts less instead. The best container's path of
generalised tags (tag and classes, without digits) is the page's vote. Spark adds up the
votes by host, and the pages are read again at their host's winning path. A page without
that path, or without text there, falls back on its own best container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.joins import lookup_join
from codeloom.session import write_stage

LOOKUP_BYTES = 16 << 20
DECAY = 0.7  # of text for the container one level up
FAVOUR = 1.5  # for containers that say they hold the article
DOUBT = 0.8  # for text in what is named like boilerplate and kept

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
FOREIGN = frozenset("svg math".split())
HTML_AGAIN = frozenset("foreignobject desc annotation-xml mtext mi mo mn ms".split())  # within foreign elements
# HTML elements that end foreign ones they stand in.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing main article section menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav header footer aside button select dialog menu head object audio video canvas label svg math".split())
FORMS = frozenset("form fieldset".split())  # some hold the whole page
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
# Words in a class or id that tell what is not the article, and what is.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert comment comments reply replies respond disqus discussion sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead topbar share sharing social related recommended newsletter subscribe subscription popup modal "
    "overlay widget widgets toolbar pagination pager login signup search form hidden".split()
)
TALK = frozenset("comment comments reply replies respond disqus discussion".split())  # can be longer than the article
APART = frozenset("has no with without".split())  # what follows in a name is not the element itself
ARTICLE = frozenset("article content main post entry story body text".split())
CLOSES_P = BLOCK - {"br", "body", "html"}
KEEPS_P = frozenset("td th button object table".split())
# Containers of text: blocks, but not those that make up a flow of text.
HOLDERS = BLOCK - frozenset("p li td th tr br dd dt pre blockquote h1 h2 h3 h4 h5 h6".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_SCOPED = frozenset().union(*SAME.values(), *STOPS.values())

# Possessive, so that a tag without an end costs one look; one with an open quote ends at the next >.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+(?=>)|[^>]*+)>""", re.S
)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Za-z]+")


def _named(names: str) -> tuple[bool, bool]:
    """Whether class and id ``names`` have words of boilerplate, up to a has, no or with in each, and whether only those, or comments."""
    out = set()
    for name in names.lower().split():
        for word in _WORD.findall(name):
            if word in APART:
                break
            out.add(word)
    return not BOILERPLATE.isdisjoint(out), out <= BOILERPLATE or BOILERPLATE & out <= TALK


class Paths:
    """Numbers for container paths: one for each parent path and generalised tag that occurs."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = []

    def number(self, parent: int, step: str) -> int:
        found = self.known.setdefault((parent, step), len(self.steps))
        if found == len(self.steps):
            self.steps.append((parent, step))
        return found

    def find(self, path: str) -> int | None:
        at: int | None = -1
        for step in path.split("/"):
            at = self.known.get((at, step))
            if at is None:
                return None
        return at

    def spell(self, number: int) -> str:
        out = []
        while number >= 0:
            number, step = self.steps[number]
            out.append(step)
        return "/".join(reversed(out))


class Node:
    """An element; ``parts`` holds texts and child elements in order; ``named`` and ``sure`` are those of ``_named``.

    What the elements around it decide is passed down: whether it lies in a link (``link``) or a foreign element
    (``foreign``), the container its text counts for (``block``), and the open elements that others end (``paragraph``, ``scope``).
    """

    __slots__ = (
        "tag", "path", "parts", "up", "drop", "favour", "score", "named", "sure", "holder", "core", "below", "size", "doubt", "base",
        "link", "foreign", "block", "paragraph", "scope",
    )

    def __init__(self, tag: str, attributes: str, up: Node | None, paths: Paths):
        self.tag, self.up, self.parts, self.score = tag, up, [], 0.0
        kept = up is not None and up.drop
        names = ""
        self.named = self.sure = tag in FORMS
        self.doubt = False
        self.size = 0
        self.holder = tag in ("html", "body", "main", "article")
        self.core = tag in ("article", "main")
        self.favour = tag in ("article", "main")
        if attributes and not attributes.isspace():
            found = {m[0].lower(): m[1] or m[2] or m[3] for m in reversed(_ATTRIBUTE.findall(attributes))}
            words = [w.lower() for a in ("class", "id") for w in _WORD.findall(found.get(a, ""))]
            names = "." + "-".join(sorted({w.lower() for w in _WORD.findall(found.get("class", ""))})) if found.get("class") else ""
            style = found.get("style", "").replace(" ", "").lower()
            role = found.get("role", "").lower()
            kept |= role in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
            kept |= "display:none" in style or "visibility:hidden" in style
            if not BOILERPLATE.isdisjoint(words):
                named, sure = _named(found.get("class", "") + " " + found.get("id", ""))
                self.named, self.sure = self.named or named, self.sure or sure
            if role == "form":
                self.named = self.sure = True
            if role in ("main", "article"):
                self.holder = self.core = self.favour = True
            if self.core and tag != "main" and self.named:  # as articles in a list of comments are
                self.core = not (ARTICLE - {"content", "body", "text"}).isdisjoint(words)
            self.favour |= not ARTICLE.isdisjoint(words)
        self.drop = kept or tag in DROPPED or tag in RAW
        self.path = paths.number(-1 if up is None else up.path, tag + names)
        self.link = tag == "a" or (up is not None and up.link)
        self.foreign = (tag in FOREIGN or (up is not None and up.foreign)) and tag not in HTML_AGAIN
        self.block = self if tag in HOLDERS else up.block if up is not None else None
        self.paragraph = self if tag == "p" else None if tag in KEEPS_P or up is None else up.paragraph
        self.scope = up.scope if up is not None else {}
        if tag in _SCOPED:
            self.scope = {t: n for t, n in self.scope.items() if tag not in STOPS[t]} | {t: self for t in SAME if tag in SAME[t]}


def parse(html: str) -> tuple[Node, Paths]:
    """The element tree; raw elements and comments are left out, and ends that HTML leaves out are put in."""
    paths = Paths()
    root = node = Node("html", "", None, paths)
    is_open: dict[str, int] = {}
    at, size = 0, len(html)

    def close(upto: Node) -> None:
        """End the open elements up to and with ``upto``."""
        nonlocal node
        while True:
            done, node = node, node.up
            is_open[done.tag] -= 1
            if done is upto:
                return

    while at < size:
        m = _TAG.search(html, at) if html.find(">", at) >= 0 else None
        if m is None:  # a tag or comment that the page's end cuts off is no text
            node.parts.append(_OPEN.split(html[at:], maxsplit=1)[0])
            break
        if m.start() > at:
            node.parts.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if node.foreign and tag in (("p", "br") if m[1] else BREAKS_OUT):
            back = node
            while back.up.foreign:
                back = back.up
            close(back)
        if m[1]:
            if is_open.get(tag):
                back = node
                while back.tag != tag:
                    back = back.up
                close(back)
            elif tag == "p":
                node.parts.append(Node("p", "", node, paths))
            continue
        if tag == "html":
            continue
        empty = tag in VOID or node.foreign and m[3].endswith("/") or tag in FOREIGN and m[3].endswith("/")
        if tag in RAW:
            end = None if empty else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = at if empty else end.end() if end else size
            continue
        if tag in CLOSES_P and node.paragraph is not None:
            close(node.paragraph)
        if tag in SAME and tag in node.scope:
            close(node.scope[tag])
        fresh = Node(tag, m[3], node, paths)
        node.parts.append(fresh)
        if not empty:  # a slash does not close an HTML element
            node = fresh
            is_open[tag] = is_open.get(tag, 0) + 1
    _settle(root)
    return root, paths


def _nodes(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed([x for x in node.parts if isinstance(x, Node)]))


def _letters(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n")


def _settle(root: Node) -> None:
    """Drop what is named like boilerplate, unless it holds an article with text, or most of the text outside links.

    That is the text of the article around it, or else of the page. Adverts and comments can be longer than an article: what has
    no other names, or lies beside an article, is kept for its text only if less than a tenth is left without it; and not at all if both hold.
    """
    order = list(_nodes(root))
    if not any(n.named for n in order):
        return
    for n in reversed(order):
        within = [x for x in n.parts if isinstance(x, Node)]
        if not n.drop and n.tag != "a":
            n.size = sum(_letters(x) for x in n.parts if isinstance(x, str)) + sum(x.size for x in within)
        n.below = any(x.core for x in within)
        n.core = n.size > 0 and (n.core or n.below)
    for n in order:
        up = n.up
        base = n.base = root if up is None else None if n.tag == "a" else up.base
        if up is not None:
            n.drop |= up.drop
            n.doubt = up.doubt
        if n.holder and n.core:
            n.doubt = False
            if base is not None:
                n.base = n
        elif n.named and not n.holder and not n.drop:
            most = False
            if base is not None and n.size:
                rest = base.size - n.size
                most = rest * 10 < base.size and not (n.sure and base.below) if n.sure or base.below else rest < n.size
            n.doubt = n.core or most
            n.drop = not n.doubt


def best_container(root: Node) -> Node | None:
    """The container with the highest score; the outer one on a tie. None if there is no text outside dropped parts."""
    for node in _nodes(root):
        holder = node.block
        if node.drop or node.link or holder is None:
            continue
        weight = sum(_letters(x) for x in node.parts if isinstance(x, str)) * (DOUBT if node.doubt else 1)
        while holder is not None and weight > 0.5:
            holder.score += weight * (FAVOUR if holder.favour else 1)
            weight *= DECAY
            holder = holder.up
    best = None
    for node in _nodes(root):
        if node.score > 0 and not node.drop and (best is None or node.score > best.score):
            best = node
    return best


def text_of(node: Node) -> str:
    """Blocks in page order, white space squeezed, joined by a space; dropped parts are left out."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or not x.drop:
            if x.tag in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.parts))
    return " ".join(unescape("".join(out)).split())


def extract(html: str | None, path: str | None) -> str:
    """The text at ``path``, or of the page's best container where there is no text at it."""
    root, paths = parse(html or "")
    asked = paths.find(path) if path else None
    found = [n for n in _nodes(root) if n.path == asked and not n.drop] if asked is not None else []
    text = " ".join(t for t in map(text_of, found) if t)
    if text:
        return text
    best = best_container(root)
    return text_of(best) if best is not None else ""


def host_of(url: Column) -> Column:
    """The host in lower case; empty for null or odd addresses."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def best_path(html: str) -> tuple[str | None, float]:
    """The path and score of a page's best container."""
    root, paths = parse(html)
    best = best_container(root)
    return (paths.spell(best.path), best.score) if best is not None else (None, 0.0)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [best_path(x.as_py() or "") for x in batch["html"]]
        yield pa.record_batch(
            [batch["host"], pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())],
            names=["host", "path", "score"],
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the container path with the most votes of the host's pages; by score, then by name on a tie.

    Pages without text have no vote, repeated rows vote as often as they come, pages without a host vote together; an empty table has no host.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    votes = rows.mapInArrow(_vote, "host string, path string, score double").where("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round("score", 3).cast("decimal(30,3)")).alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages`` (``page_id``, ``url``, ``html``; other columns are ignored).

    Forms and what is named like boilerplate go, unless they hold the article or nearly all of the text. Null or empty html, and
    pages without text outside of dropped parts, give an empty text. Pages without a
    host vote together. Repeated rows come out as often as they came in.
    """
    paths = write_stage(host_paths(pages), "paths")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    rows = lookup_join(rows, paths, ["host"], "left", LOOKUP_BYTES).select("page_id", "url", "html", "path")

    @F.arrow_udf("string")
    def read(html: pa.Array, path: pa.Array) -> pa.Array:
        return pa.array([extract(h.as_py(), p.as_py()) for h, p in zip(html, path)], pa.string())

    told = rows.select("page_id", "url", read.asNondeterministic()(F.col("html"), F.col("path")).alias("text"))
    return told.withColumn("n_chars", F.length("text").cast("long"))
