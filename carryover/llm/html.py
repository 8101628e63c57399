"""Main text of web pages, with the templates of their sites removed.

Each page is read into blocks of text, and the element subtrees around them are hashed. Spark
counts on how many pages of a host, and of a folder of it, each subtree recurs; blocks inside a
subtree that recurs on many pages there are dropped, after those that their own markup names
as menus, notices, adverts, forms or comments.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.llm.frames import BOOL, LONG, STRING, arrow_map, chosen
from carryover.llm.text import strings
from carryover.llm.urls import host_of
from carryover.session import settle

TAG = re.compile("<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile("\\b(class|id|role)\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))", re.I)
#: Names that say what else is on the page.
ABOUT = re.compile("(?:has|with|without|no)[-_]")
#: Fixed values of the HTML standard: elements without content, with raw content, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body dd dt html li option summary tbody td tfoot th thead tr figcaption".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
            "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
LISTS = {"ul", "ol", "menu", "dl", "table", "article", "main", "body", "div", "section"}
#: Elements and names (of class, id or role) that are not part of an article.
DROPPED = RAW | frozenset("head nav footer aside form button select template svg canvas dialog menu object audio video search".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer contentinfo complementary "
    "comment comments reply replies disqus respond share sharing social related recommended widget toolbar search skip skiplink".split())
ROOTS = ("article", "main")
CONTENT = frozenset("article main h1 h2 h3 h4 h5 h6".split())
#: Names of page heads; those inside an article belong to it.
HEADS = frozenset("header masthead topbar".split())
#: A subtree recurs on at least so many pages; inside a marked article, on so many.
MIN_PAGES, MIN_MARKED = 3, 20
#: Groups with templates that fit a broadcast; each has a few dozen subtrees of 8 bytes.
FEW_GROUPS = 50_000


class Element:
    """An open or closed element. ``holder`` is the nearest block that it is in or is; ``hash``
    is set when it closes."""

    __slots__ = ("tag", "dropped", "root", "parent", "holder", "digest", "hash")

    def __init__(self, tag: str, dropped: bool, root: int, parent: Element | None, named: str = ""):
        self.tag, self.dropped, self.root, self.parent, self.hash = tag, dropped, root, parent, 0
        self.holder = self if parent is None or tag in BLOCK else parent.holder
        self.digest = blake2b(f"{tag} {named}".encode(), digest_size=8) if parent else blake2b(digest_size=8)


@dataclass
class Root:
    """A marked article or main part: the element around it, and the part it lies in."""

    kind: str
    around: Element | None
    outer: int


@dataclass
class Page:
    """Blocks of text with the element each lies in, all block elements, parents first."""

    blocks: list[tuple[str, Element]]
    elements: list[Element]
    roots: list[Root]

    def main(self) -> tuple[list[tuple[str, Element]], bool]:
        """The blocks of the main text, and whether it is marked: the part around the longest
        article or else the article and its siblings, else the longest main part, else all."""
        size = [0] * len(self.roots)
        for text, e in self.blocks:
            size[e.root] += len(text)
        best = max((r for r in range(1, len(size)) if size[r]), key=lambda r: (self.roots[r].kind == "article", size[r], -r), default=0)
        if not best:
            return self.blocks, False
        root = self.roots[best]
        if root.outer:
            wanted = {r for r in range(len(size)) if root.outer in (r, self.roots[r].outer)}
        elif root.kind == "article":
            wanted = {r for r, x in enumerate(self.roots) if x.kind == "article" and x.around is root.around}
        else:
            wanted = {r for r, x in enumerate(self.roots) if best in (r, x.outer)}
        return [b for b in self.blocks if b[1].root in wanted], True

    def text(self, drop: set[int], drop_marked: set[int]) -> str:
        """The main text without what lies in a subtree to drop."""
        blocks, marked = self.main()
        gone: set[int] = set()
        templates = drop_marked if marked else drop
        if templates:
            for e in self.elements:
                if e.hash in templates or id(e.parent.holder) in gone:
                    gone.add(id(e))
        return " ".join(text for text, e in blocks if id(e) not in gone)

    def subtrees(self) -> tuple[list[int], bool]:
        """Hashes of the subtrees that hold main text, and whether it is marked."""
        blocks, marked = self.main()
        seen: set[int] = set()
        found: set[int] = set()
        for _, e in blocks:
            while e.parent is not None and id(e) not in seen:
                seen.add(id(e))
                if e.tag not in ("html", "body"):
                    found.add(e.hash)
                e = e.parent.holder
        return sorted(found), marked


def _words(attributes: str) -> tuple[set[str], set[str]]:
    """Whole names of class, id and role, and the words that they are made of; a name such as
    ``has-sidebar`` says what is elsewhere."""
    names = {n for m in ATTRIBUTE.finditer(attributes) for n in (m[2] or m[3] or m[4] or "").lower().split()}
    return names, {w for n in names if not ABOUT.match(n) for w in re.split("[^a-z0-9]+", n) if w}


def read_page(page: str) -> Page:
    """The blocks of a page in order. Work is in proportion to the page, however it is nested."""
    top = Element("", False, 0, None)
    stack, out, run = [top], Page([], [], [Root("", None, 0)]), []
    opened: Counter[str] = Counter()

    def add(text: str) -> None:
        if text:
            stack[-1].digest.update(text.strip().encode("utf-8", "replace"))
            if not stack[-1].dropped:
                run.append(text)

    def end_block() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.blocks.append((text, stack[-1].holder))

    def close() -> None:
        e = stack[-1]
        if e.tag in BLOCK:
            end_block()
        stack.pop()
        opened[e.tag] -= 1
        e.hash = int.from_bytes(e.digest.digest(), "little", signed=True)
        e.parent.digest.update(e.digest.digest())

    def close_while(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in stop:
                return

    # behind the last ``>`` nothing is a tag; a comment that is never closed goes on to the end
    at, n, last = 0, len(page), page.rfind(">") + 1
    while at < n:
        m = TAG.search(page, at, last)
        if not m:
            add(entities.unescape(page[at:].partition("<!--")[0]))
            break
        if m.start() > at:
            add(entities.unescape(page[at:m.start()]))
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        if m[1]:
            if tag in BLOCK:
                end_block()
            if tag in BLOCK or tag in DROPPED:
                close_while({tag}, {"article"} - {tag} if tag not in ("main", "body", "html") else set())
            else:
                close_while({tag}, BLOCK)
            if tag == "br":
                run.append(" ")
            continue
        if tag in VOID:
            run.append(" " if tag in ("br", "wbr") else "")
            if tag == "hr":
                end_block()
            continue
        if tag in CLOSES_P:
            close_while({"p"}, LISTS | {"td", "th", "li", "button"})
        if tag in SIBLINGS:
            close_while(SIBLINGS[tag], LISTS)
        if tag in BLOCK:
            end_block()
        up, (names, words) = stack[-1], _words(m[3]) if "=" in m[3] else (set(), set())
        # what an article or heading is about is no reason to drop it: only a whole name is
        noise = names if tag in CONTENT else words
        inside = up.root and out.roots[up.root].kind in ROOTS
        dropped = up.dropped or tag in DROPPED or (not inside and (tag == "header" or bool(noise & HEADS))) or (bool(noise & NAMES) and tag not in ("html", "body"))
        root = up.root
        if (tag in ROOTS or "main" in words and tag == "div") and not dropped and out.roots[root].kind != "article":
            out.roots.append(Root("article" if tag == "article" else "main", up.holder, root))
            root = len(out.roots) - 1
        if tag in RAW and not m[3].endswith("/"):
            stop = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        e = Element(tag, dropped, root, up, " ".join(sorted(words)))
        stack.append(e)
        opened[tag] += 1
        if tag in BLOCK:
            out.elements.append(e)
    while len(stack) > 1:
        close()
    end_block()
    return out


def _own(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows with the two groups that they are in: their host, and the first folder on it."""
    own = chosen(pages, _id=id_col, _url=url_col, text=html_col).withColumn("_host", host_of(F.col("_url")))
    folder = F.regexp_extract(F.coalesce("_url", F.lit("")), "://[^/?#]*(/[^/?#]*/)", 1)
    return own.withColumn("_folder", F.concat("_host", F.when(folder == "", F.lit("/")).otherwise(folder)))


def page_subtrees(own: DataFrame) -> DataFrame:
    """Per page: its groups, its subtrees that hold main text and whether that is marked."""
    def read(b: pa.RecordBatch) -> dict:
        found = [read_page(p).subtrees() for p in strings(b.column("text"))]
        return {"marked": [m for _, m in found], "subtrees": [s for s, _ in found]}

    return arrow_map(own.select("_host", "_folder", "text"), read, {"marked": BOOL, "subtrees": T.ArrayType(LONG)}, ["_host", "_folder"])


def recurring(seen: DataFrame, share: float, marked_share: float) -> DataFrame:
    """Per group, the subtrees on at least ``MIN_PAGES`` pages and a ``share`` of all its pages;
    ``drop_marked`` has those that count within marked articles too: on ``MIN_MARKED`` pages and
    a ``marked_share``, so that near copies of an article on a site are no template. Pages with the
    same subtrees count once. A group has no more of them than its pages have subtrees on
    average, divided by the share."""
    each = (seen.select(F.explode(F.array("_host", "_folder")).alias("_group"), F.xxhash64("subtrees").alias("page"), "subtrees")
            .dropDuplicates(["_group", "page"]))
    pages = each.groupBy("_group").agg(F.count("*").alias("pages"))
    often = (each.select("_group", F.explode("subtrees").alias("subtree")).groupBy("_group", "subtree").agg(F.count("*").alias("n"))
             .filter(F.col("n") >= MIN_PAGES).join(pages, "_group").filter(F.col("n") >= share * F.col("pages")))
    marked = (F.col("n") >= marked_share * F.col("pages")) & (F.col("n") >= MIN_MARKED)
    return often.groupBy("_group").agg(F.collect_list("subtree").alias("drop"), F.collect_list(F.when(marked, F.col("subtree"))).alias("drop_marked"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 share: float = 0.5, marked_share: float = 0.9) -> DataFrame:
    """One row per input row: id, url, ``text`` (the main text) and ``n_chars``.

    Pages are read twice, once for their subtrees and once for their text, so that no text is
    written on the way. The templates of all groups are broadcast if there are at most
    ``FEW_GROUPS`` of them, else joined by group.

    Null and empty pages, and pages without main text, give an empty text. Null urls share the
    empty host. A null id or url stays null, repeated rows give repeated results (and count
    as one page), other columns are not looked at. The result does not depend on the order
    of rows: of equally long articles in a page the first is taken, with those beside it.
    """
    own = _own(pages, id_col, url_col, html_col)
    templates = settle(recurring(settle(page_subtrees(own), "subtrees"), share, marked_share), "templates")
    few = templates.count() <= FEW_GROUPS

    def of(group: str) -> DataFrame:
        t = templates.select(F.col("_group").alias(group), F.col("drop").alias(f"{group}_drop"), F.col("drop_marked").alias(f"{group}_marked"))
        return F.broadcast(t) if few else t

    both = lambda what: F.concat(*[F.coalesce(f"{g}_{what}", F.array().cast("array<bigint>")) for g in ("_host", "_folder")])
    known = own.join(of("_host"), "_host", "left").join(of("_folder"), "_folder", "left").select("_id", "_url", "text", both("drop").alias("drop"), both("marked").alias("marked"))

    def read(b: pa.RecordBatch) -> dict:
        rows = zip(strings(b.column("text")), b.column("drop").to_pylist(), b.column("marked").to_pylist(), strict=True)
        return {"main": [read_page(p).text(set(d), set(m)) for p, d, m in rows]}

    done = arrow_map(known, read, {"main": STRING}, ["_id", "_url"])
    return done.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("main").alias("text"), F.length("main").cast("long").alias("n_chars"))
