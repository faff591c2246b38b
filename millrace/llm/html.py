"""Main text of web pages by consensus: each page scores its containers, the pages of a host vote on generalised tag-class paths in Spark, and every
page is extracted again at the path that won on its host.

A page is read once, from left to right. Its containers form a tree by parent numbers, and a path is a hash of the parent's path and the container's
own step, so neither time nor memory grows with the square of a page's depth.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, few_ids, named, written

#: Elements whose whole content is no text of the page.
DROPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video map head title select option button textarea input nav aside footer dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe canvas audio video textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article body center div main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Opening one of these ends open ones of these kinds, up to the next element around them that is a bound.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "p": ("p",)}
BOUNDS = CONTAINERS | frozenset("ul ol dl table blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar".split())
#: What the last telling word of a class or id says an element is: no part of the article, in any place.
OUTSIDE = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager sidebar sidebars cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login footer footers masthead topbar toolbar share sharing social related".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words of names that say where or how, not what.
GENERIC = frozenset("area bar block bottom box button buttons col column container content fixed group header holder icon icons inner item items left link links list main outer panel primary region right row secondary section slot sticky text thread top unit wrap wrapper zone".split())
#: Names that begin so speak of something else's state.
STATES = frozenset("has is layout no not with without".split())
#: Headers of these are the article's own.
OWN = frozenset("article blog chapter content entry main news post section story text title".split())
GOOD = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]++)")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Java and Python read this alike; only Spark applies it.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: What a container passes on of its points to the one around it.
PASSED = 0.75
#: Hosts (of 8 bytes each on average) up to which the winners are broadcast; beyond it they are joined by a shuffle.
HOSTS = 1_000_000


def step(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes (else the id), where digits are one #."""
    name = attributes.get("class") or attributes.get("id") or ""
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c.lower()) for c in name.split()})])


def telling(name: str) -> tuple[str, list[str]]:
    """The last word of a class or id that says what an element is, and the words before it: `cookie-notice-box` is a notice, `notice-period` a period."""
    parts = [p for p in re.split(r"[-_:\d]+", HUMP.sub("-", name).lower()) if p]
    if not parts or parts[0] in STATES:
        return "", []
    if (whole := "".join(parts)) in OUTSIDE | COMMENTS:
        return whole, []
    while len(parts) > 1 and parts[-1] in GENERIC and parts[-1] != "header":
        parts.pop()
    return parts[-1], parts[:-1]


def names(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """'' (part of the page), 'comments' or 'outside', by class and id."""
    if tag in ("body", "html", "main"):
        return ""
    out = ""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        word, before = telling(name)
        if word in COMMENTS:
            return "comments"
        if tag != "article" and (word in OUTSIDE or (word == "header" and tag not in HEADINGS and not in_article and not OWN & set(before))):
            out = "outside"
    return out


def concealed(attributes: dict[str, str], raw: str) -> bool:
    """Whether attributes say that an element is hidden or navigation and the like."""
    if attributes.get("role", "").lower() in ROLES or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    return "hidden" in raw and (attributes.get("hidden", "no") in ("", "hidden", "true") or re.search(r"\bhidden\b", ATTRIBUTE.sub("", raw)) is not None)


class Block:
    """Text of one block; at: the number of the innermost container around it, -1 for none; links: characters in links."""

    __slots__ = ("at", "heading", "links", "text")

    def __init__(self, text: str, at: int, links: int, heading: bool):
        self.text, self.at, self.links, self.heading = text, at, links, heading


class Page:
    """Blocks in page order, and containers by number: parent, path, depth and step. A container that names set apart has a reason in `apart`."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parent: list[int] = []
        self.path: list[int] = []
        self.depth: list[int] = []
        self.step: list[str] = []
        self.apart: list[str] = []

    def __iter__(self) -> Iterator[Block]:
        return iter(self.blocks)

    def opened(self, step_: str, around: int, apart: str) -> int:
        above = self.path[around] if around >= 0 else 0
        self.parent.append(around)
        self.path.append(int.from_bytes(hashlib.blake2b(b"%d/%s" % (above, step_.encode("utf-8", "replace")), digest_size=8).digest(), "little", signed=True))
        self.depth.append(self.depth[around] + 1 if around >= 0 else 0)
        self.step.append(step_)
        self.apart.append(apart)
        return len(self.parent) - 1

    def settled(self) -> Page:
        """Without the blocks in containers set apart. One that holds an article or main element is no banner or form around it, and stays; comments never do."""
        if any(self.apart):
            holds = [s.partition(".")[0] in ("article", "main") and not a for s, a in zip(self.step, self.apart, strict=True)]
            for i in range(len(holds) - 1, 0, -1):
                if holds[i] and self.parent[i] >= 0 and self.apart[i] != "comments":
                    holds[self.parent[i]] = True
            gone = [False] * len(holds)
            for i, (why, p) in enumerate(zip(self.apart, self.parent, strict=True)):
                gone[i] = (p >= 0 and gone[p]) or why == "comments" or (bool(why) and not holds[i])
            self.blocks = [b for b in self.blocks if b.at < 0 or not gone[b.at]]
        return self

    def readable(self, i: int) -> str:
        out = []
        while i >= 0:
            out.append(self.step[i])
            i = self.parent[i]
        return "/".join(["", *reversed(out)])


class Stack:
    """Open elements: tag, whether hidden, and the container around what is inside; with the places of each tag, so that nothing is searched for."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, int]] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.bounds: list[int] = []
        self.outer: list[int] = []  # places of elements that are not inline
        self.hidden = self.headings = self.articles = 0

    def push(self, tag: str, hidden: bool, inside: int) -> None:
        at = len(self.open)
        self.open.append((tag, hidden, inside))
        self.places[tag].append(at)
        if tag in BOUNDS:
            self.bounds.append(at)
        if tag not in INLINE:
            self.outer.append(at)
        self.hidden += hidden
        self.headings += tag in HEADINGS
        self.articles += tag in ("article", "main")

    def cut(self, at: int) -> None:
        """Closes all elements from a place on."""
        while len(self.open) > at:
            tag, hidden, _ = self.open.pop()
            self.places[tag].pop()
            if tag in BOUNDS:
                self.bounds.pop()
            if tag not in INLINE:
                self.outer.pop()
            self.hidden -= hidden
            self.headings -= tag in HEADINGS
            self.articles -= tag in ("article", "main")

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def inside(self) -> int:
        return self.open[-1][2] if self.open else -1


def tags(html: str) -> Iterator[tuple[str, str, str, int]]:
    """(text before, tag or '' at the end, its attributes, where it ends) of each tag; an end tag begins with /. Comments and declarations part nothing.

    send(place) goes on at a place. A tag whose quotes never close ends at its first >, and so do all that follow it; what follows the last > is text.
    """
    at, parts, quoted, last, sections = 0, [], True, html.rfind(">"), True
    while True:
        i = html.find("<", at)
        if i < 0 or i > last:
            yield "".join([*parts, unescape(html[at:])]), "", "", len(html)
            return
        if i > at:
            parts.append(unescape(html[at:i]))
        after = html[i + 1 : i + 2]
        if after == "!" and html.startswith("<!--", i):
            end = html.find("-->", i + 2)
            at = len(html) if end < 0 else end + 3
            continue
        if after == "!" and sections and html.startswith("<![CDATA[", i):
            end = html.find("]]>", i)
            if end >= 0:
                parts.append(html[i + 9 : end])
                at = end + 3
                continue
            sections = False
        if after in ("!", "?"):
            at = html.find(">", i) + 1
            continue
        m = NAME.match(html, i + 1 + (after == "/"))
        if not m:
            parts.append("<")
            at = i + 1
            continue
        rest = REST.match(html, m.end()) if quoted else None
        if rest is None:
            quoted = False
            end = html.find(">", m.end())
            attributes, at = html[m.end() : end], end + 1
        else:
            attributes, at = rest[1], rest.end()
        on = yield "".join(parts), ("/" if after == "/" else "") + m[0].lower(), attributes, at
        parts.clear()
        if on is not None:
            at = on
            yield "", "", "", at


def blocks(html: str | None) -> Page:
    """Text blocks in page order, without what stands in dropped elements or those that their names set apart. Broken nesting is mended as far as the next end tag."""
    page = Page()
    if not html:
        return page
    stack = Stack()
    parts: list[str] = []
    links = 0

    def end_block() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            page.blocks.append(Block(text, stack.inside(), min(links, len(text)), stack.headings > 0))
        parts.clear()
        links = 0

    reader = tags(html)
    for text, tag, raw, at in reader:
        if text and not stack.hidden:
            parts.append(text)
            if stack.places["a"]:
                links += len(text.strip())
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            place = stack.last(tag)
            if tag in INLINE:  # an inline end tag closes no block
                if place >= 0 and place > (stack.outer[-1] if stack.outer else -1):
                    stack.cut(place)
            elif place >= 0 or tag == "p":
                if not stack.hidden:
                    end_block()
                if place >= 0:
                    stack.cut(place)
            continue
        if tag == "br":
            if not stack.hidden:
                parts.append(" ")
            continue
        if tag not in INLINE:
            if not stack.hidden:
                end_block()
            place = stack.last(*SAME.get(tag, ()), *(("p",) if tag in ENDS_P else ()))
            if place > (stack.bounds[-1] if stack.bounds else -1) or (place >= 0 and stack.open[place][0] in BOUNDS and place == stack.bounds[-1]):
                stack.cut(place)
        if tag in VOID or raw.rstrip().endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b", re.I).search(html, at)
            end = html.find(">", close.end()) if close else -1
            reader.send(len(html) if end < 0 else end + 1)
            continue
        attributes: dict[str, str] = {}
        hidden = tag in DROPPED or (tag == "header" and not stack.articles)
        apart = "form" if tag == "form" else ""
        if raw and not raw.isspace() and not hidden:
            attributes = {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if "=" in raw else {}
            hidden = concealed(attributes, raw)
            apart = names(tag, attributes, stack.articles > 0) or apart
            if apart and tag in INLINE:
                hidden, apart = True, ""
        around = stack.inside()
        if not hidden and not stack.hidden and (tag in CONTAINERS or apart):
            around = page.opened(step(tag, attributes), around, apart)
        stack.push(tag, hidden, around)
    if not stack.hidden:
        end_block()
    return page.settled()


def scores(page: Page) -> dict[int, tuple[float, int]]:
    """Points and depth of each container's path: what its text outside links weighs, passed on in part to the containers around, with a bonus for telling names."""
    own = [0.0] * len(page.parent)
    for b in page:
        if b.at < 0:
            continue
        plain = len(b.text) - b.links
        points = (1 + plain / 100 + 0.2 * (b.text.count(",") + b.text.count("."))) * (1 - b.links / len(b.text))
        own[b.at] += points * (0.3 if len(b.text) < 25 and not b.heading else 1)
    out: dict[int, tuple[float, int]] = {}
    for i in range(len(own) - 1, -1, -1):
        if own[i] <= 0:
            continue
        if page.parent[i] >= 0:
            own[page.parent[i]] += PASSED * own[i]
        bonus = 1.5 if page.step[i].startswith(("article", "main")) else 1.4 if GOOD.search(page.step[i].partition(".")[2]) else 1.0
        out[page.path[i]] = (out.get(page.path[i], (0.0,))[0] + own[i] * bonus, page.depth[i])
    return out


def best_path(points: dict[int, tuple[float, int]]) -> int | None:
    """The path of most points; of equal ones the outermost."""
    return min(points, key=lambda p: (-points[p][0], points[p][1], p)) if points else None


def text_at(page: Page, path: int | None) -> str | None:
    """Blocks under containers of the path, joined by two \\n; None if the page has none."""
    within = []
    for p, above in zip(page.path, page.parent, strict=True):
        within.append(p == path or (above >= 0 and within[above]))
    found = [b.text for b in page if b.at >= 0 and within[b.at]]
    return "\n\n".join(found) if found else None


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url, text, n_chars, path) for every row of pages.

    A page's vote for a path is its points as thousandths of the page's best; the path of most votes wins on the host (of ties the outermost, then by
    hash). A page without that path falls back on its own best one, a page without containers on all its blocks. Null html is empty and gives an
    empty text; null and odd urls vote as one host; repeated rows vote each; an empty table gives an empty result; other columns are ignored.
    """
    kind = dict(pages.dtypes)[id_col]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(named(url_col)), F.lit("")), HOST, 1))
    source = pages.select(F.col(named(id_col)).alias("id"), F.col(named(url_col)).alias("url"), F.col(named(html_col)).alias("html"), host.alias("host"))

    def vote(batch: dict[str, list]) -> dict[str, list]:
        votes: dict[tuple[str, int], list[int]] = {}
        for host, html in zip(batch["host"], batch["html"], strict=True):
            points = scores(blocks(html))
            top = max((p for p, _ in points.values()), default=0)
            for path, (p, depth) in points.items():
                if n := round(1000 * p / top):
                    votes.setdefault((host, path), [0, depth])[0] += n
        return {"host": [h for h, _ in votes], "path": [p for _, p in votes], "votes": [n for n, _ in votes.values()], "depth": [d for _, d in votes.values()]}

    votes = arrow_map(source.select("host", "html"), "host string, path bigint, votes bigint, depth int", vote).groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.min("depth").alias("depth"))
    won = written(votes.groupBy("host").agg(F.min(F.struct(-F.col("votes"), "depth", "path")).alias("x")).select("host", F.col("x.path").alias("won")))
    chosen = source.join(F.broadcast(won) if few_ids(won, "host", HOSTS) else won, "host", "left")

    def extract(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": batch["id"], "url": batch["url"], "text": [], "path": []}
        for html, path in zip(batch["html"], batch["won"], strict=True):
            page = blocks(html)
            text = text_at(page, path) if path is not None else None
            if text is None:
                path = best_path(scores(page))
                text = text_at(page, path)
            out["text"].append("\n\n".join(b.text for b in page) if text is None else text)
            out["path"].append(None if text is None else page.readable(page.path.index(path)))
        return out | {"n_chars": [len(t) for t in out["text"]]}

    out = arrow_map(chosen.select("id", "url", "html", "won"), f"id {kind}, url string, text string, n_chars bigint, path string", extract)
    return out.select(F.col("id").alias(id_col), F.col("url").alias("url"), "text", "n_chars", "path")


def op10_html(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
