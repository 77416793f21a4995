"""Structure of pages: a small tree over the standard library's parser, with implied ends of paragraphs and items.

Rules (what to prune, which headings open promotional or reference sections) are parameters. Everything here runs in Arrow
UDFs, as built-in expressions know no trees; only links stay in the JVM. State scripts with embedded JSON aren't read.
"""

from __future__ import annotations

import itertools
import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
SKIP = frozenset("script style noscript template svg iframe".split())


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else "" if c.tag in SKIP else c.text() for c in self.children)

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def drop(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]

    def siblings_after(self) -> list:
        cs = self.parent.children if self.parent else []
        at = next((i for i, c in enumerate(cs) if c is self), len(cs))
        return cs[at + 1 :]


class Tree(HTMLParser):
    def __init__(self, source: str, deepest: int = 400):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")
        self.depth, self.deepest = 0, deepest
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        while self.at.tag in CLOSES and tag in CLOSES[self.at.tag]:
            self.up()
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID and self.depth < self.deepest:
            self.at, self.depth = n, self.depth + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.up()

    def up(self) -> None:
        if self.at.parent:
            self.at, self.depth = self.at.parent, self.depth - 1

    def handle_endtag(self, tag):
        n = self.at
        while n and n.tag != tag:
            n = n.parent
        if n and n.parent:
            while self.at is not n:
                self.up()
            self.up()

    def handle_data(self, data):
        self.at.children.append(data)


def squeezed(s: str) -> str:
    return " ".join(s.split())


def body(root: Node, ids: tuple[str, ...] = (), classes: tuple[str, ...] = ()) -> Node:
    """The first node of a wanted id or class, else <article>, <body>, the whole."""
    for wanted in (lambda n: n.attrs.get("id") in ids or any(c in n.attrs.get("class", "") for c in classes), lambda n: n.tag == "article", lambda n: n.tag == "body"):
        for n in root.walk():
            if wanted(n):
                return n
    return root


def prune(root: Node, marks: tuple[str, ...] = (), tags: frozenset = SKIP, phrases: tuple[str, ...] = ()) -> None:
    """Drops nodes of those tags, whose class or id holds a mark, and short lines that begin with a phrase."""
    for n in list(root.walk()):
        mark = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()
        if n is not root and (n.tag in tags or any(m in mark for m in marks) or (phrases and n.tag in ("p", "div", "li", "a", "strong") and squeezed(n.text()).lower().startswith(phrases) and len(n.text()) < 200)):
            n.drop()


# How tables of contents are named, headed and linked.
CONTENTS = ("daftar isi", "table of contents", "table of content", "toc")
CONTENTS_IDS = ("table-of-contents", "table-of-content", "toc", "daftar-isi")
CONTENTS_CLASSES = ("table-of-content", "toc-wrapper", "article-toc", "daftar-isi")
CONTENTS_TARGET = re.compile(r"[^#]*#(?:h-|heading-)")
LISTS, HEADINGS = frozenset(("ul", "ol")), frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "strong", "div", "span"))
#: Share of a list's links (two at least) that lead to headings of the page, from which it is a table of contents.
CONTENTS_SHARE = 0.6


def label(n: Node) -> str:
    return squeezed(n.text()).strip(" :*#").lower()


def contents_score(n: Node) -> float:
    """How surely a node is a table of contents by its name or by where its links lead: 1 is sure."""
    if n.tag == "nav" or n.attrs.get("id", "").lower() in CONTENTS_IDS or any(c in n.attrs.get("class", "").lower() for c in CONTENTS_CLASSES):
        return 1.0
    targets = [a.attrs.get("href", "") for a in n.walk() if a.tag == "a"] if n.tag in LISTS else []
    return sum(map(bool, map(CONTENTS_TARGET.match, targets))) / len(targets) / CONTENTS_SHARE if len(targets) > 1 else 0.0


def leads_inside(n: Node) -> bool:
    """All the node says are links to places of the page."""
    own = [a for a in n.walk() if a.tag == "a"]
    return bool(own) and all(a.attrs.get("href", "").startswith("#") for a in own) and squeezed("".join(a.text() for a in own)) == squeezed(n.text())


def headed(title: Node) -> list[Node]:
    """What stands under a heading of contents: lists, navigation and inner links up to other text, or to a rule, which belongs to it."""
    after = [s for s in title.siblings_after() if not isinstance(s, str) or s.strip()]
    own = list(itertools.takewhile(lambda s: isinstance(s, Node) and (s.tag in LISTS | {"nav", "hr"} or leads_inside(s)), after))
    rule = next((i for i, s in enumerate(own) if s.tag == "hr"), len(own))
    return own[: rule + 1]


def remove_contents(root: Node) -> None:
    """Tables of contents by their score, and headings of contents with what stands under them."""
    nodes = list(root.walk())
    titles = [n for n in nodes if n.tag in HEADINGS and label(n) in CONTENTS]
    for n in [n for n in nodes if contents_score(n) >= 1 - 1e-9] + [m for t in titles for m in (*headed(t), t)]:
        n.drop()


@dataclass(frozen=True)
class Sections:
    """Headings that open sections to leave out, and those that end them."""

    promo: tuple[str, ...] = ()
    keep: tuple[str, ...] = ("kapan harus ke dokter", "kapan perlu ke dokter", "tanda bahaya")
    reference: tuple[str, ...] = ("referensi", "daftar pustaka", "references")
    lines: tuple[str, ...] = ("ditinjau oleh", "artikel terkait", "baca juga:")
    #: Bytes below which a paragraph may open a section as a heading does.
    short: int = 75


#: Which open sections an event leaves open: an event is what a block is, a section what is left out.
CLOSED_BY = {"section": frozenset(("promo", "reference")), "step": frozenset(("promo",)), "plain": frozenset()}


def event(tag: str, text: str, rules: Sections) -> str:
    """promo or reference if the block opens such a section; section if it ends any, step if it ends a promotional one; else plain."""
    key = text.lower().strip(" :.!?*#")
    kept = any(k in key for k in rules.keep)
    if tag[0] == "h" or len(text.encode()) < rules.short:
        if not kept and any(k in key for k in rules.promo):
            return "promo"
        if key.split(":")[0] in rules.reference:
            return "reference"
    if kept or tag[0] == "h":
        return "section"
    return "step" if text.endswith("?") or re.match(r"\d+\.\s+", text) else "plain"


def paragraphs(root: Node, rules: Sections = Sections()) -> list[str]:
    """Headings, paragraphs and items (with a bullet) in order, without promotional and reference sections.

    A promotional section ends at a kept or other heading, a numbered line or a question; a reference section at a kept or
    other heading.
    """
    nested = lambda n: n.tag == "li" and any(isinstance(c, Node) and c.tag in ("p", "ul", "ol") for c in n.children)
    blocks = [(n.tag, t) for n in root.walk() if re.fullmatch(r"h[1-6]|p|li", n.tag) and not nested(n) and (t := squeezed(n.text()))]
    events = [event(tag, t, rules) for tag, t in blocks]
    # the sections left open behind each block
    open_ = itertools.accumulate(events, lambda s, e: s | {e} if e not in CLOSED_BY else s - CLOSED_BY[e], initial=frozenset())
    next(open_)
    own = [(tag, t) for (tag, t), e, s in zip(blocks, events, open_) if not s]
    wanted = lambda t: not any(x in t.lower() for x in rules.lines) and t.lower().strip(" :.!?*#") not in CONTENTS
    return [f"• {t}" if tag == "li" else t for tag, t in own if wanted(t)]


def first(root: Node, tag: str, key: str | None = None, value: str | None = None, get: str | None = None) -> str:
    for n in root.walk():
        if n.tag == tag and (key is None or n.attrs.get(key) == value):
            t = squeezed(n.attrs.get(get, "") if get else n.text())
            if t:
                return t
    return ""


def linked_data(root: Node) -> list[dict]:
    """Every ld+json script that reads as an object, or as a list of them."""
    out: list[dict] = []
    for n in root.walk():
        if n.tag == "script" and "ld+json" in n.attrs.get("type", ""):
            try:
                value = json.loads("".join(c for c in n.children if isinstance(c, str)))
            except ValueError:
                continue
            out += [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]
    return out


def last_of_srcset(s: str) -> str:
    return next((p.split()[0] for p in reversed(s.split(",")) if p.split()), "")


def fields(source: str, marks: tuple[str, ...] = (), phrases: tuple[str, ...] = (), rules: Sections = Sections()) -> dict:
    """Title, image, category and paragraphs of a page, each with the tier it came from."""
    root = Tree(source).root
    data = linked_data(root)
    image = lambda v: v.get("url", "") if isinstance(v, dict) else image(v[0]) if isinstance(v, list) and v else v if isinstance(v, str) else ""
    keywords = lambda v: ", ".join(map(str, v)) if isinstance(v, list) else v if isinstance(v, str) else ""
    tiers = {
        "title": [("h1", first(root, "h1")), ("og", first(root, "meta", "property", "og:title", "content")), ("ld", next((squeezed(str(d["headline"])) for d in data if d.get("headline")), "")), ("title", first(root, "title").split("|")[0].strip())],
        "image": [("figure", next((i.attrs.get("src", "") or last_of_srcset(i.attrs.get("srcset", "")) for f in root.walk() if f.tag in ("figure", "picture") for i in f.walk() if i.tag in ("img", "source")), "")), ("og", first(root, "meta", "property", "og:image", "content")), ("ld", next((x for d in data if (x := image(d.get("image")))), "")), ("img", first(root, "img", get="src"))],
        "category": [("section", first(root, "meta", "property", "article:section", "content")), ("keywords", first(root, "meta", "name", "keywords", "content")), ("ld", next((x for d in data if (x := keywords(d.get("keywords")))), ""))],
    }
    out = {}
    for name, options in tiers.items():
        tier, value = next(((t, v) for t, v in options if v), ("none", ""))
        out[name], out[f"{name}_tier"] = value, tier
    main = body(root)
    prune(main, marks, phrases=phrases)
    remove_contents(main)
    out["paragraphs"] = paragraphs(main, rules)
    return out


FIELDS = T.StructType([T.StructField(f"{n}{s}", T.StringType()) for n in ("title", "image", "category") for s in ("", "_tier")] + [T.StructField("paragraphs", T.ArrayType(T.StringType()))])


def page_fields(html: Column, marks: list[str] = (), phrases: list[str] = (), rules: Sections = Sections()) -> Column:
    """struct of `fields`; a null page gives nulls."""
    m, p = tuple(marks), tuple(phrases)

    @F.pandas_udf(FIELDS)
    def run(pages: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(FIELDS.names)
        return pd.DataFrame([fields(x, m, p, rules) if x else empty for x in pages], columns=FIELDS.names)

    return run(html)


def links(html: Column) -> Column:
    """Targets of anchors in order, then those of data-url attributes, first of each: array<string>, in the JVM."""
    found = lambda p: F.regexp_extract_all(html, F.lit(p), F.lit(1))
    return F.array_distinct(F.concat(found(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"'#][^"']*)["']"""), found(r"""(?i)data-url\s*=\s*["']([^"']+)["']""")))
