"""HTML as a tree of blocks, and labelled pages to train from.

parse() makes a node of each block-level element and a leaf of each run of text between block boundaries; inline elements
belong to their run. made_pages() invents labelled pages in many layouts.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

#: Elements by how they are laid out; fixed values from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object audio video canvas textarea title select option head annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas are text of their line; of these and svg, unlike other elements, a slash in the tag closes.
MATH = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE |= MATH
ONE_P = frozenset("p li dt dd tr td th thead tbody tfoot".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")


#: Attributes of which the last is an unquoted value, which a slash belongs to.
UNQUOTED = re.compile(r"=\s*[^\s\"'=]\S*\Z")


@dataclass
class Page:
    """Nodes in page order; a parent comes before its children. text is None for elements."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    hint: list[str] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)

    def add(self, parent: int, tag: str, hint: str, text: str | None = None, linked: int = 0, marked: bool = False) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.hint.append(hint)
        self.text.append(text)
        self.linked.append(linked)
        self.marked.append(marked)
        return len(self.parent) - 1


def _slashed(attributes: str) -> bool:
    return attributes.endswith("/") and not UNQUOTED.search(attributes)


class Raw:
    """Where elements end whose content isn't markup of the page; each tag's ends are looked up once a page."""

    def __init__(self, source: str):
        self.source, self.ends = source, {}

    def end(self, tag: str, at: int) -> int:
        """The end of an element whose start tag ends at `at`; `at` itself if it has no end tag."""
        if tag in ("script", "style", "textarea", "title"):
            m = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(self.source, at)
            return m.end() if m else len(self.source)
        return self._option(at) if tag == "option" else self._nested(tag).get(at, at)

    def _nested(self, tag: str) -> dict[int, int]:
        if tag not in self.ends:
            ends, opened = self.ends.setdefault(tag, {}), []
            for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", self.source, re.I):
                if not m[1]:
                    if not (tag == "svg" and _slashed(m[2])):
                        opened.append(m.end())
                elif opened:
                    ends[opened.pop()] = m.end()
        return self.ends[tag]

    def _option(self, at: int) -> int:
        """An option holds text: it ends at its end tag, or before the next option, other block or end tag of its parent."""
        inner: list[str] = []
        for m in TOKEN.finditer(self.source, at):
            tag = (m[2] or "").lower()
            if m[1] and tag == "option":
                return m.end()
            if tag and tag not in VOID and (tag not in INLINE or m[1] and tag not in inner):
                return m.start()
            if tag in INLINE:
                inner.remove(tag) if m[1] else inner.append(tag)
        return at


def parse(source: str | None) -> Page:
    """The page's blocks. Unclosed and stray tags are tolerated; a null or empty page is a root alone."""
    source, page = (source or "").replace("\0", ""), Page()
    raw = Raw(source)
    stack: list[tuple[str, int]] = [("html", page.add(-1, "html", ""))]  # with the node that text belongs to
    run: list[str] = []
    linked = anchors = 0
    mark = False

    def flush() -> None:
        nonlocal linked, mark
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            node = next(n for t, n in reversed(stack) if n >= 0)
            page.add(node, page.tag[node], page.hint[node], text, min(linked, len(text)), mark)
        run.clear()
        linked, mark = 0, False

    def close(k: int) -> None:
        nonlocal anchors
        if any(n >= 0 for _, n in stack[k:]):
            flush()
        anchors -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    at = 0
    while at < len(source):
        m = TOKEN.search(source, at)
        chunk = source[at : m.start() if m else len(source)]
        if chunk:
            run.append(chunk)
            if anchors:
                linked += len(chunk.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if k and not (tag in INLINE and any(n >= 0 for _, n in stack[k + 1 :])):
                close(k)
            continue
        if tag in ("html", "body"):
            continue
        given = {(a[0] or a[4]).lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
        hidden = "hidden" in given or "display:none" in given.get("style", "").replace(" ", "").lower()
        if tag in MATH and _slashed(m[3]):
            continue
        if tag in RAW:
            at = at if tag == "svg" and _slashed(m[3]) else raw.end(tag, at)
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                run.append(" ")
            continue
        if tag in INLINE and not hidden:
            stack.append((tag, -1))
            anchors += tag == "a"
            mark = mark or "data-content" in given
            continue
        if tag in INLINE:
            tag = "div"
        # A block ends an open paragraph; an item or cell ends its open sister.
        flush()
        opened = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p" or stack[k][0] in ONE_P and stack[k][0] == tag or stack[k][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "td", "blockquote")), 0)
        if opened and (stack[opened][0] == "p" or stack[opened][0] == tag and tag in ONE_P):
            close(opened)
        hint = " ".join(given.get(k, "") for k in ("class", "id", "role", "itemprop")).lower() + (" hidden" if hidden else "")
        parent = next(n for t, n in reversed(stack) if n >= 0)
        stack.append((tag, page.add(parent, tag, hint, marked="data-content" in given)))
        mark = "data-content" in given
        if m[3].rstrip().endswith("/") and tag not in INLINE:
            pass  # a slash closes nothing in HTML
    flush()
    return page


#: Parts of the class names that the invented layouts use; fixed values.
BOILERPLATE = {
    "menu": "nav navbar menu main-menu site-nav navigation breadcrumb topnav",
    "header": "header site-header masthead top-bar page-head branding",
    "footer": "footer site-footer page-foot copyright bottom colophon",
    "side": "sidebar side aside widget related rail secondary recommended popular",
    "notice": "cookie cookie-notice consent gdpr notice banner alert popup modal newsletter",
    "advert": "ad ads advert advertisement sponsored promo adsense banner-ad",
    "form": "form search login subscribe signup contact-form",
    "comments": "comments comment-list discussion replies responses reader-comments disqus",
    "share": "share social share-buttons tags meta byline-links pagination",
}
CONTENT = "article post content entry-content story main-content article-body text body-text post-body".split()


class Maker:
    """Invents pages; leaves under elements marked data-content are the main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts = [c + v for c in "b d f g k l m n p r s t v sh th ch".split() for v in "a e i o u ai en or ß é ñ ü".split()]

    def words(self, low: int, high: int) -> str:
        r, n = self.r, self.r.randint(low, high)
        style = r.random()
        out = ["".join(r.choices(self.parts, k=r.randint(1, 4))) + (r.choice(".,;!") if r.random() < 0.15 else "") for _ in range(n)]
        if style < 0.07:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.14:
            out = [w + r.choice(("***", "$$$", "%%%", "&amp;&amp;")) for w in out]
        elif style < 0.18:
            out = [out[0]] * n
        elif style < 0.22:
            out = " | ".join(out).split(" ")
        return " ".join(out)[:1].upper() + " ".join(out)[1:]

    def name(self, kind: str) -> str:
        value = self.r.choice(BOILERPLATE[kind].split())
        return f' {self.r.choice(("class", "class", "id"))}="{value}"' if self.r.random() < 0.75 else ""

    def links(self) -> str:
        items = [f'<a href="/{self.r.randint(1, 99)}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(3, 9))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.r.random() < 0.7 else self.r.choice((" | ", " ", "<br>")).join(items)

    def outside(self, kind: str) -> str:
        r, w = self.r, self.words
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        tag, name = (tag, self.name(kind)) if r.random() < 0.6 else ("div", f' class="{r.choice(BOILERPLATE[kind].split())}"')
        body = {
            "menu": self.links,
            "header": lambda: f"<div>{w(1, 4)}</div>" + (self.links() if r.random() < 0.5 else ""),
            "footer": lambda: f"&copy; {w(1, 3)} &middot; {w(2, 25)}" + (self.links() if r.random() < 0.4 else ""),
            "side": lambda: f"<h3>{w(1, 3)}</h3>" + (self.links() if r.random() < 0.6 else f"<p>{w(5, 40)}</p>"),
            "notice": lambda: f"<p>{w(5, 30)}</p><button>{w(1, 2)}</button>" if r.random() < 0.6 else w(5, 30),
            "advert": lambda: w(2, 30) if r.random() < 0.6 else f'<p>{w(2, 20)} <a href="/x">{w(1, 3)}</a></p>',
            "form": lambda: f'<label>{w(1, 3)}</label><input type="text"><p>{w(1, 12)}</p><button>{w(1, 2)}</button>',
            "comments": lambda: f"<h3>{w(1, 3)}</h3>" + "".join(f'<div class="{r.choice(("comment", "reply", "c"))}"><b>{w(1, 2)}</b><p>{w(3, 50)}</p></div>' for _ in range(r.randint(1, 5))),
            "share": self.links,
        }[kind]()
        return f"<{tag}{name}>{body}</{tag}>"

    def article(self) -> str:
        r, w, d = self.r, self.words, " data-content"
        parts = [f"<{h}{d}>{w(1, 12)}</{h}>"] if (h := r.choice(("h1", "h1", "h2", ""))) else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            kind, text = r.random(), w(1, r.choice((3, 15, 60, 150)))
            if r.random() < 0.2:
                text = f"<b>{text}</b>"
            if r.random() < 0.2:
                text += f' <a href="/y">{w(1, 3)}</a> {w(1, 10)}'
            if kind < 0.7:
                parts.append(f"<p{d}>{text}" + r.choice(("</p>", "</p>", "<br>", "")))
            elif kind < 0.78:
                parts.append("<ul>" + "".join(f"<li{d}>{w(1, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.84:
                parts.append(f"<h2{d}>{w(1, 8)}</h2>")
            elif kind < 0.88:
                parts.append(f"<blockquote{d}>{text}</blockquote>")
            elif kind < 0.91:
                parts.append(f"<table><tr><td{d}>{w(1, 5)}</td><td{d}>{w(1, 5)}</td></tr></table>")
            else:
                parts.append(f"<div{d}>{text}</div>")
        for kind in ("advert", "share", "comments", "form", "side", "notice"):
            if r.random() < 0.15:
                parts.insert(r.randint(1, len(parts)) if kind == "advert" else len(parts), self.outside(kind))
        style = r.random()
        if style < 0.5:
            return f"<article>{''.join(parts)}</article>"
        if style < 0.65:
            return f'<main><div class="{r.choice(CONTENT)}">{"".join(parts)}</div></main>'
        return f'<div {r.choice(("class", "id"))}="{r.choice(CONTENT)}">{"".join(parts)}</div>'

    def page(self) -> str:
        r = self.r
        before = [self.outside(k) for k in ("notice", "header", "menu", "advert", "form") if r.random() < 0.45]
        after = [self.outside(k) for k in ("share", "comments", "side", "advert", "form", "notice", "footer", "footer") if r.random() < 0.35]
        r.shuffle(before)
        main = self.article() if r.random() < 0.97 else ""
        if r.random() < 0.3:
            main = f'<div class="{r.choice(("wrap", "container", "row", "page", "layout"))}">{main}{after.pop(0) if after else ""}</div>'
        return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{''.join(before)}{main}{''.join(after)}" + r.choice(("</body></html>", ""))


def made_pages(n: int, seed: int = 7) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
