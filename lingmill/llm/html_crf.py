"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, small_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "head", "title", "textarea", "select", "button", "canvas", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"p": {"div", "section", "article", "main", "aside", "nav", "header", "footer", "td", "li", "body", "blockquote"}, "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "table", "ul", "ol", "blockquote", "figure", "figcaption", "pre", "dialog", "p", "li", "h1", "h2", "h3", "h4", "td", "dl", "address", "menu", "details")
HINTS = {
    "ad": r"(?:^|[-_ ])(?:ad|ads|advert\w*|adbox|adsense|sponsor\w*|promo\w*|banner-?ad|dfp|gpt)(?:$|[-_ \d])",
    "nav": r"nav|menu|breadcrumb|crumb|pager|paginat|toolbar|tabs|skip|navigation|toc",
    "side": r"side-?bar|aside|widget|complementary|rail|related|recommend|trending|popular|more-?(?:posts|stories)|tag-?(?:list|cloud)",
    "foot": r"foot|copyright|legal|contentinfo|colophon",
    "head": r"masthead|site-?header|top-?bar|logo|brand|page-?header|(?:^|[-_ ])(?:banner|header)(?:$|[-_ ])",
    "notice": r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|subscribe|newsletter|signup|sign-up|login|paywall",
    "comment": r"comment|disqus|respond|repl(?:y|ies)|discussion|feedback|reader",
    "share": r"share|social|follow|like-?box",
    "main": r"content|post|entry|article|story|main|text|body|prose|markdown",
    "form": r"form|search|input",
}
_HINTS = [(k, re.compile(v, re.I)) for k, v in HINTS.items()]
FEATURES = [f"t:{t}" for t in TAGS] + [f"h:{k}" for k in HINTS] + ["hidden", "leaf:p", "leaf:h", "leaf:li", "leaf:div", "len<25", "len<80", "len<200", "len>=200", "link0", "link<.3", "link<.7", "link>=.7", "stop", "copyright", "bars", "in:main,comment", "in:article,side", "early", "late", "words<4", "bias"]
INDEX = {f: i for i, f in enumerate(FEATURES)}


@lru_cache(4096)
def _hints(names: str) -> frozenset[str]:
    return frozenset(f"h:{k}" for k, r in _HINTS if r.search(names))


def _raw_end(text: str, name: str, at: int) -> int:
    m = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(text, at)
    return m.end() if m else len(text)


def blocks(page: str) -> list[tuple[str, frozenset[str], str, float]]:
    """Leaf blocks in page order: (text, names of ancestors' tags and hints, innermost block tag, share of link text).

    Comments, declarations and the content of RAW elements are left out; inline tags don't end a block; line
    breaks count as white space; unclosed elements end with their parent.
    """
    out: list = []
    stack: list[tuple[str, frozenset[str]]] = []
    marks = [frozenset()]
    buffer: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                leaf = next((n for n, _ in reversed(stack) if n not in INLINE), "body")
                out.append((text, marks[-1], leaf, min(linked / max(len(raw), 1), 1.0)))
            buffer.clear()
        linked = 0

    def pop() -> None:
        nonlocal links
        links -= stack.pop()[0] == "a"
        marks.pop()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            piece = page[at : m.start() if m else n]
            buffer.append(piece)
            if links:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA[") and len(m[0]) > 12:
                buffer.append(html.escape(m[0][9:-3]))
            continue
        name = m[2].lower()
        if name not in INLINE:
            flush()
        elif name == "br":
            buffer.append("\n")
            continue
        if m[1]:
            if any(x == name for x, _ in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            if name == "head":  # its end tag may be missing
                end = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = (end.start() if end[0][1] != "/" else end.end()) if end else at
            elif not m[3].rstrip().endswith("/"):
                at = _raw_end(page, name, at)
            continue
        if name in VOID:
            continue
        if name in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[name]:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in SCOPE.get(name, ()):
                    break
        own = {f"t:{name}"} if f"t:{name}" in INDEX else set()
        if m[3]:
            names = " ".join(a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3]))
            if names and name not in ("body", "html"):
                own |= _hints(names)
            if HIDDEN.search(m[3]):
                own.add("hidden")
        stack.append((name, frozenset(own)))
        marks.append(marks[-1] | own if own else marks[-1])
        links += name == "a"
    flush()
    return out


def features(found: list[tuple[str, frozenset[str], str, float]]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)), np.float32)
    for i, (text, marks, leaf, link) in enumerate(found):
        n = len(text)
        on = [
            *marks, "leaf:p" if leaf == "p" else "leaf:h" if leaf[0] == "h" and leaf[1:].isdigit() else "leaf:li" if leaf == "li" else "leaf:div",
            "len<25" if n < 25 else "len<80" if n < 80 else "len<200" if n < 200 else "len>=200",
            "link0" if not link else "link<.3" if link < 0.3 else "link<.7" if link < 0.7 else "link>=.7", "early" if i < 3 else "late" if i >= len(found) - 3 else "bias", "bias",
        ]
        if text[-1] in ".!?…。！？":
            on.append("stop")
        if "©" in text or "copyright" in text.lower()[:200]:
            on.append("copyright")
        if " | " in text or " · " in text or " » " in text:
            on.append("bars")
        if n < 40 and text.count(" ") < 3:
            on.append("words<4")
        if "h:comment" in marks and ("h:main" in marks or "t:article" in marks or "t:main" in marks):
            on.append("in:main,comment")
        if ("t:article" in marks or "t:main" in marks) and ("h:side" in marks or "t:aside" in marks or "h:ad" in marks or "h:share" in marks or "t:nav" in marks or "t:form" in marks):
            on.append("in:article,side")
        x[i, [INDEX[f] for f in on]] = 1
    return x


class Field:
    """Two labels (1: main text). Scores of a labelling: block weights plus weights of neighbouring labels."""

    def __init__(self) -> None:
        self.w, self.t = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best labelling (Viterbi)."""
        s = x @ self.w
        back = np.zeros((len(s), 2), np.int64)
        best = s[0].copy()
        for i in range(1, len(s)):
            paths = best[:, None] + self.t
            back[i] = paths.argmax(0)
            best = paths.max(0) + s[i]
        out = np.zeros(len(s), np.int64)
        out[-1] = best.argmax()
        for i in range(len(s) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.15, ridge: float = 1e-3) -> None:
        """Conditional likelihood by forward-backward over all pages at once; Adam."""
        n, m = len(pages), max(len(x) for x, _ in pages)
        x, y, on = np.zeros((n, m, len(FEATURES))), np.zeros((n, m), np.int64), np.zeros((n, m), bool)
        for i, (a, b) in enumerate(pages):
            x[i, : len(a)], y[i, : len(a)], on[i, : len(a)] = a, b, True
        gold = np.eye(2)[y] * on[..., None]
        pairs = np.einsum("nia,nib->ab", gold[:, :-1], gold[:, 1:])
        first, second = [0.0, 0.0], [0.0, 0.0]
        lse = lambda v, axis: np.logaddexp.reduce(v, axis)
        for step in range(1, steps + 1):
            s = x @ self.w
            f, b = np.zeros((n, m, 2)), np.zeros((n, m, 2))
            f[:, 0] = s[:, 0]
            for i in range(1, m):
                f[:, i] = np.where(on[:, i, None], lse(f[:, i - 1, :, None] + self.t, 1) + s[:, i], f[:, i - 1])
            for i in range(m - 2, -1, -1):
                b[:, i] = np.where(on[:, i + 1, None], lse(self.t + (s[:, i + 1] + b[:, i + 1])[:, None, :], 2), 0)
            z = lse(f[:, -1], 1)[:, None, None]
            p = np.exp(f + b - z) * on[..., None]
            joint = np.exp(f[:, :-1, :, None] + self.t + (s + b)[:, 1:, None, :] - z[..., None]) * on[:, 1:, None, None]
            grads = (np.einsum("nif,nia->fa", x, p - gold) / n + ridge * self.w, (joint.sum((0, 1)) - pairs) / n + ridge * self.t)
            for k, (value, g) in enumerate(zip((self.w, self.t), grads)):
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g * g
                value -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)


def labelled_pages(count: int = 500, seed: int = 5) -> list[tuple[list, np.ndarray]]:
    """Invented pages of many layouts, as (blocks, labels): what stands between the marks \\x01 and \\x02 is main text."""
    rng = random.Random(seed)
    words = "lorem ipsum dolor sit amet vita nova terra luna stella mare via lux nox ignis aqua ventus silva mons campus".split()
    pick, chance = rng.choice, lambda p: rng.random() < p

    def text(lo: int, hi: int, stop: bool = True) -> str:
        n = rng.randint(lo, hi)
        return " ".join(pick(words) + ("." if stop and rng.random() < 0.1 else "") for _ in range(n)).capitalize() + ("." if stop and chance(0.85) else "")

    def links(n: int) -> str:
        return "".join(f'<li><a href="#">{text(1, 3, False)}</a></li>' for _ in range(n))

    def div(names: list[str], inside: str, tags: tuple = ("div", "section")) -> str:
        t = pick(tags)
        return f'<{t} {pick(["class", "id", "class"])}="{pick(names)}">{inside}</{t}>'

    def paragraph(mark: bool) -> str:
        s = text(1, 12) if chance(0.25) else text(10, 90)
        if chance(0.2):
            s = s.replace(" ", f' <a href="#">{pick(words)}</a> ', 1)
        s = f"\x01{s}\x02" if mark else s
        return pick([f"<p>{s}</p>", f"<p>{s}</p>", f"<p>{s}</p>", f"<p>{s}", f"<div>{s}</div>", f"<blockquote>{s}</blockquote>", f"<ul><li>{s}</li></ul>"]) if chance(0.3) else f"<p>{s}</p>"

    out = []
    for _ in range(count):
        body = "".join((f"<{(h := pick(['h2', 'h3']))}>\x01{text(1, 6, False)}\x02</{h}>" if chance(0.15) else "") + paragraph(True) for _ in range(rng.randint(1, 14)))
        if chance(0.3):
            cut = body.find("</p>", len(body) // 2)
            if cut > 0:
                extra = pick([div(["ad", "ads", "advert", "ad-slot", "sponsored"], f"<p>{text(3, 20)}</p>"), div(["related", "related-posts", "share", "social-share"], f"<ul>{links(3)}</ul>"), f"<aside><p>{text(5, 30)}</p></aside>", div(["newsletter", "subscribe-box"], f"<p>{text(4, 20)}</p>")])
                body = body[: cut + 4] + extra + body[cut + 4 :]
        title = f"<h1>\x01{text(2, 9, False)}\x02</h1>" if chance(0.8) else ""
        comments = ""
        if chance(0.4):
            comments = div(["comments", "comment-list", "disqus_thread", "reader-comments", "responses comments"], "<h3>Comments</h3>" + "".join(f'<div class="{pick(["comment", "comment-body", "reply"])}"><p>{text(3, 60)}</p></div>' for _ in range(rng.randint(1, 5))))
        inside = title + body + (comments if chance(0.4) else "")
        comments = "" if comments in inside else comments
        core = pick([f"<article>{inside}</article>", f"<article>{inside}</article>", f"<main>{inside}</main>", f"<main><article>{inside}</article></main>", div(["content", "post", "entry-content", "article-body", "story", "main-content", "post-text"], inside), div(["c1", "x", "wrap", "col"], inside), inside])
        nav = pick([f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>", div(["menu", "nav", "navbar", "main-menu", "breadcrumbs"], f"<ul>{links(rng.randint(2, 9))}</ul>"), f"<ul>{links(6)}</ul>", ""])
        header = pick([f"<header><h2>{text(1, 3, False)}</h2><p>{text(2, 10)}</p></header>", div(["header", "site-header", "masthead", "top-bar"], f"<p>{text(1, 8)}</p>"), f'<div role="banner">{text(1, 6)}</div>', ""])
        side = pick([f"<aside>{''.join(f'<p>{text(3, 40)}</p>' for _ in range(3))}</aside>", div(["sidebar", "side-bar", "widget", "right-rail"], f"<h4>{text(1, 3)}</h4><p>{text(3, 40)}</p><ul>{links(4)}</ul>"), "", ""])
        notice = pick([div(["cookie-notice", "cookie-banner", "consent", "alert", "gdpr", "notice"], f"<p>{text(4, 40)}</p><a href='#'>OK</a>"), "", ""])
        ad = pick([div(["ad", "ads", "advert", "ad-banner", "sponsored", "promo"], pick([text(3, 25), f"<p>{text(3, 25)}</p>"])), "", ""])
        form = pick([f"<form><label>{text(1, 3)}</label><p>{text(2, 12)}</p></form>", div(["search-form", "login-form"], f"<p>{text(1, 6)}</p>"), "", ""])
        foot = pick([f"<footer><p>&copy; {text(2, 12)}</p></footer>", f"<footer>&copy; {text(2, 20)}</footer>", div(["footer", "site-footer", "copyright"], f"<p>{text(2, 20)}</p><ul>{links(3)}</ul>"), ""])
        top = [nav, header, notice, ad]
        rng.shuffle(top)
        page = "<html><head><title>x</title></head><body>" + "".join(top) + core + comments + "".join(rng.sample([side, form, ad], 3)) + foot + "</body></html>"
        found = blocks(page)
        labels = np.array(["\x01" in b[0] for b in found], np.int64)
        out.append(([(" ".join(b[0].replace("\x01", "").replace("\x02", "").split()) or "-", *b[1:]) for b in found], labels))
    return out


def trained(pages: list | None = None) -> Field:
    """A field trained on labelled pages (blocks, labels); by default on labelled_pages()."""
    field = Field()
    field.train([(features(b), y) for b, y in pages or labelled_pages() if b])
    return field


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b[0] for b, y in zip(found, field.decode(features(found))) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html, ...): the main text of the whole html.

    Null or empty html, and pages without main text, give the empty string. Rows that repeat are extracted each.
    The field has a fixed number of weights; it is trained on the driver and sent to the tasks.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())

    def each(b: pa.RecordBatch) -> dict:
        texts = [main_text(h or "", shared.value) for h in b.column(2).to_pylist()]
        return {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": list(map(len, texts))}

    return map_arrow(pages.select("page_id", "url", "html"), each, "page_id long, url string, text string, n_chars long")
