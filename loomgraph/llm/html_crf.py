"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into blocks (runs of inline text between block-level tags). Each block has features of
its ancestor tags, their class and id words, and its text; a two-label chain is trained on labelled
pages by gradient ascent and decoded by Viterbi. The labelled pages come from ``labelled_pages``:
layouts drawn by rule with the label of each block known.

Defined cases: null or empty html gives '' ; a page without content blocks gives ''; unclosed tags,
comments and quotes end with the page, and so do script, style, textarea, title and iframe, while other
dropped elements without an end tag (or closed by "/>") lose their tag alone; repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as htmllib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SHUT = re.compile(r"(?:\A|[\s\"']|(?:\A|\s)[^\s=\"']+)/\Z")  # "/>", not the end of a value without quotes
# HTML's own lists of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle semantics annotation".split())
DROPPED = frozenset("script style template svg iframe textarea title canvas audio video".split())
#: Without an end tag, these go on to the page's end; of these, only iframe is closed by "/>".
RAW = frozenset("script style textarea title iframe".split())
IMPLIED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TAGS = "article main section div p li ul ol h1 h2 h3 h4 h5 h6 a nav header footer aside form button blockquote pre table td figure figcaption dl body address".split()
# Words of class, id and role values by what they tell.
HINTS = {
    "content": "article articlebody content post entry story main body text page blog".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toc pager pagination skip links".split(),
    "head": "header masthead logo brand banner topbar tagline top hero".split(),
    "foot": "footer foot copyright legal bottom colophon".split(),
    "side": "sidebar side aside rail widget related recommended trending popular more teaser tags".split(),
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense".split(),
    "comment": "comment comments reply replies disqus discussion respond reader feedback".split(),
    "form": "form newsletter subscribe signup login search contact subscription".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay privacy warning".split(),
    "share": "share social sharing follow byline author meta date".split(),
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws}
FEATURES = (
    ["bias", "first", "last"] + [f"in_{t}" for t in TAGS] + [f"is_{t}" for t in TAGS] + [f"hint_{h}" for h in HINTS] + [f"near_{h}" for h in HINTS]
    + [f"words_{i}" for i in range(6)] + ["all_link", "some_link", "ends_stop", "copyright", "no_container", "after_title", "in_body_only"]
)
_AT = {f: i for i, f in enumerate(FEATURES)}
_SIZES = (2, 5, 12, 30, 80)
CONTENT = 1


@functools.lru_cache(maxsize=4096)
def _hints(attrs: str) -> frozenset:
    found = set()
    for m in _ATTR.finditer(attrs):
        for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()):
            if w in _HINT:
                found.add(_HINT[w])
    return frozenset(found)


def blocks_of(page: str) -> list[tuple[str, tuple, int]]:
    """(text, ancestors as (tag, hints), characters inside links) of every leaf block with text, in page order."""
    out: list = []
    stack: list[tuple[str, frozenset]] = []
    buf: list[str] = []
    state = {"link": 0}

    def flush() -> None:
        if buf:
            text = " ".join(htmllib.unescape("".join(buf)).split())
            buf.clear()
            if text:
                out.append((text, tuple(stack), state["link"]))
        state["link"] = 0

    def add(s: str) -> None:
        buf.append(s)
        if any(t == "a" for t, _ in stack[-4:]):
            state["link"] += len(s.strip())

    at, n = 0, len(page)
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in INLINE and name != "a" and not closing and "=" not in attrs:
            continue
        if closing:
            if name in INLINE and name != "a":
                continue
            if name != "a":
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in INLINE:
            if name == "a":
                stack.append((name, _hints(attrs)))
            continue
        flush()
        if name in DROPPED:
            if name in RAW - {"iframe"} or not _SHUT.search(attrs):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n if name in RAW else at
            continue
        if name in VOID:
            continue
        for t in IMPLIED.get(name, ("p",) if name in CLOSES_P else ()):
            for i in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                if stack[i][0] == t:
                    del stack[i:]
                    break
                if stack[i][0] not in ("p", "a", "li", "td", "th", "dt", "dd"):
                    break
        while name in CLOSES_P and stack and stack[-1][0] == "a":
            stack.pop()
        stack.append((name, _hints(attrs)))
    if at < n:
        add(page[at:])
    flush()
    return out


def features(blocks: list) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)), np.float32)
    titled = False
    for i, (text, up, link) in enumerate(blocks):
        on = [0]
        tags = [t for t, _ in up]
        on += [_AT[f"in_{t}"] for t in set(tags) if f"in_{t}" in _AT]
        own = next((t for t in reversed(tags) if t != "a"), "body")
        if f"is_{own}" in _AT:
            on.append(_AT[f"is_{own}"])
        for h in {h for _, hs in up for h in hs}:
            on.append(_AT[f"hint_{h}"])
        near = next((hs for _, hs in reversed(up) if hs), frozenset())
        on += [_AT[f"near_{h}"] for h in near]
        n = text.count(" ") + 1
        on.append(_AT[f"words_{sum(n > s for s in _SIZES)}"])
        if link >= 0.8 * len(text):
            on.append(_AT["all_link"])
        elif link:
            on.append(_AT["some_link"])
        if text[-1] in ".!?…:":
            on.append(_AT["ends_stop"])
        if "©" in text or "(c)" in text[:40].lower():
            on.append(_AT["copyright"])
        if not any(t in ("article", "main", "nav", "footer", "header", "aside", "form") for t in tags) and not any(hs for _, hs in up):
            on.append(_AT["no_container"])
        if not set(tags) - {"html", "body", "p", "h1", "h2", "h3", "b", "i", "a", "ul", "ol", "li"}:
            on.append(_AT["in_body_only"])
        if titled:
            on.append(_AT["after_title"])
        titled = titled or own == "h1"
        x[i, on] = 1
    if len(blocks):
        x[0, _AT["first"]] = x[-1, _AT["last"]] = 1
    return x


def _words(r: random.Random, n: int) -> str:
    sound = "the of an er in on re ti es or en at ed nd to it is ha le de ch qu ou ie so na".split()
    return " ".join("".join(r.choice(sound) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize()


def labelled_pages(count: int = 450, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages of drawn layouts with the label of each block (1: article text), in block order."""
    r = random.Random(seed)
    pages = []
    for _ in range(count):
        parts: list[str] = []
        labels: list[int] = []

        def put(markup: str, label: int | None = None, parts=parts, labels=labels) -> None:
            parts.append(markup)
            if label is not None:
                labels.append(label)

        def prose() -> str:
            n = r.choice((1, 2, 3, 6, 12, 25, 50, 90))
            if r.random() < 0.08:
                return " ".join(w + r.choice(("###", "***", "%%%", "&amp;&amp;&amp;", " |")) for w in _words(r, n).split())
            return _words(r, n) + r.choice((".", ".", ".", ".", "", "!", ":"))

        def links(k: int) -> None:
            put(f"<ul{kind('menu')}>")
            for _ in range(k):
                put(f'<li><a href="/{r.randint(1, 99)}">{_words(r, r.randint(1, 4))}</a>' + r.choice(("</li>", "</li>", "")), 0)
            put("</ul>")

        def kind(h: str, p: float = 0.7) -> str:
            return f' {r.choice(("class", "class", "id"))}="{r.choice(HINTS[h])}{r.choice(("", "-box", " wide", "-1"))}"' if r.random() < p else ""

        def boxed(h: str, tags: tuple, n: int, text=None) -> None:
            t = r.choice(tags)
            put(f"<{t}{kind(h, 1.0 if t == 'div' or t == 'section' else 0.5)}>")
            for _ in range(n):
                w = r.choice(("p", "div", "span", ""))
                put((f"<{w}>" if w else "") + (text() if text else prose()) + (f"</{w}>" if w and r.random() < 0.9 else "") + ("<br>" if w in ("", "span") else ""), 0)
            put(f"</{t}>")

        put("<html><head><title>x</title><style>p{}</style></head><body>")
        if r.random() < 0.25:
            boxed("notice", ("div", "aside", "section"), r.randint(1, 2))
        if r.random() < 0.6:
            boxed("head", ("header", "div"), r.randint(1, 2), lambda: _words(r, r.randint(1, 5)))
        if r.random() < 0.8:
            t = r.choice(("nav", "nav", "div"))
            put(f"<{t}{kind('menu', 1.0 if t == 'div' else 0.4)}>")
            links(r.randint(2, 8))
            put(f"</{t}>")
        if r.random() < 0.5:
            boxed("ad", ("div", "aside", "div"), r.randint(1, 2))
        left = r.random() < 0.2
        if left:
            boxed("side", ("aside", "div"), r.randint(1, 4))
        shell = r.choice(("article", "article", "article", "main", "main", "div", "div", "section", "both", ""))
        if shell == "both":
            put("<main><article>")
        elif shell:
            put(f"<{shell}{kind('content', 1.0 if shell in ('div', 'section') else 0.4)}>")
        if r.random() < 0.85:
            put(f"<{(h := r.choice(('h1', 'h1', 'h2')))}>{_words(r, r.randint(1, 14))}{r.choice(('', '.'))}</{h}>", 1)
        bold = False
        for _ in range(r.randint(1, 14)):
            c = r.random()
            if c < 0.62:
                lead = "<b>" if r.random() < 0.1 else ""
                bold = bold or bool(lead)
                put(f"<p>{lead}{prose()}" + (f' <a href="/x">{_words(r, 2)}</a> {_words(r, 3)}.' if r.random() < 0.1 else "") + r.choice(("</p>", "</p>", "", "<br>")), 1)
            elif c < 0.70:
                put(f"<h{r.randint(2, 4)}>{_words(r, r.randint(1, 6))}</h{r.randint(2, 4)}>", 1)
            elif c < 0.78:
                put("<ul>")
                for _ in range(r.randint(1, 4)):
                    put(f"<li>{prose()}</li>", 1)
                put("</ul>")
            elif c < 0.84:
                put(f"<blockquote>{prose()}</blockquote>", 1)
            elif c < 0.88:
                put(f"<div{kind('ad', 1.0)}>{prose()}</div>", 0)
            elif c < 0.91:
                put(f"<div{kind('share', 1.0)}>{_words(r, 2)}</div>", 0)
            elif c < 0.94:
                put(f"<aside{kind('side', 0.6)}>{prose()}</aside>", 0)
            elif c < 0.97:
                put(f"<div>{prose()}</div>", 1)
            else:
                put(f"<pre>{prose()}</pre>", 1)
        late = r.random() < 0.35

        def discussion() -> None:
            t = r.choice(("section", "div"))
            put(f"<{t}{kind('comment', 1.0)}>")
            put(f"<h3>{_words(r, 1)}</h3>", 0)
            for _ in range(r.randint(1, 5)):
                put(f"<{(u := r.choice(('div', 'article', 'li')))}{kind('comment')}><p>{prose()}</p></{u}>", 0)
            put(f"</{t}>")

        if late:
            discussion()
        if shell == "both":
            put("</article></main>")
        elif shell:
            put(f"</{shell}>")
        if not late and r.random() < 0.35:
            discussion()
        if r.random() < 0.3:
            boxed("form", ("form",), r.randint(1, 2))
        if not left and r.random() < 0.4:
            boxed("side", ("aside", "div"), r.randint(1, 4))
        if r.random() < 0.3:
            boxed("ad", ("div", "aside"), 1)
        if r.random() < 0.85:
            boxed("foot", ("footer", "footer", "div"), r.randint(1, 3), lambda: r.choice(("&copy; ", "", "")) + prose())
        put("</body></html>" if r.random() < 0.9 else "")
        page = "".join(parts)
        # A page on which the drawing and the parser disagree about the number of blocks has no labels.
        if len(blocks_of(page)) == len(labels):
            pages.append((page, labels))
    return pages


class Crf:
    """Two labels; unary weights per feature and label, and a transition matrix."""

    def __init__(self, unary: np.ndarray, trans: np.ndarray):
        self.unary, self.trans = unary, trans

    def decode(self, x: np.ndarray) -> list[int]:
        e = (x @ self.unary).tolist()
        (t00, t01), (t10, t11) = self.trans.tolist()
        a, b = e[0]
        back = []
        for u, v in e[1:]:
            k0, k1 = a + t00 < b + t10, a + t01 < b + t11
            back.append((k0, k1))
            a, b = (b + t10 if k0 else a + t00) + u, (b + t11 if k1 else a + t01) + v
        y = int(b > a)
        out = [y]
        for k in reversed(back):
            y = int(k[y])
            out.append(y)
        return out[::-1]


def train(pages: list[tuple[str, list[int]]], rounds: int = 110, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood with a ridge by Adam; forward-backward runs over all pages side by side."""
    xs, ys = [features(blocks_of(p)) for p, _ in pages], [np.array(y) for _, y in pages]
    order = sorted(range(len(xs)), key=lambda i: -len(xs[i]))
    xs, ys = [xs[i] for i in order if len(xs[i])], [ys[i] for i in order if len(xs[i])]
    n, longest = len(xs), len(xs[0])
    size = np.array([len(x) for x in xs])
    x = np.zeros((n, longest, len(FEATURES)), np.float32)
    y = np.zeros((n, longest), int)
    for i, (a, b) in enumerate(zip(xs, ys)):
        x[i, : len(a)], y[i, : len(b)] = a, b
    mask = np.arange(longest)[None, :] < size[:, None]
    w = np.zeros((len(FEATURES), 2))
    t = np.zeros((2, 2))
    hot = np.eye(2)[y] * mask[..., None]
    pair = np.einsum("ita,itb->ab", hot[:, :-1], hot[:, 1:] * mask[:, 1:, None])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    lse = lambda v, axis: np.log(np.exp(v - (m := v.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
    for step in range(1, rounds + 1):
        e = x @ w
        f = np.zeros((n, longest, 2))
        g = np.zeros((n, longest, 2))
        f[:, 0] = e[:, 0]
        for k in range(1, longest):
            new = lse(f[:, k - 1, :, None] + t[None], 1) + e[:, k]
            f[:, k] = np.where(mask[:, k, None], new, f[:, k - 1])
        for k in range(longest - 2, -1, -1):
            new = lse(t[None] + (e[:, k + 1] + g[:, k + 1])[:, None, :], 2)
            g[:, k] = np.where(mask[:, k + 1, None], new, 0)
        z = lse(f[:, -1], 1)
        p = np.exp(f + g - z[:, None, None]) * mask[..., None]
        q = np.exp(f[:, :-1, :, None] + t[None, None] + (e[:, 1:] + g[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        gw = np.einsum("itf,ita->fa", x, hot - p) / n - ridge * w
        gt = (pair - q.sum((0, 1))) / n - ridge * t
        for v, grad, (a, b) in ((w, gw, (0, 1)), (t, gt, (2, 3))):
            state[a] = 0.9 * state[a] + 0.1 * grad
            state[b] = 0.99 * state[b] + 0.01 * grad**2
            v += 0.1 * (state[a] / (1 - 0.9**step)) / (np.sqrt(state[b] / (1 - 0.99**step)) + 1e-8)
    return Crf(w, t)


def main_text(page: str | None, crf: Crf) -> tuple[str, int, int]:
    """(main text, blocks, content blocks)."""
    blocks = blocks_of(page or "")
    if not blocks:
        return "", 0, 0
    got = crf.decode(features(blocks))
    kept = [b[0] for b, y in zip(blocks, got) if y == CONTENT]
    return " ".join(kept), len(blocks), len(kept)


def extract(df: DataFrame, crf: Crf, html: str, carry: tuple[str, ...]) -> DataFrame:
    """The ``carry`` columns with text, n_blocks and n_content of every row."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        for b in batches:
            got = [main_text(p, crf) for p in b.column(0).to_pylist()]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*carry, "text", "n_blocks", "n_content"])

    d = df.select(F.col(html).alias("_html"), *carry)
    return d.mapInArrow(run, f"{fields}, text string, n_blocks bigint, n_content bigint")


def op1_html_crf(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"), train(labelled_pages()), "html", ("page_id", "url"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_content")
