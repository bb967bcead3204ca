"""Main text of web pages: a bidirectional LSTM labels the sequence of a page's blocks.

A page is cut into leaf blocks: runs of text between block-level tags.  Each block becomes a vector of its hashed
tag path and the hashed class and id words of all its ancestors (once as a set, once weighted by nearness), of all
its hashed words, and of a few lengths and shares.  A bidirectional LSTM in numpy reads the whole sequence in both
directions, so every block is classified with the whole page in view; blocks labelled as content are joined by line
feeds.

The network is trained here, on pages that a small grammar writes: articles in many kinds of containers, nested to
any depth, among menus, headers, footers, sidebars, notices, adverts, forms and reader comments, with invented words
and, in the parts around articles, words that are usual there.

Defined results: a null or empty page has the empty text; text outside any tag is a block like others; script,
style, comment and head contents are never text; character references are decoded once, unknown ones stay; an
unclosed tag lasts to the end of its parent; formulas, drawings' words and the text inside objects are text like
any other; equal pages get equal texts; repeated rows stay repeated; an empty table gives an empty table; further
columns are not read and do not appear.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TAGS, NAMES, WORDS, SCALARS = 64, 128, 64, 8
PLACE = 2 * (TAGS + NAMES)
WIDTH = PLACE + WORDS + SCALARS
FADE = 0.7  # weight of an ancestor, for each level that it is away, in the half weighted by nearness
KEPT_EVERY = 32  # every so many levels an open element keeps the vector of its place
HIDDEN = 24
TRAIN_PAGES = 1500
TRAIN_STEPS = 800
CELLS = 1 << 15  # blocks, padding included, that go through the network at once

# Elements of HTML by how they lay out.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr object svg g text tspan textpath math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mpadded".split())
HIDDEN_TEXT = frozenset("script style template noscript iframe canvas title desc metadata annotation annotation-xml".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}

_TAG = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*+>?|(/?)([A-Za-z][A-Za-z0-9:-]*+)((?>[^<>"']|"[^"]*+"|'[^']*+')*+)(?:>|(?=<)|\Z))""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in HIDDEN_TEXT}


@dataclass(eq=False, slots=True)
class Place:
    """An open element; the vector of its place is worked out when a block needs it."""

    tag: str
    names: tuple[str, ...] = ()
    up: Place | None = None
    depth: int = 0
    head: bool = False
    kept: np.ndarray | None = None

    def vector(self) -> np.ndarray:
        chain, at = [], self
        while at is not None and at.kept is None:
            chain.append(at)
            at = at.up
        v = np.zeros(PLACE, np.float32) if at is None else at.kept
        for p in reversed(chain):
            v = _deeper(v, p.tag, p.names)
            if p is self or p is self.up or p.depth % KEPT_EVERY == 0:
                p.kept = v
        return v


@dataclass(slots=True)
class Block:
    place: Place
    text: str
    linked: int = 0


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[Place] = []
    root = Place("")
    opened: Counter[str] = Counter()
    parts: list[str] = []
    unclosed: set[str] = set()  # kinds of hidden elements without an end tag further on
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(stack[-1] if stack else root, text, linked))
            linked = 0

    def pop_to(i: int) -> None:
        nonlocal links
        for o in stack[i:]:
            opened[o.tag] -= 1
            links -= o.tag == "a"
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append(page[at:lt])
            linked += (lt - at) if links else 0
        if lt == n:
            break
        m = _TAG.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if stack[i].tag in ("td", "th", "table", "article", "body") and tag in INLINE:
                    break
            continue
        if tag in HIDDEN_TEXT:
            if not m[3].rstrip().endswith("/"):
                e = None if tag in unclosed else _END[tag].search(page, at)
                if e is None:
                    unclosed.add(tag)
                if e or tag in ("script", "style"):
                    at = e.end() if e else n
            continue
        if tag not in INLINE:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if tag in CLOSED_BY.get(stack[i].tag, ()):
                    pop_to(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in VOID:
            continue
        names: tuple[str, ...] = ()
        if m[3]:
            names = tuple(w for a in _ATTR.findall(m[3]) for w in re.findall(r"[a-z]+", (a[1] or a[2] or a[3]).lower()))
        up = stack[-1] if stack else root
        stack.append(Place(tag, names, up, up.depth + 1, up.head or tag == "head"))
        opened[tag] += 1
        links += tag == "a"
    flush()
    return [b for b in out if not b.place.head]


def _bucket(word: str, width: int) -> int:
    return (zlib.crc32(word.encode("utf-8", "replace")) >> 1) % width


@lru_cache(maxsize=20_000)
def _own(tag: str, names: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(TAGS + NAMES, np.float32)
    if tag not in INLINE:
        v[_bucket("t:" + tag, TAGS)] = 1
    for w in names:
        v[TAGS + _bucket("n:" + w, NAMES)] = 1
    return v


def _deeper(v: np.ndarray, tag: str, names: tuple[str, ...]) -> np.ndarray:
    """The vector of a place one element below the place of v: what is above it at all, and what is near."""
    if tag in INLINE and not names:
        return v
    own = _own(tag, names) if sum(map(len, names)) < 500 else _own.__wrapped__(tag, names)
    half = TAGS + NAMES
    return np.concatenate([np.maximum(v[:half], own), FADE * v[half:] + own])


def _word(w: str) -> int:
    return zlib.crc32(w.encode("utf-8", "replace")) % (2 * WORDS)


_cached_word = lru_cache(maxsize=100_000)(_word)


def vectors(bs: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """A row for each of the blocks first to last of a page."""
    some = bs[first:last]
    x = np.zeros((len(some), WIDTH), np.float32)
    for k, b in enumerate(some):
        x[k, :PLACE] = b.place.vector()
        ws = b.text.lower().split(" ")
        counts = np.bincount([_cached_word(w) if len(w) < 40 else _word(w) for w in ws], minlength=2 * WORDS)
        signed = (counts[:WORDS] - counts[WORDS:]).astype(np.float32)
        x[k, PLACE : PLACE + WORDS] = signed / max(1.0, np.sqrt(signed @ signed))
        n = len(b.text)
        x[k, -SCALARS:] = (
            np.log1p(n) / 6, np.log1p(len(ws)) / 3, min(1.0, b.linked / n), b.text[-1] in ".!?\"'…:",
            (first + k) / max(1, len(bs) - 1), np.log1p(len(bs)) / 5, b.text[0].isupper(), np.log1p(b.place.depth) / 3,
        )
    return x


# --- the network ---------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(pre: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Projected inputs [T, B, 4 H] to hidden states [T, B, H]; padded steps carry the state on."""
    steps, batch, _ = pre.shape
    hid = u.shape[0]
    h, c = np.zeros((batch, hid), np.float32), np.zeros((batch, hid), np.float32)
    out, tape = np.empty((steps, batch, hid), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ u
        g = _sigmoid(z[:, : 3 * hid])
        i, f, o, a = g[:, :hid], g[:, hid : 2 * hid], g[:, 2 * hid :], np.tanh(z[:, 3 * hid :])
        c1 = f * c + i * a
        tc = np.tanh(c1)
        m = mask[t][:, None]
        if keep:
            tape.append((h, c, i, f, o, a, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, c1, c)
        out[t] = h
    return out, tape


def _lstm_back(x, w, u, tape, dout):
    steps, batch, _ = x.shape
    hid = u.shape[0]
    dh, dc = np.zeros((batch, hid), np.float32), np.zeros((batch, hid), np.float32)
    du, dz_all = np.zeros_like(u), np.empty((steps, batch, 4 * hid), np.float32)
    for t in range(steps - 1, -1, -1):
        h0, c0, i, f, o, a, tc, m = tape[t]
        dh = dh + dout[t]
        dhm = np.where(m, dh, 0)
        dc1 = np.where(m, dc, 0) + dhm * o * (1 - tc * tc)
        dz = np.concatenate([dc1 * a * i * (1 - i), dc1 * c0 * f * (1 - f), dhm * tc * o * (1 - o), dc1 * i * (1 - a * a)], axis=1)
        dz_all[t] = dz
        du += h0.T @ dz
        dh = np.where(m, 0, dh) + dz @ u.T
        dc = np.where(m, 0, dc) + dc1 * f
    flat = dz_all.reshape(steps * batch, -1)
    return x.reshape(steps * batch, -1).T @ flat, du, flat.sum(axis=0)


Params = dict[str, np.ndarray]


def _project(p: Params, x: np.ndarray) -> np.ndarray:
    """Rows of blocks to the inputs of the forward and the backward network, side by side."""
    return np.concatenate([x @ p["wf"] + p["bf"], x @ p["wr"] + p["br"]], axis=-1)


def _forward(p: Params, pre: np.ndarray, mask: np.ndarray, keep: bool = False):
    f, tf = _lstm(pre[:, :, : 4 * HIDDEN], p["uf"], mask, keep)
    r, tr = _lstm(pre[::-1, :, 4 * HIDDEN :], p["ur"], mask[::-1], keep)
    both = np.concatenate([f, r[::-1]], axis=2)
    return both @ p["v"] + p["c"], both, tf, tr


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(s) for s in seqs)
    x, mask = np.zeros((t, len(seqs), seqs[0].shape[1]), np.float32), np.zeros((t, len(seqs)), bool)
    for k, s in enumerate(seqs):
        x[: len(s), k] = s
        mask[: len(s), k] = True
    return x, mask


def label(p: Params, pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block of each page is content."""
    seqs = [np.concatenate([_project(p, vectors(bs, lo, lo + 4096)) for lo in range(0, max(1, len(bs)), 4096)]) for bs in pages]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(seqs)
    order = sorted((k for k in range(len(seqs)) if len(seqs[k])), key=lambda k: len(seqs[k]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and len(seqs[order[hi]]) * (hi + 1 - lo) <= CELLS:
            hi += 1
        ks = order[lo:hi]
        z = _forward(p, *_padded([seqs[k] for k in ks]))[0]
        for j, k in enumerate(ks):
            out[k] = z[: len(seqs[k]), j] > 0
        lo = hi
    return out


# --- training pages ------------------------------------------------------------------------------------------------

# Names that page authors give to parts of pages.
_MAIN = ["<article>", "<main>", '<div class="content">', '<div id="main">', '<div class="post">', '<section class="entry body">', '<div class="article text">', '<main id="content">', '<div role="main">', "<article class=\"post\">", "<main><article>"]
_NAV = ["<nav>", '<div class="menu">', '<ul class="nav">', '<div id="navigation">', '<nav class="breadcrumb">', '<div class="pagination pager">', '<div role="navigation">']
_HEAD = ["<header>", '<div class="header">', '<div id="masthead">', '<div class="topbar logo">', '<header class="site header">']
_FOOT = ["<footer>", '<div class="footer">', '<div id="footer">', '<footer class="site">', '<div class="copyright legal">']
_SIDE = ["<aside>", '<div class="sidebar">', '<aside class="related">', '<div id="sidebar">', '<div class="widget">', '<div class="recommended more">', '<div class="tags share social">', '<div class="trending popular">']
_AD = ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="sponsored promo">', '<div class="banner">', '<aside class="advertisement">', '<div id="ad">']
_NOTE = ['<div class="cookie notice">', '<div id="cookie">', '<div class="consent">', '<div class="alert">', '<div class="notice">', '<div class="newsletter subscribe">', '<div class="popup modal">', '<div role="alert">']
_COMMENTS = ['<div class="comments">', '<section id="comments">', '<ol class="comment list">', '<div class="comment">', '<div class="reply discussion">', '<ul class="comments">']
_NEUTRAL = ["<div>", '<div class="row">', '<div class="col">', '<div class="inner">', '<section>', '<div class="wrap box">', "<span>", '<div class="grid block">', '<div id="c">']
# Words that are usual around articles.
_TELLING = "home menu login search contact about privacy cookies cookie policy accept terms copyright rights reserved subscribe newsletter share tweet reply comments posted sponsored advertisement advert buy related popular trending more next previous click follow sign register email".split()
_INNER = ["p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "td", "dd", "figcaption", "div"]


def _closing(opened: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z0-9]+)", opened)))


@lru_cache(maxsize=1)
def _invented_words(n: int = 5000) -> list[str]:
    rng = np.random.default_rng(11)
    letters = np.array(list("etaoinshrdlucmfwypvbgkqjxzéüñ"))
    return ["".join(letters[rng.integers(0, len(letters), k)]) for k in rng.integers(2, 11, n)]


def training_page(rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page of the grammar with its true labels; content words carry a mark that is taken out again."""
    mark = ""
    pool = _invented_words()
    telling = float(rng.choice([0.0, 0.1, 0.4]))

    def words(n: int, dot: bool = True, m: str = "") -> str:
        ws = [pool[i] for i in rng.integers(0, len(pool), max(1, n))]
        for k in np.flatnonzero(rng.random(len(ws)) < (0.005 if m else telling)):
            ws[k] = pick(_TELLING)
        return m + " ".join(ws).capitalize() + ("." if dot and rng.random() < 0.9 else "")

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(rng.integers(1, 4), False)}</a></li>' for _ in range(n)) + "</ul>"

    def pick(kinds: list[str]) -> str:
        return kinds[rng.integers(len(kinds))]

    def deep(inside: str) -> str:
        o = "".join(pick(_NEUTRAL) for _ in range(rng.integers(1, 4) if rng.random() < 0.7 else rng.integers(4, 25)))
        return o + inside + _closing(o)

    def wrap(kinds: list[str], inside: str) -> str:
        o = pick(kinds)
        return o + (deep(inside) if rng.random() < 0.3 else inside) + _closing(o)

    def texts(lo: int, hi: int) -> str:
        tag = pick(["p", "p", "li", "span", "div", ""])
        return "".join((f"<{tag}>" if tag else "") + words(rng.integers(2, 40)) + (f"</{tag}>" if tag else "<br>") for _ in range(rng.integers(lo, hi)))

    def form() -> str:
        return '<form action="/f"><label>' + words(2, False) + "</label><input name=q>" + "<button>" + words(1, False) + "</button>" + (f"<p>{words(8)}</p>" if rng.random() < 0.5 else "") + "<select><option>" + words(1, False) + "<option>" + words(1, False) + "</select></form>"

    def comments() -> str:
        return wrap(_COMMENTS, "".join(f"<{t}>{words(rng.integers(2, 40))}</{t}>" for t in [pick(["p", "li", "div"])] for _ in range(rng.integers(1, 7))))

    def junk() -> str:
        r = rng.random()
        if r < 0.25:
            return wrap(_AD, texts(1, 3))
        if r < 0.45:
            return wrap(_NOTE, texts(1, 3))
        if r < 0.7:
            return wrap(_SIDE, texts(1, 5) if rng.random() < 0.6 else links(rng.integers(2, 7)))
        if r < 0.85:
            return form()
        return wrap(_NAV, links(rng.integers(1, 6)))

    def article() -> str:
        out = [f"<h1>{words(rng.integers(2, 12), False, mark)}</h1>"] if rng.random() < 0.9 else []
        plain = rng.random() < 0.4
        for _ in range(rng.integers(1, 14) if rng.random() < 0.9 else rng.integers(14, 60)):
            tag, r = "p" if plain else pick(_INNER), rng.random()
            n = rng.integers(1, 12) if tag in ("h2", "h3", "li", "td") or rng.random() < 0.2 else rng.integers(1, 90)
            text = words(int(n), True, mark)
            if r < 0.15:
                out.append(f"<p><b>{text}<br>")
            elif r < 0.25:
                out.append(f'<p>{text} <a href="/y">{words(3, False)}</a> {words(5)}</p>')
            elif tag in ("li", "td", "dd"):
                o = {"li": "<ul>", "td": "<table><tr>", "dd": "<dl>"}[tag]
                out.append(o + "".join(f"<{tag}>{words(rng.integers(1, 15), True, mark)}</{tag}>" for _ in range(rng.integers(1, 5))) + _closing(o))
            else:
                out.append(f"<{tag}>{text}" + (f"</{tag}>" if rng.random() < 0.9 or tag != "p" else ""))
            if rng.random() < 0.07:
                out.append(junk())
        return "".join(out)

    body = []
    if rng.random() < 0.5:
        body.append(wrap(_HEAD, texts(1, 3) + (wrap(_NAV, links(3)) if rng.random() < 0.4 else "")))
    if rng.random() < 0.8:
        body.append(wrap(_NAV, links(rng.integers(1, 9))))
    body += [junk() for _ in range(rng.integers(0, 3))]
    o = pick(_MAIN)
    inside = deep(article()) if rng.random() < 0.3 else article()
    late = comments() if rng.random() < 0.4 else ""
    body.append(o + inside + (late if rng.random() < 0.4 else "") + (_closing(o) if rng.random() < 0.95 else ""))
    body += [late] if late not in body[-1] else []
    body += [junk() for _ in range(rng.integers(0, 3))]
    if rng.random() < 0.8:
        body.append(wrap(_FOOT, texts(1, 4) if rng.random() < 0.7 else links(4)))
    shell = pick(["", "", '<div id="page">', '<div class="container wrapper">', '<div class="site"><div class="row">'])
    bs = blocks("<html><head><title>x</title></head><body>" + shell + "".join(body) + _closing(shell))
    y = np.array([b.text.startswith(mark) for b in bs])
    for b in bs:
        b.text = b.text.replace(mark, "") or "x"
    return bs, y


def train(seed: int = 5, pages: int = TRAIN_PAGES, steps: int = TRAIN_STEPS, batch: int = 32) -> Params:
    """Adam on the mean logistic loss over blocks, back-propagated through time."""
    rng = np.random.default_rng(seed)
    data = [(vectors(b), y) for b, y in (training_page(rng) for _ in range(pages)) if len(b)]
    data.sort(key=lambda d: len(d[0]))  # a step takes pages of about one length, so little is padded

    def init(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p: Params = {"v": init(2 * HIDDEN), "c": np.zeros((), np.float32)}
    for d in "fr":
        p |= {f"w{d}": init(WIDTH, 4 * HIDDEN), f"u{d}": init(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
        p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        first = int(rng.integers(0, max(1, len(data) - batch)))
        chosen = data[first : first + batch]
        x, mask = _padded([s for s, _ in chosen])
        y = np.zeros(mask.shape, np.float32)
        for k, (_, t) in enumerate(chosen):
            y[: len(t), k] = t
        z, both, tf, tr = _forward(p, _project(p, x), mask, True)
        dz = np.where(mask, _sigmoid(z) - y, 0).astype(np.float32) / mask.sum()
        dboth = dz[:, :, None] * p["v"]
        g: Params = {"v": np.einsum("tb,tbh->h", dz, both), "c": dz.sum()}
        g["wf"], g["uf"], g["bf"] = _lstm_back(x, p["wf"], p["uf"], tf, dboth[:, :, :HIDDEN])
        g["wr"], g["ur"], g["br"] = _lstm_back(x[::-1], p["wr"], p["ur"], tr, dboth[::-1, :, HIDDEN:])
        rate = 0.02 * (1 - step / (steps + 1))
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
            p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


@lru_cache(maxsize=1)
def model() -> dict:
    return train()


def extract(pages: DataFrame, params: Params | None = None) -> DataFrame:
    """page_id, url, the main text and its length in code points."""
    weights = pages.sparkSession.sparkContext.broadcast(params or model())  # about 95,000 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                found = [blocks(h.as_py() or "") for h in b.column(2)]
                marks = label(weights.value, found)
                texts = ["\n".join(x.text for x, m in zip(bs, ms) if m) for bs, ms in zip(found, marks)]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    cols = [pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")]
    return pages.select(*cols).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
