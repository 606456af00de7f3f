"""Main-text extraction from HTML by a recurrent block labeller.

A page is parsed into its leaf blocks: runs of text between block-level tags, each with the path of elements above
it. A bidirectional LSTM (numpy) reads the sequence of blocks of the whole page, each as a vector of hashed tag-path
tokens (tags, and words of class, id and role), hashed words and a few figures, and labels every block as main text or
not, with all of the page as context. The blocks labelled main text are joined in page order.

There are no labelled pages to learn from, so the network is trained, by backpropagation through time, on pages
generated here with known labels: articles in many kinds of mark-up among menus, headers, footers, sidebars, notices,
adverts, forms and comments. Text is random there, so that the labels are learned from the mark-up, its order and
the shape of the texts. A page reaches the network whole, whatever its length.

Scripts, styles, templates, the page's title, fields of forms, frames and comments are no text; everything else is, text inside math, svg,
object or noscript elements too. Character references are decoded once,
white space inside a block becomes one space, ends are trimmed, empty blocks dropped.

Scale: one pass over the pages without a shuffle; the network, some 100 kB, is all that is sent. Time and memory are in proportion to a
page's length however deep it is: an element holds the features of its path as bits, made from its parent's. Pages are parsed
some MB at a time. Of a page's blocks only texts, numbers of paths and shares of links are held; a page of many blocks is read in slabs of
steps, forwards and then backwards, each direction carrying its state over and leaving one number for each block.

Defined results: null or empty html, and pages without main text, give an empty text. Unclosed and stray tags are
taken as browsers mostly do: a block-level start tag ends an open paragraph, an end tag closes up to its match or is
ignored. Repeated rows are extracted each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slabs

#: Fixed values of HTML: elements that end a line of text, elements whose content is no text, and elements without content.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = set("script style template title textarea iframe noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+>|[^>]*+(?:>|\Z))""", re.S
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: What an open element of the first name is closed by, when it is directly below.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}


@lru_cache(maxsize=20_000)
def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("hidden", "aria-hidden", "style"):
            if name == "hidden" or value == "true" or "display:none" in value.replace(" ", ""):
                out.append("hidden")
        else:
            out += ["." + w for w in _PART.findall(value)]
    return tuple(out)


PATH, LAST, WORDS, FIGURES = 96, 48, 24, 8
INPUT = PATH + LAST + WORDS + FIGURES


@lru_cache(maxsize=200_000)
def _slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class Element:
    """An open element: its tag, its tokens, and the features of the path down to it."""

    __slots__ = ("tag", "tokens", "parent", "depth", "path", "last")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: Element | None):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.depth, self.path, self.last = (parent.depth + 1, parent.path, 0) if parent else (1, 0, 0)
        for t in tokens:
            h = _slot(t)
            self.path |= 1 << h % PATH
            self.last |= 1 << (h >> 8) % LAST


class Blocks:
    """A sequence of (text, innermost open element, share of its characters in links). Elements of equal features are held once."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.elements: list[Element | None] = [None]
        self.element, self.linked = array("I"), array("d")
        self._known: dict[tuple[int, int, int], int] = {}

    def append(self, text: str, element: Element | None, linked: float) -> None:
        n = 0
        if element:
            n = self._known.setdefault((element.path, element.last, element.depth), len(self.elements))
            if n == len(self.elements):
                self.elements.append(element)
        self.texts.append(text)
        self.element.append(n)
        self.linked.append(linked)

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, at):
        if isinstance(at, slice):
            return [self[n] for n in range(*at.indices(len(self)))]
        return self.texts[at], self.elements[self.element[at]], self.linked[at]

    def __eq__(self, other) -> bool:
        return list(self) == list(other)


def blocks(page: str | None) -> Blocks:
    """(text, innermost open element, share of its characters in links) of each leaf block of a page, in order."""
    page = page or ""
    out = Blocks()
    stack: list[Element] = []
    open_tags: Counter = Counter()
    text: list[str] = []
    linked = [0, 0]  # characters, of these in links
    links = 0

    def flush() -> None:
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append(whole, stack[-1] if stack else None, linked[1] / max(1, linked[0]))
            text.clear()
            linked[:] = [0, 0]

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            n = len(piece)
            linked[0] += n
            linked[1] += n if links else 0

    def close(tag: str) -> None:
        """Close up to the innermost element of that tag, if there is one; each element is closed once."""
        while open_tags[tag]:
            last = stack.pop()
            open_tags[last.tag] -= 1
            if last.tag == tag:
                return

    at = 0
    while True:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not end and not m[3].endswith("/>"):
                stop = _RAW_END[tag].search(page, at)
                at = len(page) if not stop else stop.start()
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            links = 0 if end else 1
        elif tag in BLOCKS:
            flush()
            if end:
                close(tag)
            else:
                links = 0
                close("p")
                if tag in _SIBLINGS and stack and stack[-1].tag in _SIBLINGS[tag]:
                    close(stack[-1].tag)
                if tag not in VOID:
                    stack.append(Element(tag, _tokens(tag, m[3]), stack[-1] if stack else None))
                    open_tags[tag] += 1
    flush()
    return out


def _bits(rows: list[int], width: int) -> np.ndarray:
    line = np.frombuffer(b"".join(x.to_bytes(width // 8, "little") for x in rows), np.uint8).reshape(-1, width // 8)
    return np.unpackbits(line, axis=1, bitorder="little")


def vectors(page_blocks: list) -> np.ndarray:
    """(blocks, INPUT) for the blocks of a page."""
    out = np.zeros((len(page_blocks), INPUT), np.float32)
    if page_blocks:
        out[:, :PATH] = _bits([e.path if e else 0 for _, e, _ in page_blocks], PATH)
        out[:, PATH : PATH + LAST] = _bits([e.last if e else 0 for _, e, _ in page_blocks], LAST)
    for row, (text, element, linked) in zip(out, page_blocks, strict=True):
        w = text.split(" ")
        slots = np.bincount(np.fromiter((_slot(x) % WORDS for x in w), np.int64, len(w)), minlength=WORDS)
        row[PATH + LAST : PATH + LAST + WORDS] = slots / len(w)
        n = len(text)
        row[-FIGURES:] = (1.0, np.log1p(len(w)) / 5, linked, min(1.0, n / len(w) / 20), text[-1] in ".!?", sum(text.count(c) for c in ".,;") / len(w), min(element.depth, 100) / 10 if element else 0, n > 200)
    return out


class BlockLSTM:
    """A bidirectional LSTM with one output for each step. Sequences are (steps, batch, features)."""

    def __init__(self, hidden: int = 12, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.params = {}
        for side in "fb":
            self.params["W" + side] = rng.normal(0, 0.15, (INPUT, 4 * hidden)).astype(np.float32)
            self.params["U" + side] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1
            self.params["b" + side] = b
        self.params["V"] = rng.normal(0, 0.3, 2 * hidden).astype(np.float32)
        self.params["c"] = np.zeros(1, np.float32)

    @staticmethod
    def _sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _read(self, side: str, x: np.ndarray, mask: np.ndarray, out: np.ndarray, state: tuple | None = None, rows: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Reads steps in one direction from a state, writes what each step says to out, adds what training needs to rows, and returns the state after them."""
        steps, n, _ = x.shape
        k, p = self.hidden, self.params
        g_in = x @ p["W" + side] + p["b" + side]
        h, c = state or (np.zeros((n, k), np.float32), np.zeros((n, k), np.float32))
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g = g_in[t] + h @ p["U" + side]
            ifo, new = self._sigmoid(g[:, : 3 * k]), np.tanh(g[:, 3 * k :])
            c2 = ifo[:, k : 2 * k] * c + ifo[:, :k] * new
            tc = np.tanh(c2)
            h2 = ifo[:, 2 * k :] * tc
            m = mask[t][:, None]
            if rows is not None:
                rows.append((t, h, c, ifo, new, tc, m))
            h, c = h + m * (h2 - h), c + m * (c2 - c)
            out[t] = h
        return h, c

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits (steps, batch); mask (steps, batch) is 0 for padding, which leaves the states as they are."""
        k, p = self.hidden, self.params
        out, kept = np.zeros((*x.shape[:2], 2 * k), np.float32), {}
        for side, lo in (("f", 0), ("b", k)):
            kept[side] = []
            self._read(side, x, mask, out[:, :, lo : lo + k], rows=kept[side] if keep else None)
        y = out @ p["V"] + p["c"]
        return (y, out, kept) if keep else y

    def forward_long(self, page: Blocks, slab: int) -> np.ndarray:
        """Logits of the blocks of one page, read in slabs of steps: forwards, then backwards from the end, with the state carried over."""
        k, p, y = self.hidden, self.params, np.full(len(page), self.params["c"][0], np.float32)
        starts = range(0, len(page), slab)
        for side, lo, order in (("f", 0, starts), ("b", k, reversed(starts))):
            state = None
            for a in order:
                x = vectors(page[a : a + slab])[:, None, :]
                out = np.empty((len(x), 1, k), np.float32)
                state = self._read(side, x, np.ones((len(x), 1), np.float32), out, state)
                y[a : a + slab] += out[:, 0] @ p["V"][lo : lo + k]
        return y

    def gradients(self, x, mask, label):
        k, p = self.hidden, self.params
        y, out, kept = self.forward(x, mask, True)
        s = self._sigmoid(y)
        total = max(1.0, float(mask.sum()))
        loss = float(((np.logaddexp(0, y) - label * y) * mask).sum()) / total
        dy = ((s - label) * mask / total).astype(np.float32)
        grad = {"V": np.einsum("tn,tnk->k", dy, out), "c": np.array([dy.sum()], np.float32)}
        for side, lo in (("f", 0), ("b", k)):
            u, n = p["U" + side], x.shape[1]
            dh, dc, du, dg_all = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32), np.zeros_like(u), np.zeros((*x.shape[:2], 4 * k), np.float32)
            for t, h, c, ifo, new, tc, m in reversed(kept[side]):
                dh = dh + dy[t][:, None] * p["V"][lo : lo + k]
                i, f, o = ifo[:, :k], ifo[:, k : 2 * k], ifo[:, 2 * k :]
                dh2 = dh * m
                dc2 = dc * m + dh2 * o * (1 - tc * tc)
                dg = np.concatenate([dc2 * new * i * (1 - i), dc2 * c * f * (1 - f), dh2 * tc * o * (1 - o), dc2 * i * (1 - new * new)], axis=1)
                du += h.T @ dg
                dg_all[t] = dg
                dh, dc = dh * (1 - m) + dg @ u.T, dc * (1 - m) + dc2 * f
            grad["U" + side] = du
            grad["b" + side] = dg_all.sum(axis=(0, 1))
            grad["W" + side] = np.tensordot(x, dg_all, axes=([0, 1], [0, 1]))
        return loss, grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int, batch: int = 24, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam on random batches of (vectors, labels) of pages, each batch of pages of like lengths; losses by round."""
        rng, losses = np.random.default_rng(seed), []
        pages = sorted(pages, key=lambda p: len(p[1]))
        near = min(len(pages), 4 * batch)
        m, v = ({k: np.zeros_like(a) for k, a in self.params.items()} for _ in range(2))
        for i in range(rounds):
            low = int(rng.integers(0, len(pages) - near + 1))
            pick = [pages[low + j] for j in rng.integers(0, near, batch)]
            x, mask = padded([p[0] for p in pick])
            label = np.zeros(mask.shape, np.float32)
            for j, (_, y) in enumerate(pick):
                label[: len(y), j] = y
            loss, grad = self.gradients(x, mask, label)
            losses.append(loss)
            norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grad.values()))))
            for k, g in grad.items():
                m[k] += 0.1 * (g / norm - m[k])
                v[k] += 0.01 * ((g / norm) ** 2 - v[k])
                self.params[k] -= rate * (1 - i / rounds) * (m[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (i + 1))) + 1e-7)
        return losses


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, max(len(p) for p in pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


class PageMaker:
    """Pages with known labels, to learn from."""

    #: What class and id attributes are made of, by kind of block.
    KINDS = {
        "menu": "nav menu navbar navigation breadcrumb breadcrumbs toolbar links topbar tabs pagination pager toc",
        "header": "header masthead banner logo branding top head site-title",
        "footer": "footer bottom copyright legal colophon credits foot",
        "sidebar": "sidebar side aside widget rail related recommended popular trending archive tags",
        "notice": "notice cookie consent alert warning message popup modal gdpr overlay announcement disclaimer hidden",
        "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner-ad outbrain teaser",
        "form": "form search login signup newsletter subscribe contact register",
        "comments": "comments comment reply respond discussion disqus thread responses commentlist feedback review",
        "share": "share social sharing follow buttons meta byline actions",
    }
    MAIN = "content post entry article story main body text article-body post-content entry-content prose page document single".split()

    def __init__(self, seed: int = 0):
        self.rng = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        n, r = int(self.rng.integers(low, high + 1)), self.rng
        ends = np.cumsum(r.integers(1, 9, n)).tolist()
        letters = r.integers(97, 123, ends[-1]).astype(np.uint8).tobytes().decode()
        w = [letters[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        style = r.random()
        if style < 0.06:
            w = [x.upper() + "!!" for x in w]
        elif style < 0.12:
            w = [x + self.pick("***", "%%%", "###", "$$$") for x in w]
        elif style < 0.16:
            w = [x + " |" for x in w]
        text = " ".join(w)
        return text + self.pick(".", ".", ".", "!", "?", "") if r.random() < 0.7 else text

    def attribute(self, words: str | list[str]) -> str:
        if self.rng.random() < 0.15:
            return ""
        w = self.pick(*(words.split() if isinstance(words, str) else words))
        if self.rng.random() < 0.4:
            w = self.pick("site-", "page-", "main-", "js-", "c-", "left-", "") + w + self.pick("", "-box", "-wrap", "-area", "-list", "1", "-inner", "-item")
        return f' {self.pick("class", "class", "class", "id")}="{w}"'

    def clutter(self, kind: str) -> tuple[str, list[int]]:
        own = {"menu": ("nav", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "footer", "div"), "sidebar": ("aside", "aside", "div"), "form": ("form", "form", "div"), "comments": ("section", "div", "ol")}.get(kind, ("div", "section", "aside", "p"))
        tag = self.pick(*own)
        named = tag in ("nav", "footer", "aside", "form", "header")
        attribute = self.attribute(self.KINDS[kind]) if named else f' {self.pick("class", "id")}="{self.pick(*self.KINDS[kind].split())}"'
        n = int(self.rng.integers(1, 7)) if kind in ("menu", "sidebar", "comments", "form", "footer") else int(self.rng.integers(1, 3))
        rows = []
        long = (3, 45) if kind in ("comments", "notice", "advert", "sidebar", "footer") else (1, 4)
        for _ in range(n):
            t = self.words(*long)
            rows.append(f'<a href="/{t[:5]}">{t}</a>' if kind == "menu" or self.rng.random() < 0.2 else t)
        if tag == "p":
            return f"<p{attribute}>{' '.join(rows)}</p>", [0]
        if len(rows) == 1 and self.rng.random() < 0.7:
            return f"<{tag}{attribute}>{rows[0]}</{tag}>", [0]
        inner, count = self.pick("li", "div", "p", "li"), len(rows)
        body = "".join(f"<{inner}>{x}</{inner}>" for x in rows)
        if inner == "li" and tag not in ("ul", "ol"):
            body = f"<ul>{body}</ul>"
        return f"<{tag}{attribute}>{body}</{tag}>", [0] * count

    def article(self, clean: bool) -> tuple[str, list[int]]:
        parts, labels = [], []

        def put(tag: str, text: str) -> None:
            parts.append(f"<{tag}>{text}</{tag}>" if self.rng.random() < 0.95 or tag != "p" else f"<p><b>{text}<br>")
            labels.append(1)

        if self.rng.random() < 0.85:
            title = self.words(1, 12)
            parts.append(f"<header><h1>{title}</h1></header>" if self.rng.random() < 0.1 else f"<h1>{title}</h1>")
            labels.append(1)
        for _ in range(int(self.rng.integers(1, 14))):
            r = self.rng.random()
            if r < 0.78:
                put("p", self.words(1, 60))
            elif r < 0.84:
                put(self.pick("h2", "h3", "blockquote", "pre"), self.words(1, 14))
            elif r < 0.9:
                rows = [self.words(1, 12) for _ in range(int(self.rng.integers(1, 5)))]
                parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in rows) + "</ul>")
                labels += [1] * len(rows)
            elif r < 0.93:
                rows = [self.words(1, 4) for _ in range(int(self.rng.integers(2, 6)))]
                parts.append("<table><tr>" + "".join(f"<td>{x}</td>" for x in rows) + "</tr></table>")
                labels += [1] * len(rows)
            elif not clean:
                html, y = self.clutter(self.pick("advert", "share", "sidebar", "notice", "form", "comments"))
                parts.append(html)
                labels += y
        return "".join(parts), labels

    def page(self) -> tuple[str, list[int]]:
        parts, labels = [], []

        def put(made: tuple[str, list[int]]) -> None:
            parts.append(made[0])
            labels.extend(made[1])

        kinds = list(self.KINDS)
        for kind in ("header", "menu"):
            if self.rng.random() < 0.7:
                put(self.clutter(kind))
        for _ in range(int(self.rng.integers(0, 3))):
            put(self.clutter(self.pick(*kinds)))
        tag = self.pick("article", "article", "article", "article", "main", "div", "section")
        html, y = self.article(self.rng.random() < 0.6)
        attribute = self.attribute(self.MAIN) if tag in ("article", "main") else f' class="{self.pick(*self.MAIN)}"'
        put((f"<{tag}{attribute if self.rng.random() < 0.6 or tag in ('div', 'section') else ''}>{html}</{tag}>", y))
        for _ in range(int(self.rng.integers(0, 4))):
            put(self.clutter(self.pick(*kinds)))
        if self.rng.random() < 0.8:
            put(self.clutter("footer"))
        body = "".join(parts)
        for _ in range(int(self.rng.integers(0, 3))):
            body = f"<div{self.attribute(['wrapper', 'container', 'page', 'site', 'layout', 'grid', 'row'])}>{body}</div>"
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{body}</body></html>", labels


@lru_cache(maxsize=4)
def trained(pages: int = 1500, rounds: int = 350, hidden: int = 12, seed: int = 0) -> BlockLSTM:
    maker, made = PageMaker(seed), []
    for _ in range(pages):
        html, labels = maker.page()
        found = blocks(html)
        if len(found) == len(labels) and found:
            made.append((vectors(found), np.array(labels, np.float32)))
    net = BlockLSTM(hidden, seed)
    net.train(made, rounds, seed=seed)
    return net


#: Characters of pages that are parsed at a time.
SLAB = 2 << 20


def extract(net: BlockLSTM, pages: list[str | None], most_steps: int = 40_000) -> list[str]:
    """The main text of each page; pages of like lengths are read together, at most most_steps blocks at a time, longer ones in slabs of so many."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and n < 512 and (n + 1) * len(found[order[at + n]]) <= most_steps:
            n += 1
        some = order[at : at + n]
        if len(found[some[0]]) > most_steps:
            texts, y = found[some[0]].texts, net.forward_long(found[some[0]], most_steps)
            out[some[0]] = "\n".join(texts[b] for b in np.flatnonzero(y > 0).tolist())
            at += 1
            continue
        x, mask = padded([vectors(found[i]) for i in some])
        y = net.forward(x, mask)
        for j, i in enumerate(some):
            out[i] = "\n".join(b[0] for b, keep in zip(found[i], y[: len(found[i]), j] > 0, strict=True) if keep)
        at += n
    return out


def _extract(net: BlockLSTM):
    def run(batches):
        for batch in batches:
            html = batch.column("html").to_pylist()
            for a, b in slabs(html, SLAB):
                part = batch.slice(a, b - a)
                texts = extract(net, html[a:b])
                keep = [c for c in part.schema.names if c != "html"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, net: BlockLSTM | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    net = net or trained()
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(_extract(net), "page_id long, url string, text string, n_chars long")


def op7(spark, sf_dir):
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
