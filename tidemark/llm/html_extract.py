"""Main text of web pages, by a recurrent labeller of their blocks.

A page becomes the sequence of its leaf blocks (texts between block-level tags, in
page order).  Each block has a vector: hashed tags and class words of its path, hashed
words, and a few shape figures.  A bidirectional LSTM in numpy reads the whole
sequence, so every block is classified knowing all others, as article text or not.

The network is trained when it is needed, on pages made from layout rules with a
fixed seed; it takes seconds and always gives the same weights.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|[^<]+|<""", re.S)
STOP = re.compile(r"""["'>]""")
#: Quoted values with a ``<`` in a tag, from which on its quotes count as not closed.
ODD_VALUES = 16
HINT = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z]+")
#: Fixed lists of the HTML standard: what ends a block, what has no end tag, whose text is never shown.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without shown text.  RAW: their content is raw text up to the end tag; of REST, or to the end of the page.  FOREIGN may close themselves.
REST = frozenset("script style title textarea".split())
RAW = REST | frozenset("noscript iframe".split())
SILENT = RAW | frozenset("template svg math object canvas audio video".split())
FOREIGN = frozenset("svg math".split())
#: Elements that an opening tag ends if they are open inside the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "summary", "figcaption", "tbody", "thead", "tfoot", "tr", "td", "th", "li", "dt", "dd"}

PATH_DIMS, WORD_DIMS, SHAPE_DIMS, HIDDEN = 160, 24, 8, 24


class Markup:
    """Reads a page piece by piece, in time that grows with its length, however broken it is."""

    def __init__(self, html: str):
        self.html, self.none_behind = html, {}

    def find(self, what: str, at: int) -> int:
        """Place of a string from ``at`` on, or -1; that there is none is remembered."""
        if at >= self.none_behind.get(what, len(self.html) + 1):
            return -1
        if (found := self.html.find(what, at)) < 0:
            self.none_behind[what] = at
        return found

    def attributes(self, at: int) -> tuple[str, int]:
        """What stands in a tag behind its name, and the tag's end.

        A quoted value that holds a ``<`` is believed only if a blank, ``/`` or ``>``
        follows it.  Where quotes are not closed, the tag ends at its first ``>``, or
        before the next ``<``.
        """
        html, place, odd = self.html, at, 0
        while m := STOP.search(html, place):
            if m[0] == ">":
                return html[at : m.start()], m.end()
            close = self.find(m[0], m.end())
            if close < 0:
                break
            if 0 <= html.find("<", m.end(), close):
                odd += 1
                if odd > ODD_VALUES or html[close + 1 : close + 2] not in (" ", "\t", "\n", "\r", "\f", "/", ">"):
                    break
            place = close + 1
        end, other = self.find(">", at), self.find("<", at)
        if end >= 0 and (other < 0 or end < other):
            return html[at:end], end + 1
        stop = other if other >= 0 else len(html)
        return html[at:stop], stop

    def read(self, at: int) -> tuple[int, str, str, str, str] | None:
        """End of the piece at ``at``, "/" of an end tag, name and attributes of a tag, text (of anything else); None at the end."""
        if not (m := TOKEN.match(self.html, at)):
            return None
        if m[2] is None:
            return m.end(), "", "", "", m[0]
        attributes, end = self.attributes(m.end())
        return end, m[1], m[2].lower(), attributes, ""

    def raw_end(self, name: str, at: int) -> int | None:
        """Where the raw text of an element ends; None if it has no end tag and need not reach the page's end."""
        key = f"</{name}"
        if at < self.none_behind.get(key, len(self.html) + 1):
            if end := re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(self.html, at):
                return end.end()
            self.none_behind[key] = at
        return len(self.html) if name in REST else None

    def ends(self) -> dict[int, int]:
        """Where the elements without shown text end that are not raw text, by the place of their start; not those without an end tag."""
        out: dict[int, int] = {}
        begun: dict[str, list[int]] = {}
        at = 0
        while (piece := self.read(at)) is not None:
            begin, (at, slash, name, attributes, _) = at, piece
            if name not in SILENT or not slash and name in FOREIGN and attributes.rstrip().endswith("/"):
                continue
            if slash:
                if begun.get(name):
                    out[begun[name].pop()] = at
            elif name in RAW and (end := self.raw_end(name, at)) is not None:
                at = end
            else:
                begun.setdefault(name, []).append(begin)
        return out


#: Open elements, beyond which a page's further elements are not nested.
DEPTH = 512


def blocks(html: str) -> list[tuple[tuple[str, ...], str, float]]:
    """Path (tags and words of class, id and role), text and share of link text of each block."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    page, linked, links, path, at = Markup(html), 0, 0, (), 0
    hidden, ends = 0, None  # open elements whose content is not shown: their stack entries have no words

    def flush() -> None:
        nonlocal linked
        if pieces:
            if text := " ".join(unescape("".join(pieces)).split()):
                out.append((path, text, min(1.0, linked / max(1, len(text)))))
            pieces.clear()
            linked = 0

    def close(i: int) -> None:
        nonlocal links, hidden
        links -= sum(x[0] == "a" for x in stack[i:])
        hidden -= sum(not x[1] for x in stack[i:])
        del stack[i:]

    known: dict[tuple[str, ...], tuple[str, ...]] = {}
    while (piece := page.read(at)) is not None:
        begin, (at, slash, name, attributes, text) = at, piece
        if not name:
            if not hidden and (text[:1] != "<" or text == "<"):
                if not pieces:
                    if text.isspace():
                        continue
                    path = tuple(w for _, words in stack for w in words)
                    path = known.setdefault(path, path)
                pieces.append(text)
                linked += len(text) if links else 0
            continue
        if slash:
            if name in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in SILENT and not (name in FOREIGN and attributes.rstrip().endswith("/")):
            if name in RAW and (end := page.raw_end(name, at)) is not None:
                at = end
                continue
            ends = page.ends() if ends is None else ends
            if (end := ends.get(begin)) is not None:
                at = end
            elif len(stack) < DEPTH:  # closed with its parent
                stack.append((name, ()))
                hidden += 1
            continue
        if name in BLOCK:
            flush()
        elif name == "br" and not hidden:
            pieces.append(" ")
        if name in VOID:
            continue
        if name in CLOSES_P or name in ENDS:
            stop = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}.get(name, {"table"})
            goal = {"p"} if name in CLOSES_P else ENDS[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in goal:
                    close(i)
                    break
                if stack[i][0] in BLOCK and (name in CLOSES_P or stack[i][0] in stop):
                    break
        if len(stack) >= DEPTH:
            continue
        words = [name]
        for h in HINT.finditer(attributes) if attributes else ():
            words += [f".{w}" for w in SPLIT.split((h[2] or h[3] or h[4] or "").lower()) if w]
        stack.append((name, tuple(words)))
        links += name == "a"
    flush()
    return out


@lru_cache(100_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_DIMS, np.float32)
    for word in path:
        h = zlib.crc32(word.encode())
        out[h % PATH_DIMS] = 1 if h & 0x10000 else -1
    if path:  # the last tag once more, by itself
        last = next((w for w in reversed(path) if w[0] != "."), "")
        h = zlib.crc32(f"/{last}".encode())
        out[h % PATH_DIMS] = 1 if h & 0x10000 else -1
    return out


@lru_cache(200_000)
def _word_slot(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "replace")) % WORD_DIMS


def vectors(page: list[tuple[tuple[str, ...], str, float]], first: int = 0, last: int | None = None) -> np.ndarray:
    """Vectors of a page's blocks, or of some of them."""
    last = len(page) if last is None else min(last, len(page))
    out = np.zeros((last - first, PATH_DIMS + WORD_DIMS + SHAPE_DIMS), np.float32)
    for i, (path, text, linked) in enumerate(page[first:last]):
        words = text.split(" ")
        out[i, :PATH_DIMS] = _path_vector(path)
        bag = np.bincount(np.fromiter(map(_word_slot, words), np.int64, len(words)), minlength=WORD_DIMS)
        out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = bag / (4 * np.sqrt((bag * bag).sum()))
        ends = text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?")
        out[i, PATH_DIMS + WORD_DIMS :] = (
            np.log1p(len(words)) / 5, min(1, len(words) / 100), linked, min(1, ends / 5), text[-1] in ".!?:;\"",
            "©" in text, (first + i) / len(page), 1 / (1 + len(page)),
        )
    return out


class Labeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 7):
        rng, width = np.random.default_rng(seed), PATH_DIMS + WORD_DIMS + SHAPE_DIMS
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = (rng.normal(0, 0.1, (width, 4 * HIDDEN))).astype(np.float32)
            self.p[f"h{d}"] = (rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN))).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p["o"], self.p["ob"] = rng.normal(0, 0.1, (2 * HIDDEN, 1)).astype(np.float32), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Hidden states, and the last state; x is (blocks, pages, width), mask (blocks, pages, 1)."""
        steps, n, _ = x.shape
        pre = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p[f"h{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh))
            m = mask[t]
            c, h = m * new + (1 - m) * c, m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, kept.setdefault(d, []) if kept is not None else None)[0] for d in "fb"], 2)
        if kept is not None:
            kept["both"] = both
        return 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["ob"])))[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict = {}
        p = self.forward(x, mask, kept)
        dz = ((p - y) * mask[..., 0])[..., None] / max(1.0, mask.sum())
        out = {"o": np.einsum("tnh,tnk->hk", kept["both"], dz), "ob": dz.sum((0, 1))}
        dboth = dz @ self.p["o"].T
        for k, d in enumerate("fb"):
            dout = dboth[..., k * HIDDEN : (k + 1) * HIDDEN]
            dpre, dh, dc = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), 0.0, 0.0
            grad = np.zeros_like(self.p[f"h{d}"])
            for t, h0, c0, i, f, o, g, tanh in reversed(kept[d]):
                m = mask[t]
                dh = dh + dout[t]
                now, rest = dh * m, dh * (1 - m)
                dcell = dc * m + now * o * (1 - tanh * tanh)
                dgate = np.concatenate([dcell * g * i * (1 - i), dcell * c0 * f * (1 - f), now * tanh * o * (1 - o), dcell * i * (1 - g * g)], 1)
                dpre[t] = dgate
                grad += h0.T @ dgate
                dh, dc = dgate @ self.p[f"h{d}"].T + rest, dcell * f + dc * (1 - m)
            out |= {f"h{d}": grad, f"x{d}": np.einsum("tnw,tng->wg", x, dpre, optimize=True), f"c{d}": dpre.sum((0, 1))}
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Labeller:
        rng = random.Random(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i][1]) // 8, rng.random()))
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            rng.shuffle(groups)
            for group in groups:
                x, mask = padded([pages[i][0] for i in group])
                y = np.zeros(mask.shape[:2], np.float32)
                for j, i in enumerate(group):
                    y[: len(pages[i][1]), j] = pages[i][1]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list], cells: int = 1 << 14) -> list[np.ndarray]:
        """Probability of article text for each block of each page (as of blocks()).

        Pages of like length go together, padded to at most ``cells`` blocks; a longer
        page goes alone, its vectors made piece by piece.
        """
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: -len(pages[i]))
        while order:
            longest = len(pages[order[0]])
            if longest > cells:
                out[order[0]], order = self._long(pages[order[0]], cells), order[1:]
                continue
            group, order = order[: max(1, cells // longest)], order[max(1, cells // longest) :]
            p = self.forward(*padded([vectors(pages[i]) for i in group]))
            for j, i in enumerate(group):
                out[i] = p[: len(pages[i]), j]
        return out

    def _long(self, page: list, cells: int) -> np.ndarray:
        z = np.zeros(len(page), np.float32)
        for k, d in enumerate("fb"):
            state = np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)
            starts = range(0, len(page), cells)
            for first in starts if d == "f" else reversed(starts):
                x = vectors(page, first, first + cells)[:, None, :]
                hidden, state = self._run(x, np.ones((len(x), 1, 1), np.float32), d, None, state)
                z[first : first + cells] += (hidden[:, 0] @ self.p["o"][k * HIDDEN : (k + 1) * HIDDEN])[:, 0]
        return 1 / (1 + np.exp(-(z + self.p["ob"][0])))


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages), 1), np.float32)
    for j, page in enumerate(pages):
        x[: len(page), j], mask[: len(page), j] = page, 1
    return x, mask


MARK = "\ue000"
#: Names that layouts give to what surrounds an article.
AROUND = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topnav toc pagination pager tabs links".split(),
    "header": "header masthead banner top site-header logo branding".split(),
    "footer": "footer bottom copyright site-footer legal colophon credits".split(),
    "aside": "sidebar aside related widget rail recommended trending popular tags side".split(),
    "notice": "notice cookie consent gdpr alert popup modal message warning subscribe newsletter overlay".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad promotion adsense".split(),
    "form": "form search login signup search-form contact".split(),
    "comments": "comments comment replies responses discussion disqus reply respond".split(),
    "share": "share social sharing follow author-bio".split(),
}
CONTENT = "content article post entry story main body text article-body post-content entry-content prose".split()


class Layouts:
    """Random pages whose article text starts with MARK in every block."""

    def __init__(self, seed: int = 5):
        self.r = random.Random(seed)
        self.junk = False
        self.syllables = [
            "the an er ing tion st re en ou ha wh on ea ly ed".split(), "ein sch ung keit lich der ge ver ü ö ä ach".split(),
            "de la que ción os as ñ en í ó es".split(), "le é è ment eau ou re tre aux ç pa".split(), "да но ст ко ри ов ть".split(), "的 一 是 文 章 内 容".split(),
        ]

    def words(self, low: int, high: int) -> str:
        s = self.r.choice(self.syllables)
        return " ".join("".join(self.r.choices(s, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentences(self, n: int) -> str:
        out = []
        for _ in range(n):
            text = self.words(3, 22)
            if self.junk:
                marks = self.r.choice([["*** ", "$$$ ", "&amp;&amp;&amp; ", "%%% ", "### "], [" | "], ["!! "]])
                text = "".join(w + self.r.choice(marks) for w in text.split()).strip(" ")
            out.append(text.capitalize() + self.r.choice(["", " |"] if self.junk else "....!?"))
        return " ".join(out)

    def links(self, n: int) -> str:
        items = [f'<li><a href="/{i}">{self.words(1, 4)}</a></li>' if self.r.random() < 0.95 else f"<li>{self.words(1, 3)}</li>" for i in range(n)]
        return f"<ul>{''.join(items)}</ul>" if self.r.random() < 0.8 else " ".join(f'<a href="#">{self.words(1, 3)}</a>' for _ in range(n))

    def wrap(self, kind: str, inner: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        name = self.r.choice(AROUND[kind])
        how = self.r.random()
        if tag == "div" or how < 0.4:
            attr = self.r.choice(["class", "class", "id"])
            extra = self.r.choice(["", " box", "-1", " widget", "-wrapper"])
            tag = self.r.choice(["div", "div", "section"])
            return f'<{tag} {attr}="{name}{extra}">{inner}</{tag}>'
        return f"<{tag}>{inner}</{tag}>" if how < 0.8 else f'<{tag} class="{name}">{inner}</{tag}>'

    def extra(self, kind: str) -> str:
        r = self.r
        if kind in ("nav",):
            return self.wrap(kind, self.links(r.randint(2, 12)))
        if kind == "header":
            tag = r.choice(["h1", "h2", "div", "p"])
            return self.wrap(kind, f"<{tag}>{self.words(1, 5)}</{tag}>" + (self.links(4) if r.random() < 0.5 else ""))
        if kind == "footer":
            return self.wrap(kind, r.choice(["&copy; ", "", "© 2024 "]) + r.choice([self.words(2, 14), f"<p>{self.sentences(r.randint(1, 3))}</p>", self.links(5)]))
        if kind == "form":
            return self.wrap(kind, f"<label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button>" + (f"<p>{self.sentences(1)}</p>" if r.random() < 0.4 else ""))
        if kind == "comments":
            name = r.choice(["comment", "reply", "item"])
            each = "".join(f'<div class="{name}"><b>{self.words(1, 2)}</b><p>{self.sentences(r.randint(1, 4))}</p></div>' for _ in range(r.randint(1, 6)))
            return self.wrap(kind, f"<h3>{self.words(1, 3)}</h3>{each}")
        if kind == "aside":
            return self.wrap(kind, r.choice([f"<h3>{self.words(1, 4)}</h3>{self.links(r.randint(2, 8))}", f"<p>{self.sentences(r.randint(1, 3))}</p>"]))
        return self.wrap(kind, r.choice([self.sentences(r.randint(1, 3)), f"<p>{self.sentences(1)}</p>", self.words(2, 8)]))

    def body(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f"<h1>{MARK}{self.words(2, 12)}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            text, how = MARK + self.sentences(r.choice([1, 1, 2, 4, 7])), r.random()
            if r.random() < 0.08:
                text = MARK + self.words(1, 3).capitalize() + "."
            if r.random() < 0.15:
                text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(1, 6)}.'
            if how < 0.6:
                out.append(f"<p>{text}</p>")
            elif how < 0.72:
                out.append(f"<p><b>{text}<br>")
            elif how < 0.8:
                out.append(f"<h2>{MARK}{self.words(1, 6)}</h2><p>{text}</p>")
            elif how < 0.87:
                out.append(f"<ul><li>{text}</li><li>{MARK}{self.words(2, 9)}</li></ul>")
            elif how < 0.92:
                out.append(f"<blockquote>{text}</blockquote>")
            elif how < 0.96:
                out.append(f"<div>{text}</div>")
            else:
                out.append(f"<table><tr><td>{MARK}{self.words(1, 5)}</td><td>{MARK}{self.words(1, 5)}</td></tr></table><p>{text}")
            if r.random() < 0.05:
                out.append(self.extra(r.choice(["ad", "aside", "share", "notice"])))
        return "".join(out)

    def page(self) -> str:
        r, how = self.r, self.r.random()
        self.junk = r.random() < 0.2
        if how < 0.05:
            return "".join(f"<p>{MARK}{self.sentences(r.randint(1, 4))}</p>" for _ in range(r.randint(1, 5)))
        if how < 0.08:
            return MARK + self.sentences(r.randint(1, 5))
        before = [self.extra(k) for k in ("notice", "header", "nav", "ad", "nav", "form", "aside") if r.random() < 0.45]
        after = [self.extra(k) for k in ("share", "comments", "aside", "nav", "form", "ad", "notice") if r.random() < 0.35]
        body = self.body()
        kind = r.random()
        if kind < 0.45:
            body = f"<article>{body}</article>"
        elif kind < 0.6:
            body = f"<main>{body}</main>"
        elif kind < 0.9:
            tag = r.choice(["div", "section"])
            body = f'<{tag} {r.choice(["class", "id"])}="{r.choice(CONTENT)}">{body}</{tag}>'
        else:
            body = f"<div>{body}</div>"
        if r.random() < 0.3:
            body = f"<main>{body}</main>" if r.random() < 0.5 else f'<div class="{r.choice(["wrapper", "container", "page", "row", "col"])}">{body}</div>'
        foot = self.extra("footer") if r.random() < 0.85 else ""
        return f"<html><head><title>{self.words(1, 6)}</title></head><body>{''.join(before)}{body}{''.join(after)}{foot}</body></html>"


@lru_cache(1)
def trained(pages: int = 1200, seed: int = 5) -> Labeller:
    """The labeller, trained on made pages; the same weights every time."""
    made, data = Layouts(seed), []
    for _ in range(pages):
        found = blocks(made.page())
        if found:
            y = np.array([MARK in text for _, text, _ in found], np.float32)
            data.append((vectors([(p, text.replace(MARK, "").strip() or "-", k) for p, text, k in found]), y))
    return Labeller().fit(data)


PAGE = T.StructType().add("page_id", "long").add("url", "string").add("text", "string").add("n_chars", "long").add("n_blocks", "long").add("kept_blocks", "long")


def extract_text(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` (article blocks joined by two line feeds),
    ``n_chars``, and how many blocks it has and keeps.

    The whole page is read.  Null or empty html, or a page without article text, gives
    an empty text; null ids and urls stay null; repeated rows give a row each; other
    columns are ignored.  Broken markup (open or unknown tags, stray signs) is read as
    far as it goes.  No shuffle; the broadcast network has a fixed size.
    """
    spark = pages.sparkSession
    shipped = spark.sparkContext.broadcast(labeller or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in slices(batches, "html", 1 << 20):
            found = [blocks(h or "") for h in batch.column("html").to_pylist()]
            labels = model.label(found)
            kept = [[text for (_, text, _), p in zip(page, ps, strict=True) if p > 0.5] for page, ps in zip(found, labels, strict=True)]
            texts = ["\n\n".join(x) for x in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), *(pa.array(list(map(len, x)), pa.int64()) for x in (texts, found, kept))], names=PAGE.fieldNames()
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, PAGE)
