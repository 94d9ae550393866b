"""Main text of web pages by a recurrent block labeller.

A page is cut into its text blocks (leaves between block-level tags) with the path of
elements above each.  A bidirectional LSTM in numpy reads the blocks in page order, each
as vectors of its path, its hashed words and a few measures, and labels every block main
text or not in the light of the whole page.  It is trained here, on pages that a
generator writes in many layouts with known labels.

Defined results: null and empty html gives an empty text; broken markup is read as
browsers do roughly (a new paragraph ends an open one, stray end tags are skipped);
rows that repeat a page_id are read by their own html; extra columns are ignored; an
empty table gives an empty result.  Pages are read whole, whatever their length.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm import textvec as tv
from cairn.llm.store import columns, session

#: Elements inside a line of text, without content, never shown, and closed by their like.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head title script style noscript template svg math iframe object canvas audio video select option datalist".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block-level elements that end an open paragraph.
BREAKS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
PATH, WORD, MORE, HIDDEN = 48, 16, 8, 24
#: Names of an element that count in full, and blocks that are labelled at once.
NAMES, SLOTS = 12, 1 << 14
_space, _token = re.compile(r"\s+"), re.compile(r"[a-z]+")
_vectors: dict[str, np.ndarray] = {}


class Place:
    """An open element: its tokens below its parent's; sums are made once, whatever the depth."""

    __slots__ = ("above", "block", "own", "size", "sum", "tag", "weight")

    def __init__(self, above: Place | None, tag: str, names: list[str]):
        self.above, self.tag, self.own = above, tag, (tag, *(f".{n}" for n in names))
        self.weight = min(1.0, NAMES / max(1, len(names)))  # of each name: long lists count as NAMES of them
        self.size = (above.size if above else 0) + 1 + min(len(names), NAMES)
        self.block = tag if tag not in INLINE else above.block if above else ""
        self.sum: np.ndarray | None = None

    def __iter__(self) -> Iterator[str]:
        up, at = [], self
        while at:
            up.append(at.own)
            at = at.above
        return (t for own in reversed(up) for t in own)

    def __len__(self) -> int:
        return self.size

    def vector(self) -> np.ndarray:
        todo, at = [], self
        while at and at.sum is None:
            todo.append(at)
            at = at.above
        total = at.sum if at else np.zeros(PATH, np.float32)
        for p in reversed(todo):
            total = total + _vector(p.tag)
            for name in p.own[1:]:
                total = total + np.float32(p.weight) * _vector(name)
            p.sum = total
        return total


class Blocks(HTMLParser):
    """Text blocks of a page, in order: (text, place, leaf tag, characters inside links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, Place, str, int]] = []
        self._open: list[Place] = []
        self._tags: Counter = Counter()
        self._text: list[str] = []
        self._hidden = self._links = self._linked = 0
        self._at: tuple[Place, str] | None = None

    def _flush(self) -> None:
        text = _space.sub(" ", "".join(self._text)).strip()
        if text and self._at:
            self.found.append((text, *self._at, self._linked))
        self._text, self._linked, self._at = [], 0, None

    def _pop(self) -> None:
        tag = self._open.pop().tag
        self._tags[tag] -= 1
        self._hidden -= tag in UNSEEN
        self._links -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("br", "wbr"):
            self._text.append(" " if tag == "br" else "")
            return
        if tag not in INLINE:
            self._flush()
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in BREAKS_P else set())
            for i in range(len(self._open) - 1, -1, -1):
                if self._open[i].tag in ends:
                    while len(self._open) > i:
                        self._pop()
                    break
                if self._open[i].tag not in INLINE:
                    break
        if tag in EMPTY:
            return
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role", "itemprop") and v).lower()
        self._open.append(Place(self._open[-1] if self._open else None, tag, _token.findall(names)))
        self._tags[tag] += 1
        self._hidden += tag in UNSEEN
        self._links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
        if not self._tags[tag]:
            return
        if tag not in INLINE:
            self._flush()
        while self._open:
            last = self._open[-1].tag
            if last != tag and tag in INLINE and last not in INLINE:
                return  # an inline end tag doesn't close a block
            self._pop()
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if self._hidden or not data:
            return
        if self._at is None and not data.isspace():
            here = self._open[-1] if self._open else Place(None, "", [])
            self._at = (here, here.block)
        self._text.append(data)
        self._linked += len(data) if self._links else 0

    @classmethod
    def of(cls, html: str) -> list[tuple[str, Place, str, int]]:
        p = cls()
        p.feed(html)
        p.close()
        p._flush()
        return p.found


def _vector(token: str) -> np.ndarray:
    v = _vectors.get(token)
    if v is None:
        if len(_vectors) > 50_000:
            _vectors.clear()
        v = _vectors[token] = np.random.default_rng(zlib.crc32(token.encode())).standard_normal(PATH).astype(np.float32) / 4
    return v


def inputs(pages: list[list[tuple]]) -> list[np.ndarray]:
    """The labeller's input vectors of each page's blocks."""
    flat = [b for p in pages for b in p]
    hashes, at = tv.word_hashes(*tv.buffers(pa.array([b[0] for b in flat], pa.string())), tv.ALNUM, tv.ASCII_LOWER)
    x = np.zeros((len(flat), 2 * PATH + WORD + MORE), np.float32)
    if len(hashes):
        row = np.repeat(np.arange(len(flat)), np.diff(at))
        place = (hashes & tv.U(WORD - 1)).astype(np.int64)
        sign = np.where(hashes >> tv.U(63), 1.0, -1.0)
        size = np.sqrt(np.maximum(1, np.diff(at)))[:, None]
        for a in range(0, len(flat), SLOTS):
            b = min(len(flat), a + SLOTS)
            own = slice(at[a], at[b])
            counts = np.bincount((row[own] - a) * WORD + place[own], sign[own], (b - a) * WORD).reshape(b - a, WORD)
            x[a:b, 2 * PATH : 2 * PATH + WORD] = counts / size[a:b] / 2
    for i, (text, path, leaf, linked) in enumerate(flat):
        if isinstance(path, Place):
            x[i, :PATH] = path.vector()
        else:
            for t in path:
                x[i, :PATH] += _vector(t)
        n = len(text)
        x[i, PATH : 2 * PATH] = _vector(f"leaf {leaf}")
        ends = text[-1] in ".!?…\"')"
        x[i, 2 * PATH + WORD :] = (np.log1p(n) / 4, n < 25, n > 120, min(1.0, linked / n), ends, min(1.0, 20 * text.count(",") / n), len(path) / 10, 1.0)
    out, a = [], 0
    for p in pages:
        out.append(x[a : a + len(p)])
        a += len(p)
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 5):
        r, d = np.random.default_rng(seed), 2 * PATH + WORD + MORE
        self.p = {f"w{k}": (r.standard_normal((d + HIDDEN, 4 * HIDDEN)) / np.sqrt(d + HIDDEN)).astype(np.float32) for k in "fb"}
        self.p |= {f"b{k}": np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32) for k in "fb"}
        self.p |= {"v": (r.standard_normal(2 * HIDDEN + d) / 10).astype(np.float32), "c": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, k: str) -> tuple[np.ndarray, list]:
        n, t, _ = x.shape
        h, c, out, kept = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, t, HIDDEN), np.float32), []
        for i in range(t) if k == "f" else range(t - 1, -1, -1):
            z = np.concatenate([x[:, i], h], axis=1)
            g = z @ self.p["w" + k] + self.p["b" + k]
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -20, 20)))
            i_, f_, o_, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, i, None]
            c_new = (f_ * c + i_ * u) * m
            th = np.tanh(c_new)
            kept.append((i, z, i_, f_, o_, u, c, th, m))
            c, h = c_new, o_ * th * m
            out[:, i] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, kf = self._run(x, mask, "f")
        b, kb = self._run(x, mask, "b")
        both = np.concatenate([f, b, x], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["v"] + self.p["c"][0], -20, 20))), (both, kf, kb)

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        q, (both, kf, kb) = self.forward(x, mask)
        d = (q - y) * mask / mask.sum()
        g = {"v": np.einsum("nt,ntk->k", d, both), "c": np.array([d.sum()])}
        d_h = d[:, :, None] * self.p["v"]
        for k, kept, part in (("f", kf, d_h[:, :, :HIDDEN]), ("b", kb, d_h[:, :, HIDDEN : 2 * HIDDEN])):
            w = self.p["w" + k]
            gw, gb = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            back_h, back_c = np.zeros_like(part[:, 0]), np.zeros_like(part[:, 0])
            for i, z, i_, f_, o_, u, c, th, m in reversed(kept):
                dh = (part[:, i] + back_h) * m
                dc = (dh * o_ * (1 - th * th) + back_c) * m
                dg = np.concatenate([dc * u * i_ * (1 - i_), dc * c * f_ * (1 - f_), dh * th * o_ * (1 - o_), dc * i_ * (1 - u * u)], axis=1)
                gw += z.T @ dg
                gb += dg.sum(0)
                back_h, back_c = (dg @ w.T)[:, -HIDDEN:], dc * f_
            g |= {"w" + k: gw, "b" + k: gb}
        return g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Chance of main text for every block; pages of like length go together, SLOTS blocks at most or one page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * len(pages[order[b]]) <= SLOTS and b - a < 64:
                b += 1
            q = self.infer(*_padded([pages[i] for i in order[a:b]]))
            for j, i in enumerate(order[a:b]):
                out[i] = q[j, : len(pages[i])]
            a = b
        return out

    def infer(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The chances that ``forward`` gives, without what a gradient needs: memory for a few steps alone."""
        n, t, d = x.shape
        v = self.p["v"]
        score = x @ v[2 * HIDDEN :] + self.p["c"][0]
        step = max(1, SLOTS // 4 // n)
        for k, own in (("f", v[:HIDDEN]), ("b", v[HIDDEN : 2 * HIDDEN])):
            w, h, c = self.p["w" + k], np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            parts = range(0, t, step)
            for a in parts if k == "f" else reversed(parts):
                b = min(t, a + step)
                read = x[:, a:b] @ w[:d] + self.p["b" + k]
                for i in range(a, b) if k == "f" else range(b - 1, a - 1, -1):
                    g = read[:, i - a] + h @ w[d:]
                    s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -20, 20)))
                    m = mask[:, i, None]
                    c = (s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * np.tanh(g[:, 3 * HIDDEN :])) * m
                    h = s[:, 2 * HIDDEN :] * np.tanh(c) * m
                    score[:, i] += h @ own
        return 1 / (1 + np.exp(-np.clip(score, -20, 20)))


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((len(pages), t, pages[0].shape[1]), np.float32), np.zeros((len(pages), t), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


# -- training pages --------------------------------------------------------------------

#: Names that layouts give to parts of a page.
SIDE_NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "breadcrumb", "topnav", "tabs", "toc", "pagination"],
    "header": ["header", "masthead", "top", "logo", "tagline", "site-header", "branding"],
    "footer": ["footer", "copyright", "bottom", "legal", "site-footer", "colophon"],
    "sidebar": ["sidebar", "aside", "widget", "related", "popular", "trending", "share", "social", "tags", "author-box"],
    "notice": ["cookie", "consent", "notice", "banner", "alert", "gdpr", "popup", "modal", "toast", "paywall"],
    "advert": ["ad", "ads", "advert", "sponsored", "promo", "adsbox", "advertisement", "sponsor", "banner-ad"],
    "form": ["form", "newsletter", "subscribe", "signup", "login", "search", "contact"],
    "comment": ["comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "reactions"],
}
MAIN_NAMES = ["content", "post", "entry", "article", "story", "body", "text", "main", "article-body", "post-content", "entry-content", "page", "read"]
SIDE_TAGS = {"menu": ["nav", "div", "ul", "menu"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "aside", "section"], "advert": ["div", "aside", "ins"], "form": ["form", "div"], "comment": ["section", "div", "ol"]}


class Generator:
    """Pages in random layouts with a label for every block."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int, stop: bool = True) -> str:
        out = ["".join(self.r.choice("aeiouéärtnslmdcpghbfvkñüw") for _ in range(self.r.randint(1, 11))) for _ in range(self.r.randint(low, high))]
        for i in range(0, len(out), self.r.randint(4, 12)):
            out[i] = out[i].capitalize() + self.r.choice(["", "", ",", ".", "***", "!!"])
        return " ".join(out) + (self.r.choice([".", ".", ".", "?", "***", ""]) if stop else "")

    def name(self, names: list[str]) -> str:
        r = self.r.random()
        if r < 0.25:
            return ""
        own = self.r.choice(names) + self.r.choice(["", "", "", f"-{self.r.randint(1, 9)}", " x", "-wrap", " box"])
        return f' {self.r.choice(["class", "class", "id"])}="{own}"'

    def side(self, kind: str) -> list[str]:
        tag = self.r.choice(SIDE_TAGS[kind])
        named = tag in ("nav", "footer", "aside", "header", "form", "menu")
        attr = self.name(SIDE_NAMES[kind]) if named else f' class="{self.r.choice(SIDE_NAMES[kind])}"'
        out = [f"<{tag}{attr}>"]
        if kind in ("menu", "sidebar") or self.r.random() < 0.15:
            out += ["<ul>"] + [f'<li><a href="#">{self.words(1, 4, False)}</a></li>' for _ in range(self.r.randint(2, 9))] + ["</ul>"]
        if kind == "form":
            out += [f"<label>{self.words(1, 4, False)}</label><input>" for _ in range(self.r.randint(1, 3))] + [f"<p>{self.words(3, 20)}</p>", f"<button>{self.words(1, 2, False)}</button>"]
        elif kind == "comment":
            for _ in range(self.r.randint(1, 6)):
                said = [f"<p>{self.words(1, self.r.choice([5, 20, 60]))}</p>" for _ in range(self.r.randint(1, 2))]
                if self.r.random() < 0.6:
                    said = [f'<div{self.name(["comment", "reply"])}>', f"<b>{self.words(1, 2, False)}</b>", *said, "</div>"]
                out += said
        elif kind != "menu":
            for _ in range(self.r.randint(1, 3)):
                inner = self.r.choice(["p", "p", "div", "span", ""])
                said = self.words(3, 40 if kind != "header" else 8)
                said = f'<a href="#">{said}</a>' if self.r.random() < 0.25 else said
                out.append(f"<{inner}>{said}</{inner}>" if inner else said)
        return [*out, f"</{tag}>"]

    def main(self) -> list[str]:
        out = [f"<h1>{self.words(2, 12)}</h1>"] if self.r.random() < 0.9 else []
        for _ in range(self.r.randint(1, 18)):
            r = self.r.random()
            if r < 0.72:
                out.append(self.r.choice(["<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<div>{}</div>", "<p>{} <a href='#'>x</a></p>"]).format(self.words(1, self.r.choice([6, 40, 200]))))
            elif r < 0.84:
                n = self.r.randint(2, 4)
                out.append(f"<h{n}>{self.words(1, 8, False)}</h{n}>")
            elif r < 0.92:
                out += ["<ul>"] + [f"<li>{self.words(1, 25)}</li>" for _ in range(self.r.randint(1, 6))] + ["</ul>"]
            else:
                tag = self.r.choice(["blockquote", "pre", "td", "figcaption", "dd"])
                out.append(f"<{tag}>{self.words(2, 40)}</{tag}>")
        return out

    def page(self) -> tuple[list[tuple], np.ndarray]:
        """(blocks, labels); a marker in the path of main text gives the labels and is taken out."""
        tag = self.r.choice(["article", "article", "main", "div", "section", "div"])
        attr = self.name(MAIN_NAMES) if tag in ("article", "main") else f' class="{self.r.choice(MAIN_NAMES)}"'
        body = self.main()
        if self.r.random() < 0.3:  # something foreign inside the article
            at = self.r.randint(0, len(body))
            kind = self.r.choice(["advert", "notice", "form", "sidebar", "comment"])
            body = [*body[:at], "<kzside>", *self.side(kind), "</kzside>", *body[at:]]
        core = ["<kzmain>", f"<{tag}{attr}>", *body, f"</{tag}>", "</kzmain>"]
        if self.r.random() < 0.4:
            core = [f'<{self.r.choice(["main", "div"])}{self.name(MAIN_NAMES + ["wrapper", "container"])}>', *core]
        before = [self.side(k) for k in self.r.sample(["menu", "header", "notice", "advert", "form", "sidebar", "menu"], self.r.randint(0, 4))]
        after = [self.side(k) for k in self.r.sample(["comment", "footer", "sidebar", "advert", "form", "notice", "menu", "footer"], self.r.randint(0, 5))]
        html = "".join(x for part in [*before, core, *after] for x in part)
        blocks, labels = [], []
        for text, path, leaf, linked in Blocks.of(f"<html><body>{html}</body></html>"):
            labels.append("kzmain" in path and "kzside" not in path)
            blocks.append((text, tuple(t for t in path if not t.startswith("kz")), leaf.replace("kzmain", "body").replace("kzside", "div"), linked))
        return blocks, np.array(labels, np.float32)


_trained: list[Labeller] = []


def train(pages: int = 1500, epochs: int = 10, seed: int = 17) -> Labeller:
    """A labeller trained on generated pages; the same seed gives the same weights."""
    g = Generator(seed)
    made = [p for p in (g.page() for _ in range(pages)) if p[0]]
    x, net, r = inputs([b for b, _ in made]), Labeller(seed), random.Random(seed)
    order = sorted(range(len(made)), key=lambda i: len(x[i]))
    parts = [order[a : a + 32] for a in range(0, len(order), 32)]
    m, v, t = {k: 0.0 for k in net.p}, {k: 0.0 for k in net.p}, 0
    for _ in range(epochs):
        r.shuffle(parts)
        for part in parts:
            px, mask = _padded([x[i] for i in part])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(part):
                y[j, : len(x[i])] = made[i][1]
            t += 1
            for k, grad in net.gradient(px, mask, y).items():
                grad = np.clip(grad, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.99 * v[k] + 0.01 * grad * grad
                net.p[k] = (net.p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def labeller() -> Labeller:
    if not _trained:
        _trained.append(train())
    return _trained[0]


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of ``pages(page_id, url, html)``."""
    session(spark)
    net = labeller()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            held: list[list[tuple]] = []
            for k in range(b.num_rows):
                h = b.column("html")[k].as_py()
                held.append(Blocks.of(h) if h else [])
                if sum(map(len, held)) >= 4 * SLOTS or k + 1 == b.num_rows:
                    texts += ["\n\n".join(x[0] for x, q in zip(p, label, strict=True) if q >= 0.5) for p, label in zip(held, net.label(inputs(held)), strict=True)]
                    held = []
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return columns(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string")
