"""Main text of web pages: a bidirectional LSTM labels the leaf blocks of a page in page order."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ship, table

#: Markup: comments, closed elements whose content is no text, tags, declarations. In a tag a quote opens a value only
#: after an equals sign, and only if it is closed; so a stray quote, or an element without end, takes no text with it.
MARKUP = re.compile(
    r"<!--(?:-?>|.*?--!?>)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|title|canvas)\b(?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+(?<!/)>.*?</\1\s*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
#: Elements whose text, up to the next tag, is code or input even where the end tag is missing.
MUTE = frozenset("script style textarea title iframe".split())
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
#: Elements that stand in a line of text and do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow msub msup mfrac msqrt mtext object q s samp small span strike strong sub sup time tt u var wbr br img input picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Block elements that may stand in a head; any other ends it, as its end tag is optional.
IN_HEAD = frozenset("script style title noscript template".split())

PATH, TAIL, WORDS, SHAPE = 96, 48, 24, 10
INPUT, HIDDEN = PATH + TAIL + WORDS + SHAPE, 24
PAGES, EPOCHS, BATCH, RATE, SEED = 900, 9, 30, 0.008, 11
THRESHOLD = 0.5


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int
    emphasised: int


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page: runs of text between the borders of block elements, with the elements around them.

    Character references are decoded, white space becomes one space. Comments, scripts, styles and the like give no
    text, a noscript element neither. Tags that are not closed or not opened are borne: an element of these kinds
    without an end tag takes with it at most the text up to the next tag, a comment without end its own tag only.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    run: list[str] = []
    inline: dict[str, int] = {}
    linked = emphasised = 0
    mute = False

    def end() -> None:
        nonlocal linked, emphasised
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        if text:
            out.append(Block(text, tuple(x[1] for x in stack), linked, emphasised))
        run.clear()
        linked = emphasised = 0

    def add(text: str) -> None:
        nonlocal linked, emphasised
        run.append(text)
        if inline.get("a"):
            linked += len(text)
        if inline.get("b") or inline.get("strong") or inline.get("em"):
            emphasised += len(text)

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at and not mute:
            add(page[at:m.start()])
        at, mute = m.end(), False
        name = (m[3] or "").lower()
        if not name:
            continue
        closing, rest = m[2], m[4] or ""
        if name in MUTE:
            mute = not closing
            continue
        if name in INLINE:
            if name in ("br", "img"):
                add(" ")
            elif closing:
                inline[name] = max(0, inline.get(name, 0) - 1)
            else:
                inline[name] = inline.get(name, 0) + 1
            continue
        end()
        inline.clear()
        if closing:
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID and not rest.rstrip().endswith("/"):
            heads = [i for i, x in enumerate(stack) if x[0] == "head"]
            if heads and name not in IN_HEAD:
                del stack[heads[0]:]
            ends = ENDS.get(name, {"p"})
            while stack and stack[-1][0] in ends:
                stack.pop()
            named = " ".join(x for g in NAMED.findall(rest) for x in g if x).lower() if rest else ""
            stack.append((name, f"{name} {named}"))
    if at < len(page) and not mute:
        add(page[at:])
    end()
    return [b for b in out if not any(p.startswith("head ") for p in b.path)]


@lru_cache(maxsize=50_000)
def place(term: str, size: int) -> int:
    return zlib.crc32(term.encode()) % size


@lru_cache(maxsize=20_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Names, classes and ids along the path, hashed; apart from that those of the last two elements."""
    x = np.zeros(PATH + TAIL, np.float32)
    for depth, element in enumerate(path):
        name, *named = PARTS.findall(element)
        for t in (name, *("." + n for n in named)):
            x[place(t, PATH)] = 1
            if depth >= len(path) - 2:
                x[PATH + place(f"{len(path) - depth}{t}", TAIL)] = 1
    return x


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block: its path, its hashed words, and its shape."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    for i, b in enumerate(blocks):
        words = b.text.split(" ")
        x[i, :PATH + TAIL] = path_vector(b.path)
        counts = np.bincount([zlib.crc32(w.lower().encode()) % WORDS for w in words], minlength=WORDS)
        x[i, PATH + TAIL:PATH + TAIL + WORDS] = counts / len(words)
        n = len(b.text)
        x[i, -SHAPE:] = (np.log1p(n) / 8, np.log1p(len(words)) / 6, min(1, b.linked / n), min(1, b.emphasised / n),
                         min(1, (b.text.count(".") + b.text.count(",")) / len(words)), b.text[-1] in ".!?…", i / len(blocks),
                         i == 0, len(b.path) / 16, n / len(words) / 12)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights of both directions (w: input, u: state, b) and of the output."""

    params: dict[str, np.ndarray]

    @staticmethod
    def start(rng: np.random.Generator) -> Labeller:
        p = {}
        for d in "fb":
            p[f"w{d}"] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN)).astype(np.float32)
            p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            p[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        p["o"], p["c"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)
        return Labeller(p)

    def direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction over (time, page, input); padding leaves a state as it is."""
        p, steps = self.params, range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        drive = x @ p[f"w{d}"] + p[f"b{d}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in steps:
            z = drive[t] + h @ p[f"u{d}"]
            gates = sigmoid(z[:, :3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            on = mask[t][:, None]
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                kept.append((t, i, f, o, g, c, th, h, on))
            c, h = np.where(on, new, c), np.where(on, o * th, h)
            out[t] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.direction("f", x, mask, False)[0], self.direction("b", x, mask, False)[0]], axis=2)
        return both @ self.params["o"] + self.params["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, sides = self.params, {d: self.direction(d, x, mask, True) for d in "fb"}
        both = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
        e = (sigmoid(both @ p["o"] + p["c"]) - y) * mask / mask.sum()
        g = {"o": np.einsum("tb,tbh->h", e, both), "c": np.array([e.sum()])}
        for k, d in enumerate("fb"):
            dout = e[:, :, None] * p["o"][k * HIDDEN:(k + 1) * HIDDEN]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            du = np.zeros_like(p[f"u{d}"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, i, f, o, gg, c, th, h, on in reversed(sides[d][1]):
                dh = dh + dout[t]
                dn = np.where(on, dc + dh * o * (1 - th * th), 0)
                part = np.concatenate([dn * gg * i * (1 - i), dn * c * f * (1 - f), np.where(on, dh * th * o * (1 - o), 0), dn * i * (1 - gg * gg)], axis=1)
                dz[t] = part
                du += h.T @ part
                dc = np.where(on, dn * f, dc)
                dh = np.where(on, 0, dh) + part @ p[f"u{d}"].T
            g[f"u{d}"] = du
            g[f"w{d}"] = np.tensordot(x, dz, ([0, 1], [0, 1]))
            g[f"b{d}"] = dz.sum(axis=(0, 1))
        return g

    def label(self, pages: list[np.ndarray], together: int = 64) -> list[np.ndarray]:
        """Chance of each block to be main text; pages of like length go together."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        for a in range(0, len(order), together):
            rows = order[a:a + together]
            x, mask = padded([pages[i] for i in rows])
            s = sigmoid(self.logits(x, mask))
            for j, i in enumerate(rows):
                out[i] = s[:len(pages[i]), j]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), INPUT), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for j, p in enumerate(pages):
        x[:len(p), j], mask[:len(p), j] = p, True
    return x, mask


class Maker:
    """Makes pages of many layouts, whose blocks say by a mark whether they are main text."""

    MAIN = ("content", "main", "post", "entry", "story", "article-body", "text", "page-content", "body-copy", "post-content", "entry-content", "prose")
    SIDE = ("sidebar", "side", "widget", "widget-area", "right-column", "rail", "aside", "related", "popular", "tags", "archive-list", "recommended")
    ADS = ("ad", "ads", "advert", "ad-slot", "sponsor", "sponsored", "promo", "banner-ad", "advertisement", "adsbox")
    NOTICE = ("cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe-box", "paywall", "cookie-notice")
    HEAD = ("header", "site-header", "masthead", "top", "topbar", "branding", "logo", "banner")
    FOOT = ("footer", "site-footer", "bottom", "colophon", "legal", "copyright", "credits")
    MENU = ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "main-menu", "pagination", "share", "social", "tabs", "toc")
    TALK = ("comments", "comment-list", "comment", "responses", "discussion", "replies", "reader-comments", "disqus", "commentlist", "feedback")
    META = ("byline", "meta", "author-box", "post-meta", "date", "timestamp")

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def one(self, items):
        return items[int(self.r.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        return "".join(self.one("bcdfghklmnprstvwz") + self.one("aeiouéäö") for _ in range(int(self.r.integers(1, 5))))

    def words(self, a: int, b: int) -> str:
        w = [self.word() for _ in range(int(self.r.integers(a, b)))]
        return " ".join(w).capitalize()

    def prose(self, a: int = 1, b: int = 6) -> str:
        return " ".join(self.words(1, 18) + self.one(".,.?!.") for _ in range(int(self.r.integers(a, b))))

    def named(self, names) -> str:
        how = self.r.random()
        n = self.one(names)
        return f' class="{n}"' if how < 0.55 else f' id="{n}"' if how < 0.75 else f' class="{self.word()} {n}-{self.word()}"' if how < 0.9 else f' class="{n}{int(self.r.integers(9))}"'

    def boxed(self, tag: str, names, inner: str) -> str:
        """A box with its own element, or a div with a telling name."""
        if tag and self.chance(0.6):
            return f"<{tag}{self.named(names) if self.chance(0.4) else ''}>{inner}</{tag}>"
        t = self.one(("div", "div", "section", "ul" if "<li" in inner else "div"))
        return f"<{t}{self.named(names)}>{inner}</{t}>"

    def links(self, a: int = 2, b: int = 9) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 5)}</a>' for _ in range(int(self.r.integers(a, b)))]
        how = self.r.random()
        if how < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if how < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def form(self) -> str:
        return f'<form action="/x"><label>{self.words(1, 4)}</label><input name="q"><p>{self.prose(1, 3)}</p><button>{self.words(1, 3)}</button></form>'

    def extra(self) -> str:
        """Something that is no main text."""
        kind = int(self.r.integers(9))
        if kind == 0:
            return self.boxed("nav", self.MENU, self.links())
        if kind == 1:
            return self.boxed("", self.ADS, self.one((self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f'<a href="#">{self.words(2, 8)}</a>')))
        if kind == 2:
            return self.boxed("aside", self.SIDE, f"<h3>{self.words(1, 4)}</h3>" + self.one((self.links(), f"<p>{self.prose(1, 4)}</p>")))
        if kind == 3:
            return self.boxed("", self.NOTICE, f"<p>{self.prose(1, 4)}</p><button>{self.words(1, 3)}</button>" if self.chance(0.6) else self.prose(1, 3))
        if kind == 4:
            return self.form() if self.chance(0.5) else self.boxed("", self.NOTICE + self.SIDE, self.form())
        if kind == 5:
            said = "".join(self.one((f"<li{self.named(self.TALK)}><b>{self.words(1, 3)}</b><p>{self.prose()}</p></li>", f"<div{self.named(self.TALK)}><p>{self.prose()}</p></div>", f"<p>{self.prose()}</p>")) for _ in range(int(self.r.integers(1, 6))))
            return self.boxed("", self.TALK, (f"<h3>{self.words(1, 4)}</h3>" if self.chance(0.7) else "") + (f"<ol>{said}</ol>" if "<li" in said else said))
        if kind == 6:
            return self.boxed("", self.MENU + self.META, self.links(1, 4) if self.chance(0.5) else self.words(1, 6))
        if kind == 7:
            return self.boxed("aside", self.SIDE, "".join(f"<p>{self.prose(1, 3)}</p>" for _ in range(int(self.r.integers(1, 4)))))
        return "<!-- ad -->" + self.boxed("div", self.ADS, self.prose(1, 3))

    def main(self) -> str:
        """Main text; every block begins with the mark."""
        out = [f"<h{int(self.r.integers(1, 3))}>\x01{self.words(2, 12)}</h1>" if self.chance(0.5) else f"<h1>\x01{self.words(2, 12)}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.r.integers(1, 14))):
            how = self.r.random()
            text = self.prose() if self.chance(0.85) else self.words(1, 6) + self.one((".", "", " |", " $$$"))
            if how < 0.62:
                out.append(f"<p>\x01{text}</p>")
            elif how < 0.78:
                out.append(f"<p><b>\x01{text}<br>")
            elif how < 0.83:
                out.append(f"<h{int(self.r.integers(2, 5))}>\x01{self.words(1, 8)}</h{2}>")
            elif how < 0.87:
                out.append("<ul>" + "".join(f"<li>\x01{self.prose(1, 2)}</li>" for _ in range(int(self.r.integers(1, 5)))) + "</ul>")
            elif how < 0.9:
                out.append(f"<blockquote><p>\x01{text}</p></blockquote>")
            elif how < 0.92:
                out.append(f"<pre>\x01{text}</pre>")
            elif how < 0.95:
                out.append(f"<div>\x01{text}</div>")
            elif how < 0.97:
                out.append("<table><tr>" + "".join(f"<td>\x01{self.words(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(f"<p>\x01{self.words(2, 9)} <a href='/{self.word()}'>{self.words(1, 4)}</a> <em>{self.words(1, 4)}</em> {self.prose(1, 3)}</p>")
            if self.chance(0.06):
                out.append(self.extra())
        return "".join(out)

    def page(self) -> str:
        body = []
        if self.chance(0.5):
            body.append(self.boxed("header", self.HEAD, self.one((f"<a href='/'>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 4)}</h1><p>{self.words(2, 8)}</p>", f"<div>{self.words(1, 4)}</div>"))))
        if self.chance(0.8):
            body.append(self.boxed("nav", self.MENU, self.links(2, 10)))
        body += [self.extra() for _ in range(int(self.r.integers(0, 3)))]
        main = self.main()
        how = self.r.random()
        if how < 0.45:
            main = f"<article{self.named(self.MAIN) if self.chance(0.3) else ''}>{main}</article>"
        elif how < 0.6:
            main = f"<main>{main}</main>"
        elif how < 0.9:
            main = f"<div{self.named(self.MAIN)}>{main}</div>"
        elif how < 0.95:
            main = f"<table><tr><td>{main}</td></tr></table>"
        if self.chance(0.2):
            main = f"<main>{main}{self.extra() if self.chance(0.5) else ''}</main>"
        if self.chance(0.3):
            main = f"<div{self.named(('wrapper', 'container', 'page', 'row', 'col'))}>{main}{self.extra() if self.chance(0.4) else ''}</div>"
        body.append(main)
        body += [self.extra() for _ in range(int(self.r.integers(0, 4)))]
        if self.chance(0.85):
            body.append(self.boxed("footer", self.FOOT, self.one((f"&copy; {self.word()}.example &middot; {self.prose(1, 3)}", f"<p>{self.prose(1, 3)}</p>", self.links(2, 6)))))
        whole = f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{''.join(body)}"
        return whole + "</body></html>" if self.chance(0.85) else whole


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, fitted to made pages; the same weights wherever it is called."""
    maker, rng = Maker(seed), np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        found = blocks_of(maker.page())
        y = np.array(["\x01" in b.text for b in found], np.float32)
        for b in found:
            b.text = b.text.replace("\x01", "").strip() or "-"
        if found:
            data.append((features(found), y))
    model = Labeller.start(rng)
    m, v = ({k: np.zeros_like(p) for k, p in model.params.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][1]))
        for lot in rng.permutation(-(-len(order) // BATCH)):
            rows = order[lot * BATCH:(lot + 1) * BATCH]
            x, mask = padded([data[i][0] for i in rows])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(rows):
                y[:len(data[i][1]), j] = data[i][1]
            step += 1
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                rate = RATE * (1 - 0.9 * epoch / epochs)
                model.params[k] = (model.params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def extract_partition(model: Labeller, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                pages = [blocks_of(x.as_py()) for x in part.column(2)]
                chances = model.label([features(p) if p else np.empty((0, INPUT), np.float32) for p in pages])
                texts = ["\n".join(b.text for b, s in zip(p, c, strict=True) if s >= threshold) for p, c in zip(pages, chances, strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                      names=["page_id", "url", "text", "n_chars"])
    return run


def extract_text(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars of every row: the blocks of the whole page that are main text, a line each.

    A null or empty page, and one without main text, gives an empty text. Broken markup is read as far as it goes.
    Repeated rows are read each; an empty table gives no rows; other columns are ignored.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract_partition(trained(), threshold), "page_id long, url string, text string, n_chars long")


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_text(table(spark, sf_dir, "pages"))
