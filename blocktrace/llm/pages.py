"""Main text of web pages from a recurrent labeller of their blocks.

A page is cut into leaf blocks at block-level tags. Each block becomes a vector
of its hashed tag path (tags, classes and ids of its ancestors), its hashed
words and a few figures. A bidirectional long short-term memory reads the
blocks of a page in order, so every decision uses the whole document, and labels
each as main text or not.

There are no labelled pages. Training pages come from a bounded sample: the
article element of a real page is its main text, and pages are varied by
wrapping articles in other containers and by adding menus, sidebars, notices,
forms, adverts and reader comments with the usual class names, whose labels are
known.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktrace.llm.common import hashed_words, slices, texts
from blocktrace.llm.recurrent import train

#: Pages that the network is fitted on, chosen by a hash of their id.
TRAINING_PAGES = 240
PATHS, WORDS, FIGURES = 512, 128, 6
HIDDEN, STEPS, BATCH = 10, 120, 24
INPUTS = PATHS + WORDS + FIGURES

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|"
                   r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Za-z]+")
#: Elements without visible text, and elements that don't end a block.
SILENT = frozenset("script style noscript template svg math title iframe object select textarea button".split())
#: Silent elements whose content is not markup, and the tag that ends them or shows that they were never closed.
RAW = {tag: re.compile(rf"<(/{'' if tag in ('script', 'style') else '?'}){tag}(?=[\s/>])[^>]*>?", re.I)
       for tag in "script style title textarea iframe".split()}
#: Silent elements that may hold each other.
NESTED = frozenset("template svg math object".split())
#: A silent element without an end tag ends at one of these.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th "
                   "thead tr ul".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
Block = tuple[tuple[str, ...], str, int]


def _tokens(page: str) -> list[list]:
    """Tags and comments: start, end, name, whether it closes, attributes, index of the tag that ends a silent element.

    The end of an element whose content is not markup is behind its end tag. The index is -1 for other tags and None
    for a silent element that is never closed.
    """
    found: list[list] = []
    opened: dict[str, list[int]] = {}
    lost: set[str] = set()
    at = 0
    while token := TOKEN.search(page, at):
        at = token.end()
        tag, closing, rest = (token[2] or "").lower(), bool(token[1]), token[3] or ""
        last: int | None = -1
        if tag in SILENT and closing:
            if opened.get(tag):
                found[opened[tag].pop()][5] = len(found)
        elif tag in SILENT and rest.rstrip()[-1:] != "/":
            last = None
            if tag in RAW:
                stop = None if tag in lost else RAW[tag].search(page, at)
                if stop is None:
                    lost.add(tag)
                elif stop[1]:
                    at, last = stop.end(), len(found)
            elif tag in NESTED:
                opened.setdefault(tag, []).append(len(found))
            else:
                opened[tag] = [len(found)]
        found.append([token.start(), at, tag, closing, rest, last])
    return found


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page: tag path with class words, text, and characters inside links."""
    found: list[Block] = []
    path: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = at = 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append((tuple(word for tag, names in path for word in (tag, *names)), text, linked))
        parts.clear()
        linked = 0

    links = 0
    tokens = _tokens(page)
    final = max((k for k, token in enumerate(tokens) if token[2] in BLOCKS), default=-1)
    i = 0
    while i < len(tokens):
        start, stop, tag, closing, rest, last = tokens[i]
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            linked += len(piece) * (links > 0)
        at = stop
        i += 1
        if not tag:
            continue
        if tag in SILENT and not closing:
            end_block()
            if last is None:
                # Never closed: up to the next block, or the tag alone.
                if i <= final:
                    i = next(k for k in range(i, len(tokens)) if tokens[k][2] in BLOCKS)
                    at = tokens[i][0]
                elif tag in ("script", "style"):
                    i, at = len(tokens), len(page)
            elif last >= i:
                i, at = last + 1, tokens[last][1]
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        end_block()
        links = 0
        if closing:
            place = next((i for i in range(len(path) - 1, -1, -1) if path[i][0] == tag), None)
            if place is not None:
                del path[place:]
        elif tag not in VOID and tag != "head":
            # The end tag of a head may be left out; what it holds is silent by itself.
            if tag in ("p", "li") and path and path[-1][0] == tag:
                path.pop()
            names = [w.lower() for m in NAMES.finditer(rest) for w in PART.findall(m[1] or m[2] or m[3] or "")]
            path.append((tag, tuple("." + name for name in names)))
    if at < len(page):
        parts.append(page[at:])
    end_block()
    return found


@lru_cache(maxsize=100_000)
def _bucket(word: str) -> int:
    return crc32(word.encode()) % PATHS


def vectors(page: list[Block]) -> np.ndarray:
    """One row of inputs per block."""
    out = np.zeros((len(page), INPUTS), dtype=np.float32)
    for i, (path, text, linked) in enumerate(page):
        for word in path:
            out[i, _bucket(word)] = 1
        if path:
            out[i, _bucket("leaf " + next((p for p in reversed(path) if p[0] != "."), ""))] = 1
        hashes = hashed_words(text.lower().encode())
        count = len(hashes)
        out[i, PATHS:PATHS + WORDS] = np.bincount((hashes % WORDS).astype(np.int64), minlength=WORDS) / max(count, 1)
        size = len(text)
        out[i, PATHS + WORDS:] = (min(np.log1p(size) / 8, 1.5), min(np.log1p(count) / 6, 1.5), min(linked / size, 1.0),
                                  float(text[-1] in ".!?"), text.count(",") / max(count, 1), float(count < 5))
    return out


class BlockNetwork:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed).standard_normal
        h = HIDDEN
        self.parts = [a.astype(np.float32) for a in (
            0.05 * draw((2, INPUTS, 4 * h)), draw((2, h, 4 * h)) / np.sqrt(h), np.zeros((2, 1, 4 * h)),
            draw((2 * h, 1)) / np.sqrt(2 * h), np.zeros((1, 1)))]

    def run(self, rows: np.ndarray, sizes: np.ndarray, remember: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probability of main text for each block, and the states; pages lie one after the other in `rows`."""
        w, u, b, v, c = self.parts
        h = HIDDEN
        order = np.argsort(-sizes, kind="stable")
        first = (np.cumsum(sizes) - sizes)[order]
        lengths = sizes[order]
        states = np.zeros((len(rows), 2 * h), dtype=np.float32)
        for way in (0, 1):
            inputs = rows @ w[way] + b[way]
            state = np.zeros((len(sizes), h), dtype=np.float32)
            cell = np.zeros_like(state)
            for t in range(int(lengths[0]) if len(lengths) else 0):
                n = int(np.searchsorted(-lengths, -t, side="left"))
                at = first[:n] + (t if way == 0 else lengths[:n] - 1 - t)
                g = inputs[at] + state[:n] @ u[way]
                gates = 0.5 * np.tanh(0.5 * g[:, :3 * h]) + 0.5
                new = np.tanh(g[:, 3 * h:])
                keep, take, show = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
                before, last = cell[:n], state[:n]
                after = keep * before + take * new
                shown = np.tanh(after)
                if remember is not None:
                    remember.append((way, at, n, last, before, keep, take, show, new, shown))
                cell = np.concatenate([after, cell[n:]])
                state = np.concatenate([show * shown, state[n:]])
                states[at, way * h:(way + 1) * h] = state[:n]
        return 0.5 * np.tanh(0.5 * (states @ v + c)[:, 0]) + 0.5, states

    def gradients(self, rows: np.ndarray, sizes: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean logistic loss, by backpropagation through time."""
        remember: list = []
        p, states = self.run(rows, sizes, remember)
        w, u, b, v, c = self.parts
        h = HIDDEN
        d = ((p - target) / len(rows)).astype(np.float32)[:, None]
        grads = [np.zeros_like(a) for a in self.parts]
        grads[3], grads[4] = states.T @ d, d.sum(keepdims=True)
        back = d @ v.T
        inputs = [np.zeros((len(rows), 4 * h), dtype=np.float32) for _ in (0, 1)]
        carry = [[np.zeros((len(sizes), h), dtype=np.float32) for _ in (0, 1)] for _ in (0, 1)]
        for way, at, n, last, before, keep, take, show, new, shown in reversed(remember):
            dh = back[at, way * h:(way + 1) * h] + carry[way][0][:n]
            dc = carry[way][1][:n] + dh * show * (1 - shown * shown)
            g = np.hstack([dc * before * keep * (1 - keep), dc * new * take * (1 - take),
                           dh * shown * show * (1 - show), dc * take * (1 - new * new)])
            inputs[way][at] = g
            grads[1][way] += last.T @ g
            carry[way][0][:n] = g @ u[way].T
            carry[way][1][:n] = dc * keep
        for way in (0, 1):
            grads[0][way] = rows.T @ inputs[way]
            grads[2][way] = inputs[way].sum(axis=0)
        return grads


# Containers that training pages vary: what holds an article, and what doesn't.
GOOD = (("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post", ".body"), ("section", ".story"),
        ("div", ".entry"), ("div", ".article"), ("main", "div", ".text"), ("div",))
BAD = (("nav", "ul", "li"), ("header", "div"), ("footer", "p"), ("footer", "div"), ("aside", "div"), ("aside", "p"),
       ("div", ".sidebar", "p"), ("div", ".menu", "ul", "li"), ("div", ".nav", "li"), ("div", ".ad"), ("div", ".ads", "p"),
       ("div", ".advert"), ("div", ".sponsored", "p"), ("div", ".banner"), ("div", ".cookie", ".notice", "p"),
       ("div", ".notice"), ("div", ".consent", "p"), ("div", ".popup", "p"), ("form", "p"), ("form", "div"), ("form", "fieldset"),
       ("div", ".newsletter", "form", "p"), ("div", ".comments", "div", ".comment", "p"), ("section", ".comments", "article", "p"),
       ("section", ".comments", "p"), ("ol", ".commentlist", "li", ".comment", "p"), ("div", ".comment", "p"), ("div", ".disqus", "p"),
       ("div", ".related", "ul", "li"), ("div", ".share"), ("div", ".social", "li"), ("div", ".breadcrumb"),
       ("div", ".footer"), ("div", ".header"), ("div", ".promo", "p"), ("div", ".warning", "p"), ("div", ".subscribe", "p"),
       ("div", ".login"), ("div", ".search"), ("div", ".pagination"), ("div", ".copyright"), ("div", ".legal", "p"))
ROOT = ("html", "body")


def varied(page: list[Block], pool: list[str], draw: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page and its labels, with its article in another container and other parts around and inside."""
    plain = draw.random() < 0.3
    container = ("article",) if plain else GOOD[draw.integers(len(GOOD))]
    out: list[Block] = []
    labels: list[int] = []

    def add(path: tuple[str, ...], text: str, linked: int, label: int) -> None:
        out.append((path, text, linked))
        labels.append(label)

    def extra(base: tuple[str, ...], most: int) -> None:
        for _ in range(draw.integers(0, most + 1)):
            kind = BAD[draw.integers(len(BAD))]
            for _ in range(draw.integers(1, 5)):
                words = pool[draw.integers(len(pool))].split()
                short = kind[-1] == "li" or draw.random() < 0.4
                text = " ".join(words[:draw.integers(1, 6)] if short else words)
                add(base + kind, text, len(text) * (short and draw.random() < 0.7), 0)

    seen = False
    wrap = ("div", ".wrapper") if draw.random() < 0.3 else ()
    for path, text, linked in page:
        if "article" in path:
            if not seen and not plain:
                extra(ROOT + wrap, 2)
            seen = True
            add(ROOT + wrap + container + path[path.index("article") + 1:], text, linked, 1)
            if not plain and draw.random() < 0.05:
                extra(ROOT + wrap + container, 1)
        elif plain or draw.random() < 0.8:
            add(path, text, linked, 0)
    if not plain:
        extra(ROOT + wrap + (container if draw.random() < 0.4 else ()), 2)
        extra(ROOT + wrap, 2)
    return out, labels


def fit(pages: list[str], seed: int = 5) -> BlockNetwork:
    """Train on varied sample pages that have an article element."""
    network, draw = BlockNetwork(), np.random.default_rng(seed)
    cut = [found for found in map(blocks, pages) if any("article" in path for path, _, _ in found)]
    pool = [text for found in cut for _, text, _ in found]
    if not cut:
        return network

    def gradients(_: int) -> list[np.ndarray]:
        made = [varied(cut[draw.integers(len(cut))], pool, draw) for _ in range(BATCH)]
        rows = np.concatenate([vectors(page) for page, _ in made])
        return network.gradients(rows, np.array([len(page) for page, _ in made]),
                                 np.concatenate([np.array(labels, dtype=np.float32) for _, labels in made]))

    train(network.parts, gradients, STEPS, 0.02)
    return network


def extract_text(pages: DataFrame, *, training: int = TRAINING_PAGES) -> DataFrame:
    """Main text of every page.

    Returns one row per row of `pages`: `page_id`, `url`, `text` (main blocks
    in page order, joined by two line feeds; empty if there are none),
    `n_chars`, `n_blocks` and `n_main`. Null html is empty. Character
    references are decoded and white space inside a block is one space. Nested
    or unclosed tags and unfinished comments are read as far as they go; an
    element without visible text that is never closed ends at the next block.
    Without sample pages with an article element nothing is learned and
    the labels are those of an untrained network. An empty table gives no rows.
    """
    sample = (pages.filter("html IS NOT NULL").select("html", F.xxhash64(F.col("page_id").cast("string")).alias("_order"))
              .orderBy("_order", "html").limit(training).toArrow().column("html").to_pylist())
    network = fit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            cut = [blocks(page) for page in texts(part, "html")]
            sizes = np.array([len(found) for found in cut], dtype=np.int64)
            rows = np.concatenate([vectors(found) for found in cut])
            main = np.split(network.run(rows, sizes)[0] >= 0.5, np.cumsum(sizes)[:-1])
            kept = [[text for (_, text, _), good in zip(found, labels) if good] for found, labels in zip(cut, main)]
            joined = ["\n\n".join(found) for found in kept]
            yield pa.record_batch(
                [part.column("page_id"), part.column("url"), pa.array(joined), pa.array([len(t) for t in joined], pa.int64()),
                 pa.array(sizes), pa.array([len(found) for found in kept], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", pages["url"].cast("string"), "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_main long")
