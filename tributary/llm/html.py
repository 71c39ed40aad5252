"""HTML extraction by a recurrent block labeller.

A page is split into leaf blocks: the texts between block-level tags, each with
its path of open tags. A bidirectional LSTM, in numpy, reads the whole sequence of
hashed path and word vectors, so that each block is judged by all of its page, and
says which blocks are content.

It is trained here, on a bounded sample of pages whose own markup labels blocks
(``article`` and ``main`` against ``nav``, ``footer``, ``aside``, advertising
classes and the like). In half of the training pages those tags and classes are
hidden, so that words, lengths and neighbours must tell.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import load, map_texts
from tributary.llm.common import quoted as _quoted

#: At most so many pages train the labeller, so many times over; fewer pages, more often.
TRAINING_PAGES, EPOCHS, LEAST_STEPS, SEED = 400, 4, 120, 7
PATH, WORDS, MEASURES, HIDDEN = 32, 48, 6, 24
INPUT = PATH + WORDS + MEASURES
#: Pages that are labelled side by side.
SIDE = 256

_NAME = re.compile(r"(/?)([a-z][a-z0-9:-]*)", re.I)
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_STOPS = re.compile(r"[>\"']")
#: Elements whose content is no text: those that run to the end of the page where they aren't closed, and those that then count as tags.
_RAW, _SKIPPED = frozenset(("script", "style", "title", "iframe")), frozenset(("noscript", "template", "svg", "object"))
_END_TAG = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*_RAW, *_SKIPPED)}
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?([^\"'>]+)", re.I)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_GOOD, _BAD = frozenset(("article", "main")), frozenset(("nav", "footer", "aside", "header", "form", "menu"))
_BAD_MARK = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sidebar|menu|nav\w*|footer|cookies?|banner|breadcrumbs?|share|social|promo|sponsor\w*|related)(?:$|[\s_-])", re.I)
_TEXT = re.compile(r"\w+")


class Node:
    """An open tag, with the tags around it."""

    __slots__ = ("parent", "tag", "mark", "depth", "label")

    def __init__(self, parent: Node | None, tag: str, mark: str):
        self.parent, self.tag, self.mark = parent, tag, mark
        self.depth: int = 1 + (parent.depth if parent else 0)
        self.label: int | None = None


@dataclass
class Block:
    #: The innermost open tag; None outside all tags.
    node: Node | None
    text: str
    linked: int

    @property
    def depth(self) -> int:
        return self.node.depth if self.node else 0

    @property
    def path(self) -> tuple[tuple[str, str], ...]:
        """(tag, class, id and role) from the outermost tag in."""
        out, node = [], self.node
        while node:
            out.append((node.tag, node.mark))
            node = node.parent
        return tuple(reversed(out))


def tokens(page: str) -> Iterator[tuple[str | None, bool, str]]:
    """(tag in lower case, whether it closes, its attributes), or (None, False, text), in one pass.

    Nothing is looked for twice: where the next ``>`` is, which end tags there are
    none of, and, after one tag that an open quote leaves without an end, where every
    later tag ends.
    """
    at, size, last = 0, len(page), page.rfind(">")
    gt, missing = -1, set()
    ends: tuple[list[int], list[int]] | None = None

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            yield None, False, page[at:lt]
            at = lt
            continue
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            at = size if close < 0 else close + 3
            continue
        if gt < at:
            gt = page.find(">", at) if at < last + 1 else -1
            gt = size if gt < 0 else gt
        m = _NAME.match(page, at + 1) if gt < size else None
        if m is None:
            if gt < size and page[at + 1] in "!?/":
                at = gt + 1
            else:
                yield None, False, "<"
                at += 1
            continue
        closing, tag, after = bool(m.group(1)), m.group(2).lower(), m.end()
        if not closing and tag in _END_TAG and (page[after] in "/>" or page[after].isspace()):
            if tag == "svg" and page[gt - 1] == "/" and gt - 1 >= after:
                at = gt + 1
                continue
            end = None if tag in missing else _END_TAG[tag].search(page, gt + 1)
            if end is not None or tag in _RAW:
                at = end.end() if end else size
                continue
            missing.add(tag)
        if ends is None and (found := _ATTRIBUTES.match(page, after)):
            close = found.end() - 1
        else:
            ends = ends or _ends(page)
            place = bisect_left(ends[0], after)
            close = ends[1][place] if place < len(ends[0]) else -1
        if close < 0:
            if closing:  # as any other "</": up to the next ">"
                at = gt + 1
            else:
                yield None, False, "<"
                at += 1
            continue
        yield tag, closing, page[after:close]
        at = close + 1


def _ends(page: str) -> tuple[list[int], list[int]]:
    """Places of all ``>`` and quotes, and for each where a tag ends whose attributes go on there; -1 if nowhere."""
    places = [m.start() for m in _STOPS.finditer(page)]
    out, following = [-1] * len(places), {'"': len(places), "'": len(places)}
    for i in range(len(places) - 1, -1, -1):
        c = page[places[i]]
        if c == ">":
            out[i] = places[i]
        else:
            other = following[c] + 1
            out[i] = out[other] if other < len(places) else -1
            following[c] = i
    return places, out


def _unescaped(text: str) -> str:
    if "&#" in text:  # numbers that Python doesn't read, since they are so long, are no characters
        text = re.sub(r"&#0+(?=\d)", "&#", text)
        text = re.sub(r"&#\d{8,};?", "\ufffd", text)
    return entities.unescape(text)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; markup may be broken, unclosed or missing. Time is in proportion to the page's length."""
    stack: list[Node] = []
    #: Where in the stack each tag is open.
    opened: dict[str, list[int]] = {}
    out: list[Block] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal parts, linked, links
        if parts:
            lines = (" ".join(line.split()) for line in _unescaped("".join(parts)).split("\n"))
            if text := "\n".join(line for line in lines if line):
                out.append(Block(stack[-1] if stack else None, text, min(linked, len(text))))
        parts, linked, links = [], 0, 0

    def close(place: int) -> None:
        while len(stack) > place:
            opened[stack.pop().tag].pop()

    for tag, closing, rest in tokens(page):
        if tag is None:
            # Line ends in the source are spaces.
            piece = rest.replace("\n", " ").replace("\r", " ")
            parts.append(piece)
            linked += len(piece.strip()) if links else 0
            continue
        if tag in _INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in _VOID and tag != "hr":
            continue
        flush()
        same = opened.get(tag)
        if closing:
            if same:
                close(same[-1])
            continue
        if tag in _CLOSES_P and opened.get("p"):
            close(opened["p"][-1])
        if same and tag in _CLOSES_SELF and all(same[-1] > places[-1] for c in _CLOSES_SELF[tag] if (places := opened.get(c))):
            close(same[-1])
        if tag not in _VOID and not rest.endswith("/"):
            opened.setdefault(tag, []).append(len(stack))
            stack.append(Node(stack[-1] if stack else None, tag, " ".join(_MARK.findall(rest))))
    flush()
    return out


def markup_label(block: Block) -> int:
    """1 content, 0 not, -1 unsaid: what the page's own markup says."""
    around, node = [], block.node
    while node and node.label is None:
        around.append(node)
        node = node.parent
    label = node.label if node else -1
    for node in reversed(around):
        if label != 0:
            if node.tag in _BAD or (node.mark and _BAD_MARK.search(node.mark)):
                label = 0
            elif node.tag in _GOOD:
                label = 1
        node.label = label
    return label


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


def vectors(page: list[Block], hidden: bool = False) -> np.ndarray:
    """A row of path, word and measure features for each block; ``hidden`` covers up what labels it."""
    out = np.zeros((len(page), INPUT), np.float32)
    for i, block in enumerate(page):
        weight, node = 1.0, block.node
        while node:
            tag, mark, node = node.tag, node.mark, node.parent
            if hidden and (tag in _GOOD or tag in _BAD or mark):
                tag, mark = "div", ""
            out[i, _bucket(tag, PATH)] += weight
            for name in mark.lower().split():
                out[i, _bucket("." + name, PATH)] += weight
            weight *= 0.7
            if weight < 1e-3:
                break
        words = _TEXT.findall(block.text.lower())
        if words:
            hashed = np.fromiter((hash_word(w) for w in words), np.int64, len(words))
            counts = np.bincount(hashed, minlength=WORDS)
            out[i, PATH : PATH + WORDS] = counts / np.sqrt((counts * counts).sum())
        size = len(block.text)
        out[i, PATH + WORDS :] = (np.log1p(len(words)) / 4, block.linked / size, sum(block.text.count(c) for c in ".,;:!?") / (1 + len(words)), i / len(page), (len(page) - 1 - i) / len(page), block.depth / 8)
    return out


_WORD_HASHES: dict[str, int] = {}


def hash_word(word: str) -> int:
    got = _WORD_HASHES.get(word)
    if got is None:
        if len(_WORD_HASHES) > 100_000:
            _WORD_HASHES.clear()
        got = _WORD_HASHES[word] = _bucket(word, WORDS)
    return got


# -- the network --

Weights = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(seed: int = SEED) -> Weights:
    rng = np.random.default_rng(seed)
    out: Weights = {}
    for side in "fb":
        out["w" + side] = (rng.standard_normal((INPUT + HIDDEN, 4 * HIDDEN)) / np.sqrt(INPUT + HIDDEN)).astype(np.float32)
        out["c" + side] = np.zeros(4 * HIDDEN, np.float32)
        out["c" + side][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
    out["v"] = (rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
    out["o"] = np.zeros(1, np.float32)
    return out


def _read(w: np.ndarray, c: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states of one direction; x is (time, pages, input), mask says where pages have blocks."""
    steps, pages, _ = x.shape
    h, cell = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out = np.empty((steps, pages, HIDDEN), np.float32)
    fed = x @ w[:INPUT] + c
    for t in range(steps):
        gates = fed[t] + h @ w[INPUT:]
        on = mask[t][:, None]
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        new = f * cell + i * g
        bent = np.tanh(new)
        if keep is not None:
            keep.append((h, cell, i, f, o, g, bent))
        cell, h = np.where(on, new, cell), np.where(on, o * bent, h)
        out[t] = h
    return out


def _back(w: np.ndarray, x: np.ndarray, mask: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dw, dc = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
    dh, dcell = np.zeros(dout.shape[1:], np.float32), np.zeros(dout.shape[1:], np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, cell, i, f, o, g, bent = kept[t]
        on = mask[t][:, None]
        dh = dh + dout[t]
        own = np.where(on, dh, 0)
        dnew = own * o * (1 - bent * bent) + np.where(on, dcell, 0)
        dgates = np.concatenate([dnew * g * i * (1 - i), dnew * cell * f * (1 - f), own * bent * o * (1 - o), dnew * i * (1 - g * g)], 1)
        dw[:INPUT] += x[t].T @ dgates
        dw[INPUT:] += h.T @ dgates
        dc += dgates.sum(0)
        dh = np.where(on, 0, dh) + dgates @ w[INPUT:].T
        dcell = np.where(on, 0, dcell) + dnew * f
    return dw, dc


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


def scores(weights: Weights, pages: list[np.ndarray]) -> list[np.ndarray]:
    """The probability of being content of every block of every page."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((j for j, p in enumerate(pages) if len(p)), key=lambda j: len(pages[j]))
    at = 0
    while at < len(order):
        # As many pages side by side as the longest of them leaves room for.
        size = SIDE
        while size > 1 and size * len(pages[order[min(at + size, len(order)) - 1]]) > 64 * SIDE:
            size //= 2
        own = order[at : at + size]
        at += size
        x, mask = _padded([pages[j] for j in own])
        both = np.concatenate([_read(weights["wf"], weights["cf"], x, mask, None), _read(weights["wb"], weights["cb"], x[::-1], mask[::-1], None)[::-1]], 2)
        p = _sigmoid(both @ weights["v"] + weights["o"])
        for k, j in enumerate(own):
            out[j] = p[: len(pages[j]), k]
    return out


def train(pages: list[list[Block]], epochs: int = EPOCHS, seed: int = SEED) -> Weights | None:
    """Weights fitted to what markup says of the pages' blocks; None if it says nothing of any, or the same of all."""
    labelled = [(p, np.array([markup_label(b) for b in p])) for p in pages]
    labelled = [(p, y) for p, y in labelled if (y >= 0).any()]
    known = np.concatenate([y[y >= 0] for _, y in labelled]) if labelled else np.zeros(0)
    if not len(known) or known.min() == known.max():
        return None
    weights, rng = initial(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    seen = [(vectors(p), vectors(p, True), y) for p, y in labelled]
    # Blocks count so that content and the rest weigh alike.
    share = known.mean()
    step = 0
    for _ in range(max(epochs, -(-LEAST_STEPS // -(-len(seen) // 16)))):
        order = sorted(rng.permutation(len(seen)).tolist(), key=lambda j: len(seen[j][2]) // 8)
        groups = [order[a : a + 16] for a in range(0, len(order), 16)]
        for g in rng.permutation(len(groups)).tolist():
            own = groups[g]
            x, mask = _padded([seen[j][int(rng.random() < 0.5)] for j in own])
            y = np.full(mask.shape, -1.0, np.float32)
            for k, j in enumerate(own):
                y[: len(seen[j][2]), k] = seen[j][2]
            forth, back = [], []
            both = np.concatenate([_read(weights["wf"], weights["cf"], x, mask, forth), _read(weights["wb"], weights["cb"], x[::-1], mask[::-1], back)[::-1]], 2)
            p = _sigmoid(both @ weights["v"] + weights["o"])
            d = np.where(y >= 0, (p - y) * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)), 0) / max(1, (y >= 0).sum())
            d = d.astype(np.float32)
            grads = {"v": np.einsum("tb,tbh->h", d, both), "o": d.sum(keepdims=True).reshape(1)}
            dboth = d[:, :, None] * weights["v"]
            grads["wf"], grads["cf"] = _back(weights["wf"], x, mask, forth, dboth[:, :, :HIDDEN])
            grads["wb"], grads["cb"] = _back(weights["wb"], x[::-1], mask[::-1], back, dboth[::-1, :, HIDDEN:])
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            step += 1
            for k, v in grads.items():
                v = v * min(1, 1 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                weights[k] = (weights[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return weights


# -- pages --


def sample(df: DataFrame, id_column: str, html_column: str, pages: int = TRAINING_PAGES) -> list[str]:
    """The pages that train: those whose ids' hashes are least, at most ``pages``."""
    ids = df.select(F.col(_quoted(id_column)).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(pages)
    own = df.select(F.col(_quoted(id_column)).alias("id"), F.col(_quoted(html_column)).cast("string").alias("html")).filter("html is not null")
    rows = own.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("html").alias("html")).orderBy("id").collect()  # bounded by `pages`
    return [r["html"] for r in rows]


def extract(df: DataFrame, pages: int = TRAINING_PAGES, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """A row a row of ``df``: id, ``text`` of its content blocks (a line each), how many blocks it has and how many are content.

    Null markup gives a null text and counts, markup without text an empty text and
    0. A null id stays null, repeated rows are repeated, other columns are left out,
    an empty table gives an empty one. A column of the result that has the id column's
    name gets a leading ``_``. If no page's markup labels blocks to learn from, all
    blocks are content; one whose probability is just a half isn't. Pages are read and
    labelled whole.
    """
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(train([blocks(h) for h in sample(df, id_column, html_column, pages)]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shipped.value
        for whole in it:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found = [None if h is None else blocks(h) for h in batch.column(1).to_pylist()]
                if weights is None:
                    kept = [np.ones(len(b or ()), bool) for b in found]
                else:
                    kept = [p > 0.5 for p in scores(weights, [vectors(b or []) for b in found])]
                texts = [None if b is None else "\n".join(x.text for x, on in zip(b, k, strict=True) if on) for b, k in zip(found, kept, strict=True)]
                counts = [None if b is None else len(b) for b in found]
                content = [None if b is None else int(k.sum()) for b, k in zip(found, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(content, pa.int32())], names=["id", "text", "n_blocks", "n_content"])

    return map_texts(df, run, "text string, n_blocks int, n_content int", id_column, html_column)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page."""
    return extract(load(spark, sf_dir, "pages"))
