"""Main-text extraction by a recurrent block labeller.

A page is the sequence of its leaf blocks.  A bidirectional LSTM in numpy reads a vector of each
block's tag path and one of its hashed words and labels every block in the context of the whole
page.  It is trained here, on pages whose markup tells content from boilerplate; the tags that
do so are hidden from it at random, so that it also learns from position, words and neighbours.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import Counter
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import pick
from tessella.llm.words import word_batches

#: Pages (expected number, chosen by hash from all of up to so many characters) that the labeller is trained on.
TRAINING_PAGES, TRAINING_CHARS = 384, 1 << 20
HIDDEN, PATH, WORDS, NUMBERS = 24, 40, 32, 8
SIZE = PATH + WORDS + NUMBERS
_TAGS = PATH * 3 // 5  # slots of a path's names; the rest are its last name's
EPOCHS, BATCH, RATE, DROP = 5, 16, 0.01, 0.5
SEED = 11
THRESHOLD = 0.5

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = frozenset("script style noscript template textarea svg math iframe title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CONTENT = frozenset(("article", "main"))
_BOILERPLATE = frozenset("nav aside footer header form menu button".split())
_AD = re.compile(r"\b(?:ads?|advert\w*|banner|cookie\w*|promo\w*|sidebar|menu|breadcrumbs?|share|social|related|comments?)\b", re.I)
_SPACE = re.compile(r"\s+")


class Path:
    """The open tags from the outside in, with a ``.name`` after one for each class or id.  What
    is read from a path is kept up as it grows, so depth costs nothing: the slots that its names
    have in a vector, its length, its last name, and what the markup says; each also without the
    names that say so (``shown``)."""

    __slots__ = ("above", "names", "slots", "length", "last", "shown", "content", "boilerplate")

    def __init__(self, above: Path | None = None, names: tuple[str, ...] = ()):
        self.above, self.names = above, names
        self.slots, self.length, self.last = (above.slots, above.length, above.last) if above else (0, 0, None)
        self.shown = above.shown if above else (0, 0, None)
        self.content, self.boilerplate = (above.content, above.boilerplate) if above else (False, False)
        for name in names:
            bit = 1 << _slot(name, _TAGS)
            self.slots, self.length, self.last = self.slots | bit, self.length + 1, name
            self.content |= name in _CONTENT
            self.boilerplate |= name in _BOILERPLATE or name[0] == "." and _AD.search(name) is not None
            if name[0] != "." and name not in _CONTENT and name not in _BOILERPLATE:
                self.shown = (self.shown[0] | bit, self.shown[1] + 1, name)

    def __iter__(self):
        parts, at = [], self
        while at is not None:
            parts.append(at.names)
            at = at.above
        return (name for names in reversed(parts) for name in names)

    def __eq__(self, other):
        return tuple(self) == tuple(other)

    def __getitem__(self, at):
        return tuple(self)[at]


def _slot(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % size


@lru_cache(maxsize=1 << 14)
def _places(slots: int) -> np.ndarray:
    return np.array([i for i in range(_TAGS) if slots >> i & 1], dtype=np.int64)


def leaves(page: str | None) -> list[tuple[str, Path, int]]:
    """Leaf blocks of a page in order: (text, path, characters within links).  Time and memory
    are in proportion to the page, however deep it is.

    Malformed markup never fails: an end tag without a start is skipped, open tags end with their
    parents, and an unfinished tag or comment ends the page.  Comments, scripts, styles and other
    raw elements give no text; a script or style without an end tag ends the page, of another raw
    element only the tag is left out.
    """
    out: list[tuple[str, Path, int]] = []
    if not page:
        return out
    top = Path()
    stack: list[tuple[str, Path]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = 0
    path = top
    endless: set[str] = set()

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, path, linked))
        linked = 0

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        start = m.start() if m else len(page)
        if start > at:
            parts.append(page[at:start])
            if links:
                linked += start - at
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                parts.append(_html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if opened[name] and name not in _INLINE:
                flush()
                while True:
                    ended = stack.pop()[0]
                    opened[ended] -= 1
                    if ended == name:
                        break
                path = stack[-1][1] if stack else top
            continue
        if name in _RAW:
            if name in endless or name in ("svg", "math") and m[0].endswith("/>"):
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            else:
                endless.add(name)
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                flush()
            else:
                parts.append(" ")
            continue
        if name in _INLINE:
            links += name == "a"
            continue
        flush()
        closes = _CLOSES.get(name)
        if closes and stack and stack[-1][0] in closes:
            opened[stack.pop()[0]] -= 1
            path = stack[-1][1] if stack else top
        names = ["." + n for v in _NAMES.findall(m[3]) for n in "".join(v).lower().split()] if m[3] else []
        path = Path(path, (name, *names))
        if not m[0].endswith("/>"):
            stack.append((name, path))
            opened[name] += 1
    flush()
    return out


def weak_label(path: Path) -> bool:
    """Whether the markup itself calls a block content."""
    return path.content and not path.boilerplate


def vectors(blocks: list[tuple[str, Path, int]], hide: np.ndarray | None = None) -> np.ndarray:
    """A row for each block: hashed tag path, hashed words, and sizes, links and place.
    ``hide`` says for which blocks the tags that ``weak_label`` reads are left out."""
    n = len(blocks)
    x = np.zeros((n, SIZE), dtype=np.float32)
    for i, (text, path, linked) in enumerate(blocks):
        slots, deep, last = path.shown if hide is not None and hide[i] else (path.slots, path.length, path.last)
        x[i, _places(slots)] = 1.0
        if last is not None:
            x[i, _TAGS + _slot(last, PATH - _TAGS)] = 1.0
        length = len(text)
        marks = sum(map(text.count, ".,;:!?"))
        x[i, PATH + WORDS :] = (np.log1p(length) / 8, min(1.0, linked / length), min(1.0, marks * 10 / length), text[-1] in ".!?\"”", text[0].isupper(), i / n, deep / 16, length > 80)
    for first, hashed, counts in word_batches([b[0] for b in blocks]):
        owner = np.repeat(np.arange(len(counts)), counts)
        sign = np.where(hashed >> np.uint64(63), 1.0, -1.0)
        cell = owner * WORDS + (hashed % np.uint64(WORDS)).astype(np.int64)
        v = np.bincount(cell, sign, len(counts) * WORDS).reshape(-1, WORDS)
        x[first : first + len(counts), PATH : PATH + WORDS] = np.sign(v) * np.log1p(np.abs(v)) / np.sqrt(1 + np.log1p(counts))[:, None]
    return x


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def new_weights(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
    for d in "fb":
        w["x" + d] = rng.normal(0, SIZE**-0.5, (SIZE, 4 * HIDDEN))
        w["h" + d] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        w["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in w.items()}


def _direction(w, d, x, mask, keep=None):
    """Hidden states (steps, pages, HIDDEN) of one direction; masked steps leave the state as it is."""
    steps, pages = mask.shape
    z = x @ w["x" + d] + w["c" + d]
    h = c = np.zeros((pages, HIDDEN), dtype=np.float32)
    out = np.zeros((steps, pages, HIDDEN), dtype=np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        g = z[t] + h @ w["h" + d]
        i, f, o = np.split(_sigmoid(g[:, : 3 * HIDDEN]), 3, axis=1)
        u = np.tanh(g[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = np.where(m, f * c + i * u, c)
        th = np.tanh(new)
        if keep is not None:
            keep.append((t, h, c, i, f, o, u, th, m))
        h, c = np.where(m, o * th, h), new
        out[t] = h
    return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), SIZE), dtype=np.float32), np.zeros((steps, len(pages)), dtype=bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


def probabilities(w: dict[str, np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    """Probability that each block is content, for pages of vectors; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    for at in range(0, len(order), 64):
        own = order[at : at + 64]
        x, mask = _padded([pages[i] for i in own])
        h = np.concatenate([_direction(w, d, x, mask) for d in "fb"], axis=2)
        p = _sigmoid(h @ w["out"] + w["bias"][0])
        for j, i in enumerate(own):
            out[i] = p[: len(pages[i]), j]
    return out


def _gradients(w, x, mask, y):
    """Gradients of the mean logistic loss by backpropagation through time."""
    kept = {d: [] for d in "fb"}
    states = {d: _direction(w, d, x, mask, kept[d]) for d in "fb"}
    h = np.concatenate([states["f"], states["b"]], axis=2)
    error = np.where(mask, _sigmoid(h @ w["out"] + w["bias"][0]) - y, 0) / max(1, mask.sum())
    grads = {"out": np.einsum("tp,tph->h", error, h), "bias": np.array([error.sum()])}
    for k, d in enumerate("fb"):
        through = error[:, :, None] * w["out"][k * HIDDEN : (k + 1) * HIDDEN]
        dz = np.zeros((*mask.shape, 4 * HIDDEN), dtype=np.float32)
        dh = np.zeros((mask.shape[1], HIDDEN), dtype=np.float32)
        dc, dw = np.zeros_like(dh), np.zeros_like(w["h" + d])
        for t, h0, c0, i, f, o, u, th, m in reversed(kept[d]):
            dh = dh + through[t]
            here = np.where(m, dh, 0)
            dn = np.where(m, dc + here * o * (1 - th**2), 0)
            dz[t] = np.concatenate([dn * u * i * (1 - i), dn * c0 * f * (1 - f), here * th * o * (1 - o), dn * i * (1 - u**2)], axis=1)
            dw += h0.T @ dz[t]
            dh, dc = np.where(m, dz[t] @ w["h" + d].T, dh), np.where(m, dn * f, dc)
        grads |= {"x" + d: np.einsum("tps,tpg->sg", x, dz, optimize=True), "h" + d: dw, "c" + d: dz.sum(axis=(0, 1))}
    return grads


def fit(pages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray] | None:
    """Weights trained with Adam on pages that have both kinds of blocks by ``weak_label``; None
    if no page has."""
    told = []
    for page in pages:
        blocks = leaves(page)
        y = np.array([weak_label(p) for _, p, _ in blocks], dtype=np.float32)
        if len(blocks) and 0 < y.sum() < len(y):
            told.append((blocks, y))
    if not told:
        return None
    rng = np.random.default_rng(seed)
    w = new_weights(seed)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    power = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(told))
        for at in range(0, len(order), BATCH):
            own = [told[i] for i in order[at : at + BATCH]]
            x, mask = _padded([vectors(b, rng.random(len(b)) < DROP) for b, _ in own])
            y = np.zeros(mask.shape, dtype=np.float32)
            for j, (_, labels) in enumerate(own):
                y[: len(labels), j] = labels
            step += 1
            for k, g in _gradients(w, x, mask, y).items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                power[k] = 0.999 * power[k] + 0.001 * g * g
                w[k] = (w[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(power[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def training_pages(pages: DataFrame, n: int = TRAINING_PAGES) -> list[str]:
    """About ``n`` pages, drawn by hash from all of up to ``TRAINING_CHARS`` characters."""
    rows = pick(pages, "page_id", "url", "html").where(f"length(html) between 1 and {TRAINING_CHARS}")
    share = min(1.0, n / max(1, rows.count()))
    bound = min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))
    drawn = rows.where(F.xxhash64("page_id", "url", F.lit(SEED)) <= F.lit(bound)).select("html")
    return sorted(r["html"] for r in drawn.collect())  # bounded by ``n``


def _extract(w: dict[str, np.ndarray] | None, threshold: float, batches):
    for batch in batches:
        texts = batch.column("html").to_pylist()
        for i in range(0, len(texts), 256):
            run = [leaves(t) for t in texts[i : i + 256]]
            kept = [np.ones(len(b), dtype=bool) for b in run] if w is None else [p >= threshold for p in probabilities(w, [vectors(b) for b in run])]
            found = [None if t is None else "\n".join(b[0] for b, k in zip(blocks, keep) if k) for t, blocks, keep in zip(texts[i : i + 256], run, kept)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(i, 256), batch.column("url").slice(i, 256), pa.array(found, pa.string()), pa.array([len(b) for b in run], pa.int32()), pa.array([int(k.sum()) for k in kept], pa.int32())], ["page_id", "url", "text", "n_blocks", "n_kept"])


def extract_text(pages: DataFrame, weights: dict[str, np.ndarray] | None = None, threshold: float = THRESHOLD, training: int = TRAINING_PAGES) -> DataFrame:
    """(page_id, url, text, n_blocks, n_kept) of each page: the blocks that the labeller calls
    content, one to a line.

    Without ``weights`` it is trained on about ``training`` of the pages; if none of these tells
    its content by markup, every block is kept.  A null html gives a null text, an empty one or
    one without text an empty text.  Whole pages are read.  Repeated rows get equal results, an
    empty table none; other columns don't matter.
    """
    w = weights or fit(training_pages(pages, training))
    return pick(pages, "page_id", "url", "html").mapInArrow(partial(_extract, w, threshold), "page_id long, url string, text string, n_blocks int, n_kept int")
