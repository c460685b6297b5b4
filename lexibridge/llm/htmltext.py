"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks of text, each with the path of tags above it. A
bidirectional LSTM in numpy reads the whole sequence of blocks, a vector of hashed tag
path tokens, hashed words and a few measures for each, and labels every block as main
text or not, so that a label depends on the document around it. The weights are trained
here, on generated pages of many layouts whose labels are known; training is
deterministic and takes some seconds.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibridge.llm.arrays import code_points, slices, span_hashes, word_spans

PATH, WORDS, PLAIN, HIDDEN = 128, 16, 8, 20

# No part gives back what it took, and `blocks` looks no further once no `>` is left, so a page is read in one pass.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|([^<]++|<)""",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
#: Tags that stay within a block; all others end it.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Skipped with all inside, if their end tag follows. (Scripts and styles without one reach to the page's end.)
SKIPPED = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("noscript", "template", "svg", "iframe", "object", "title")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind closes an open one of the second.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


#: The nearest tokens of a path count 1, 0.9 and so on, all others 0.4.
FAR, NEAR = 0.4, 6


@lru_cache(50_000)
def _token_vector(token: str) -> np.ndarray:
    """A token's signed hashed places."""
    v = np.zeros(PATH, np.float32)
    for seed in ("x", "y"):
        h = _hash(seed + token)
        v[h % PATH] += 1 if h >> 16 & 1 else -1
    return v


class Path:
    """The tags above a block, folded: each step down adds its own tokens to what its parent holds."""

    def __init__(self, total: np.ndarray, near: tuple[str, ...] = (), headed: bool = False):
        self.total, self.near, self.headed = total, near, headed
        self.steps: dict[tuple[str, ...], Path] = {}

    def below(self, names: tuple[str, ...]) -> Path:
        """The path one step down; equal steps from one place are one path."""
        if names not in self.steps:
            self.steps[names] = Path(self.total + sum(map(_token_vector, names)), (*self.near, *names)[-NEAR:], self.headed or any(n in ("h1", "h2", "h3", "h4") for n in names))
        return self.steps[names]

    @cached_property
    def vector(self) -> np.ndarray:
        v = FAR * self.total
        for depth, token in enumerate(reversed(self.near)):
            v = v + (1 - FAR - 0.1 * depth) * _token_vector(token)
        return v.astype(np.float32)


def root() -> Path:
    return Path(np.zeros(PATH, np.float32))


@dataclass
class Block:
    text: str
    path: Path
    linked: float


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    words = [tag]
    if "=" in attributes:
        for m in _NAMED.finditer(attributes):
            words += [f".{w}" for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(words)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: character references decoded, white space made one blank, trimmed."""
    out: list[Block] = []
    # Paths are shared within a page and go with it.
    top = root()
    stack: list[tuple[str, Path]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    state = {"link": 0, "linked": 0}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, stack[-1][1] if stack else top, min(state["linked"] / len(text), 1.0)))
        parts.clear()
        state["linked"] = 0

    def take(text: str) -> None:
        # A reference may be cut only by markup, so pieces of text decode alone.
        text = html.unescape(text) if "&" in text else text
        parts.append(text)
        if state["link"]:
            state["linked"] += len(text)

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    at, unended, last = 0, set(), page.rfind(">")
    # The pattern's last part takes whatever comes, so it matches up to the last tag's end.
    while at <= last and (m := _TOKEN.match(page, at)):
        at = m.end()
        text = m[8]
        if text is not None:
            take(text)
            continue
        tag = m[3] or m[6]
        if tag is None:
            if m[1]:
                flush()
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                state["link"] = 0 if closing else 1
            continue
        flush()
        if closing:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in SKIPPED and tag not in unended and not attributes.endswith("/"):
            if end := SKIPPED[tag].search(page, at):
                at = end.end()
                continue
            unended.add(tag)
        if tag in CLOSES and stack and stack[-1][0] in CLOSES[tag]:
            pop()
        elif tag in ENDS_P and stack and stack[-1][0] == "p":
            pop()
        # The end tags of head may be left out: it encloses nothing here.
        if tag not in VOID and tag not in ("head", "title") and not attributes.endswith("/"):
            stack.append((tag, (stack[-1][1] if stack else top).below(_names(tag, attributes))))
            opened[tag] += 1
    # What follows the last tag is text, up to a comment without an end.
    if at < len(page):
        take(page[at:].split("<!--", 1)[0])
    flush()
    return out


def _hash(token: str) -> int:
    h = 2166136261
    for c in token.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h


def features(page: list[Block]) -> np.ndarray:
    """float32 (blocks, PATH + WORDS + PLAIN)."""
    n = len(page)
    x = np.zeros((n, PATH + WORDS + PLAIN), np.float32)
    if not n:
        return x
    texts = [b.text for b in page]
    x[:, :PATH] = np.stack([b.path.vector for b in page])
    points, offsets = code_points([t.lower() for t in texts])
    starts, ends, row = word_spans(points, offsets)
    count = np.bincount(row, minlength=n)
    if len(row):
        words = span_hashes(points, starts, ends)
        bag = np.bincount(row * WORDS + (words & np.uint64(WORDS - 1)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        x[:, PATH : PATH + WORDS] = np.sqrt(bag / np.maximum(count, 1)[:, None])
    size = np.array([len(t) for t in texts])
    plain = x[:, PATH + WORDS :]
    plain[:, 0] = np.log1p(size) / 5
    plain[:, 1] = np.log1p(count) / 4
    plain[:, 2] = [b.linked for b in page]
    plain[:, 3] = [t[-1] in ".!?…:;" for t in texts]
    plain[:, 4] = np.arange(n) / n
    plain[:, 5] = np.log1p(n) / 5
    plain[:, 6] = [b.path.headed for b in page]
    plain[:, 7] = 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, learn: bool = True) -> tuple[np.ndarray, list]:
    """LSTM over (time, batch, input): states (time, batch, HIDDEN) and, to learn, what the way back needs."""
    steps, batch, _ = x.shape
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    out, tape = np.zeros((steps, batch, HIDDEN), np.float32), []
    z = x.reshape(steps * batch, -1) @ w
    z = z.reshape(steps, batch, -1)
    for t in range(steps):
        g = z[t] + h @ u
        gates = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o, k = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
        live = mask[t][:, None]
        after = (f * c + i * k) * live
        s = np.tanh(after)
        if learn:
            tape.append((h, c, i, f, o, k, s, live))
        h, c = o * s * live, after
        out[t] = h
    return out, tape


def _back(d_out: np.ndarray, x: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    steps = len(tape)
    dz = np.zeros((steps, d_out.shape[1], 4 * HIDDEN), np.float32)
    d_u, dh, dc = np.zeros_like(u), np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, k, s, live = tape[t]
        dh = (dh + d_out[t]) * live
        dc = (dc + dh * o * (1 - s * s)) * live
        dz[t] = np.concatenate((dc * k * i * (1 - i), dc * c * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - k * k)), axis=1)
        d_u += h.T @ dz[t]
        dh, dc = dz[t] @ u.T, dc * f
    return x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, 4 * HIDDEN), d_u


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each column's own steps in reverse order."""
    at = lengths[None, :] - 1 - np.arange(len(x))[:, None]
    at = np.where(at < 0, np.arange(len(x))[:, None], at)
    return np.take_along_axis(x, at.reshape(at.shape + (1,) * (x.ndim - 2)), axis=0)


class Labeller:
    """Bidirectional LSTM and a logistic layer on both directions' states."""

    def __init__(self, seed: int = 7):
        random = np.random.Generator(np.random.PCG64(seed))
        size = PATH + WORDS + PLAIN
        scale = lambda *s: (random.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.weights = [scale(size, 4 * HIDDEN), scale(HIDDEN, 4 * HIDDEN), scale(size, 4 * HIDDEN), scale(HIDDEN, 4 * HIDDEN), scale(2 * HIDDEN), scale(size) * 0, np.zeros(1, np.float32)]

    def _forward(self, x: np.ndarray, lengths: np.ndarray, learn: bool = True):
        mask = (np.arange(len(x))[:, None] < lengths[None, :]).astype(np.float32)
        w, u, w2, u2, v, direct, b = self.weights
        ahead, tape = _run(x, mask, w, u, learn)
        turned = _flip(x, lengths)
        behind, tape2 = _run(turned, mask, w2, u2, learn)
        states = np.concatenate((ahead, _flip(behind, lengths)), axis=2)
        return states, _sigmoid(states @ v + x @ direct + b[0]), mask, turned, tape, tape2

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """P(main text) of every block of every page; pages of similar length run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            # Bounded padding: the batch shrinks as pages grow.
            longest = len(pages[order[-1]])
            count = max(1, min(64, 20_000 // longest))
            take, order = order[-count:], order[:-count]
            lengths = np.array([len(pages[i]) for i in take])
            x = np.zeros((longest, len(take), PATH + WORDS + PLAIN), np.float32)
            for k, i in enumerate(take):
                x[: lengths[k], k] = pages[i]
            p = self._forward(x, lengths, learn=False)[1]
            for k, i in enumerate(take):
                out[i] = p[: lengths[k], k]
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 32) -> None:
        mean, square, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        random = np.random.Generator(np.random.PCG64(1))
        for epoch in range(epochs):
            order = random.permutation(len(pages))
            for s in range(0, len(order), batch):
                part = [pages[i] for i in order[s : s + batch]]
                lengths = np.array([len(y) for _, y in part])
                x = np.zeros((lengths.max(), len(part), PATH + WORDS + PLAIN), np.float32)
                y = np.zeros((lengths.max(), len(part)), np.float32)
                for k, (a, b) in enumerate(part):
                    x[: lengths[k], k], y[: lengths[k], k] = a, b
                    if random.random() < 0.3:  # layout decides where texts say nothing
                        x[:, k, PATH:-1] = 0
                states, p, mask, turned, tape, tape2 = self._forward(x, lengths)
                d = (p - y) * mask / mask.sum()
                d_states = d[:, :, None] * self.weights[4]
                d_w, d_u = _back(d_states[:, :, :HIDDEN], x, self.weights[1], tape)
                d_w2, d_u2 = _back(_flip(d_states[:, :, HIDDEN:], lengths), turned, self.weights[3], tape2)
                grads = [d_w, d_u, d_w2, d_u2, np.einsum("tbh,tb->h", states, d), np.einsum("tbi,tb->i", x, d), np.array([d.sum()])]
                step += 1
                rate = 0.01 * (1 - epoch / epochs) + 0.001
                for k, g in enumerate(grads):
                    g = np.clip(g, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.weights[k] = (self.weights[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


@cache
def trained(pages: int = 1500) -> Labeller:
    """The labeller, trained on `pages` generated pages."""
    from lexibridge.llm.htmlpages import generate

    model = Labeller()
    data = []
    for seed in range(pages):
        found = blocks(generate(seed)[0])
        kept = generate(seed)[1]
        data.append((features(found), np.array([b.text in kept for b in found], np.float32)))
    model.fit([d for d in data if len(d[1])])
    return model


def extract_pages(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`.

    text: the blocks labelled as main text in page order, one line feed between them; empty if
    there are none, as for a null or empty html. n_chars: its code points. Reads page_id, url and
    html alone; repeated rows give repeated rows.
    """
    weights = (model or trained()).weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.weights = weights
        for batch in batches:
            htmls = batch.column("html").to_pylist()
            for start, stop in slices([len(t) for t in htmls]):
                found = [blocks(t) for t in htmls[start:stop]]
                main = labeller.probabilities([features(f) for f in found])
                texts = ["\n".join(b.text for b, p in zip(f, ps, strict=True) if p >= 0.5) for f, ps in zip(found, main, strict=True)]
                yield pa.record_batch({"page_id": batch.column("page_id").slice(start, stop - start), "url": batch.column("url").slice(start, stop - start), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
