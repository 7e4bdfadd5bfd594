"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Each block has the features of its ancestors' tags and names and of its own text; the chain weighs them, and how
likely main text follows main text. Training maximises the likelihood of labelled pages; Viterbi decoding labels a page.

Labelled pages: a bounded sample of the table's own pages that mark their article (blocks in `article` or `main`, outside
of menus, forms, asides and the like, are main text), once as they are and once with some marks hidden, so that the
text features are learnt too; and pages composed from labelled layouts (`LAYOUTS`) and the sample's words.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmetrics.llm.html_blocks import MARKS, NAMES, NUMBER, Block, block_features, leaf_blocks

TRAIN_PAGES = 200
TRAIN_BYTES = 200_000
COMPOSED_PAGES = 300

#: Regions of composed pages: opening tags, closing tags, kind of text, and whether it is main text.
LAYOUTS = {
    "menu": [('<nav><ul>', '</ul></nav>', "links", 0), ('<div class="menu"><ul>', '</ul></div>', "links", 0), ('<div id="breadcrumbs">', '</div>', "inline-links", 0)],
    "head": [('<header><h2>', '</h2></header>', "phrase", 0), ('<div class="masthead"><div>', '</div></div>', "phrase", 0), ('<header><p>', '</p></header>', "sentence", 0)],
    "notice": [('<div class="cookie-notice"><p>', '</p></div>', "sentence", 0), ('<div role="alert" class="notice">', '</div>', "sentence", 0), ('<dialog><p>', '</p></dialog>', "sentence", 0)],
    "advert": [('<div class="ad">', '</div>', "sentence", 0), ('<div class="sponsored"><p>', '</p></div>', "sentence", 0), ('<aside class="promo"><p>', '</p></aside>', "sentence", 0)],
    "form": [('<form><p>', '</p><label>', "phrase", 0), ('<form class="search"><label>', '</label></form>', "phrase", 0), ('<div class="newsletter"><form><p>', '</p></form></div>', "sentence", 0)],
    "side": [('<aside><h3>', '</h3></aside>', "phrase", 0), ('<aside><p>', '</p></aside>', "paragraph", 0), ('<div class="sidebar"><ul>', '</ul></div>', "links", 0), ('<div class="related"><ul>', '</ul></div>', "links", 0)],
    "remarks": [('<section class="comments"><p>', '</p></section>', "paragraph", 0), ('<div id="comments"><div class="comment"><p>', '</p></div></div>', "sentence", 0), ('<ol class="commentlist"><li><p>', '</p></li></ol>', "paragraph", 0)],
    "foot": [('<footer>', '</footer>', "rights", 0), ('<div class="footer"><p>', '</p></div>', "rights", 0), ('<footer><p>', '</p></footer>', "sentence", 0)],
    "share": [('<div class="share">', '</div>', "inline-links", 0), ('<ul class="social">', '</ul>', "links", 0)],
}
BODIES = [("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"),
          ('<div id="main"><div class="post">', "</div></div>"), ('<div class="entry-content">', "</div>"), ("<div>", "</div>"), ("<section>", "</section>"), ("", "")]
OUTSIDE = frozenset(NUMBER[f"in:{t}"] for t in ("nav", "footer", "aside", "form", "dialog")) | frozenset(
    NUMBER[f"mark:{m}"] for m in MARKS if m not in ("text", "head"))
INSIDE = frozenset(NUMBER[f"in:{t}"] for t in ("article", "main"))


class Chain(NamedTuple):
    weights: np.ndarray  # [feature, label]
    moves: np.ndarray  # [label, next label]
    start: np.ndarray

    def decode(self, features: list[list[int]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        w, ((a, b), (c, d)) = self.weights, self.moves.tolist()
        back, zero, one = [], self.start[0], self.start[1]
        for k, f in enumerate(features):
            e0, e1 = w[f].sum(0).tolist()
            if k:
                from0, from1 = (0 if zero + a >= one + c else 1), (0 if zero + b > one + d else 1)
                zero, one = max(zero + a, one + c), max(zero + b, one + d)
                back.append((from0, from1))
            zero, one = zero + e0, one + e1
        if not features:
            return []
        labels = [int(one > zero)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def own_labels(blocks: list[Block]) -> list[int] | None:
    """Labels that a page's own marks give, if it marks its article."""
    if not any(b.inside & INSIDE for b in blocks):
        return None
    return [int(bool(b.inside & INSIDE) and not b.inside & OUTSIDE) for b in blocks]


def compose(rng: np.random.Generator, words: list[str]) -> tuple[str, list[int]]:
    """A page from the layouts, and the labels of its blocks."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    some = lambda low, high: " ".join(pick(words) for _ in range(int(rng.integers(low, high))))
    sentence = lambda low=5, high=20: some(low, high).capitalize() + "."
    out, labels = [], []

    def add(region: str) -> None:
        begin, end, kind, label = pick(LAYOUTS[region])
        if kind == "links":
            n = int(rng.integers(2, 7))
            out.append(begin + "".join(f'<li><a href="/x">{some(1, 4)}</a></li>' for _ in range(n)) + end)
            labels.extend([label] * n)
            return
        text = {"inline-links": lambda: " ".join(f'<a href="/x">{some(1, 3)}</a>' for _ in range(3)), "phrase": lambda: some(1, 5),
                "sentence": sentence, "paragraph": lambda: " ".join(sentence() for _ in range(int(rng.integers(1, 6)))),
                "rights": lambda: f"&copy; {some(1, 3)} &middot; {sentence()}"}[kind]()
        out.append(begin + text + end)
        labels.append(label)

    before = [r for r in ("menu", "head", "notice", "advert", "share") if rng.random() < 0.5]
    after = [r for r in ("share", "side", "advert", "remarks", "form", "foot") if rng.random() < 0.5]
    within = [r for r in ("advert", "share", "form", "side", "notice") if rng.random() < 0.15]
    for region in before:
        add(region)
    begin, end = pick(BODIES)
    out.append(begin)
    if rng.random() < 0.8:
        out.append(f"<h1>{some(2, 12)}</h1>")
        labels.append(1)
    for _ in range(int(rng.integers(1, 9))):
        kind = rng.random()
        if kind < 0.75:
            out.append("<p>" + " ".join(sentence() for _ in range(int(rng.integers(1, 8)))) + "</p>")
        elif kind < 0.85:
            out.append(f"<h2>{some(1, 7)}</h2>")
        elif kind < 0.92:
            out.append(f"<ul><li>{sentence()}</li></ul>")
        else:
            out.append(f"<blockquote>{sentence(8, 40)}</blockquote>")
        labels.append(1)
        if within and rng.random() < 0.3:
            add(within.pop())
    out.append(end)
    for region in after:
        add(region)
    return "<html><body>" + "".join(out) + "</body></html>", labels


def labelled(pages: list[str], composed: int = COMPOSED_PAGES, seed: int = 5) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of the training pages."""
    rng = np.random.default_rng(seed)
    out, words = [], set()
    hidden = frozenset(NUMBER[n] for n in NAMES if n.startswith(("in:", "mark:")) or n.endswith("-region"))
    for page in pages:
        blocks = leaf_blocks(page)
        words.update(w for b in blocks[:40] for w in b.text.split()[:50])
        labels = own_labels(blocks)
        if labels:
            features = block_features(blocks)
            out.append((features, labels))
            out.append(([[f for f in row if f not in hidden or rng.random() < 0.3] for row in features], labels))
    vocabulary = sorted(w for w in words if w.isalpha())[:5000] or ["lorem", "ipsum", "dolor", "sit", "amet"]
    for _ in range(composed):
        page, labels = compose(rng, vocabulary)
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            out.append((block_features(blocks), labels))
    return out


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Maximum likelihood by full-gradient Adam steps; forward and backward sums run over all pages at once."""
    n, longest, size = len(pages), max(len(y) for _, y in pages), len(NAMES)
    flat = np.concatenate([f for rows, _ in pages for f in rows]).astype(np.int64)
    lengths = np.array([len(f) for rows, _ in pages for f in rows])
    long = np.array([len(y) for _, y in pages])
    page = np.repeat(np.arange(n), long)
    place = np.arange(len(page)) - np.repeat(np.cumsum(long) - long, long)
    block = np.repeat(np.arange(len(lengths)), lengths)
    truth = np.concatenate([y for _, y in pages]).astype(np.int64)
    follows = np.flatnonzero(place[1:] > 0)
    seen = np.stack([np.bincount(flat, (truth == y)[block], size) for y in (0, 1)], 1)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (truth[follows], truth[follows + 1]), 1)
    seen_start = np.bincount(truth[place == 0], minlength=2)
    inside = np.arange(longest) < long[:, None]
    parameters = [np.zeros((size, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, rounds + 1):
        weights, moves, start = parameters
        edges = np.concatenate(([0], np.cumsum(lengths)))
        sums = np.concatenate((np.zeros((1, 2)), np.cumsum(weights[flat], 0)))
        emit = np.zeros((n, longest, 2))
        emit[page, place] = sums[edges[1:]] - sums[edges[:-1]]
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = emit[:, 0] + start
        for k in range(1, longest):
            ahead[:, k] = np.where(inside[:, k, None], emit[:, k] + np.logaddexp.reduce(ahead[:, k - 1, :, None] + moves, 1), ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            step_back = np.logaddexp.reduce(moves + (emit[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
            behind[:, k] = np.where(inside[:, k + 1, None], step_back, 0)
        total = np.logaddexp.reduce(ahead[:, -1], 1)
        chance = np.exp(ahead + behind - total[:, None, None])[page, place]
        pair = ahead[:, :-1, :, None] + moves + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(pair, 0)) * inside[:, 1:, None, None]).sum((0, 1))
        found = np.stack([np.bincount(flat, chance[block, y], size) for y in (0, 1)], 1)
        gradients = [(found - seen) / n + decay * weights, (expected - seen_moves) / n + decay * moves, (chance[place == 0].sum(0) - seen_start) / n + decay * start]
        for p, g, a, b in zip(parameters, gradients, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return Chain(*parameters)


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES, train_bytes: int = TRAIN_BYTES) -> Chain:
    """The chain of a sample of about `train_pages` pages (by hash of their text; none over `train_bytes`) and the layouts."""
    usable = pages.select(F.col("html").cast("string").alias("html")).filter(F.octet_length("html").between(1, train_bytes))
    share = int(min(1.0, train_pages / max(1, usable.count())) * (1 << 30))
    sample = usable.filter(F.pmod(F.xxhash64(F.lit("pages"), "html"), F.lit(1 << 30)) < share).distinct()
    return fit(labelled(sorted(r.html for r in sample.toLocalIterator())))


def main_text(chain: Chain, page: str, known: dict | None = None) -> str:
    blocks = leaf_blocks(page, known)
    return "\n".join(b.text for b, y in zip(blocks, chain.decode(block_features(blocks)), strict=True) if y)


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """Per row `page_id, url, text, n_chars`. A null or empty page, and one without main text, has the empty text;
    repeated rows are extracted each; a page is read whole, whatever its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                texts = [main_text(chain, page, known) if page else "" for page in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
