"""Toxicity by a factorization machine over hashed terms.

A document's score is `sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>)` over its distinct terms, so a pair
of terms can weigh more (or less) than its parts, which an additive model cannot learn. Terms are hashed to
2^20 buckets. Features are the buckets that the training rows show to be related to the label (chi-square), alone or
in pairs: every pair of the `PAIR_TERMS` most frequent buckets is tested too, so two terms that only together say something are kept.

The model is fitted on at most about `TRAIN_ROWS` labelled rows (chosen by a hash of their id); scoring reads
every document's whole text in one pass without a shuffle, and the model every task holds has a fixed size.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmetrics.llm.label_model import sigmoid
from haulmetrics.llm.words import ALPHANUMERIC, slices, words

BUCKET_BITS = 20
TRAIN_ROWS = 16_384
MAX_FEATURES = 4_096
MIN_ROWS = 3
MIN_CHI_SQUARE = 10.8  # p = 0.001 with one degree of freedom
PAIR_TERMS = 1_024
MIN_PAIR_CHI_SQUARE = 33.0  # p = 0.01 over all pairs of that many terms
FACTORS = 8
BLOCK = 1_024  # training rows whose gradients are in memory at a time


class Machine(NamedTuple):
    feature_of: np.ndarray  # bucket -> feature or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Scores of rows given as a flat list of features with row bounds."""
        return sigmoid(margins(self.bias, self.weights, self.factors, features, bounds)[0])


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
    return total[bounds[1:]] - total[bounds[:-1]]


def margins(bias: float, weights: np.ndarray, factors: np.ndarray, features: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)`, and the row sums of the factors."""
    v = factors[features]
    sums = row_sums(v, bounds)
    pairs = 0.5 * ((sums ** 2).sum(1) - row_sums((v ** 2).sum(1), bounds))
    return bias + row_sums(weights[features], bounds) + pairs, sums


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def distinct_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each row's words, and row bounds."""
    hashes, first = words(data, offsets, ALPHANUMERIC)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(first))
    keys = np.unique((row << np.uint64(BUCKET_BITS)) | (hashes >> np.uint64(64 - BUCKET_BITS)))
    bounds = np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(BUCKET_BITS))
    return (keys & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64), bounds


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch["text"]):
            buckets, bounds = distinct_buckets(data, offsets)
            yield pa.RecordBatch.from_arrays([
                batch["toxic"].slice(first, end - first),
                pa.array([buckets[bounds[k]: bounds[k + 1]].astype(np.uint32).tobytes() for k in range(end - first)], pa.binary()),
            ], names=["toxic", "buckets"])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """`toxic, buckets` of the labelled rows outside the held-out fold, thinned by a hash of the id to about `rows`.

    A document with several labels is toxic if one of them says so; rows without id or label do not count.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, rows / max(1, known.count()))
    draw = lambda df: df.filter(F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast("long")), F.lit(1 << 30)) < int(share * (1 << 30)))
    marks = draw(known).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    texts = draw(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL"))
    return texts.join(marks, "doc_id").orderBy("doc_id", F.xxhash64("text")).select("text", "toxic").mapInArrow(_training_rows, "toxic int, buckets binary")


def chi_square(seen: np.ndarray, bad: np.ndarray, rows: int, toxic: float) -> np.ndarray:
    """Chi-square (with Yates' correction) of being in `seen` of the rows, `bad` of them toxic, against the label."""
    out = np.zeros(np.shape(seen))
    for count, share in ((bad, toxic), (seen - bad, rows - toxic)):
        for observed, expected in ((count, seen * share / max(rows, 1)), (share - count, (rows - seen) * share / max(rows, 1))):
            out += np.divide(np.maximum(np.abs(observed - expected) - 0.5, 0) ** 2, expected, out=np.zeros_like(out), where=expected > 0)
    return out


def related_pairs(flat: np.ndarray, owner: np.ndarray, toxic: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets among the most frequent ones that are in a pair related to the label more than either is alone, and the pair's chi-square."""
    frequent = np.argsort(-seen, kind="stable")[:PAIR_TERMS]
    frequent = frequent[seen[frequent] >= MIN_ROWS]
    if len(frequent) < 2 or not 0 < toxic.sum() < len(toxic):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    place = np.full(len(seen), -1, dtype=np.int32)
    place[frequent] = np.arange(len(frequent))
    both, bad = np.zeros((len(frequent),) * 2, dtype=np.float32), np.zeros((len(frequent),) * 2, dtype=np.float32)
    for first in range(0, len(toxic), BLOCK):
        low, high = np.searchsorted(owner, (first, first + BLOCK))
        at, row = place[flat[low:high]], owner[low:high] - first
        rows = np.zeros((min(BLOCK, len(toxic) - first), len(frequent)), dtype=np.float32)
        rows[row[at >= 0], at[at >= 0]] = 1
        marked = rows[toxic[first: first + BLOCK] > 0]
        both += rows.T @ rows
        bad += marked.T @ marked
    strength = chi_square(both.astype(np.float64), bad.astype(np.float64), len(toxic), toxic.sum())
    alone = np.diag(strength).copy()
    strength[(both < MIN_ROWS) | (strength < MIN_PAIR_CHI_SQUARE) | (strength <= 1.5 * np.maximum(alone[:, None], alone))] = 0
    found = np.flatnonzero(strength.max(1) > 0)
    return frequent[found], strength.max(1)[found]


def fit(toxic: np.ndarray, rows: list[np.ndarray], factors: int = FACTORS, rounds: int = 300, rate: float = 0.05,
        decay: float = 1e-4, seed: int = 7) -> Machine:
    """Feature choice, then full-gradient Adam steps, the gradient added up over blocks of rows. Without rows, or with one class only, scores follow the prior."""
    n, size = len(rows), 1 << BUCKET_BITS
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, dtype=np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    toxic = np.asarray(toxic, dtype=np.float64)
    prior = (toxic.sum() + 0.5) / (n + 1) if n else 0.05
    seen, bad = np.bincount(flat, minlength=size).astype(float), np.bincount(flat, toxic[owner] if n else None, minlength=size).astype(float)
    share = toxic.mean() if n else 0.0
    related = chi_square(seen, bad, n, toxic.sum())
    able = np.flatnonzero((seen >= MIN_ROWS) & (related >= MIN_CHI_SQUARE))
    together, strength = related_pairs(flat, owner, toxic, seen)
    ranked = np.concatenate((together[np.argsort(-strength, kind="stable")], able[np.argsort(-related[able], kind="stable")]))
    _, first = np.unique(ranked, return_index=True)
    chosen = ranked[np.sort(first)[:MAX_FEATURES]]
    feature_of = np.full(size, -1, dtype=np.int16)
    feature_of[chosen] = np.arange(len(chosen))

    kept = feature_of[flat] >= 0
    features, bounds = feature_of[flat[kept]].astype(np.int64), np.searchsorted(owner[kept], np.arange(n + 1))
    row = owner[kept]
    parameters = [np.array([np.log(prior / (1 - prior))]), np.zeros(len(chosen)),
                  np.random.default_rng(seed).normal(0, 0.05, (len(chosen), factors))]
    if n == 0 or share in (0.0, 1.0) or not len(chosen):
        return Machine(feature_of, float(parameters[0][0]), parameters[1], parameters[2])
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    for step in range(1, rounds + 1):
        gradients = [np.zeros(1), decay * parameters[1], decay * parameters[2]]
        for low in range(0, n, BLOCK):
            high = min(n, low + BLOCK)
            part, own = features[bounds[low]: bounds[high]], row[bounds[low]: bounds[high]] - low
            margin, sums = margins(parameters[0][0], parameters[1], parameters[2], part, bounds[low: high + 1] - bounds[low])
            error = (sigmoid(margin) - toxic[low:high]) / n
            each = error[own]
            pull = each[:, None] * (sums[own] - parameters[2][part])
            gradients[0] += error.sum()
            gradients[1] = gradients[1] + np.bincount(part, each, len(chosen))
            gradients[2] = gradients[2] + np.stack([np.bincount(part, pull[:, f], len(chosen)) for f in range(factors)], 1)
        for p, g, a, b in zip(parameters, gradients, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return Machine(feature_of, float(parameters[0][0]), parameters[1], parameters[2])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    toxic, buckets = [], []
    for r in training_rows(docs, labels, rows).toLocalIterator():
        toxic.append(r.toxic)
        buckets.append(np.frombuffer(r.buckets, dtype=np.uint32))
    return fit(np.array(toxic), buckets)


def text_scores(machine: Machine, column: pa.Array) -> np.ndarray:
    out = [np.zeros(0)]
    for _, _, data, offsets in slices(column):
        buckets, bounds = distinct_buckets(data, offsets)
        features = machine.feature_of[buckets].astype(np.int64)
        known = np.concatenate(([0], np.cumsum(features >= 0)))
        out.append(machine.scores(features[features >= 0], known[bounds]))
    return np.concatenate(out)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Per row `doc_id, held_out, score, predicted`. An empty or null text gets the score of no terms;
    repeated rows are scored each; a null id is treated as an empty one for the fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = text_scores(machine, batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: Machine, limit: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `limit`, all columns as they are, whatever their names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(text_scores(machine, pc.cast(batch["text"], pa.string())) < limit))
    return docs.mapInArrow(run, docs.schema)
