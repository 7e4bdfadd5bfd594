"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Their votes are counted by pattern over the whole
corpus; expectation-maximisation over the pattern counts estimates how often each labeller is right on good and on
bad documents, without any gold label. The posteriors label a hashed linear scorer, which also judges documents
on which the labellers say nothing.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmetrics.llm.label_model import LabelModel, estimate, sigmoid
from haulmetrics.llm.toxicity import row_sums
from haulmetrics.llm.words import NON_SPACE, LOWER, prefix_sums, slices, span_hashes, word_spans
from haulmetrics.plans.staging import stage

BUCKET_BITS = 18
TRAIN_ROWS = 16_384
BAD, GOOD, NONE = 0, 1, 2  # as the label model's no, yes and no vote

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
PLAIN = LETTER | ~NON_SPACE
PLAIN[48:58] = True
PLAIN[[ord(c) for c in ".,;:!?'\"()-"]] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
ENDS = np.zeros(256, dtype=bool)
ENDS[[ord(c) for c in ".!?"]] = True


def _bad(flags: np.ndarray) -> np.ndarray:
    return np.where(flags, BAD, NONE)


def _good(flags: np.ndarray) -> np.ndarray:
    return np.where(flags, GOOD, NONE)


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A column of votes per labeller; rows without words get a bad vote for length and none else.

    Labellers of bad documents: odd symbols, words that end in a doubled symbol, capitals, words without letters,
    repeated words, repeated lines, no words. Labeller of good ones: running text with a usual share of sentence ends
    and of new words.
    """
    rows = len(offsets) - 1
    starts, ends, bounds = word_spans(data, offsets, NON_SPACE)
    n = np.diff(bounds)
    count = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[data])))[offsets])
    size, letters = np.diff(offsets), count(LETTER)
    sums = prefix_sums(data)
    letter_sums = np.concatenate(([0], np.cumsum(LETTER[data])))
    word_row = np.repeat(np.arange(rows), n)
    share = lambda flags: np.bincount(word_row, flags, minlength=rows) / np.maximum(n, 1)
    last, before = ends - 1, np.maximum(ends - 2, starts)
    doubled = (ends - starts > 1) & (data[last] == data[before]) & ~LETTER[data[last]] & ~DIGIT[data[last]]
    repeats = _repeated(word_row, span_hashes(sums, starts, ends), rows)
    not_newline = np.ones(256, dtype=bool)
    not_newline[10] = False
    line_starts, line_ends, line_bounds = word_spans(data, offsets, not_newline)
    lines = np.diff(line_bounds)
    line_repeats = _repeated(np.repeat(np.arange(rows), lines), span_hashes(sums, line_starts, line_ends), rows)
    sentence_ends = share(ENDS[data[last]])
    return np.stack([
        _bad((n > 0) & (count(PLAIN) < 0.95 * size)),
        _bad(share(doubled) > 0.2),
        _bad((letters > 0) & (count(UPPER) > 0.4 * letters)),
        _bad((n > 0) & (share(letter_sums[ends] == letter_sums[starts]) > 0.15)),
        _bad((n >= 20) & (repeats > 0.85 * n)),
        _bad((lines >= 4) & (line_repeats > 0.3 * lines)),
        _bad(n < 1),
        _good((n >= 1) & ((n < 20) | (sentence_ends > 0.01) & (sentence_ends < 0.5)) & (share(doubled) < 0.05) & (repeats < 0.75 * n)),
    ], 1).astype(np.int64)


def _repeated(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Per row, how many of its items repeat an earlier one."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    again = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    return np.bincount(row[1:], again, minlength=rows)


LABELLERS = 8
POWERS = 3 ** np.arange(LABELLERS)


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each row's words and of their last three bytes, with the share of each; and row bounds."""
    lowered = LOWER[data]
    starts, ends, bounds = word_spans(lowered, offsets, NON_SPACE)
    sums = prefix_sums(lowered)
    tails = span_hashes(sums, np.maximum(starts, ends - 3), ends) * np.uint64(0x9E3779B97F4A7C15)
    hashes = np.concatenate((span_hashes(sums, starts, ends), tails))
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(bounds))
    keys, counts = np.unique((np.concatenate((row, row)) << np.uint64(BUCKET_BITS)) | (hashes >> np.uint64(64 - BUCKET_BITS)), return_counts=True)
    first = np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(BUCKET_BITS))
    norm = np.sqrt(np.maximum(row_sums(counts.astype(float) ** 2, first), 1))
    return (keys & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64), counts / np.repeat(norm, np.diff(first)), first


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [votes(data, offsets) @ POWERS for _, _, data, offsets in slices(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(out) if out else np.zeros(0, dtype=np.int64))], names=["doc_id", "pattern"])


class Scorer(NamedTuple):
    bias: float
    weights: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for _, _, data, offsets in slices(column):
            buckets, values, bounds = hashed(data, offsets)
            out.append(sigmoid(self.bias + row_sums(self.weights[buckets] * values, bounds)))
        return np.concatenate(out)


def fit(target: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels by full-gradient Adam steps; without rows everything scores a half."""
    size = 1 << BUCKET_BITS
    bias, weights = np.zeros(1), np.zeros(size)
    if not rows:
        return Scorer(0.0, weights)
    buckets, values = np.concatenate([b for b, _ in rows]), np.concatenate([v for _, v in rows])
    bounds = np.concatenate(([0], np.cumsum([len(b) for b, _ in rows])))
    used, local = np.unique(buckets, return_inverse=True)
    parameters = [bias, np.zeros(len(used))]
    row, first, second = np.repeat(np.arange(len(rows)), np.diff(bounds)), [0.0, 0.0], [0.0, 0.0]
    for step in range(1, rounds + 1):
        error = (sigmoid(parameters[0] + row_sums(parameters[1][local] * values, bounds)) - target) / len(rows)
        for k, g in enumerate((np.array([error.sum()]), np.bincount(local, error[row] * values, len(used)) + decay * parameters[1])):
            first[k] = first[k] + 0.1 * (g - first[k])
            second[k] = second[k] + 0.001 * (g * g - second[k])
            parameters[k] = parameters[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-9)
    weights[used] = parameters[1]
    return Scorer(float(parameters[0][0]), weights)


def label(docs: DataFrame) -> tuple[DataFrame, LabelModel]:
    """`doc_id, pattern` of every row, written to the shared folder, and the label model of all patterns."""
    cast = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                 .mapInArrow(_vote_rows, "doc_id long, pattern long"), "quality-votes")
    return cast, estimate({r.pattern: r.n for r in cast.groupBy("pattern").agg(F.count("*").alias("n")).toLocalIterator()}, LABELLERS)


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row `doc_id, posterior, score, good`: the label model's and the scorer's chance that it is good.

    The scorer learns from about `train_rows` rows, chosen by a hash of text and id; votes, their counts and scores
    cover all rows. A text without words has a bad vote and the scorer's bias; repeated rows are judged each;
    an empty table gives an empty result.
    """
    _, model = label(docs)
    total = docs.count()
    share = int(min(1.0, train_rows / max(1, total)) * (1 << 30))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch["text"]):
                buckets, values, bounds = hashed(data, offsets)
                chance = model.posterior[votes(data, offsets) @ POWERS]
                cut = [slice(bounds[k], bounds[k + 1]) for k in range(end - first)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(chance), pa.array([buckets[c].astype(np.uint32).tobytes() for c in cut], pa.binary()),
                    pa.array([values[c].astype(np.float32).tobytes() for c in cut], pa.binary())], names=["chance", "buckets", "shares"])

    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id", "text"), F.lit(1 << 30)) < share)
    target, features = [], []
    for r in drawn.mapInArrow(train, "chance double, buckets binary, shares binary").toLocalIterator():
        target.append(r.chance)
        features.append((np.frombuffer(r.buckets, dtype=np.uint32), np.frombuffer(r.shares, dtype=np.float32)))
    scorer = fit(np.array(target), features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = [votes(data, offsets) @ POWERS for _, _, data, offsets in slices(batch["text"])]
            scores = scorer.scores(batch["text"])
            chance = model.posterior[np.concatenate(patterns)] if patterns else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(chance), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                                             names=["doc_id", "posterior", "score", "good"])

    return rows.mapInArrow(run, "doc_id long, posterior double, score double, good int")
