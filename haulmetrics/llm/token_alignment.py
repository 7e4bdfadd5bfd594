"""Alignment of two tokenizers' tokens, byte for byte, with counts of aligned id pairs over all documents.

A is a byte-level BPE of the `tokenizers` library, B a sentencepiece model, which puts a space before a text itself; so both
are shown the text with one space before it. The libraries' spans (characters of A, bytes of B's proto) are the coarse
cuts: places where one token's span ends and the next one's does not begin before. Between two coarse cuts stand the
tokens that share a character, bytes of a character's fallback, and B's own space, which has an empty span; there the
lengths of the tokens' decoded bytes say where each ends. Where the two do not agree at every coarse cut the tokens do not
spell the text, and the document has none.

Neither tokenizer merges over the place between a character that is no white space and a space before a word, between a letter
and a mark that no piece of B holds behind a letter, or between a single line's end and a letter. Texts are cut there into
segments, and the distinct segments of a task are encoded, refined and grouped once. B sees a segment that begins with no
space behind a line's end, whose tokens are left out again.

Counts: a slice of documents gives each id pair it holds once, with its number. These are added up over all slices, compared by B id
(at most as many rows as A has ids), and sent back to the slices that hold the pair, each pair as one row per slice. So a pair that
every document holds is no larger in any join than the number of slices. Nothing passes through the driver.
"""

import functools
import itertools
import os
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmetrics.llm.byte_bpe import Numbers
from haulmetrics.llm.words import CHUNK_BYTES, ranges, slices
from haulmetrics.plans.staging import stage

SPACE = "▁"
CACHED_TOKENS = 1 << 21

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"  # letters in every version of Unicode
MARKS = ",.;:!?#$%)\n"

#: Before a space, behind a character that no version of Unicode calls white space and that is not B's sign for a space;
#: not before spaces that end in other white space or in the end of the text.
BEFORE_SPACE = rf"(?<=[^\s\u180e{SPACE}])(?= +\S)"


class Spans(NamedTuple):
    """Tokens of several texts, one after the other: ids, coarse begins and ends (bytes, from the first text's first), tokens per text."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    sizes: np.ndarray


class Coder(NamedTuple):
    """One tokenizer: spans of texts, and the bytes of its ids."""

    spans: Callable[[list[str], np.ndarray, np.ndarray], Spans]
    data: np.ndarray
    starts: np.ndarray

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.starts[ids + 1] - self.starts[ids]


def coder(spans: Callable[[list[str], np.ndarray, np.ndarray], Spans], token_bytes: list[bytes]) -> Coder:
    if not all(token_bytes):
        raise ValueError("every token must stand for at least one byte")
    return Coder(spans, np.frombuffer(b"".join(token_bytes), dtype=np.uint8), np.cumsum([0, *map(len, token_bytes)]))


def byte_of_sign() -> dict[str, int]:
    """The signs that byte-level vocabularies write bytes with: printable bytes are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(printable))
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def _flat(values: Iterable[Iterable[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(values), dtype=np.int64)


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> Coder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    model = tokenizers.Tokenizer.from_file(path)
    model.encode_special_tokens = True
    sign, vocabulary = byte_of_sign(), model.get_vocab()
    token_bytes = [b"?"] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        token_bytes[i] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()

    def spans(texts: list[str], data: np.ndarray, starts: np.ndarray) -> Spans:
        found = model.encode_batch(texts, add_special_tokens=False)
        ids = [x.ids for x in found]
        at = _flat(itertools.chain.from_iterable(x.offsets for x in found)).reshape(-1, 2)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        # characters to bytes
        begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        at = begins[at + np.repeat(np.searchsorted(begins, starts[:-1]), sizes)[:, None]]
        return Spans(_flat(ids), at[:, 0], at[:, 1], sizes)
    return coder(spans, token_bytes)


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Coder:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE in name.lstrip(SPACE) for name in names):
        raise ValueError("a piece holds a space behind another character, so texts cannot be cut before spaces")
    line_end = np.array(model.encode("\n"), dtype=np.int64)
    token_bytes = [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)]

    def spans(texts: list[str], data: np.ndarray, starts: np.ndarray) -> Spans:
        # the model puts the first space itself; its spans count from behind it, and each begins where the last one ended
        inner = np.array([not text.startswith(" ") for text in texts], dtype=bool)
        found = [x.pieces for x in model.encode([text[1:] if text[0] == " " else "\n" + text for text in texts], return_type="proto", num_threads=1)]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        ids = np.array([p.id for x in found for p in x], dtype=np.int64)
        end = np.array([p.end for x in found for p in x], dtype=np.int64) + np.repeat(starts[:-1] + np.where(inner, -1, 1), sizes)
        if inner.any():
            place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = (place >= len(line_end)) | ~np.repeat(inner, sizes)
            if (ids[~kept] != np.tile(line_end, int(inner.sum()))).any():
                raise ValueError("a line's end is no token of its own")
            ids, end, sizes = ids[kept], end[kept], sizes - len(line_end) * inner
        begin = np.concatenate(([0], end[:-1]))[: len(end)]
        begin[(np.cumsum(sizes) - sizes)[sizes > 0]] = starts[:-1][sizes > 0]
        return Spans(ids, begin, end, sizes)
    return coder(spans, token_bytes)


@functools.lru_cache(maxsize=4)
def cutter(path: str) -> re.Pattern:
    """Where texts are cut for the sentencepiece model in `path`."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    marks = [m for m in MARKS if not any(re.search(rf"[{LETTERS}]{re.escape(m)}", name) for name in names if m in name)]
    after_line = [rf"(?<=[^\s\u180e]\n)(?=[{LETTERS}])"] if not any("\n" in name for name in names) else []
    behind_letter = [rf"(?<=[{LETTERS}])(?=[{re.escape(''.join(marks))}])"] if marks and after_line else []
    return re.compile("|".join([BEFORE_SPACE, *after_line, *behind_letter]))


def refined(tokenizer: Coder, spans: Spans, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte at which each token ends, and whether each text is spelled by its tokens."""
    text = np.repeat(np.arange(len(spans.sizes)), spans.sizes)
    lengths = tokenizer.lengths(spans.ids)
    summed = np.concatenate(([0], np.cumsum(lengths)))
    bounds = np.concatenate(([0], np.cumsum(spans.sizes)))
    ends = summed[1:] - summed[bounds[:-1]][text] + starts[:-1][text]
    # a span that is empty, or that the next token's overlaps, is no cut: its token ends where its decoded bytes do
    last = np.append(text[1:] != text[:-1], True)[: len(text)]
    coarse = (last | (np.append(spans.begin[1:], 0) >= spans.end)) & (spans.end > spans.begin)
    spelled = summed[bounds[1:]] - summed[bounds[:-1]] == np.diff(starts)
    spelled[text[coarse & (ends != spans.end)]] = False
    sure = np.flatnonzero(spelled[text])
    at = ranges(tokenizer.starts[spans.ids[sure]], lengths[sure])
    differs = tokenizer.data[at] != data[ranges((ends - lengths)[sure], lengths[sure])]
    spelled[np.repeat(text[sure], lengths[sure])[differs]] = False
    return ends, spelled


NOTHING = np.zeros(0, dtype=np.int64)


class Aligner:
    """Aligns texts, each distinct segment once; forgets the segments when they hold too many tokens.

    Segments are rows of flat arrays with start marks: A's ids, B's ids, and the groups, each with the number of tokens up
    to its end and the two ids that end it, which are its link.
    """

    def __init__(self, a_path: str, b_path: str):
        self.coders, self.cutter = (byte_level(a_path), pieces(b_path)), cutter(b_path)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.texts, self.spelled = Numbers(), [], np.zeros(0, dtype=bool)
        self.ids, self.starts = [NOTHING, NOTHING], [np.zeros(1, dtype=np.int64) for _ in range(2)]
        self.cuts, self.links, self.group_starts = [NOTHING, NOTHING], NOTHING, np.zeros(1, dtype=np.int64)

    def segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all segments, and the bounds of each text's. An empty text has no segment."""
        if sum(map(len, self.ids)) > CACHED_TOKENS:
            self.forget()
        found = [self.cutter.split(" " + text) if text else [] for text in texts]
        numbers = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(found)), dtype=np.int64)
        new, self.numbers.fresh = self.numbers.fresh, []
        for first in range(0, len(new), 16384):
            self._add(new[first: first + 16384])
        return numbers, np.cumsum([0, *map(len, found)])

    def _add(self, texts: list[str]) -> None:
        raw = [text.encode() for text in texts]
        data, starts = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
        found = [c.spans(texts, data, starts) for c in self.coders]
        (a_ends, a_ok), (b_ends, b_ok) = (refined(c, f, data, starts) for c, f in zip(self.coders, found, strict=True))
        spelled = a_ok & b_ok
        ids, ends = [], []
        for f, e, side in zip(found, (a_ends, b_ends), range(2), strict=True):
            kept = np.repeat(spelled, f.sizes)
            ids.append(f.ids[kept])
            ends.append(e[kept])
            sizes = np.where(spelled, f.sizes, 0)
            self.starts[side] = np.concatenate((self.starts[side], self.starts[side][-1] + np.cumsum(sizes)))
            self.ids[side] = np.concatenate((self.ids[side], ids[side]))
        common = np.intersect1d(*ends, assume_unique=True)
        owner = np.searchsorted(starts, common) - 1
        cuts = [np.searchsorted(e, common) + 1 for e in ends]
        groups = np.bincount(owner, minlength=len(texts))
        signs = [list(map(str, i.tolist())) for i in ids]
        edges = [itertools.pairwise([0, *c.tolist()]) for c in cuts]
        written = [f"{','.join(signs[0][p:q]) if q - p > 1 else signs[0][p]}|{','.join(signs[1][r:s]) if s - r > 1 else signs[1][r]}" for (p, q), (r, s) in zip(*edges, strict=True)]
        bounds = np.concatenate(([0], np.cumsum(groups)))
        self.texts += [";".join(written[p:q]) for p, q in itertools.pairwise(bounds.tolist())]
        for side in range(2):
            here = self.starts[side][-len(texts) - 1: -1] - self.starts[side][-len(texts) - 1]
            self.cuts[side] = np.concatenate((self.cuts[side], cuts[side] - here[owner]))
        self.links = np.concatenate((self.links, (ids[0][cuts[0] - 1] << 32) + ids[1][cuts[1] - 1]))
        self.group_starts = np.concatenate((self.group_starts, self.group_starts[-1] + bounds[1:]))
        self.spelled = np.concatenate((self.spelled, spelled))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


ALIGNED_SCHEMA = ("slice long, doc_id long, a array<int>, b array<int>, cuts_a array<int>, cuts_b array<int>, groups string, "
                  "n_a long, n_b long, n_groups long, n_links long, links binary, pair_a array<int>, pair_b array<int>, pair_n array<long>")
ALIGNED = pa.schema([("slice", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.list_(pa.int32())) for c in ("a", "b", "cuts_a", "cuts_b")], ("groups", pa.string()),
                     *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("links", pa.binary()),
                     ("pair_a", pa.list_(pa.int32())), ("pair_b", pa.list_(pa.int32())), ("pair_n", pa.list_(pa.int64()))])


def _aligned_rows(a_path: str, b_path: str, tokens: bool, chunk_bytes: int):
    """A row per document, and one per slice with the id pairs of its links; a document's links are places in that list."""
    def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))

    def one(kind: pa.DataType, values: np.ndarray) -> pa.Array:
        return pa.array([values], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            for first, end, data, offsets in slices(batch["text"], chunk_bytes):
                raw, n = data.tobytes(), end - first
                numbers, bounds = aligner.segments([raw[x:y].decode() for x, y in itertools.pairwise(offsets.tolist())])
                spelled = sums(~aligner.spelled[numbers], bounds) == 0
                numbers = numbers[np.repeat(spelled, np.diff(bounds))]
                bounds = np.concatenate(([0], np.cumsum(np.where(spelled, np.diff(bounds), 0))))
                used, at = np.unique(numbers, return_inverse=True)
                start, size = aligner.group_starts[used], aligner.group_starts[used + 1] - aligner.group_starts[used]
                pairs, place = np.unique(aligner.links[ranges(start, size)], return_inverse=True)
                place, begin = place.astype("<u4"), np.cumsum(size) - size
                links = place[ranges(begin[at], size[at])]
                n_links = sums(size[at], bounds)
                texts, counts, arrays = aligner.texts, [], [pa.nulls(n, pa.list_(pa.int32()))] * 4
                for side in range(2):
                    its, starts = aligner.ids[side], aligner.starts[side]
                    sizes = starts[numbers + 1] - starts[numbers]
                    counts.append(sums(sizes, bounds))
                    if tokens:
                        before = np.cumsum(sizes) - sizes
                        ends = np.concatenate(([0], np.cumsum(counts[side])))
                        cuts = aligner.cuts[side][ranges(start[at], size[at])] + np.repeat(before - np.repeat(ends[:-1], np.diff(bounds)), size[at])
                        arrays[side] = lists(its[ranges(starts[numbers], sizes)], ends)
                        arrays[side + 2] = lists(cuts, np.concatenate(([0], np.cumsum(n_links))))
                listed, flat = numbers.tolist(), links.tobytes()
                edges = np.concatenate(([0], np.cumsum(4 * n_links))).tolist()
                key = batch["slice"][first: first + 1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, key[0].as_py(), dtype=np.int64)), batch["doc_id"].slice(first, n), *arrays,
                    pa.array([";".join([texts[k] for k in listed[x:y]]) for x, y in itertools.pairwise(bounds.tolist())], pa.string()),
                    *[pa.array(c.astype(np.int64)) for c in (*counts, n_links, n_links)],
                    pa.array([flat[x:y] for x, y in itertools.pairwise(edges)], pa.binary()), *[pa.nulls(n, kind) for kind in ALIGNED.types[-3:]],
                ], schema=ALIGNED)
                yield pa.RecordBatch.from_arrays([
                    key, *[pa.nulls(1, kind) for kind in ALIGNED.types[1:-3]], one(ALIGNED.types[-3], (pairs >> 32).astype(np.int32)),
                    one(ALIGNED.types[-2], (pairs & 0xFFFFFFFF).astype(np.int32)), one(ALIGNED.types[-1], np.bincount(links, minlength=len(pairs))),
                ], schema=ALIGNED)
    return run


def _rows(docs: DataFrame) -> DataFrame:
    # a slice is named by its first row
    return docs.select(F.monotonically_increasing_id().alias("slice"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of `docs`: `doc_id, a, b` (ids), `cuts_a, cuts_b` (number of ids up to the end of each group), `groups` (as text).

    Null and empty texts, and those that the tokens of A or B do not spell byte for byte, have empty arrays. Repeated rows
    are aligned each; an empty table gives an empty result; other columns are not looked at. The paths are those of each machine.
    """
    found = _rows(docs).mapInArrow(_aligned_rows(a_path, b_path, True, chunk_bytes), ALIGNED_SCHEMA)
    return found.filter("n_a IS NOT NULL").select("doc_id", "a", "b", "cuts_a", "cuts_b", "groups")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """`a, b, total, is_best` from `a, b, n` rows: links that hold the pair, and whether no other pair of that B id has more."""
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    return totals.withColumn("is_best", F.col("total") == F.max("total").over(Window.partitionBy("b")))


REPORT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _report_rows(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    place = np.asarray(pairs["place"])
    total, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
    total[place], best[place] = np.asarray(pairs["total"]), np.asarray(pairs["is_best"]).astype(np.int64)
    links = [np.frombuffer(x, dtype="<u4") for x in docs["links"].to_pylist()]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    return pa.table([*[docs[c] for c in names], pa.array([int(best[x].sum()) for x in links], pa.int64()),
                     pa.array([int(total[x].sum()) for x in links], pa.int64()), docs["groups_sha256"]],
                    names=[*names, "n_best", "count_sum", "groups_sha256"])


def report(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of `docs`: `doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`, counts over all of `docs`.

    Rows without tokens (see `align`) have zeros and an empty hash.
    """
    found = _rows(docs).mapInArrow(_aligned_rows(a_path, b_path, False, chunk_bytes), ALIGNED_SCHEMA)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = stage(found.select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "links", digest.alias("groups_sha256"), "pair_a", "pair_b", "pair_n"), "aligned")
    pairs = found.filter("pair_n IS NOT NULL").select("slice", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("place", "pair")).select(
        "slice", "place", F.col("pair.pair_a").alias("a"), F.col("pair.pair_b").alias("b"), F.col("pair.pair_n").alias("n"))
    scored = pairs.drop("n").join(pair_counts(pairs.select("a", "b", "n")), ["a", "b"]).select(F.col("slice").alias("at"), "place", "total", "is_best")
    rows = found.filter("pair_n IS NULL").select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "links", "groups_sha256")
    return rows.groupBy("slice").cogroup(scored.groupBy("at")).applyInArrow(_report_rows, REPORT_SCHEMA)
