"""Byte-level BPE with the ranks of a vocabulary file, by merges in length-bucketed padded matrices.

A text is split by the tokenizer's pattern; the distinct pieces of a slice of rows are encoded once. Pieces that are tokens
as a whole are looked up. The others go into matrices by length, a row per piece, padded to the bucket's width. In
each round every row merges its leftmost pair of minimum rank: ranks come from a hashed pair table, the column that a merge frees is
closed up, and rows without a pair left are taken out. After a merge only the two pairs beside it are looked up again.

Pieces of more than `LONG` bytes are merged alone. A round there makes all merges of the minimum rank, from the left,
up to the first one that makes a pair of a lower rank, which is what one merge after the other would do.

A task holds the vocabulary, a slice of rows (`CHUNK_BYTES` of text, or one document if that is longer) and the pieces it
has seen, at most about `CACHED_TOKENS` tokens of them; there is no shuffle.
"""

import base64
import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmetrics.llm.words import mix, ranges, slices

LONG = 256
MATRIX_CELLS = 1 << 18
CACHED_TOKENS = 1 << 21
NONE = np.iinfo(np.int32).max
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Vocabulary(NamedTuple):
    ranks: dict[bytes, int]
    byte_ids: np.ndarray
    pair_keys: np.ndarray  # open addressing; the size is a power of two, at most a quarter is used
    pair_ids: np.ndarray
    data: np.ndarray  # the tokens' bytes, one after the other
    starts: np.ndarray  # by id, with an end mark
    known: np.ndarray

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the token that each pair makes, which is its rank; `NONE` if there is none, or an id is negative."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys = _pair_keys(left.ravel()[todo], right.ravel()[todo])
        mask = np.uint64(len(self.pair_keys) - 1)
        slot = mix(keys) & mask
        while len(todo):
            there = self.pair_keys[slot]
            hit = there == keys
            out.ravel()[todo[hit]] = self.pair_ids[slot[hit]]
            going = ~hit & (there != EMPTY)
            todo, keys, slot = todo[going], keys[going], (slot[going] + np.uint64(1)) & mask
        return out


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The ranks of a file of `base64(token) rank` lines; once per worker process. Every byte must be a token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    pairs = [(ranks[token[:k]], ranks[token[k:]], rank) for token, rank in ranks.items() for k in range(1, len(token))
             if token[:k] in ranks and token[k:] in ranks]
    left, right, ids = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
    size = 1 << max(4, int(4 * len(pairs)).bit_length())
    table, values, mask = np.full(size, EMPTY, dtype=np.uint64), np.zeros(size, dtype=np.int32), np.uint64(size - 1)
    keys = _pair_keys(left, right)
    slot, todo = mix(keys) & mask, np.arange(len(keys))
    while len(todo):
        free = np.flatnonzero(table[slot] == EMPTY)
        _, first = np.unique(slot[free], return_index=True)
        placed = free[first]
        table[slot[placed]], values[slot[placed]] = keys[todo[placed]], ids[todo[placed]]
        left_over = np.ones(len(todo), dtype=bool)
        left_over[placed] = False
        todo, slot = todo[left_over], (slot[left_over] + np.uint64(1)) & mask
    by_id: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    lengths = np.array([len(t) for t in by_id], dtype=np.int64)
    return Vocabulary(ranks, np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32), table, values,
                      np.frombuffer(b"".join(by_id), dtype=np.uint8), np.concatenate(([0], np.cumsum(lengths))), lengths > 0)


# --- splitting ------------------------------------------------------------------------------------------------------

class Splitter(NamedTuple):
    plain: regex.Pattern
    doubtful: re.Pattern | None  # characters whose class the two regex libraries may see differently
    exact: regex.Pattern

    def pieces(self, text: str) -> list[str]:
        return (self.exact if not text.isascii() and self.doubtful is not None and self.doubtful.search(text) else self.plain).findall(text)


@functools.lru_cache(maxsize=4)
def splitter(pattern: str = PATTERN) -> Splitter:
    """The pattern as the tokenizer library applies it.

    `regex` knows a newer Unicode than the library. Letters and numbers that Python's own tables do not know yet are shown to
    the library, alone; those it does not take for letters or numbers are taken out of the classes.
    """
    newer = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000)))))
             if unicodedata.category(c) == "Cn"]
    if not newer:
        return Splitter(regex.compile(pattern), None, regex.compile(pattern))
    ranks = {bytes([b]): b for b in range(256)}
    for k, token in enumerate(f"{before}{c}".encode() for c in newer for before in "a1"):
        ranks[token] = 256 + k
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    is_kind = {kind: {c for c in newer if len(probe.encode_ordinary(f"{before}{c}")) == 1} for kind, before in (("L", "a"), ("N", "1"))}
    known = {kind: rf"\p{{{kind}}}" for kind in is_kind}
    for kind, members in is_kind.items():
        if others := [c for c in newer if c not in members]:
            known[kind] = rf"[\p{{{kind}}}--[{_class(others)}]]"
    exact = regex.sub(r"\\p\{([LN])\}", lambda m: known[m[1]], pattern)
    return Splitter(regex.compile(pattern), re.compile(f"[{_class(newer)}]"), regex.compile(exact, regex.V1))


def _class(characters: list[str]) -> str:
    """A class of these characters, as ranges."""
    codes = np.unique([ord(c) for c in characters]) if characters else np.zeros(0, dtype=np.int64)
    new = np.flatnonzero(np.concatenate(([True], np.diff(codes) > 1))[: len(codes)])
    last = np.append(new[1:], len(codes)) - 1
    return "".join(rf"\U{codes[a]:08x}-\U{codes[b]:08x}" for a, b in zip(new, last, strict=True))


# --- merging --------------------------------------------------------------------------------------------------------

def merge_rows(words: Vocabulary, tokens: np.ndarray) -> list[np.ndarray]:
    """Final ids of each row of a padded (-1) matrix of byte ids."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(tokens)
    rows, ranks = np.arange(len(tokens)), words.merged(tokens[:, :-1], tokens[:, 1:])
    while len(rows):
        if ranks.shape[1]:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            going = best != NONE
        else:
            going = np.zeros(len(rows), dtype=bool)
        for row, ids in zip(rows[~going].tolist(), tokens[~going], strict=True):
            out[row] = ids[ids >= 0]
        if not going.any():
            break
        rows, tokens, ranks, at, best = rows[going], tokens[going], ranks[going], at[going], best[going]
        each, column = np.arange(len(rows)), np.arange(tokens.shape[1] - 1)
        tokens = np.where(column > at[:, None], tokens[:, 1:], tokens[:, :-1])
        tokens[each, at] = best
        ranks = np.where(column[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
        for place in (at - 1, at):
            there = np.flatnonzero((place >= 0) & (place < ranks.shape[1]))
            ranks[there, place[there]] = words.merged(tokens[there, place[there]], tokens[there, place[there] + 1])
    return out


def merge_long(words: Vocabulary, tokens: np.ndarray) -> np.ndarray:
    """Final ids of one long row of byte ids."""
    ranks = words.merged(tokens[:-1], tokens[1:])
    while len(ranks) and (best := ranks.min()) != NONE:
        at = np.flatnonzero(ranks == best)
        new = np.concatenate(([True], np.diff(at) > 1))
        at = at[(at - at[new][np.cumsum(new) - 1]) % 2 == 0]  # of pairs that overlap, every other one from the left
        beside = np.concatenate(([False], np.diff(at) == 2))
        before = np.where(beside, best, np.where(at > 0, tokens[at - 1], -1))
        after = np.where(at + 2 < len(tokens), tokens[np.minimum(at + 2, len(tokens) - 1)], -1)
        same = np.full(len(at), best, dtype=np.int32)
        lower = (words.merged(before, same) < best) | (words.merged(same, after) < best)
        if lower.any():
            at = at[: lower.argmax() + 1]
        tokens = tokens.copy()
        tokens[at] = best
        tokens, ranks = np.delete(tokens, at + 1), np.delete(ranks, at)
        place = at - np.arange(len(at))
        place = np.unique(np.concatenate((place - 1, place)))
        place = place[(place >= 0) & (place < len(ranks))]
        ranks[place] = words.merged(tokens[place], tokens[place + 1])
    return tokens


def encode_pieces(words: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of each piece."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        rank = words.ranks.get(piece)
        if rank is not None:
            out[k] = np.array([rank], dtype=np.int32)
        elif len(piece) > LONG:
            out[k] = merge_long(words, words.byte_ids[np.frombuffer(piece, dtype=np.uint8)])
        elif piece:
            buckets.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
    for width, members in buckets.items():
        for first in range(0, len(members), max(1, MATRIX_CELLS // width)):
            some = members[first: first + max(1, MATRIX_CELLS // width)]
            size = np.array([len(pieces[k]) for k in some])
            tokens = np.full((len(some), width), -1, dtype=np.int32)
            tokens[np.arange(width) < size[:, None]] = words.byte_ids[np.frombuffer(b"".join(pieces[k] for k in some), dtype=np.uint8)]
            for k, ids in zip(some, merge_rows(words, tokens), strict=True):
                out[k] = ids
    return out


class Numbers(dict):
    """Numbers new keys in the order in which they are asked for, and lists those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        self.fresh.append(key)
        self[key] = number = len(self)
        return number


class Encoder:
    """Encodes texts, each distinct piece once; forgets the pieces when they hold too many tokens."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.words, self.splitter = vocabulary(path), splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.ids, self.starts = Numbers(), np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text."""
        if len(self.ids) > CACHED_TOKENS:
            self.forget()
        found = [self.splitter.pieces(text) for text in texts]
        numbers = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(found)), dtype=np.int64)
        if self.numbers.fresh:
            new = encode_pieces(self.words, [piece.encode() for piece in self.numbers.fresh])
            self.numbers.fresh = []
            self.ids = np.concatenate((self.ids, *new))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum([len(x) for x in new])))
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)]
        return self.ids[ranges(self.starts[numbers], sizes)], bounds


def decoded(words: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids' bytes, and the bounds of each id's. An id that names no token is an error."""
    if len(ids) and not (ids.min() >= 0 and ids.max() < len(words.known) and words.known[ids].all()):
        raise ValueError("an id names no token")
    sizes = words.starts[ids + 1] - words.starts[ids]
    return words.data[ranges(words.starts[ids], sizes)], np.concatenate(([0], np.cumsum(sizes)))


# --- tables ---------------------------------------------------------------------------------------------------------

def encode(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """Per row of `docs`: `doc_id, ids` (array of int) of the whole text, without special tokens.

    `path` names the vocabulary on every machine. A null or empty text has no ids; repeated rows are encoded each; an
    empty table gives an empty result; other columns of `docs` are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for first, end, data, offsets in slices(batch["text"]):
                raw = data.tobytes()
                ids, bounds = encoder.encode([raw[a:b].decode() for a, b in itertools.pairwise(offsets.tolist())])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, end - first), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))],
                                                 names=["doc_id", "ids"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of `encoded`: `doc_id, ids, bytes`. Null ids are none; an id that names no token is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for whole in batches:
            for first in range(0, len(whole), 256):
                batch = whole.slice(first, 256)
                column = batch["ids"].fill_null([])
                bounds = np.asarray(column.offsets).astype(np.int64)
                data, places = decoded(words, np.asarray(column.flatten()).astype(np.int64))
                places = places[bounds - bounds[0]]
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([batch["doc_id"], column, pa.array([raw[a:b] for a, b in itertools.pairwise(places.tolist())], pa.binary())],
                                                 names=["doc_id", "ids", "bytes"])
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, bytes binary")
