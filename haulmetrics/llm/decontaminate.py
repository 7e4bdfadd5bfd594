"""Benchmark decontamination with a distributed positional inverted index.

`build_index` stores, per document, the postings of every term that occurs in a test item: distinct terms,
and their word positions. `search` reads the index and intersects, for each window of test words, the posting
lists from the rarest term on, each shifted by the term's offset in the window; what is left are exact phrase
matches. Windows whose three rarest terms lie within `slop` words of each other are reported as proximity matches.

The index is cut by document: a term that fills a third of the corpus is spread like the documents are, and
nothing but the term counts (one row per test term) is shuffled. Test items are handled in blocks of at most
`BLOCK_WORDS` words, so what every task holds is bounded however large the benchmark is.
"""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmetrics.llm.words import ALPHANUMERIC, ranges, slices, words
from haulmetrics.plans.staging import stage

WINDOW = 10
SLOP = 30
BLOCK_WORDS = 250_000
RAREST = 3
INDEX_SCHEMA = "doc_id long, n_words long, terms binary, counts binary, positions binary"
MATCH_SCHEMA = "doc_id long, n_words long, hit binary, phrase_items binary, near_items binary"


class Windows(NamedTuple):
    """Distinct windows of a block of items; window `w` has the terms `terms[first[w]:first[w + 1]]`."""

    vocabulary: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    by_rarity: np.ndarray
    items: np.ndarray
    items_first: np.ndarray


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, streamed through the driver."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id").toLocalIterator():
        n = len(row.text) // 2 + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    if block:
        yield block


def item_words(block: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    out = []
    for first, end, data, offsets in slices(pa.array([t for _, t in block], pa.large_string())):
        hashes, bounds = words(data, offsets, ALPHANUMERIC)
        out += [(block[first + k][0], hashes[bounds[k]: bounds[k + 1]]) for k in range(end - first)]
    return out


def windows_of(items: list[tuple[int, np.ndarray]], counts: dict[int, int], width: int) -> Windows:
    vocabulary = np.unique(np.concatenate([w for _, w in items]))
    frequency = np.array([counts.get(int(h.view(np.int64)), 0) for h in vocabulary], dtype=np.int64)
    owners: dict[bytes, set[int]] = {}
    for item, hashes in items:
        ids = np.searchsorted(vocabulary, hashes).astype(np.int64)
        for start in range(max(1, len(ids) - width + 1) if len(ids) else 0):
            owners.setdefault(ids[start: start + width].tobytes(), set()).add(item)
    parts = [np.frombuffer(k, dtype=np.int64) for k in owners]
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    terms = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    by_rarity = np.concatenate([np.argsort(frequency[p], kind="stable") for p in parts]) if parts else terms
    items_first = np.concatenate(([0], np.cumsum([len(o) for o in owners.values()]))).astype(np.int64)
    owned = np.array([i for o in owners.values() for i in sorted(o)], dtype=np.int64)
    return Windows(vocabulary, terms, first, by_rarity, owned, items_first)


def term_ids(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted vocabulary, or -1."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def _postings(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch["text"]):
                hashes, bounds = words(data, offsets, ALPHANUMERIC)
                ids = term_ids(vocabulary, hashes)
                at = np.flatnonzero(ids >= 0)
                doc = np.searchsorted(bounds, at, "right") - 1
                order = np.lexsort((at, ids[at], doc))
                at, doc = at[order], doc[order]
                term = ids[at]
                new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])))) if len(at) else at
                size = np.diff(np.append(new, len(at)))
                lists = np.searchsorted(doc[new], np.arange(end - first + 1))
                edge = np.append(new, len(at))[lists]
                position = (at - bounds[doc]).astype(np.uint32)
                term, size = term[new].astype(np.uint32), size.astype(np.uint32)
                rows = range(end - first)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(first, end - first).cast(pa.int64()),
                    pa.array(np.diff(bounds)),
                    pa.array([term[lists[k]: lists[k + 1]].tobytes() for k in rows], pa.binary()),
                    pa.array([size[lists[k]: lists[k + 1]].tobytes() for k in rows], pa.binary()),
                    pa.array([position[edge[k]: edge[k + 1]].tobytes() for k in rows], pa.binary()),
                ], names=["doc_id", "n_words", "terms", "counts", "positions"])
    return run


def build_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The postings of the vocabulary's terms, one row per document, written to the shared folder."""
    return stage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                 .mapInArrow(_postings(vocabulary), INDEX_SCHEMA), "positional-index")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = np.frombuffer(b"".join(batch["terms"].to_pylist()), dtype=np.uint32)
        sizes = np.frombuffer(b"".join(batch["counts"].to_pylist()), dtype=np.uint32)
        totals = np.bincount(terms, sizes).astype(np.int64) if len(terms) else np.zeros(0, dtype=np.int64)
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found])], names=["term", "n"])


def term_frequencies(index: DataFrame) -> dict[int, int]:
    """Occurrences of each term in the whole corpus; one row per test term."""
    rows = index.select("terms", "counts").mapInArrow(_frequencies, "term long, n long")
    return {r.term: r.n for r in rows.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}


def phrase_starts(windows: Windows, keys: np.ndarray, listed: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and the word positions at which they start.

    `keys` are the sorted postings `term * stride + position` and `listed` the start of each term's list. The
    list of a window's rarest term gives the candidates; each further list, rarest first, is shifted by the
    term's offset and intersected with them.
    """
    lengths = np.diff(windows.first)
    rarest = windows.first[:-1] + windows.by_rarity[windows.first[:-1]]
    term = windows.terms[rarest]
    size = listed[term + 1] - listed[term]
    window = np.repeat(np.arange(len(lengths)), size)
    start = keys[ranges(listed[term], size)] - np.repeat(term * stride + (rarest - windows.first[:-1]), size)
    alive = start >= 0
    window, start = window[alive], start[alive]
    for step in range(1, int(lengths.max(initial=0))):
        longer = np.flatnonzero(lengths[window] > step)
        offset = windows.by_rarity[windows.first[window[longer]] + step]
        wanted = windows.terms[windows.first[window[longer]] + offset] * stride + start[longer] + offset
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        keep = np.ones(len(window), dtype=bool)
        keep[longer] = keys[at] == wanted if len(keys) else False
        window, start = window[keep], start[keep]
    return window, start


def near_windows(windows: Windows, keys: np.ndarray, listed: np.ndarray, stride: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of three terms or more, and positions of their rarest term with the next two within `slop` words."""
    lengths = np.diff(windows.first)
    able = np.flatnonzero(lengths >= RAREST)
    picks = [windows.terms[windows.first[able] + windows.by_rarity[windows.first[able] + k]] for k in range(RAREST)]
    size = listed[picks[0] + 1] - listed[picks[0]]
    window = np.repeat(np.arange(len(able)), size)
    at = keys[ranges(listed[picks[0]], size)] - np.repeat(picks[0] * stride, size)
    for term in picks[1:]:
        low = np.searchsorted(keys, term[window] * stride + np.maximum(at - slop, 0))
        close = np.searchsorted(keys, term[window] * stride + at + slop, "right") > low
        window, at = window[close], at[close]
    return able[window], at


def _matches(windows: Windows, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.asarray(batch["n_words"])
            limit, first = 1 << 21, 0
            gaps = n_words + slop + WINDOW + 1
            while first < len(n_words):
                end = max(first + 1, int(np.searchsorted(np.cumsum(gaps[first:]), limit, "right")) + first)
                yield match(batch.slice(first, end - first), n_words[first:end], gaps[first:end])
                first = end

    def match(batch: pa.RecordBatch, n_words: np.ndarray, gaps: np.ndarray) -> pa.RecordBatch:
        base = np.concatenate(([0], np.cumsum(gaps))).astype(np.int64)
        stride = int(base[-1]) + slop + WINDOW + 1
        lists = [np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.uint32).astype(np.int64) for c in ("terms", "counts", "positions")]
        per_doc = np.array([len(p.as_buffer()) // 4 for p in batch["positions"]], dtype=np.int64)
        keys = np.sort(np.repeat(lists[0], lists[1]) * stride + lists[2] + np.repeat(base[:-1], per_doc))
        listed = np.searchsorted(keys, np.arange(len(windows.vocabulary) + 1, dtype=np.int64) * stride)
        window, start = phrase_starts(windows, keys, listed, stride)
        near, near_at = near_windows(windows, keys, listed, stride, slop)
        delta = np.zeros(stride + 1, dtype=np.int32)
        np.add.at(delta, start, 1)
        np.add.at(delta, start + np.diff(windows.first)[window], -1)
        hit = np.cumsum(delta) > 0
        found = [_items(windows, w, np.searchsorted(base, p, "right") - 1, len(n_words)) for w, p in ((window, start), (near, near_at))]
        return pa.RecordBatch.from_arrays([
            batch["doc_id"], batch["n_words"],
            pa.array([np.packbits(h).tobytes() if (h := hit[base[k]: base[k] + n_words[k]]).any() else b"" for k in range(len(n_words))], pa.binary()),
            *[pa.array(x, pa.binary()) for x in found],
        ], names=["doc_id", "n_words", "hit", "phrase_items", "near_items"])
    return run


def _items(windows: Windows, window: np.ndarray, doc: np.ndarray, n_docs: int) -> list[bytes]:
    pairs = np.unique(np.stack((doc, window), 1), axis=0) if len(doc) else np.zeros((0, 2), dtype=np.int64)
    bounds = np.searchsorted(pairs[:, 0], np.arange(n_docs + 1))
    out = []
    for k in range(n_docs):
        w = pairs[bounds[k]: bounds[k + 1], 1]
        out.append(np.unique(windows.items[ranges(windows.items_first[w], np.diff(windows.items_first)[w])]).tobytes() if len(w) else b"")
    return out


def search(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: `doc_id, n_words, hit` (a bit per word), `phrase_items, near_items` (64-bit item ids).

    One pass and one row per document for each block of items; nearly always there is one block. A null or empty
    text has no words and no hit; items without words or id match nothing; repeated items are reported each.
    """
    out = None
    for block in item_blocks(benchmark, block_words):
        items = [(i, w) for i, w in item_words(block) if len(w)]
        if not items:
            continue
        vocabulary = np.unique(np.concatenate([w for _, w in items]))
        index = build_index(docs, vocabulary)
        counts = {int(vocabulary[t].view(np.int64)): n for t, n in term_frequencies(index).items()}
        found = index.mapInArrow(_matches(windows_of(items, counts, width), slop), MATCH_SCHEMA)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = build_index(docs, np.zeros(1, dtype=np.uint64)).select(
            "doc_id", "n_words", *[F.lit(b"").alias(c) for c in ("hit", "phrase_items", "near_items")])
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [sorted(map(str, np.frombuffer(b, dtype=np.int64).tolist())) for b in batch["phrase_items"].to_pylist()]
        near = [len(b) // 8 for b in batch["near_items"].to_pylist()]
        n_hit = [int(np.unpackbits(np.frombuffer(b, dtype=np.uint8)).sum()) for b in batch["hit"].to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"], batch["n_words"], pa.array(n_hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]),
            pa.array([n > 0 for n in n_hit]), pa.array(near, pa.int64()),
        ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"])


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: `doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items`.

    With several blocks of items, what they find is put together per different text.
    """
    blocks = sum(1 for _ in item_blocks(benchmark, options.get("block_words", BLOCK_WORDS)))
    if blocks <= 1:
        return search(docs, benchmark, **options).mapInArrow(_digest, REPORT_SCHEMA)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_key"), "text")
    # equal texts give equal rows, so that a group has one row per block
    found = search(rows.select(F.col("_key").alias("doc_id"), "text"), benchmark, **options).distinct()
    digest = found.groupBy("doc_id").applyInArrow(_merge, MATCH_SCHEMA).mapInArrow(_digest, REPORT_SCHEMA)
    return rows.select("doc_id", "_key").join(digest.withColumnRenamed("doc_id", "_key"), "_key").drop("_key")


REPORT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long"


def _merge(rows: pa.Table) -> pa.Table:
    """One row of a text's rows, one for each block of items."""
    hit = np.zeros((rows["n_words"][0].as_py() + 7) // 8, dtype=np.uint8)
    for b in rows["hit"].to_pylist():
        if b:
            hit |= np.frombuffer(b, dtype=np.uint8)
    both = [np.unique(np.frombuffer(b"".join(rows[c].to_pylist()), dtype=np.int64)).tobytes() for c in ("phrase_items", "near_items")]
    return pa.table({"doc_id": rows["doc_id"][:1], "n_words": rows["n_words"][:1], "hit": pa.array([hit.tobytes() if hit.any() else b""], pa.binary()),
                     "phrase_items": pa.array([both[0]], pa.binary()), "near_items": pa.array([both[1]], pa.binary())})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without a hit, all columns as they are. What a text contains depends on the text alone, so the
    decision travels by a hash of it, and rows that repeat a text go or stay together."""
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = search(docs.select(key.alias("doc_id"), "text"), benchmark, **options)
    hit = found.filter(F.octet_length("hit") > 0).select(F.col("doc_id").alias("_key")).distinct()
    rows = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(hit, "_key", "left_anti").select("row.*")
