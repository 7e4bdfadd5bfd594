"""Exact substring dedup: bytes covered by a string of `length` bytes that also starts anywhere else are removed.

Sorting the suffix at every byte of a large corpus is out of reach, and not needed. Every window of `length` bytes
has an anchor, the gram of least hash in it (leftmost of equals), which its bytes alone determine: equal windows have
equal anchors at equal offsets. So only the suffixes at anchors are kept (about one in 185 bytes), each with its context,
the bytes of all windows it is the anchor of. Anchors meet by gram. Equal contexts cover each other as a whole, which
hashes tell. Only where contexts differ are their bytes read: the suffixes after the anchor, and the reversed ones
before it, are put in order by deep-shallow sorting (multikey quicksort to a shallow depth, then blind tries for
the groups that are still equal), whose common prefixes say how far each pair agrees to both sides.

Copies inside a slice of rows meet before the shuffle. A gram with more than `max_sorted` different contexts is not
sorted in one task: its windows are counted one by one, with the same result.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmetrics.llm.words import gram_hashes, prefix_sums, slices, span_hashes
from haulmetrics.plans.staging import stage

LENGTH = 400
GRAM = 32
SHALLOW = 64
SYMBOL = 8
MAX_SORTED = 65_536  # contexts of one gram that a task sorts (about 50 MB)
PAIRWISE = 256
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
POSITION_BITS = np.uint64(32)


# --- deep-shallow sorting ---------------------------------------------------------------------------------------

def deep_shallow_sort(texts: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the texts, and the common prefix length of each with the one before it (0 for the first)."""
    order = _multikey(texts, list(range(len(texts))), 0, shallow)
    return order, [0] + [common_prefix(texts[a], texts[b]) for a, b in zip(order, order[1:], strict=False)]


def _multikey(texts: list[bytes], group: list[int], depth: int, shallow: int) -> list[int]:
    """Three-way quicksort on symbols of several bytes; what is equal down to the shallow depth goes to a blind trie."""
    out, todo = [], [(group, depth)]
    while todo:
        group, depth = todo.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            out += blind_trie_sort(texts, group)
        else:
            pivot = texts[group[len(group) // 2]][depth: depth + SYMBOL]
            less, same, more = [], [], []
            for i in group:
                symbol = texts[i][depth: depth + SYMBOL]
                (same if symbol == pivot else less if symbol < pivot else more).append(i)
            deeper = depth + SYMBOL if len(pivot) == SYMBOL else shallow
            todo += [(more, depth), (same, deeper), (less, depth)]
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Node:
    """An inner node of a blind trie: branches on the byte at `skip` (-1: the text ends there)."""

    def __init__(self, skip: int, children: dict):
        self.skip, self.children = skip, children


def _byte(text: bytes, at: int) -> int:
    return text[at] if at < len(text) else -1


def blind_trie_sort(texts: list[bytes], group: list[int]) -> list[int]:
    """Order of the texts by insertion into a blind trie, whose leaves are lists of equal texts.

    A search compares only the bytes at the skips; one comparison with the leaf it ends in then tells where the new
    text branches off.
    """
    root: Node | list[int] = [group[0]]
    for i in group[1:]:
        text, node = texts[i], root
        while isinstance(node, Node):
            node = node.children.get(_byte(text, node.skip)) or next(iter(node.children.values()))
        other = texts[node[0]]
        depth = common_prefix(text, other)
        if depth == len(text) == len(other):
            node.append(i)
            continue
        above, node, edge = None, root, None
        while isinstance(node, Node) and node.skip < depth:
            edge = _byte(text, node.skip)
            above, node = node, node.children[edge]
        if isinstance(node, Node) and node.skip == depth:
            node.children[_byte(text, depth)] = [i]
            continue
        branch = Node(depth, {_byte(text, depth): [i], _byte(other, depth): node})
        if above is None:
            root = branch
        else:
            above.children[edge] = branch
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, Node):
            todo += [node.children[k] for k in sorted(node.children, reverse=True)]
        else:
            out += node
    return out


def _agreements(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefix lengths of all pairs, as least values of the sorted texts' neighbours' ones."""
    n = len(order)
    out = np.zeros((n, n), dtype=np.int64)
    for k in range(n - 1):
        out[order[k], order[k + 1:]] = np.minimum.accumulate(common[k + 1:])
    return np.maximum(out, out.T)


def reaches(before: list[bytes], after: list[bytes], length: int, pairwise: int = PAIRWISE) -> tuple[np.ndarray, np.ndarray]:
    """How far to the left and right of its anchor each context is covered by windows that another one has too (0, 0: not at all).

    Read from the two sorted orders: for few contexts, pair by pair; for many, offset by offset, as the contexts that are
    in one interval of common prefixes in both orders.
    """
    (order_l, common_l), (order_r, common_r) = (tuple(np.array(x, dtype=np.int64) for x in deep_shallow_sort(t)) for t in (before, after))
    n = len(before)
    if n <= pairwise:
        left, right = _agreements(order_l, common_l), _agreements(order_r, common_r)
        agree = left + right >= length
        np.fill_diagonal(agree, False)
        return np.where(agree, left, 0).max(1), np.where(agree, right, 0).max(1)
    size_l, size_r = np.array([len(t) for t in before]), np.array([len(t) for t in after])
    left, right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    at_l, at_r = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for offset in range(max(0, length - int(size_r.max())), min(length, int(size_l.max())) + 1):
        able = np.flatnonzero((size_l >= offset) & (size_r >= length - offset))
        at_l[order_l], at_r[order_r] = np.cumsum(common_l < offset), np.cumsum(common_r < length - offset)
        _, group, times = np.unique(at_l[able] * (n + 1) + at_r[able], return_inverse=True, return_counts=True)
        shared = able[times[group] > 1]
        left[shared] = offset
        right[shared] = np.maximum(right[shared], length - offset)
    return left, right


# --- anchors ------------------------------------------------------------------------------------------------------

def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor position, first and last window start, row, gram hash and context hash, for the windows of all rows."""
    none = np.zeros(0, dtype=np.int64)
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(data)
    n, width = len(data), length - gram + 1
    keys = np.full(-(-(n + 1) // width) * width + width, NEVER, dtype=np.uint64)
    hashes = gram_hashes(sums, gram)
    keys[: len(hashes)] = ((hashes >> POSITION_BITS) << POSITION_BITS) | np.arange(len(hashes), dtype=np.uint64)
    blocks = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    row = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows)
    anchor = (np.minimum(behind[start], ahead[start + width - 1]) & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    return anchor[new], first, last, row[new], hashes[anchor[new]], span_hashes(sums, first, last + length)


def merged(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the ranges of each row, as ranges that neither overlap nor touch."""
    if not len(rows):
        return rows, starts, ends
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    wide = int(ends.max()) + 2
    reach = np.maximum.accumulate(rows * wide + ends)
    new = np.concatenate(([True], rows[1:] * wide + starts[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return rows[at], starts[at], reach[np.append(at[1:], len(rows)) - 1] - rows[at] * wide


ANCHOR_SCHEMA = "doc_id long, text_key long, gram long, context long, n long, first long, anchor long, last long"


def _anchor_rows(length: int, gram: int):
    """Per slice of rows, an anchor row per gram and context (`n` times met), and cover rows (`n` 0, `first` to `last`) for those met twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, offsets in slices(batch["text"]):
                anchor, first, last, row, grams, contexts = anchors(data, offsets, length, gram)
                order = np.lexsort((first, row, contexts, grams))
                new = np.concatenate(([True], (grams[order][1:] != grams[order][:-1]) | (contexts[order][1:] != contexts[order][:-1])))[: len(order)]
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(order)))
                many = order[np.repeat(times, times) > 1] if len(order) else order
                base = offsets[:-1]
                cover_row, cover_first, cover_end = merged(row[many], first[many] - base[row[many]], last[many] + length - base[row[many]])
                one = order[at]
                rows = pa.array(np.concatenate((row[one], cover_row)) + begin)
                zero = np.zeros(len(cover_row), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].take(rows), batch["text_key"].take(rows),
                    *[pa.array(np.concatenate(x)) for x in (
                        (grams[one].view(np.int64), zero), (contexts[one].view(np.int64), zero), (times, zero),
                        (first[one] - base[row[one]], cover_first), (anchor[one] - base[row[one]], zero), (last[one] - base[row[one]], cover_end))],
                ], names=["doc_id", "text_key", "gram", "context", "n", "first", "anchor", "last"])
    return run


# --- contexts that differ -----------------------------------------------------------------------------------------

CONTEXT_SCHEMA = "doc_id long, text_key long, gram long, context long, n long, many boolean, anchor long, before binary, after binary"


def _contexts(length: int):
    """The bytes of the contexts wanted of each document: reversed before the anchor, and from it on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in slices(batch["text"]):
                raw = data.tobytes()
                out = []
                for k, wanted in enumerate(batch["wanted"].slice(begin, end - begin).to_pylist()):
                    for w in wanted:
                        middle = offsets[k] + w["anchor"]
                        out.append((begin + k, w, raw[offsets[k] + w["first"]: middle][::-1], raw[middle: offsets[k] + w["last"] + length]))
                rows = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].take(rows), batch["text_key"].take(rows),
                    *[pa.array([o[1][c] for o in out], pa.int64()) for c in ("gram", "context", "n")],
                    pa.array([o[1]["many"] for o in out], pa.bool_()), pa.array([o[1]["anchor"] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.binary()),
                ], names=["doc_id", "text_key", "gram", "context", "n", "many", "anchor", "before", "after"])
    return run


COVER_SCHEMA = "doc_id long, text_key long, first long, last long"


def _sorted_covers(length: int):
    """Rows come in order of their gram; each gram has a bounded number of them."""
    def covers(group: list[dict]) -> list[tuple]:
        if len(group) < 2:
            return []
        left, right = reaches([g["before"] for g in group], [g["after"] for g in group], length)
        return [(g["doc_id"], g["text_key"], g["anchor"] - int(left[k]), g["anchor"] + int(right[k]))
                for k, g in enumerate(group) if g["n"] == 1 and right[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if group and group[0]["gram"] != row["gram"]:
                    out += covers(group)
                    group = []
                group.append(row)
            yield _cover_batch(out)
        yield _cover_batch(covers(group))
    return run


def _cover_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "text_key", "first", "last"])


def _window_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 256):
                batch = whole.slice(first, 256)
                texts = [b[::-1] + a for b, a in zip(batch["before"].to_pylist(), batch["after"].to_pylist(), strict=True)]
                bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                sums = prefix_sums(np.frombuffer(b"".join(texts), dtype=np.uint8))
                count = np.diff(bounds) - length + 1
                row = np.repeat(np.arange(len(texts)), count)
                shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = bounds[row] + shift
                begins = np.asarray(batch["anchor"]) - np.array([len(b.as_buffer()) for b in batch["before"]])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    *[batch[c].take(take) for c in ("doc_id", "text_key", "gram", "n")],
                    pa.array(span_hashes(sums, start, start + length).view(np.int64)), pa.array(begins[row] + shift),
                ], names=["doc_id", "text_key", "gram", "n", "window", "first"])
    return run


def covers(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_sorted: int = MAX_SORTED) -> DataFrame:
    """`doc_id, text_key, first, last`: byte ranges that strings repeated elsewhere cover; they may overlap.

    `docs` has `doc_id` (long), `text_key` and `text`. A text shorter than `length` has none.
    """
    if not 0 < gram <= length:
        raise ValueError("the gram must fit into the length")
    found = stage(docs.mapInArrow(_anchor_rows(length, gram), ANCHOR_SCHEMA), "anchors")
    inside = found.filter("n = 0").select("doc_id", "text_key", "first", "last")
    found = found.filter("n > 0")
    member = F.struct("doc_id", "text_key", "first", "anchor", "last")
    classes = stage(found.groupBy("gram", "context").agg(F.sum("n").alias("n"), F.min(member).alias("member"), F.count("*").alias("rows")), "contexts")
    equal = found.filter("n = 1").join(classes.filter("n > 1 AND rows > 1").select("gram", "context"), ["gram", "context"])
    equal = equal.select("doc_id", "text_key", "first", (F.col("last") + length).alias("last"))

    mixed = classes.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).filter("contexts > 1 AND least = 1")
    wanted = classes.join(mixed, "gram").select("gram", "context", "n", (F.col("contexts") > max_sorted).alias("many"), "member.*")
    lists = wanted.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("gram", "context", "n", "many", "first", "anchor", "last")).alias("wanted"))
    bytes_of = _attach(docs, lists).filter("wanted IS NOT NULL").mapInArrow(_contexts(length), CONTEXT_SCHEMA)
    # a row that repeats the id and text of another has given the same contexts
    read = stage(bytes_of, "context-bytes")
    few = read.filter("NOT many").dropDuplicates(["gram", "context"]).repartition("gram").sortWithinPartitions("gram")
    ordered = few.mapInArrow(_sorted_covers(length), COVER_SCHEMA)

    windows = read.filter("many").mapInArrow(_window_rows(length), "doc_id long, text_key long, gram long, n long, window long, first long").dropDuplicates()
    twice = windows.groupBy("gram", "window").agg(F.count("*").alias("times")).filter("times > 1")
    alone = windows.filter("n = 1").join(twice, ["gram", "window"]).select("doc_id", "text_key", "first", (F.col("first") + length).alias("last"))
    return inside.unionByName(equal).unionByName(ordered).unionByName(alone)


def _attach(docs: DataFrame, lists: DataFrame) -> DataFrame:
    renamed = lists.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    return docs.join(renamed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").drop("_id", "_key")


REMOVED_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def _removed(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in slices(batch["text"]):
                lists = batch["spans"].slice(begin, end - begin).to_pylist()
                rows = []
                for k, spans in enumerate(lists):
                    text = data[offsets[k]: offsets[k + 1]]
                    at = np.array([(s["first"], s["last"]) for s in spans or []], dtype=np.int64).reshape(-1, 2)
                    _, first, last = merged(np.zeros(len(at), dtype=np.int64), at[:, 0], at[:, 1])
                    kept = b"".join(text[a:b].tobytes() for a, b in zip(np.append(0, last), np.append(first, len(text)), strict=True))
                    rows.append((len(text), len(text) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), kept if texts else None))
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(begin, end - begin), *[pa.array([r[c] for r in rows], pa.int64()) for c in range(3)],
                    pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.binary()),
                ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])
    return run


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_sorted: int = MAX_SORTED, texts: bool = True) -> DataFrame:
    """Per row `doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text` (bytes; null unless `texts`).

    All copies of a repeated string go, the first one too. Null texts are empty; rows that repeat an id and text are
    copies of each other; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"),
                       F.col("text").cast("string").alias("text"))
    spans = covers(rows, length, gram, max_sorted).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return _attach(rows, spans).mapInArrow(_removed(texts), REMOVED_SCHEMA)
