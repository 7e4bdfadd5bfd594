"""Exact n-gram Jaccard join by universe partitioning (links of 75% or more).

Sets of different texts that link differ in at most `(|x| + |y|) / 7` elements. The elements are hashed to `m` segments,
`m` by size band, so that linked sets agree on at least `m - H` of them (pigeonhole). The signature of a segment is the
hash of the subset that falls into it. A set of size `s` drops the costliest `m - H_s - 1` segments (threshold -1) and
indexes the others (threshold 0); the order of cost is the same for all sets, so the cheapest segment two linked sets
agree on is indexed by both. Empty segments cost most, then signatures that a first pass counts as common; a set with
too few filled segments is also partitioned anew.

Signatures meet in buckets of bounded size. Those in at most `group` different sets give candidate lists. A signature
in more sets is hot. Lists and hot groups are first linked around a few members each, which joins copies; where a hot
group still holds several components, its sets are indexed again: all their segments, and, if hot ones exceed the
budget, one-deletion neighbourhoods of the others (threshold 1), which make up for `m - (H + 1) / 2` hot segments.
What is left, sets of hot segments nearly throughout, links only if they share a shingle that is not hot (then it gives a
list), or through their hot shingles alone. Sets with the same hot shingles are one part then, of which the set with the
fewest other shingles stands for all. Parts are compared in blocks, and what goes on is a spanning forest of their links and,
for each part, the partner that leaves most room: a set that links with any links with that one, and so do the heads.

Candidates are tested on sizes and parity sketches, which rule out most but no link, and the rest is verified on whole
sets, read again from the text. Sets are fingerprinted by 64-bit hashes of shingles and sets.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmetrics.llm.components import components
from haulmetrics.llm.words import NON_SPACE, mix, ranges, slices, words
from haulmetrics.plans.staging import stage

WORDS = 5
GROUP = 48
BAND = 4
BUCKET_SIGNATURES = 1 << 20
SIGNATURE_BITS = 40
SLACK = 1.25
SELDOM = 3  # a signature met more often in one batch is counted
CENTRES, SIZES_PER_FACTOR = 4, 8
STARS = 8  # centres of hot groups that a set is compared with first; what they leave apart is compared later
PIECE_SHINGLES, PIECE_CENTRES = 1 << 18, 1 << 18  # shingles and centres a task works on at a time
BLOCK_SETS, BLOCK_SHINGLES, BLOCK_PAIRS = 256, 1 << 16, 32  # parts and shingles of a block, as a mean; pairs of blocks in a task
COLUMNS = 4096
COMMON = 1_000_000  # signatures of the highest counts that every task knows (8 MB); they steer costs, not results


# --- sets -----------------------------------------------------------------------------------------------------------

def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and row bounds; a row of fewer words has one shingle of all."""
    hashes, first = words(data, offsets, NON_SPACE)
    n = np.diff(first)
    rows = len(n)
    full = np.maximum(n - size + 1, 0)
    starts = ranges(first[:-1], full)
    value = np.zeros(len(starts), dtype=np.uint64)
    for k in range(size):
        value = mix(value + hashes[starts + k] * np.uint64(2 * k + 1)) if len(starts) else value
    row = np.repeat(np.arange(rows), full)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.array([int(mix(np.array([_fold(hashes[first[k]: first[k + 1]])], dtype=np.uint64))[0]) for k in short], dtype=np.uint64)
        value, row = np.concatenate((value, whole)), np.concatenate((row, short))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])))[: len(value)]
    return value[new], np.searchsorted(row[new], np.arange(rows + 1))


def _fold(hashes: np.ndarray) -> int:
    total = len(hashes)
    for h in hashes.tolist():
        total = (total * 0x100000001B3 + h) & 0xFFFFFFFFFFFFFFFF
    return total


def sums_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def set_keys(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever its order."""
    return mix(sums_of(mix(shingles), bounds) ^ mix(np.diff(bounds).astype(np.uint64))).view(np.int64)


def sketches(shingles: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity bits of each set, about one per element. Two sets differ in no fewer elements than their sketches in bits."""
    n = np.diff(bounds)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(bits)))
    at = np.repeat(first[:-1], n) + (shingles & np.repeat((bits - 1).astype(np.uint64), n)).astype(np.int64)
    parity = np.packbits((np.bincount(at, minlength=int(first[-1])) & 1).astype(np.uint8)[: int(first[-1])], bitorder="little").tobytes()
    return [parity[i // 8: j // 8] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def sketch_distance(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the other."""
    if len(x) > len(y):
        x, y = y, x
    short, long, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(y)
    while bits > 8 * len(x):
        bits //= 2
        long = (long >> bits) ^ (long & ((1 << bits) - 1))
    return (short ^ long).bit_count()


SET_SCHEMA = "doc_id long, text_key long, n long, key long, sketch binary, signature long, times long"


def _set_rows(seldom: int):
    """A row per document, and a row per signature that occurs more than `seldom` times in a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, values = np.zeros(0, dtype=np.int64), [np.zeros(0, dtype=np.uint64)]
            for first, end, data, offsets in slices(batch["text"]):
                shingles, bounds = shingle_sets(data, offsets)
                keys, n = set_keys(shingles, bounds), end - first
                key, at = np.unique(keys, return_index=True)
                at = np.sort(at[~np.isin(key, seen)])
                seen = np.concatenate((seen, key))
                values.append(signatures(*_some(shingles, bounds, at), everything=True)[1])
                zero = pa.array(np.zeros(n, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(first, n), batch["text_key"].slice(first, n), pa.array(np.diff(bounds)), pa.array(keys),
                    pa.array(sketches(shingles, bounds), pa.binary()), zero, zero], names=["doc_id", "text_key", "n", "key", "sketch", "signature", "times"])
            value, times = np.unique(np.concatenate(values), return_counts=True)
            value, times = value[times > seldom].view(np.int64), times[times > seldom]
            none = pa.nulls(len(value), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(value), pa.binary()), pa.array(value), pa.array(times)],
                                             names=["doc_id", "text_key", "n", "key", "sketch", "signature", "times"])
    return run


def _some(shingles: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked sets alone."""
    size = np.diff(bounds)[at]
    return shingles[ranges(bounds[at], size)], np.concatenate(([0], np.cumsum(size))).astype(np.int64)


# --- signatures -----------------------------------------------------------------------------------------------------

def schemes(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For its own size band, and the next one if a partner can be there: set, differences of the band, of the set, band."""
    band = np.floor(np.log2(np.maximum(n, 1)) / np.log2(BAND) + 1e-12).astype(np.int64)
    upper = BAND ** (band + 1)
    partner = 4 * n // 3
    own = np.flatnonzero(n > 0)
    following = np.flatnonzero((n > 0) & (partner >= upper))
    return [(own, (2 * (upper[own] - 1)) // 7, (n[own] + np.minimum(partner[own], upper[own] - 1)) // 7, band[own]),
            (following, (2 * (BAND * upper[following] - 1)) // 7, (n[following] + partner[following]) // 7, band[following] + 1)]


def segments(shingles: np.ndarray, bounds: np.ndarray, picked: np.ndarray, m: np.ndarray, band: np.ndarray, salt: int) -> tuple[np.ndarray, ...]:
    """Filled segments of the picked sets: set (index into picked), subset size, signature; and element order and bounds for deletions."""
    size = np.diff(bounds)[picked]
    owner = np.repeat(np.arange(len(picked)), size)
    element = shingles[ranges(bounds[picked], size)]
    scattered = mix(element ^ mix(np.full(1, 0x5851F42D4C957F2D + salt, dtype=np.uint64)))
    segment = ((scattered >> np.uint64(32)) * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    slot = np.concatenate(([0], np.cumsum(m)))[owner] + segment
    order = np.argsort(slot, kind="stable")
    slot, owner, element = slot[order], owner[order], mix(element[order])
    at = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))[: len(slot)])
    edges = np.append(at, len(slot))
    where = mix(band[owner[at]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + segment[order][at].astype(np.uint64) * np.uint64(64) + np.uint64(salt))
    return owner[at], np.diff(edges), sums_of(element, edges), where, element, edges


def signatures(shingles: np.ndarray, bounds: np.ndarray, everything: bool = False, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Set (row) and signature of all segments that are indexed; with `everything`, of all filled segments.

    `common` lists signatures that cost most. It steers the choice only: any list gives complete results, if it is the same for all sets.
    """
    common = np.zeros(0, dtype=np.uint64) if common is None else common
    n = np.diff(bounds)
    rows, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for picked, most, own, band in schemes(n):
        m = np.ceil(SLACK * most).astype(np.int64) + 1
        salt = 0
        while len(picked):
            owner, size, total, where, _, _ = segments(shingles, bounds, picked, m, band, salt)
            value = mix(total ^ where)
            filled = np.bincount(owner, minlength=len(picked))
            if everything:
                keep = np.ones(len(owner), dtype=bool)
            else:
                # signatures known to be common cost most; larger subsets are rarer; equal sizes in order of their hash
                order = np.lexsort((value, -size, np.isin(value, common), owner))
                place = np.arange(len(order)) - np.repeat(np.cumsum(filled) - filled, filled)
                keep = np.zeros(len(owner), dtype=bool)
                keep[order] = place <= own[owner[order]]
            rows.append(picked[owner[keep]])
            values.append(value[keep])
            lacking = filled <= own
            picked, m, own, band, salt = picked[lacking], m[lacking], own[lacking], band[lacking], salt + 1
    return np.concatenate(rows), np.concatenate(values)


def _short(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return bucket, mix(values) & np.uint64((1 << SIGNATURE_BITS) - 1)


BLOB_SCHEMA = "bucket int, signatures binary, places binary, keys binary, hot binary"


def blobs(keys: np.ndarray, values: np.ndarray, buckets: int, group: int) -> Iterator[pa.RecordBatch]:
    """Signatures with their sets' keys, a row per bucket. Members of a signature that is hot here already go by rows
    of their own (negative bucket), spread at random; its bucket learns that it is hot."""
    bucket, short = _short(values, buckets)
    full = (bucket.astype(np.uint64) << np.uint64(SIGNATURE_BITS)) | short
    order = np.lexsort((keys, full))
    full, keys = full[order], keys[order]
    new = np.concatenate(([True], (full[1:] != full[:-1]) | (keys[1:] != keys[:-1])))[: len(full)]
    full, keys = full[new], keys[new]
    at = np.flatnonzero(np.concatenate(([True], full[1:] != full[:-1]))[: len(full)])
    times = np.diff(np.append(at, len(full)))
    is_hot = np.repeat(times > group, times)
    hot = full[at[times > group]]
    cool, cool_keys = full[~is_hot], keys[~is_hot]
    edges = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(SIGNATURE_BITS)
    cut, hot_cut = np.searchsorted(cool, edges), np.searchsorted(hot, edges)
    rows = []
    for b in np.flatnonzero((np.diff(cut) > 0) | (np.diff(hot_cut) > 0)).tolist():
        table, place = np.unique(cool_keys[cut[b]: cut[b + 1]], return_inverse=True)
        signature = cool[cut[b]: cut[b + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SIGNATURE_BITS // 8]
        rows.append((b, signature.tobytes(), place.astype(np.uint32 if len(table) > 65535 else np.uint16).tobytes(), table.tobytes(), hot[hot_cut[b]: hot_cut[b + 1]].tobytes()))
    for first in range(0, int(is_hot.sum()), 4096):
        part = np.flatnonzero(is_hot)[first: first + 4096]
        rows.append((-1 - int(mix(full[part[:1]] ^ keys[part[:1]].view(np.uint64))[0] >> np.uint64(34)), full[part].tobytes(), b"", keys[part].tobytes(), b""))
    for first in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[first: first + 512]], pa.int32()),
                                          *[pa.array([r[c] for r in rows[first: first + 512]], pa.binary()) for c in range(1, 5)]],
                                         names=["bucket", "signatures", "places", "keys", "hot"])


def _text_blobs(buckets: int, group: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, seen = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], np.zeros(0, dtype=np.int64)
            for _, _, data, offsets in slices(batch["text"]):
                shingles, bounds = shingle_sets(data, offsets)
                every = set_keys(shingles, bounds)
                key, at = np.unique(every, return_index=True)
                at = np.sort(at[~np.isin(key, seen)])  # copies met in this batch are indexed once
                seen = np.concatenate((seen, key))
                row, value = signatures(*_some(shingles, bounds, at), common=common)
                keys.append(every[at][row])
                values.append(value)
            yield from blobs(np.concatenate(keys), np.concatenate(values), buckets, group)
    return run


def _set_blobs(buckets: int, group: int):
    """The same for sets at hand, with all their segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_sets(batches):
            shingles, bounds = _sets(batch)
            row, value = signatures(shingles, bounds, True)
            yield from blobs(np.asarray(batch["key"])[row], value, buckets, group)
    return run


def _one_by_one(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """Rows of the batch as Python values, one at a time."""
    return ((*(batch[c][i].as_py() for c in columns),) for i in range(len(batch)))


def _pieces(batches: Iterator[pa.RecordBatch], column: str, most: int, unit: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, of about `most` values of the list column (or units of bytes of the binary one) each."""
    for batch in batches:
        lengths = batch[column].value_lengths() if pa.types.is_list(batch[column].type) else pc.binary_length(batch[column])
        ends = np.cumsum(np.asarray(pc.fill_null(lengths, 0), dtype=np.int64) // unit)
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
            yield batch.slice(first, last - first)
            first = last


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _pieces(batches, "shingles", PIECE_SHINGLES, 8)


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch["shingles"].to_pylist()
    return np.frombuffer(b"".join(column), dtype=np.uint64), np.concatenate(([0], np.cumsum([len(b) // 8 for b in column]))).astype(np.int64)


GROUP_SCHEMA = "hot boolean, signature long, keys array<long>"


def _groups(group: int):
    """Groups of one bucket or several: lists of the keys that share a signature, each list once; and members of hot signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, keys, hot = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for batch in batches:
            for bucket, signature, place, table, flagged in _one_by_one(batch, "bucket", "signatures", "places", "keys", "hot"):
                table = np.frombuffer(table, dtype=np.int64)
                if bucket < 0:
                    yield _hot_rows(np.frombuffer(signature, dtype=np.uint64), table, group)
                    continue
                raw = np.zeros((len(signature) * 8 // SIGNATURE_BITS, 8), dtype=np.uint8)
                raw[:, : SIGNATURE_BITS // 8] = np.frombuffer(signature, dtype=np.uint8).reshape(-1, SIGNATURE_BITS // 8)
                full.append(raw.view("<u8").ravel() | (np.uint64(bucket) << np.uint64(SIGNATURE_BITS)))
                keys.append(table[np.frombuffer(place, dtype=np.uint32 if len(table) > 65535 else np.uint16)])
                hot.append(np.frombuffer(flagged, dtype=np.uint64))
        full, keys, hot = np.concatenate(full), np.concatenate(keys), np.unique(np.concatenate(hot))
        order = np.lexsort((keys, full))
        full, keys = full[order], keys[order]
        new = np.concatenate(([True], (full[1:] != full[:-1]) | (keys[1:] != keys[:-1])))[: len(full)]
        full, keys = full[new], keys[new]
        at = np.flatnonzero(np.concatenate(([True], full[1:] != full[:-1]))[: len(full)])
        times = np.diff(np.append(at, len(full)))
        many = (times > group) | np.isin(full[at], hot)
        members = np.repeat(many, times)
        for first in range(0, int(members.sum()), 65536):
            part = np.flatnonzero(members)[first: first + 65536]
            yield _hot_rows(full[part], keys[part], group)
        listed = np.flatnonzero(~many & (times > 1))
        digest = sums_of(mix(keys.view(np.uint64)), np.append(at, len(full)))[listed]
        _, once = np.unique(digest, return_index=True)
        listed = listed[once]
        for first in range(0, len(listed), 65536):
            part = listed[first: first + 65536]
            flat = keys[ranges(at[part], times[part])]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(times[part]))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), dtype=bool)), pa.array(np.zeros(len(part), dtype=np.int64)), lists],
                                             names=["hot", "signature", "keys"])
    return run


def _hot_rows(signature: np.ndarray, keys: np.ndarray, group: int) -> pa.RecordBatch:
    """Members of hot signatures (in order of the signature), as lists of at most `group` keys each."""
    at = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1]))[: len(signature)])
    times = np.diff(np.append(at, len(signature)))
    pieces = -(-times // group)
    place = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(at, pieces) + group * place
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)).astype(np.int32)), pa.array(keys))
    return pa.RecordBatch.from_arrays([pa.array(np.ones(len(first), dtype=bool)), pa.array(signature[first].view(np.int64)), lists], names=["hot", "signature", "keys"])


def grouped(rows: DataFrame, buckets: int, group: int, name: str) -> tuple[DataFrame, DataFrame]:
    """`keys` (lists, each once) and `signature, key` of hot signatures, from rows of signatures."""
    found = stage(rows.repartition(buckets, "bucket").mapInArrow(_groups(group), GROUP_SCHEMA), name)
    return found.filter("NOT hot").select("keys").distinct(), found.filter("hot").select("signature", "keys")


def members(hot: DataFrame) -> DataFrame:
    """`signature, key` of hot signatures, each once."""
    return hot.select("signature", F.explode("keys").alias("key")).distinct()


def _dealt(slots: int):
    """Members of hot signatures, packed by slot of their key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch["keys"].flatten())
            signature = np.repeat(np.asarray(batch["signature"]), np.asarray(batch["keys"].value_lengths()))
            slot = ((mix(keys.view(np.uint64)) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            cut = np.searchsorted(slot[order], np.arange(slots + 1))
            filled = np.flatnonzero(np.diff(cut)).tolist()
            packed = lambda x: pa.array([x[order[cut[k]: cut[k + 1]]].tobytes() for k in filled], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), packed(keys), packed(signature)], names=["slot", "keys", "signatures"])
    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, signature = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for batch in batches:
        keys += [np.frombuffer(b, dtype=np.int64) for b in batch["keys"].to_pylist()]
        signature += [np.frombuffer(b, dtype=np.int64) for b in batch["signatures"].to_pylist()]
    keys, signature = np.concatenate(keys), np.concatenate(signature)
    order = np.lexsort((signature, keys))
    keys, signature = keys[order], signature[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (signature[1:] != signature[:-1])))[: len(keys)]
    keys, signature = keys[new], signature[new]
    at = np.append(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]), len(keys))
    for first in range(0, len(at) - 1, 4096):
        part = at[first: first + 4097]
        lists = pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), pa.array(signature[part[0]: part[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(keys[part[:-1]]), lists], names=["key", "hot"])


def hot_of_keys(hot: DataFrame, slots: int) -> DataFrame:
    """`key, hot`: the hot signatures of each set, which travel packed."""
    return hot.mapInArrow(_dealt(slots), "slot int, keys binary, signatures binary").repartition(slots, "slot").mapInArrow(_gathered, "key long, hot array<long>")


# --- one-deletion neighbourhoods ------------------------------------------------------------------------------------

DELETION_SCHEMA = "signature long, key long, deleted boolean"


def _is_hot(batch: pa.RecordBatch, row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether signatures of the batch's sets are among the hot ones of their set."""
    buckets = batch["buckets"][0].as_py() if len(batch) else 1
    of_set = lambda row, signature: mix(mix(row.astype(np.uint64)) ^ signature)
    known = of_set(np.repeat(np.arange(len(batch)), np.asarray(batch["hot"].value_lengths())), np.asarray(batch["hot"].flatten()).view(np.uint64))
    bucket, short = _short(values, buckets)
    return np.isin(of_set(row, (bucket.astype(np.uint64) << np.uint64(SIGNATURE_BITS)) | short), known)


def _second_look(batch: pa.RecordBatch, shingles: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Per size band: picked sets, differences of band and set, band; owner of each filled segment, whether it is not hot;
    hot or empty segments of each set; and the segments themselves with their elements."""
    for picked, most, own, band in schemes(np.diff(bounds)):
        m = np.ceil(SLACK * most).astype(np.int64) + 1
        owner, size, total, where, element, edges = segments(shingles, bounds, picked, m, band, 0)
        cool = ~_is_hot(batch, picked[owner], mix(total ^ where))
        unfit = m - np.bincount(owner, cool, len(picked)).astype(np.int64)
        yield picked, most, own, band, owner, cool, unfit, (size, total, where), (element, edges)


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sets with more hot or empty segments than their budget: signatures of the other segments, whole and less one element."""
    for batch in _whole_sets(batches):
        shingles, bounds = _sets(batch)
        keys = np.asarray(batch["key"])
        for picked, most, own, _, owner, cool, unfit, (size, total, where), (element, edges) in _second_look(batch, shingles, bounds):
            m = np.ceil(SLACK * most).astype(np.int64) + 1
            whole = np.flatnonzero((unfit > m - own - 1)[owner] & cool)
            rest = np.repeat(whole, size[whole])
            less = total[rest] - element[ranges(edges[whole], size[whole])]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((mix(total[whole] ^ where[whole]), mix(less ^ where[rest]))).view(np.int64)),
                pa.array(np.concatenate((keys[picked[owner[whole]]], keys[picked[owner[rest]]]))),
                pa.array(np.repeat([False, True], [len(whole), len(rest)])),
            ], names=["signature", "key", "deleted"])


# --- verification ---------------------------------------------------------------------------------------------------

def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in _one_by_one(batch, "left", "right"):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[at] == x).sum())
            keep.append(100 * common >= 75 * (len(x) + len(y) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mask = pa.array([7 * sketch_distance(x, y) <= n + m for n, m, x, y in _one_by_one(batch, "n_a", "n_b", "sketch_a", "sketch_b")], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of keys that sizes and sketches do not rule out, written to the shared folder."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    return stage(both.mapInArrow(_near, "a long, b long"), "plausible-pairs")


def sets_of(keys: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """`key, n, shingles` of the keys, read again from the text of one document each and written to the shared folder."""
    source = classes.join(keys, "key").select("key", *_place(F.col("row.doc_id"), F.col("row.text_key")))
    texts = rows.select(*_place(F.col("doc_id"), F.col("text_key")), "text")
    at = ["_id", "_none", "_text"]
    wanted = texts.join(source, at).dropDuplicates(at).select("key", "text")
    return stage(wanted.mapInArrow(_shingle_rows, "key long, n long, shingles binary"), "involved-sets")


def _place(doc_id: Column, text_key: Column) -> list[Column]:
    """Columns that are never null and name a document."""
    return [F.coalesce(doc_id, F.lit(0)).alias("_id"), doc_id.isNull().alias("_none"), text_key.alias("_text")]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of keys whose sets link."""
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("right"))
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("left"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(_overlaps, "a long, b long")


def _links(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidate pairs to links."""
    near = plausible(pairs, classes)
    keys = near.select(F.col("a").alias("key")).unionByName(near.select(F.col("b").alias("key"))).distinct()
    return stage(verified(near, sets_of(keys, classes, rows)), "links")


def _list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each list (bounded in length): the pairs across components that sizes and sketches do not rule out."""
    for batch in batches:
        out = []
        for members, in _one_by_one(batch, "members"):
            members = sorted((x["n"], x["key"], x["component"], x["sketch"]) for x in members)
            for i, (n, key, component, sketch) in enumerate(members):
                for m, other, far, longer in members[i + 1:]:
                    if 4 * n < 3 * m:
                        break
                    if component != far and 7 * sketch_distance(sketch, longer) <= n + m:
                        out.append((min(key, other), max(key, other)))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _pairs_across(lists: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of keys of one list that are in different components and can link."""
    rows = _labelled(lists.select(F.xxhash64("keys").alias("list"), F.explode("keys").alias("key")), labels)
    full = rows.join(classes.select("key", "n", "sketch"), "key").groupBy("list").agg(
        F.collect_list(F.struct("key", "component", "n", "sketch")).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    return stage(full.filter("low != high").select("members").mapInArrow(_list_pairs, "a long, b long").distinct(), "list-pairs")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of keys that are in different components."""
    named = lambda k, c: labels.select(F.col("node").alias(k), F.col("component").alias(c))
    both = pairs.join(named("a", "_low"), "a", "left").join(named("b", "_high"), "b", "left")
    return both.filter(F.coalesce("_low", "a") != F.coalesce("_high", "b")).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, F.col("key") == F.col("node"), "left").select(*rows.columns, F.coalesce("component", "key").alias("component"))


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch["text"]):
            shingles, bounds = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([
                batch["key"].slice(first, end - first), pa.array(np.diff(bounds)),
                pa.array([shingles[bounds[k]: bounds[k + 1]].tobytes() for k in range(end - first)], pa.binary())], names=["key", "n", "shingles"])


def link(docs: DataFrame, group: int = GROUP, bucket_signatures: int = BUCKET_SIGNATURES) -> DataFrame:
    """Per row of `docs`: `doc_id, text_key, n_shingles, set_key, component_id`.

    Documents with equal shingle sets are one class; `component_id` is the least id reachable by links. Null, empty and
    blank texts have no shingles and are their own component; a null id is counted as no id (a component of null ids
    only has a null id). Repeated rows link like any copies. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = stage(rows.mapInArrow(_set_rows(SELDOM), SET_SCHEMA), "shingle-sets")
    known = found.filter("times = 0").select("doc_id", "text_key", "n", "key", "sketch")
    often = found.filter("times > 0").groupBy("signature").agg(F.sum("times").alias("times")).filter(F.col("times") > group)
    common = np.array([r.signature for r in often.orderBy(F.desc("times"), "signature").limit(COMMON).select("signature").toLocalIterator()], dtype=np.int64).view(np.uint64)
    filled = known.filter("n > 0")
    total = filled.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    classes = stage(filled.groupBy("key").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("row"),
                                              F.max("n").alias("n"), F.max("sketch").alias("sketch")), "set-classes")
    buckets = max(8, int(total * 0.4 / bucket_signatures) + 1)
    lists, hot = grouped(rows.select("text").mapInArrow(_text_blobs(buckets, group, np.sort(common)), BLOB_SCHEMA), buckets, group, "signature-groups")

    stars = _stars(lists, hot, classes)
    # the least centre of each set first, which joins large groups of copies by one edge a set; then the other stars across components
    stars = stage(stars, "stars")
    links = _links(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), classes, rows)
    links = stage(links.unionByName(_links(_across(stars, components(links)), classes, rows)), "links")
    labels = components(links)

    # what stars have not joined: all pairs of lists across components; hot groups across components by more signatures
    more = _pairs_across(lists, labels, classes)
    open_hot = _labelled(members(hot), labels)
    undecided = open_hot.join(open_hot.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high"), "signature")
    affected = stage(undecided.select("key").distinct(), "hot-sets")
    if not affected.isEmpty():
        again = sets_of(affected, classes, rows)
        lists, hot = grouped(again.mapInArrow(_set_blobs(buckets, group), BLOB_SCHEMA), buckets, group, "hot-set-groups")
        links = stage(links.unionByName(_links(_across(_stars(lists, hot, classes), labels), classes, rows)), "links")
        labels = components(links)
        more = _across(more, labels).unionByName(_hot_pairs(again, lists, hot, labels, classes, buckets, group))
    final = components(links.unionByName(_links(more.distinct(), classes, rows)))

    joined = _labelled(classes.select("key", "least"), final)
    named = joined.join(joined.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("key", "component_id")
    out = known.join(named, "key", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("key").alias("set_key"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _stars(lists: DataFrame, hot: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that join copies: every list around its least key; every hot group, cut by size, around a few members that
    differ from group to group, of which a set takes those it meets most often. So the rows grow with the sets, however
    many hot groups a set is in."""
    sized = members(hot).join(classes.select("key", "n"), "key").select("signature", "key", F.floor(F.ln("n") * SIZES_PER_FACTOR).alias("size"))
    centres = sized.groupBy("signature", "size").agg(
        F.array_distinct(F.array(*[F.min_by("key", F.xxhash64("key", F.lit(k))) for k in range(CENTRES)])).alias("centres"))
    met = sized.join(centres, ["signature", "size"]).groupBy("key").agg(F.flatten(F.collect_list("centres")).alias("centres"))
    around = met.mapInArrow(_frequent_centres, "a long, b long")
    pairs = lists.select(F.array_min("keys").alias("a"), F.explode("keys").alias("b")).unionByName(around)
    return pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _frequent_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set the other sets that are centres of most of its groups, `STARS` of them at most."""
    for batch in _pieces(batches, "centres", PIECE_CENTRES):
        keys, centre = np.asarray(batch["key"]), np.asarray(batch["centres"].flatten())
        row = np.repeat(np.arange(len(keys)), np.asarray(batch["centres"].value_lengths()))
        order = np.lexsort((centre, row))
        centre, row = centre[order], row[order]
        at = np.flatnonzero(np.concatenate(([True], (centre[1:] != centre[:-1]) | (row[1:] != row[:-1])))[: len(centre)])
        times, centre, row = np.diff(np.append(at, len(centre))), centre[at], row[at]
        other = centre != keys[row]
        times, centre, row = times[other], centre[other], row[other]
        order = np.lexsort((mix(centre.view(np.uint64)), -times, row))
        centre, row = centre[order], row[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < STARS
        yield pa.RecordBatch.from_arrays([pa.array(centre[first]), pa.array(keys[row[first]])], names=["a", "b"])


def _hot_pairs(sets: DataFrame, lists: DataFrame, hot: DataFrame, labels: DataFrame, classes: DataFrame, buckets: int, group: int) -> DataFrame:
    """Candidates between sets that share hot signatures but no component yet."""
    pairs = _pairs_across(lists, labels, classes)

    marked = stage(sets.join(hot_of_keys(hot, buckets), "key").withColumn("buckets", F.lit(buckets)), "hot-marked")
    near = stage(marked.mapInArrow(_deletions, DELETION_SCHEMA).distinct(), "one-deletions")
    both = near.groupBy("signature").agg(F.count_if("deleted").alias("d"), F.count_if(~F.col("deleted")).alias("f")).filter("d > 0 AND f > 0")
    met = near.join(both, "signature")
    whole, less = met.filter("NOT deleted"), met.filter("deleted")
    labelled = _labelled(whole.select("signature", "key"), labels).select("signature", F.col("key").alias("a"), F.col("component").alias("low"))
    across = labelled.join(_labelled(less.select("signature", "key"), labels).withColumnRenamed("key", "b"), "signature").filter("low != component AND a != b")
    pairs = pairs.unionByName(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    # sets of hot segments nearly throughout: linked ones share a shingle that is not hot, or link by hot shingles alone
    rest = sets.join(stage(marked.mapInArrow(_beyond, "key long"), "beyond-budget"), "key")
    shared, common = grouped(rest.mapInArrow(_shingle_blobs(buckets, group), BLOB_SCHEMA), buckets, group, "shingle-groups")
    pairs = pairs.unionByName(_pairs_across(shared, labels, classes))
    parts = rest.join(hot_of_keys(common, buckets), "key").withColumn("buckets", F.lit(buckets)).mapInArrow(_hot_parts, PART_SCHEMA)
    return pairs.unionByName(_across(part_links(stage(parts, "hot-parts")), labels))


def _shingle_blobs(buckets: int, group: int):
    """Every shingle of sets at hand as a signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_sets(batches):
            shingles, bounds = _sets(batch)
            yield from blobs(np.repeat(np.asarray(batch["key"]), np.diff(bounds)), shingles, buckets, group)
    return run


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets with more hot or empty segments than their budget."""
    for batch in _whole_sets(batches):
        shingles, bounds = _sets(batch)
        lacking = np.zeros(len(batch), dtype=bool)
        for picked, most, own, _, _, _, unfit, _, _ in _second_look(batch, shingles, bounds):
            lacking[picked] |= unfit > np.ceil(SLACK * most).astype(np.int64) - own
        yield pa.RecordBatch.from_arrays([batch["key"].filter(pa.array(lacking))], names=["key"])


# --- sets of hot shingles --------------------------------------------------------------------------------------------

PART_SCHEMA = "key long, part long, own long, size long, least long, shingles binary"


def _hot_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sets that can link by hot shingles alone (three quarters of them at least): these shingles, and how many others there are."""
    for batch in _whole_sets(batches):
        shingles, bounds = _sets(batch)
        n = np.diff(bounds)
        row = np.repeat(np.arange(len(n)), n)
        hot = _is_hot(batch, row, shingles)
        size = np.bincount(row[hot], minlength=len(n)).astype(np.int64)
        shingles, bounds = _some(shingles[hot], np.concatenate(([0], np.cumsum(size))), np.flatnonzero(4 * size >= 3 * n))
        at = np.flatnonzero(4 * size >= 3 * n)
        scattered = mix(shingles)
        least = [int(scattered[i:j].min().view(np.int64)) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([
            batch["key"].take(pa.array(at)), pa.array(set_keys(shingles, bounds)), pa.array((n - size)[at]), pa.array(size[at]), pa.array(least, pa.int64()),
            pa.array([shingles[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()),
        ], names=["key", "part", "own", "size", "least", "shingles"])


def part_links(parts: DataFrame) -> DataFrame:
    """Links of sets by their hot shingles alone, enough of them to connect all that link so; no more than a few per set and block.

    In a part, and between two parts, whether sets link depends on how many other shingles (`own`) they have together. So a
    set that links with any set of another part links with its head (the least `own`), and where several parts are near, the
    heads of all that a set links with link with the head of its own part.
    """
    heads = parts.groupBy("part").agg(F.min(F.struct("own", "key")).alias("head"), F.max("size").alias("size"), F.max("least").alias("least"), F.max("shingles").alias("shingles"))
    heads = stage(heads.select("part", F.col("head.key").alias("head"), F.col("head.own").alias("head_own"), "size", "least", "shingles"), "part-heads")
    blocks = heads.join(heads.groupBy("least").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s")), "least").withColumn(
        "block", F.xxhash64("least", F.pmod("part", F.ceil(F.greatest(F.col("c") / BLOCK_SETS, F.col("s") / BLOCK_SHINGLES)))))
    blocks = stage(blocks.groupBy("block").agg(F.collect_list(F.struct("part", "head", "head_own", "size", "shingles")).alias("members")), "part-blocks")
    met = blocks.mapInArrow(_prefixes, "shingle long, block long").groupBy("shingle").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    met = stage(met.select("blocks").distinct().mapInArrow(_block_pairs, "i long, j long").distinct(), "block-pairs")
    side = lambda x, y: blocks.select(F.col("block").alias(x), F.col("members").alias(y))
    both = met.join(side("i", "left"), "i").join(side("j", "right"), "j").repartition(met.count() // BLOCK_PAIRS + 1)
    found = stage(both.mapInArrow(_block_links, "part long, room long, a long, b long"), "part-links")
    best = found.filter("part IS NOT NULL").groupBy("part").agg(F.max_by("b", "room").alias("b"), F.max("room").alias("room"))
    within = parts.join(heads.select("part", "head", "head_own"), "part").filter("3 * (own + head_own) <= size").select(F.col("key").alias("a"), F.col("head").alias("b"))
    nearest = parts.join(best, "part").filter("3 * own <= room").select(F.col("key").alias("a"), "b")
    pairs = found.filter("part IS NULL").select("a", "b").unionByName(within).unionByName(nearest).filter("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles by which blocks meet: of each part, the quarter that comes first; linked parts share one of those."""
    for batch in batches:
        for block, inside in _one_by_one(batch, "block", "members"):
            first = [np.sort(mix(np.frombuffer(x["shingles"], dtype=np.uint64)))[: x["size"] // 4 + 1] for x in inside]
            shingle = np.unique(np.concatenate(first)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(np.full(len(shingle), block, dtype=np.int64))], names=["shingle", "block"])


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks that meet, each block with itself too."""
    for batch in batches:
        seen = set()
        for blocks in batch["blocks"].to_pylist():
            seen.update((x, y) for i, x in enumerate(blocks) for y in blocks[i:])
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in seen], pa.int64()) for k in (0, 1)], names=["i", "j"])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks: a spanning forest of the links between heads (no part), and each part's partner that leaves most room,
    three times the shingles of its own that a set of the part may have."""
    for batch in batches:
        for left, right in _one_by_one(batch, "left", "right"):
            both = [*left, *right] if left != right else left
            side = slice(len(left)), slice(len(both) - len(right), len(both))
            part, head, own, size = (np.array([x[c] for x in both], dtype=np.int64) for c in ("part", "head", "head_own", "size"))
            common = _common([x["shingles"] for x in left], [x["shingles"] for x in right])
            room = 7 * common - 3 * (size[side[0], None] + size[None, side[1]])
            room[part[side[0], None] == part[None, side[1]]] = -1
            rows = []
            for spare, near, mine in ((room - 3 * own[None, side[1]], head[side[1]], part[side[0]]), ((room - 3 * own[side[0], None]).T, head[side[0]], part[side[1]])):
                best = spare.argmax(1)
                most = spare[np.arange(len(best)), best]
                rows += [(int(p), int(m), None, int(b)) for p, m, b in zip(mine, most, near[best], strict=True) if m >= 0]
            linked = np.zeros((len(both), len(both)), dtype=bool)
            linked[side] = room >= 3 * (own[side[0], None] + own[None, side[1]])
            rows += [(None, None, int(head[i]), int(head[j])) for i, j in _forest(linked | linked.T)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["part", "room", "a", "b"])


def _common(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """How many shingles each of the left sets has in common with each of the right ones."""
    arrays = [[np.frombuffer(b, dtype=np.uint64) for b in x] for x in (left, right)]
    known = np.intersect1d(*(np.unique(np.concatenate(x)) for x in arrays))
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    marks = []
    for x in arrays:
        value = np.concatenate(x)
        at = np.minimum(np.searchsorted(known, value), max(0, len(known) - 1))
        hit = known[at] == value if len(known) else np.zeros(len(value), dtype=bool)
        marks.append((np.repeat(np.arange(len(x)), [len(y) for y in x])[hit], at[hit]))
    for first in range(0, len(known), COLUMNS):
        tables = []
        for x, (row, at) in zip(arrays, marks, strict=True):
            table = np.zeros((len(x), min(COLUMNS, len(known) - first)), dtype=np.float32)
            inside = (at >= first) & (at < first + COLUMNS)
            table[row[inside], at[inside] - first] = 1
            tables.append(table)
        out += (tables[0] @ tables[1].T).astype(np.int64)
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a graph, from its matrix."""
    out, fresh = [], np.ones(len(linked), dtype=bool)
    for start in range(len(linked)):
        walk = [start] if fresh[start] else []
        fresh[start] = False
        while walk:
            at = walk.pop()
            found = np.flatnonzero(linked[at] & fresh).tolist()
            fresh[found] = False
            out += [(at, x) for x in found]
            walk += found
    return out


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: of the least id, then of the least text hash. Documents without shingles stay.
    Rows that repeat an id and text count once."""
    linked = link(docs, **options)
    at = lambda id, key: (F.coalesce(id, F.lit(0)).alias("_id"), id.isNull().alias("_none"), key.alias("_key"))
    first = linked.filter("n_shingles > 0").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("row"))
    chosen = first.select(*at(F.col("row.doc_id"), F.col("row.text_key"))).unionByName(
        linked.filter("n_shingles = 0").select(*at(F.col("doc_id"), F.col("text_key"))).distinct())
    rows = docs.select(*at(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(chosen, ["_id", "_none", "_key"], "left_semi").dropDuplicates(["_id", "_none", "_key"]).select("row.*")
