"""Hard negatives of anchors, with score bounds along a spanning tree of the anchors.

Components become integers, so scores are exact. Two passes ask for each anchor: its best rows of the same label (the positives), and
then, for each positive, the best rows of another label whose score is in a window below the positive's.

Candidates are put into blocks by the nearest of a few pivots, anchors into trees likewise. A block is sent to one task
once; the trees stream past it, tree by tree, in the order in which every anchor's parent stands before it. For the first anchor of a tree
all scores with the block are taken. For any other one, the score at its parent plus or minus edge length times candidate norm
bounds the score, and the parent's own interval is widened where it was not scored itself. Only candidates whose interval
reaches a window (or, for positives, the best lower bounds) are scored. Anchors whose edge is too long to rule out much, judged by some
of the block's rows, are heads like the first one: all scores of a tree's heads are one matrix product. Before that, a pivot and the
radius around it rule out whole blocks for an anchor by the same inequality; such an anchor is not sent to them.

What is bounded: pivots are drawn on the driver from at most about `PIVOT_ROWS` rows; a block holds about `BLOCK_ROWS` rows and a tree
`TREE_ROWS` anchors, hot pivots and hot labels being dealt out by hash. All anchors meet all rows that the bounds do not rule
out, in blocks, so the work of a table without structure is anchors times rows, and the shuffle anchors times blocks. Neither anchors nor
what is sent to blocks is ever broadcast: their files say little of their size, since whole numbers pack well.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmetrics.plans.staging import stage

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
WINDOW = (50, 95)  # per cent of the positive's score
PIVOT_ROWS, PIVOTS = 4_096, 64
BLOCK_ROWS, TREE_ROWS = 16_384, 256
EXACT, SINGLE = 2 ** 52, 2 ** 24  # up to here sums of products are exact in doubles, and in floats
JUDGES, REACHED = 256, 0.25  # rows of a block that judge an edge; a longer share of them in reach makes a head
FOUND_ROWS = 8_192  # of results, before they are sent on
FEW_BLOCKS = 8_192  # names of so many blocks are broadcast


class Pivots(NamedTuple):
    rows: np.ndarray

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        return (((self.rows ** 2).sum(1) - 2 * vectors @ self.rows.T)).argmin(1)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """`vec_id, label, x` (whole numbers as doubles) of the rows that take part: an id, a label, a vector without null or non-finite components.

    Labels of ids divisible by 7 are moved on by one, of ten. Rows equal in all of these count once.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(
        F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), F.transform("x", lambda v: F.floor(v * SCALE).cast("double")).alias("x"))


def _matrix(column: pa.Array | pa.ChunkedArray, dimensions: int, dtype: type = np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=dtype).reshape(-1, dimensions)


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers: in the floating type they come in if it holds them, else in 64-bit integers."""
    return np.rint(a @ b).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64)


def spanning_tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of a minimum spanning tree of the rows from the first one on, place of each one's parent in that order, edge lengths."""
    n = len(rows)
    squares = (rows ** 2).sum(1)
    nearest, parent = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    order, place, edge = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n)
    done = np.zeros(n, dtype=bool)
    for k in range(n):
        now = 0 if k == 0 else int(np.where(done, np.inf, nearest).argmin())
        order[k], place[now], done[now] = now, k, True
        edge[k] = np.sqrt(((rows[now] - rows[parent[now]]) ** 2).sum()) if k else 0.0
        distance = squares + squares[now] - 2 * rows @ rows[now]
        closer = (distance < nearest) & ~done
        nearest[closer], parent[closer] = distance[closer], now
    return order, place[parent[order]], edge


class Shape(NamedTuple):
    dimensions: int
    exact: bool
    single: bool
    pivots: Pivots

    @property
    def element(self) -> str:
        """What components are kept as; where floats hold the sums, no component is above 2^12."""
        return "short" if self.single else "double"

    @property
    def dtype(self) -> type:
        return np.float32 if self.single else np.float64


def fit(rows: DataFrame, block_rows: int = BLOCK_ROWS, seed: int = 5, pivots: int = PIVOTS, pivot_rows: int = PIVOT_ROWS) -> Shape | None:
    """Up to `pivots` pivots, one per `block_rows` rows, from about `pivot_rows` rows; the length that most vectors have counts (the longer of two equally common ones)."""
    square = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("longest")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes or not sizes[0].d:
        return None
    share = int(min(1.0, pivot_rows / sizes[0].n) * (1 << 30))
    # each row draws for itself, so one id or vector cannot fill the sample; the limit only bounds what chance may add
    drawn = rows.filter((F.size("x") == sizes[0].d) & (F.pmod(F.xxhash64(F.lit(seed), "vec_id", "x"), F.lit(1 << 30)) < max(share, 1)))
    wanted = int(min(pivots, -(-sizes[0].n // block_rows)))
    found = drawn.orderBy(F.xxhash64(F.lit(seed), "vec_id", "x"), "vec_id").select("x").limit(wanted).collect()
    centres = np.unique(np.array([r.x for r in found] or [[0.0] * sizes[0].d]), axis=0)
    return Shape(sizes[0].d, sizes[0].longest < EXACT, sizes[0].longest < SINGLE, Pivots(centres))


def place(rows: DataFrame, shape: Shape) -> DataFrame:
    """Rows with their nearest pivot, the distance to it and their norm, written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 4096):
                batch = whole.slice(first, 4096)
                x = _matrix(batch["x"], shape.dimensions)
                pivot = shape.pivots.nearest(x)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["x"].cast(pa.list_(pa.int16() if shape.single else pa.float64())), pa.array(pivot.astype(np.int32)), pa.array(np.sqrt(((x - shape.pivots.rows[pivot]) ** 2).sum(1))),
                                                  pa.array(np.sqrt((x ** 2).sum(1)))], names=["vec_id", "label", "x", "pivot", "far", "norm"])
    usual = rows.filter(F.size("x") == shape.dimensions)
    facts = usual.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids")).first()
    if facts.ids < facts.n:
        usual = usual.dropDuplicates(["vec_id", "label", "x"])
    return stage(usual.mapInArrow(run, f"vec_id long, label long, x array<{shape.element}>, pivot int, far double, norm double"), "placed-vectors")


def trees(placed: DataFrame, is_anchor: str, shape: Shape, tree_rows: int) -> DataFrame:
    """Anchors with their tree, their place in its order, their parent's place and the edge to it, written to the shared folder."""
    def run(table: pa.Table) -> pa.Table:
        order, parent, edge = spanning_tree(_matrix(table["x"], shape.dimensions))
        table = table.take(pa.array(order))
        return pa.table([*[table[c] for c in ("vec_id", "label", "x", "norm", "tree")], pa.array(np.arange(len(order))), pa.array(parent), pa.array(edge)],
                        names=["vec_id", "label", "x", "norm", "tree", "nth", "parent", "edge"])
    anchors = placed.filter(is_anchor).select("vec_id", "label", "x", "pivot", "norm")
    sizes = anchors.groupBy("pivot").agg(F.ceil(F.count("*") / tree_rows).alias("parts"))  # at most one row per pivot
    dealt = anchors.join(F.broadcast(sizes), "pivot").withColumn("tree", F.xxhash64("pivot", F.pmod(F.xxhash64("vec_id", "x"), F.col("parts"))))
    built = dealt.select("vec_id", "label", "x", "norm", "tree").groupBy("tree").applyInArrow(
        run, f"vec_id long, label long, x array<{shape.element}>, norm double, tree long, nth long, parent long, edge double")
    return stage(built, "anchor-trees")


def blocks(placed: DataFrame, by_label: bool, block_rows: int) -> tuple[DataFrame, DataFrame, bool]:
    """Candidates with their block, a row per block with its label (positives only) and pivot, and whether these rows are few."""
    keys = ["label", "pivot"] if by_label else ["pivot"]
    sizes = placed.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    names = sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(F.xxhash64(*keys, "part").alias("block"), *keys)
    few = names.limit(FEW_BLOCKS + 1).count() <= FEW_BLOCKS
    dealt = placed.join(F.broadcast(sizes) if few else sizes.hint("merge"), keys).withColumn(
        "block", F.xxhash64(*keys, F.pmod(F.xxhash64(F.lit("block"), "vec_id", "x"), F.col("parts"))))
    return dealt.select("block", "vec_id", "label", "x", "norm"), names, few


def send(anchors: DataFrame, names: DataFrame, few: bool, key: str) -> DataFrame:
    """A row per anchor and block of its key. Anchors stay where they are or are shuffled."""
    return anchors.join(F.broadcast(names) if few else names.hint("merge"), key)


class Block(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    norms: np.ndarray
    distinct: bool


class Tree:
    """Intervals of the scores of a tree's anchors with the rows of one block."""

    def __init__(self, block: Block, exact: bool):
        self.x, self.columns, self.norms, self.exact = block.x, block.x.T, block.norms, exact
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}
        self.vectors: dict[int, np.ndarray] = {}

    def head(self, nth: int, vector: np.ndarray, scores: np.ndarray) -> None:
        """An anchor whose scores with the whole block are known."""
        self.low[nth] = self.high[nth] = scores
        self.vectors[nth] = vector

    def visit(self, nth: int, parent: int, vector: np.ndarray, edge: float, able) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that `able(low, high)` does not rule out, and their scores. The parent stands before its children;
        one that was not sent here is replaced by the last anchor seen, at their distance."""
        if not self.low:
            scores = products(vector, self.columns, self.exact)
            picked = np.flatnonzero(able(scores, scores))
            self.low[nth] = self.high[nth] = scores.astype(np.float64)
            self.vectors[nth] = vector
            return picked, scores[picked]
        if parent not in self.low:
            parent = next(reversed(self.low))
            edge = float(np.sqrt(((vector - self.vectors[parent]) ** 2).sum()))
        slack = edge * (1 + 1e-9) * self.norms + 1e-3
        low, high = self.low[parent] - slack, self.high[parent] + slack
        picked = np.flatnonzero(able(low, high))
        if 2 * len(picked) > len(self.norms):
            scores = products(vector, self.columns, self.exact)[picked]
        else:
            scores = products(self.x[picked], vector, self.exact)
        low[picked] = high[picked] = scores
        self.low[nth], self.high[nth], self.vectors[nth] = low, high, vector
        return picked, scores


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` highest scores of different ids, ties by smaller id."""
    if len(scores) > 64 * k:
        least = np.partition(scores, len(scores) - 8 * k)[len(scores) - 8 * k]
        some = np.flatnonzero(scores >= least)
        if len(np.unique(ids[some])) >= k:
            return some[best_of_all(scores[some], ids[some], k)]
    return best_of_all(scores, ids, k)


def best_distinct(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The same where no id stands twice."""
    if len(scores) <= 8 * k:
        return np.lexsort((ids, -scores))[:k]
    some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def best_of_all(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


STREAM_COLUMNS = ["block", "is_anchor", "tree", "nth", "parent", "edge", "vec_id", "label", "x", "norm", "scores"]
FOUND_SCHEMA = "anchor_id long, anchor_label long, positive_id long, positive_score long, vec_id long, score long"


class Asked(NamedTuple):
    """An anchor, and the windows that it asks for (negatives only): positive, its score, least and most score of the window."""

    id: int
    label: int
    windows: list[tuple[int, int, int, int]]


def windows_of(scores: list[dict] | None, window: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """Least per cent rounded up, most per cent rounded down; empty windows are left out."""
    all_of_them = [(p["vec_id"], p["score"], -(-window[0] * p["score"] // 100), window[1] * p["score"] // 100) for p in scores or []]
    return [w for w in all_of_them if w[2] <= w[3]]


def _hull(asked: Asked) -> tuple[int, int]:
    """Least and most score of all windows, which overlap; without a window nothing is in it."""
    return min((w[2] for w in asked.windows), default=1), max((w[3] for w in asked.windows), default=0)


def heads(block: Block, vectors: np.ndarray, parent: np.ndarray, edge: np.ndarray, asked: list[Asked], shape: Shape, by_label: bool) -> np.ndarray:
    """Whether an anchor's edge is too long to rule out much of the block. Some of its rows judge, so this decides on time alone."""
    some = slice(None, None, -(-len(block.ids) // JUDGES))
    at = products(vectors, block.x[some].T, shape.exact)[parent]
    slack = edge[:, None] * block.norms[some]
    if by_label:
        reached = at + slack >= (at - slack).max(axis=1, keepdims=True)
    else:
        hulls = np.array([_hull(a) for a in asked], dtype=np.float64)
        reached = (at + slack >= hulls[:, :1]) & (at - slack <= hulls[:, 1:])
    far = reached.mean(axis=1) > REACHED
    far[0] = True
    return far


def _chains(nth: np.ndarray, parent: np.ndarray, edge: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the parents among these anchors of a tree, and edges; a parent that is not among them is replaced by the anchor before, at their distance."""
    place = np.minimum(np.searchsorted(nth, parent), len(nth) - 1)
    there = (nth[place] == parent) & (place < np.arange(len(nth)))
    before = np.maximum(np.arange(len(nth)) - 1, 0)
    distance = np.sqrt(((vectors - vectors[before]).astype(np.float64) ** 2).sum(1))
    return np.where(there, place, before), np.where(there, edge, distance)


def _stream(shape: Shape, positives: int, negatives: int, window: tuple[int, int], by_label: bool):
    """Rows come block by block, candidates first, then anchors tree by tree in order."""
    def positives_of(asked: Asked, block: Block, picked: np.ndarray | None, scores: np.ndarray) -> Iterator[tuple]:
        ids = block.ids if picked is None else block.ids[picked]
        if picked is None:
            other = np.flatnonzero((ids != asked.id) & (block.labels == asked.label))
            if len(other) < len(ids):
                ids, scores = ids[other], scores[other]
        best = (best_distinct if block.distinct else best_of)(scores, ids, positives)
        for vec_id, score in zip(ids[best].tolist(), scores[best].tolist(), strict=True):
            yield asked.id, asked.label, None, None, vec_id, int(score)

    def near_best(asked: Asked, block: Block):
        other = (block.ids != asked.id) & (block.labels == asked.label)

        def able(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            # nothing whose upper bound is under the best lower bounds can be among the first
            if not block.distinct or other.sum() <= positives:
                return other
            return other & (high >= np.partition(low[other], -positives)[-positives])
        return able

    def negatives_of(asked: Asked, block: Block, picked: np.ndarray | None, scores: np.ndarray) -> Iterator[tuple]:
        if not asked.windows:
            return
        if picked is None:
            picked = np.flatnonzero(scores >= min(w[2] for w in asked.windows))
            picked = picked[(block.ids[picked] != asked.id) & (block.labels[picked] != asked.label)]
            scores = scores[picked]
        ids = block.ids[picked]
        below = np.flatnonzero(scores <= min(w[3] for w in asked.windows))
        if len(below) > 64 * negatives:
            # the first of every window are among these or higher ones, whichever window starts above them
            under = scores[below]
            least = np.partition(under, len(under) - 8 * negatives)[len(under) - 8 * negatives]
            if len(np.unique(ids[below[under >= least]])) >= negatives:
                kept = np.flatnonzero(scores >= least)
                ids, scores = ids[kept], scores[kept]
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        for positive, score, least, most in asked.windows:
            first, end = np.searchsorted(-scores, (-most, -least + 1))
            inside = slice(first, min(end, first + negatives)) if block.distinct else first + best_of_all(scores[first:end], ids[first:end], negatives)
            for vec_id, found in zip(ids[inside].tolist(), scores[inside].tolist(), strict=True):
                yield asked.id, asked.label, positive, score, vec_id, int(found)

    def in_window(asked: Asked, block: Block):
        other = (block.ids != asked.id) & (block.labels != asked.label)

        least, most = _hull(asked)

        def reached(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return other & (high >= least) & (low <= most)
        return reached

    found, able = (positives_of, near_best) if by_label else (negatives_of, in_window)

    def meet(block: Block, part: pa.RecordBatch) -> Iterator[tuple]:
        """Anchors of one tree, in order, with the block."""
        nth, vectors = np.asarray(part["nth"]), _matrix(part["x"], shape.dimensions, shape.dtype)
        ids, labels = part["vec_id"].to_pylist(), part["label"].to_pylist()
        asked = [Asked(i, label, windows_of(s, window)) for i, label, s in zip(ids, labels, part["scores"].to_pylist(), strict=True)]
        parent, edge = _chains(nth, np.asarray(part["parent"]), np.asarray(part["edge"]), vectors)
        far = heads(block, vectors, parent, edge, asked, shape, by_label)
        rows = np.flatnonzero(far)
        whole = dict(zip(rows.tolist(), vectors[rows] @ block.x.T if shape.exact else products(vectors[rows], block.x.T, False), strict=True))
        above = set(parent[~far].tolist())
        tree = Tree(block, shape.exact)
        for k, one in enumerate(asked):
            if k in whole:
                if k in above:
                    tree.head(k, vectors[k], whole[k])
                yield from found(one, block, None, whole[k])
            else:
                yield from found(one, block, *tree.visit(k, int(parent[k]), vectors[k], float(edge[k]), able(one, block)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, block, out = None, [], None, []
        for batch in batches:
            names, anchor, trees = np.asarray(batch["block"]), np.asarray(batch["is_anchor"]), np.asarray(batch["tree"].fill_null(0))
            changes = (names[1:] != names[:-1]) | (anchor[1:] != anchor[:-1]) | (trees[1:] != trees[:-1])
            edges = np.flatnonzero(np.append(True, changes)[: len(batch)]).tolist()
            for first, end in zip(edges, [*edges[1:], len(batch)], strict=True):
                part = batch.slice(first, end - first)
                if names[first] != name:
                    name, parts, block = names[first], [], None
                if not anchor[first]:
                    parts.append((np.asarray(part["vec_id"]), np.asarray(part["label"]), _matrix(part["x"], shape.dimensions, shape.dtype), np.asarray(part["norm"])))
                    continue
                if not parts:  # the hash left this part of its pivot without rows
                    continue
                if block is None:
                    ids, labels, x, norms = (np.concatenate(c) for c in zip(*parts, strict=True))
                    block = Block(ids, labels, x, norms, len(np.unique(ids)) == len(ids))
                for k in range(0, len(part), TREE_ROWS):
                    out += meet(block, part.slice(k, TREE_ROWS))
                    if len(out) >= FOUND_ROWS:
                        yield _found_batch(out)
                        out = []
        yield _found_batch(out)
    return run


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["anchor_id", "anchor_label", "positive_id", "positive_score", "vec_id", "score"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=names)


def _probes(wanted: DataFrame, shape: Shape, radius: np.ndarray, window: tuple[int, int]) -> DataFrame:
    """A row per anchor and pivot around which a score can be in one of its windows: the score at the pivot, give or take norm times radius."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 1024):
                batch = whole.slice(first, 1024)
                scores = batch["scores"].to_pylist()
                least = np.array([min(p["score"] for p in some) for some in scores]) * window[0] / 100
                most = np.array([max(p["score"] for p in some) for some in scores]) * window[1] / 100
                at = _matrix(batch["x"], shape.dimensions) @ shape.pivots.rows.T
                slack = np.asarray(batch["norm"])[:, None] * radius * (1 + 1e-9) + 1e-3
                row, pivot = np.nonzero((at + slack >= least[:, None]) & (at - slack <= most[:, None]) & (radius >= 0))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(pivot.astype(np.int32))], names=[*whole.schema.names, "pivot"])
    schema = f"vec_id long, label long, x array<{shape.element}>, norm double, tree long, nth long, parent long, edge double, scores array<struct<vec_id:long,score:long>>"
    return wanted.select("vec_id", "label", "x", "norm", "tree", "nth", "parent", "edge", "scores").mapInArrow(run, f"{schema}, pivot int")


def _meet(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Both as one table, by block, candidates before anchors and anchors in the order of their trees."""
    nothing = {"tree": "long", "nth": "long", "parent": "long", "edge": "double", "scores": "array<struct<vec_id:long,score:long>>"}
    left = candidates.withColumn("is_anchor", F.lit(False)).withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    right = anchors.withColumn("is_anchor", F.lit(True))
    both = left.select(*STREAM_COLUMNS).unionByName(right.select(*STREAM_COLUMNS))
    return both.repartition("block").sortWithinPartitions("block", "is_anchor", "tree", "nth")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The `k` best rows of each, with their rank."""
    each = found.groupBy(*by, "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: str = "vec_id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
         key: str = "vec_id", vector: str = "embedding", label: str = "label", block_rows: int = BLOCK_ROWS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    For each row that `is_anchor` holds for, its `positives` best other rows of the same label, and for each of these the
    `negatives` best rows of other labels whose score is `window` per cent of the positive's. Ties go to the smaller id. Ids
    name rows: rows that repeat an id are never each other's partners, and as candidates count once, with the
    better score; an anchor id that stands there with several labels or vectors is asked for each label, the better
    score counting. Vectors whose length is not the usual one take no part. Without usable rows, or without a
    positive or a negative, there is no row.
    """
    rows = stage(usable(vectors, key, vector, label), "usable-vectors")  # read several times
    empty = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    shape = fit(rows, block_rows)
    if shape is None:
        return empty
    placed = place(rows, shape)
    anchors = trees(placed, is_anchor, shape, tree_rows)

    candidates, names, few = blocks(placed, True, block_rows)
    asked = send(anchors, names.select("block", "label"), few, "label").withColumn("scores", F.lit(None).cast("array<struct<vec_id:long,score:long>>"))
    near = _meet(candidates, asked).mapInArrow(_stream(shape, positives, negatives, window, True), FOUND_SCHEMA)
    best = stage(_first(near, ["anchor_id", "anchor_label"], positives), "positives")

    scores = best.groupBy("anchor_id", "anchor_label").agg(F.collect_list(F.struct("vec_id", "score")).alias("scores"))  # at most `positives` each
    wanted = anchors.join(scores.hint("merge"), (F.col("vec_id") == F.col("anchor_id")) & (F.col("label") == F.col("anchor_label")))
    radius = np.full(len(shape.pivots.rows), -1.0)
    for r in placed.groupBy("pivot").agg(F.max("far").alias("radius")).collect():  # at most one row per pivot
        radius[r.pivot] = r.radius
    candidates, names, few = blocks(placed, False, block_rows)
    asked = send(_probes(wanted, shape, radius, window), names, few, "pivot")
    near = _meet(candidates, asked).mapInArrow(_stream(shape, positives, negatives, window, False), FOUND_SCHEMA)
    first = _first(near, ["anchor_id", "anchor_label", "positive_id", "positive_score"], negatives)
    return first.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
