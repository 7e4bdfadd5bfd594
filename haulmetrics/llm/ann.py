"""Nearest neighbours by inner product with an adaptive dimension scan over probed lists.

Vectors get one more component so that all have the same length, which turns the largest inner product into the
smallest distance, and are rotated at random, so that any few components estimate the whole distance. They are put
into lists around centroids. A query gets an upper bound of its k-th distance from a sample of fixed size, which has one
row per id, and probes the lists that the triangle inequality does not rule out. Inside a list, distances are added up by blocks of columns;
after each block a hypothesis test abandons the candidates whose partial distance is too large for them to end below
the bound. Survivors are scored exactly, in double precision, on the original vectors.

Rows that repeat id and vector are dropped first. Lists are cut into blocks of rows. A block is sent to one task once,
and the queries that probe it stream past it, so no task holds more than a block and a batch of queries, even if a third of all vectors are equal or have the same id. The driver sees the sample, and one row per list.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmetrics.plans.staging import stage

SAMPLE_ROWS = 8_192
LIST_ROWS = 2_048
MAX_LISTS = 1_024
BLOCK_ROWS = 8_192
COLUMNS = 16
CONFIDENCE = 2.1
DENSE_SHARE = 0.05


class Index(NamedTuple):
    dimensions: int
    rotation: np.ndarray
    longest: float
    centroids: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray  # rotated

    def rotated(self, vectors: np.ndarray, candidates: bool) -> np.ndarray:
        last = np.sqrt(np.maximum(self.longest - (vectors ** 2).sum(1), 0)) if candidates else np.zeros(len(vectors))
        return np.concatenate((vectors, last[:, None]), 1) @ self.rotation


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a ** 2).sum(1)[:, None] + (b ** 2).sum(1) - 2 * (a @ b.T), 0)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`vec_id, embedding` (doubles) of the vectors that take part: an id, no null, non-finite or missing component, and not zero.

    The length that most vectors have is the one that counts (the longer of two equally common ones).
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    rows = rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    usual = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.filter(F.size("embedding") == (usual.n if usual else -1))


def distinct(rows: DataFrame) -> DataFrame:
    """`rows` without those that repeat both id and vector; written to the shared folder if any id is there twice."""
    facts = rows.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids")).first()
    return rows if facts.ids == facts.n else stage(rows.dropDuplicates(["vec_id", "embedding"]), "vectors")


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, seed: int = 11) -> Index | None:
    """Rotation, length bound (over all rows), and centroids by k-means on a sample of about `sample_rows` ids, one vector of each."""
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"), F.max(square).alias("longest"),
                     F.max(F.size("embedding")).alias("d")).first()
    if not facts.n:
        return None
    share = int(min(1.0, sample_rows / facts.ids) * (1 << 30))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < max(share, 1))
    drawn = drawn.groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding")).toPandas()
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.normal(size=(facts.d + 1, facts.d + 1)))
    empty = Index(facts.d, rotation, facts.longest, np.zeros((1, facts.d + 1)), np.zeros(0, dtype=np.int64), np.zeros((0, facts.d + 1)))
    if drawn.empty:
        return empty
    drawn = drawn.sort_values("vec_id", kind="stable")
    sample = empty.rotated(np.stack(drawn["embedding"].to_numpy()), True)
    lists = int(np.clip(facts.n // list_rows, 1, min(MAX_LISTS, max(1, len(sample) // 8))))
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(12):
        nearest = squared_distances(sample, centroids).argmin(1)
        sizes = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return empty._replace(centroids=centroids, sample_ids=drawn["vec_id"].to_numpy(dtype=np.int64), sample=sample)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dimensions)


def assign(rows: DataFrame, index: Index) -> DataFrame:
    """`vec_id, embedding, list, distance` of every row, written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances = squared_distances(index.rotated(_matrix(batch["embedding"], index.dimensions), True), index.centroids)
            nearest = distances.argmin(1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array(nearest.astype(np.int32)),
                                              pa.array(np.sqrt(distances[np.arange(len(nearest)), nearest]))],
                                             names=["vec_id", "embedding", "list", "distance"])
    return stage(rows.mapInArrow(run, "vec_id long, embedding array<double>, list int, distance double"), "vector-lists")


def probes(queries: DataFrame, index: Index, k: int, radius: np.ndarray, blocks: np.ndarray) -> DataFrame:
    """A row per query and block of each list it probes, with the bound of its k-th squared distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 512):
                batch = whole.slice(first, 512)
                ids = np.asarray(batch["vec_id"])
                rotated = index.rotated(_matrix(batch["embedding"], index.dimensions), False)
                near = squared_distances(rotated, index.sample)
                near[ids[:, None] == index.sample_ids] = np.inf
                bound = np.partition(near, k - 1, 1)[:, k - 1] if near.shape[1] >= k else np.full(len(ids), np.inf)
                bound = bound * (1 + 1e-9) + 1e-9
                least = np.sqrt(squared_distances(rotated, index.centroids)) - radius
                query, probed = np.nonzero((least <= np.sqrt(bound)[:, None] + 1e-6) & (blocks > 0))
                copies = blocks[probed]
                which = np.repeat(np.arange(len(probed)), copies)
                block = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
                take = pa.array(query[which])
                yield pa.RecordBatch.from_arrays([
                    pa.array(probed[which].astype(np.int32)), pa.array(block.astype(np.int32)),
                    batch["vec_id"].take(take), batch["embedding"].take(take), pa.array(bound[query[which]]),
                ], names=["list", "block", "vec_id", "embedding", "bound"])

    return queries.mapInArrow(run, "list int, block int, vec_id long, embedding array<double>, bound double")


def scan(candidates: np.ndarray, queries: np.ndarray, bound: np.ndarray, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that survive the scan of the rotated vectors, block of columns by block."""
    width = candidates.shape[1]
    alive, partial, pairs = None, np.zeros((len(queries), len(candidates))), None
    for first in range(0, width, COLUMNS):
        end = min(first + COLUMNS, width)
        x, q = candidates[:, first:end], queries[:, first:end]
        # a partial distance of d of D rotated components estimates the whole within about confidence / sqrt(d)
        limit = bound * end / width * ((1 + confidence / np.sqrt(end)) ** 2 if end < width else 1 + 1e-9)
        if pairs is None:
            partial += squared_distances(q, x)
            alive = partial <= limit[:, None]
            if alive.mean() <= DENSE_SHARE or end == width:
                pairs = np.nonzero(alive)
                partial = partial[pairs]
        else:
            partial = partial + ((queries[pairs[0], first:end] - candidates[pairs[1], first:end]) ** 2).sum(1)
            keep = partial <= limit[pairs[0]]
            pairs, partial = (pairs[0][keep], pairs[1][keep]), partial[keep]
    return pairs


NEAR_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _best_of_block(index: Index, k: int, confidence: float, ids: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The `k` best rows of one block, in order of their id, for each query of a batch."""
    asked, sought, bound = np.asarray(queries["vec_id"]), _matrix(queries["embedding"], index.dimensions), np.asarray(queries["bound"])
    step = max(1, (1 << 22) // len(ids))
    for first in range(0, len(asked), step):
        cut = slice(first, first + step)
        query, found = scan(rotated, index.rotated(sought[cut], False), bound[cut], confidence)
        query = query + first
        other = asked[query] != ids[found]
        query, found = query[other], found[other]
        score = np.concatenate([np.zeros(0)] + [(sought[query[a: a + (1 << 18)]] * vectors[found[a: a + (1 << 18)]]).sum(1) for a in range(0, len(query), 1 << 18)])
        best = np.lexsort((-score, ids[found], query))
        same = (np.diff(query[best]) == 0) & (np.diff(ids[found[best]]) == 0)
        best = best[np.concatenate((np.ones(min(len(best), 1), dtype=bool), ~same))]
        query, found, score = query[best], found[best], score[best]
        rank = np.lexsort((ids[found], -score, query))
        query, found, score = query[rank], found[rank], score[rank]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < k
        yield pa.RecordBatch.from_arrays([pa.array(asked[query[top]]), pa.array(ids[found[top]]), pa.array(score[top])], schema=NEAR_SCHEMA)


def _best(index: Index, k: int, confidence: float):
    """Rows come block by block, each block's vectors before the queries that probe it; the queries stream past."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, block = None, [], None
        for batch in batches:
            names = np.asarray(batch["list"]).astype(np.int64) << 32 | np.asarray(batch["block"])
            asks = np.asarray(batch["is_query"])
            edges = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (asks[1:] != asks[:-1]))[: len(batch)]).tolist()
            for first, end in zip(edges, [*edges[1:], len(batch)], strict=True):
                part = batch.slice(first, end - first)
                if names[first] != name:
                    name, parts, block = names[first], [], None
                if not asks[first]:
                    parts.append((np.asarray(part["vec_id"]), _matrix(part["embedding"], index.dimensions)))
                elif parts:
                    if block is None:
                        ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
                        order = np.argsort(ids, kind="stable")
                        block = ids[order], vectors[order], index.rotated(vectors[order], True)
                    yield from _best_of_block(index, k, confidence, *block, part)

    return run


def search(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, key: str = "vec_id", vector: str = "embedding",
           confidence: float = CONFIDENCE, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`query_id, rank, vec_id, score`: for each row that `is_query` holds for, the `k` other rows of largest inner product.

    Ties go to the smaller id. Ids name vectors: rows that repeat an id are one candidate (the better score counts), and
    never their own query's. Vectors that take no part (see `usable`) are neither found nor searched for. Without
    usable vectors, or with one, the result is empty. The scan's tests can lose a neighbour by chance; `confidence`
    sets how rarely.
    """
    rows = distinct(usable(vectors, key, vector))
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(rows, list_rows=list_rows)
    if index is None:
        return empty
    listed = assign(rows, index)
    facts = listed.groupBy("list").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.count_if(F.expr(is_query)).alias("asked")).collect()
    radius, blocks = np.zeros(len(index.centroids)), np.zeros(len(index.centroids), dtype=np.int64)
    for r in facts:
        radius[r.list], blocks[r.list] = r.radius, -(-r.n // block_rows)
    asked = probes(listed.filter(is_query).select("vec_id", "embedding"), index, k, radius, blocks)
    per_list = F.element_at(F.array(*[F.lit(int(max(b, 1))) for b in blocks]), F.col("list") + 1)
    offered = listed.select("list", F.pmod(F.xxhash64("vec_id", "embedding"), per_list).cast("int").alias("block"), F.lit(False).alias("is_query"), "vec_id", "embedding",
                            F.lit(None).cast("double").alias("bound"))
    both = offered.unionByName(asked.withColumn("is_query", F.lit(True)))
    near = both.repartition("list", "block").sortWithinPartitions("list", "block", "is_query").mapInArrow(
        _best(index, k, confidence), "query_id long, vec_id long, score double")
    pairs = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
