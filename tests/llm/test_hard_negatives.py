"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
import pytest

from haulmetrics.llm import hard_negatives
from haulmetrics.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute(rows, is_anchor=lambda i: i % 50 == 0, positives=5, negatives=3, window=(50, 95)):
    """`rows` are (id, label, vector), each id once."""
    known = []
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        known.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * v) for v in vector]))
    if not known:
        return []
    ids, labels = np.array([k[0] for k in known]), np.array([k[1] for k in known])
    x = np.array([k[2] for k in known], dtype=np.int64)
    out = []
    for i, label, vector in known:
        if not is_anchor(i):
            continue
        scores = x @ np.array(vector, dtype=np.int64)
        order = np.lexsort((ids, -scores))
        order = order[ids[order] != i]
        for p in order[labels[order] == label][:positives].tolist():
            others = [n for n in order[labels[order] != label].tolist() if window[0] * int(scores[p]) <= 100 * int(scores[n]) <= window[1] * int(scores[p])]
            out += [(i, int(ids[p]), rank, int(ids[n]), int(scores[p]), int(scores[n])) for rank, n in enumerate(others[:negatives], 1)]
    return sorted(out)


def clustered(n, spread, d=8, seed=3):
    """Labels spread over clusters, so that windows hold something and bounds rule something out."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    which = rng.integers(0, 6, n)
    x = centres[which] * rng.uniform(0.5, 1.5, (n, 1)) + rng.normal(size=(n, d)) * spread
    return [(i, int(rng.integers(0, 10)), x[i].astype(np.float32).tolist()) for i in range(n)]


def result(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(table, **options).collect())


@pytest.mark.parametrize("spread, options", [(0.05, {}), (1.0, {}), (0.02, {"block_rows": 40, "tree_rows": 3}), (0.3, {"block_rows": 100, "tree_rows": 1000, "window": (10, 99), "negatives": 5})])
def test_equals_brute_force(spark, spread, options):
    rows = clustered(900, spread)
    kept = {k: v for k, v in options.items() if k in ("window", "negatives")}
    want = brute(rows, **kept)
    assert want and result(spark, rows, **options) == want


def test_bounds_rule_out_candidates(monkeypatch):
    """On clustered rows most candidates are not scored, and nothing in a window is lost."""
    rows = np.floor(256 * np.array([r[2] for r in clustered(2000, 0.01)]))
    block = hard_negatives.Block(np.arange(2000), np.zeros(2000, dtype=int), rows, np.sqrt((rows ** 2).sum(1)), True)
    anchors = rows[:200]
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    assert sorted(order.tolist()) == list(range(200)) and (parent[1:] < np.arange(1, 200)).all()
    tree, scored = hard_negatives.Tree(block, True), 0
    for nth, k in enumerate(order.tolist()):
        exact = (rows @ anchors[k]).astype(int)
        limit = np.sort(exact)[-20]
        picked, scores = tree.visit(nth, int(parent[nth]), anchors[k], float(edge[nth]), lambda low, high, limit=limit: high >= limit)  # noqa: B023
        assert (scores == exact[picked]).all() and set(np.flatnonzero(exact >= limit)) <= set(picked.tolist())
        scored += len(picked) if nth else 0
    assert scored < 0.5 * 199 * 2000


def test_ties_equal_vectors_and_hot_label(spark):
    rng = random.Random(1)
    rows = [(i, 3 if i % 3 else rng.randrange(10), [1.0, 0.5] if i % 2 else [rng.choice([0.75, 1.0]), rng.choice([0.25, 0.5])]) for i in range(400)]
    assert result(spark, rows, block_rows=50, tree_rows=2) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*clustered(120, 0.5), (1000, None, [1.0] * 8), (1050, 1, None), (1100, 1, [nan] * 8), (1150, 2, [inf] + [0.0] * 7), (1200, 2, [None] + [0.0] * 7), (1250, 3, [0.0] * 8)]
    want = brute(rows)
    assert result(spark, rows) == want
    assert result(spark, [*rows, *rows, (None, 1, [1.0] * 8), (1300, 1, [1.0])]) == want  # repeated rows count once
    assert result(spark, []) == result(spark, [(50, 1, None)]) == result(spark, [(50, 1, [1.0])]) == []
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, block string, score int")
    assert sorted(tuple(r) for r in hard_negatives.mine(table).collect()) == want


def test_integers_beyond_doubles(spark):
    rows = [(i, i % 3, [float(2 ** 20 + i), float(2 ** 20 - 3 * i)]) for i in range(101)]
    assert result(spark, rows) == brute(rows)


def broadcast_types(plan, inside=False):
    """Types of the columns that broadcasts of a physical plan hold."""
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    inside = inside or plan.nodeName().startswith("BroadcastExchange")
    found = [plan.output().apply(k).dataType().simpleString() for k in range(plan.output().size())] if inside else []
    return found + [t for k in range(plan.children().size()) for t in broadcast_types(plan.children().apply(k), inside)]


def test_vectors_are_never_broadcast(spark, monkeypatch):
    """Files of anchors are small beside their rows, and the rows sent to blocks are many times the anchors."""
    frames, write = [], hard_negatives.stage
    monkeypatch.setattr(hard_negatives, "stage", lambda df, name: (frames.append(df), write(df, name))[1])
    rows = clustered(3000, 0.3)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = hard_negatives.mine(table, "vec_id % 2 = 0", block_rows=300, tree_rows=50)
    types = [broadcast_types(df._jdf.queryExecution().executedPlan()) for df in [*frames, got]]
    assert any(types) and not any("array" in t for some in types for t in some)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 2 == 0)


def test_empty_parts_of_pivots_and_long_sums(spark):
    """A pivot's parts are dealt by hash, and some get no row; scores above 2^24 are not exact in floats."""
    rows = clustered(300, 0.3)
    assert result(spark, rows, block_rows=1, tree_rows=4) == brute(rows)
    long = [(i, label, [40.0 * v for v in vector]) for i, label, vector in rows]
    assert max(max(abs(s) for s in r[4:]) for r in brute(long)) > 2 ** 24 and result(spark, long, block_rows=100) == brute(long)


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in table.collect()]
    got = QUERIES["op13_hard_negatives"](spark, FOLDER)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
