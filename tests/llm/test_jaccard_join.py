"""The join against a brute-force version, for several limits of what counts as a hot signature."""

import random
import re
from collections import defaultdict

import pytest

from haulmetrics.llm import jaccard_join
from haulmetrics.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(rows):
    sets, parent, listed, least = [shingles(t) for _, t in rows], list(range(len(rows))), defaultdict(list), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in listed[x]:
                common[j] += 1
            listed[x].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed, n):
    """Copies with few edits, texts around shared passages, and texts of all small sizes."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50)]
    some = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages, rows = [some(25) for _ in range(3)], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 or not rows:
            text = some(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 20, 40, 90]))
        elif kind < 0.5:
            text = rng.choice(passages) + " " + some(rng.randint(0, 12))
        else:
            words = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words) + 1)
                words[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            text = " ".join(words)
        rows.append((i if i % 13 else None, text if i % 31 else None))
    return rows + rows[:4]


@pytest.mark.parametrize("seed, group", [(1, 48), (2, 4), (3, 2)])
def test_links_equal_brute_force(spark, seed, group):
    rows = corpus(seed, 160)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link(frame, group=group).collect()]
    assert sorted(got, key=str) == sorted(brute_force(rows), key=str)


def test_one_of_each_component_stays(spark):
    rows = corpus(5, 80)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard_join.keep_one(frame).collect()
    want = brute_force(rows)
    assert len([r for r in kept if shingles(r.text)]) == len({str(c) for _, n, c in want if n})
    assert {r.doc_id for r in kept if shingles(r.text) and r.doc_id} <= {c for _, _, c in want}


def test_linked_sets_share_an_indexed_signature():
    """The pigeonhole promise itself, on random pairs at the edge of the threshold."""
    import numpy as np
    rng = np.random.default_rng(4)
    for size in [3, 4, 5, 7, 8, 15, 16, 17, 60, 64, 100, 255, 256, 300]:
        for _ in range(20):
            common = int(rng.integers(max(1, int(size * 0.8)), size + 1))
            x = rng.integers(1, 2**63, size).astype(np.uint64)
            extra = rng.integers(1, 2**63, int(rng.integers(0, size // 3 + 1))).astype(np.uint64)
            y = np.concatenate((x[:common], extra))
            if 100 * common < 75 * (size + len(extra)):
                continue
            row, value = jaccard_join.signatures(np.concatenate((np.sort(x), np.sort(y))), np.array([0, size, size + len(y)]))
            assert set(value[row == 0]) & set(value[row == 1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7 + 93), (200, 201), (202, 201), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 200: 200, 201: 200, 202: 200}


def test_sets_of_hot_shingles_are_connected_by_few_pairs(spark, monkeypatch):
    """Every link by hot shingles alone is in a component of the pairs, whose number grows with the sets and not with their square."""
    import numpy as np
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 16)
    rng = random.Random(7)
    hot = [frozenset(rng.sample(range(1, 2**60), 40)) for _ in range(3)]
    sets = [(frozenset(rng.sample(sorted(base := rng.choice(hot)), len(base) - rng.randint(0, 8))), rng.randint(0, 8)) for _ in range(300)]
    sets = [(p, own) for p, own in sets if 4 * len(p) >= 3 * (len(p) + own)]
    rows = []
    for key, (p, own) in enumerate(sets):
        values = np.array(sorted(p), dtype=np.uint64)
        part = int(jaccard_join.set_keys(values, np.array([0, len(p)]))[0])
        rows.append((key, part, own, len(p), int(jaccard_join.mix(values).min().view(np.int64)), bytearray(values.tobytes())))
    pairs = jaccard_join.part_links(spark.createDataFrame(rows, jaccard_join.PART_SCHEMA)).collect()

    def named(edges):
        name = list(range(len(sets)))
        for _ in sets:
            for a, b in edges:
                name[a] = name[b] = min(name[a], name[b])
        return name

    linked = [(a, b) for a in range(len(sets)) for b in range(a)
              if 7 * len(sets[a][0] & sets[b][0]) >= 3 * (len(sets[a][0]) + sets[a][1] + len(sets[b][0]) + sets[b][1])]
    assert {(p.a, p.b) for p in pairs} <= {(b, a) for a, b in linked}
    assert named([(p.a, p.b) for p in pairs]) == named(linked)
    assert len(pairs) < 6 * len(sets) and 2 * len(pairs) < len(linked)


def test_stars_grow_with_the_sets_and_not_with_their_hot_groups(spark):
    """Sets in many hot groups make a bounded number of pairs each, and groups of the same members are still joined."""
    rng = random.Random(11)
    keys = list(range(200))
    hot = [(s, rng.sample(keys, 60)) for s in range(80)]
    classes = spark.createDataFrame([(k, 100) for k in keys], "key long, n long")
    lists = spark.createDataFrame([([1000, 1001, 1002],)], "keys array<long>")
    pairs = [(p.a, p.b) for p in jaccard_join._stars(lists, spark.createDataFrame(hot, "signature long, keys array<long>"), classes).collect()]
    assert {(1000, 1001), (1000, 1002)} <= set(pairs) and all(a < b for a, b in pairs) and len(pairs) == len(set(pairs))
    assert len(pairs) - 2 <= jaccard_join.STARS * len(keys)
    together = {frozenset(m) for _, m in hot}
    assert all(any({a, b} <= m for m in together) for a, b in pairs if a < 1000)
    assert {k for p in pairs for k in p} >= set(keys)


def test_batches_are_worked_on_in_pieces():
    """All rows come once and in order, and a piece holds about as many shingles as it may."""
    import pyarrow as pa
    sizes = [0, 5, 1, 30, 2, 2, 2, 0, 7, 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([b"12345678" * n for n in sizes], pa.binary()), pa.array([list(range(n)) for n in sizes], pa.list_(pa.int64()))],
                                       names=["key", "shingles", "hot"])
    for pieces in (list(jaccard_join._pieces([batch, batch], "shingles", 6, 8)), list(jaccard_join._pieces([batch, batch], "hot", 6))):
        assert [k for x in pieces for k in x["key"].to_pylist()] == 2 * list(range(10))
        assert all(len(x) == 1 or sum(sizes[k] for k in x["key"].to_pylist()) <= 6 for x in pieces)
