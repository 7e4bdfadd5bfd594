"""Mixing, decontamination, line dedup and nearest neighbours against brute force."""

import random
import re

import numpy as np
import pytest

from haulmetrics.llm import ann, decontaminate, line_dedup, mixing
from haulmetrics.llm.queries import QUERIES


def filled(sizes, weights, share, cap):
    """Targets by sharing again and again."""
    target, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while open_:
        per = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * per > cap * sizes[s]}
        if not full:
            return target | {s: weights[s] * per for s in open_}
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    names = [f"s{k}" for k in range(rng.randint(1, 9))] + [None]
    sizes = {s: rng.choice([0, 10, rng.randint(1, 5000)]) for s in names}
    order = sorted(n for n in names if n is not None) + [None]
    want = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: pytest.approx(r.target) for r in got} == want


def test_copies_follow_the_rates_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, two = (sorted((r.doc_id, r.copies) for r in mixing.copies(x).select("doc_id", "copies").collect()) for x in (docs, docs.repartition(7)))
    assert one == two
    rows = mixing.copies(docs).collect()
    assert all(r.copies <= 2 for r in rows)
    taken = sum(r.size * r.copies for r in rows)
    assert abs(taken / (1.5 * sum(r.size for r in rows)) - 1) < 0.05
    assert mixing.mix(docs).count() == sum(r.copies for r in rows)


def spans_of(words, grams):
    hit = set()
    for g in grams:
        for p in range(len(words) - len(g) + 1):
            if words[p:p + len(g)] == g:
                hit |= set(range(p, p + len(g)))
    return hit


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_decontamination_equals_brute_force(spark, block_words):
    rng = random.Random(6)
    some = lambda n: [rng.choice("abcdef") for _ in range(n)]
    items = [(k, " ".join(some(rng.choice([0, 1, 2, 5, 10, 14])))) for k in range(12)]
    docs = []
    for k in range(40):
        words = some(rng.randint(0, 60))
        at = rng.randint(0, len(words))
        docs.append((k, ", ".join(words[:at] + rng.choice(items)[1].upper().split() + words[at:])))
    got = {r.doc_id: r for r in decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"),
                                                     spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()}
    for d, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        grams = {i: [w[p:p + 10] for p in range(max(1, len(w) - 9))] for i, t in items if (w := t.split())}
        hits = {i: spans_of(words, g) for i, g in grams.items()}
        assert got[d].n_words == len(words) and got[d].n_hit == len(set().union(*hits.values()))
        assert got[d].n_items == sum(bool(h) for h in hits.values())
        assert got[d].n_near_items >= 0


def test_proximity_finds_reordered_terms(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog tonight again")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "again tonight the dog was lazy and the fox was quick and brown and jumps over it"), (2, "a quick word")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(docs, items).collect()}
    assert got[1].n_hit == 0 and got[1].n_near_items == 1 and got[2].n_near_items == 0


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_runs_equal_brute_force(spark, min_lines):
    rng = random.Random(min_lines)
    lines = ["a", "b", "c", "", " ", "one two three four five six seven eight nine ten eleven"]
    docs = [(k if k else None, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12))) if k % 9 else None) for k in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.row.doc_id: r for r in line_dedup.cut(frame, min_lines).collect()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    seen, want = set(), {}
    for d, text in order:
        split = (text or "").split("\n")
        kept = [k for k, line in enumerate(split) if line.strip()]
        words = [split[k] for k in kept]
        off = set()
        for p in range(len(words)):
            for n in {min_lines} | ({1} if min_lines > 1 and len(words[p].split()) >= 10 else set()):
                gram = tuple(words[p:p + n])
                if len(gram) == n:
                    if gram in seen:
                        off |= set(range(p, p + n))
                    seen.add(gram)
        want[d] = "\n".join(line for k, line in enumerate(split) if k not in {kept[p] for p in off}) if text is not None else None
        assert (got[d].n_lines, got[d].n_removed) == (len(words), len(off))
        assert got[d].kept_text == want[d]


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = np.concatenate((rng.normal(size=(600, 24)), np.repeat(rng.normal(size=(1, 24)), 300, 0) * 2, rng.normal(size=(100, 24)) * 0.05 + rng.normal(size=24)))
    vectors = vectors.astype(np.float32).astype(float)
    rows = [(int(k), v.tolist()) for k, v in enumerate(vectors)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), list_rows=100, block_rows=64).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    right = 0
    for q in range(0, 1000, 20):
        score = (vectors * vectors[q]).sum(1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(1000), -score))[:20].tolist()
        right += len(set(best) & set(found[q]))
        if 600 <= q < 900:
            assert found[q][:5] == best[:5]
    assert set(found) == set(range(0, 1000, 20)) and right >= 0.97 * 50 * 20


def best_ids(rows, q, k=20):
    """The `k` ids other than `q` of the largest inner product of any of their vectors with any of the query's."""
    sought, best = np.stack([v for i, v in rows if i == q]), {}
    for i, v in rows:
        if i != q:
            best[i] = max(best.get(i, -np.inf), (sought @ v).max())
    return sorted(best, key=lambda i: (-best[i], i))[:k]


@pytest.mark.parametrize("case", ["doubled", "crowded", "hot"])
def test_neighbours_of_repeated_ids_equal_brute_force(spark, case):
    rng = np.random.default_rng(4)
    rows = list(enumerate(rng.normal(size=(400, 24))))
    if case == "doubled":  # every row stands there twice
        rows += rows
    elif case == "crowded":  # 40 different vectors of one id beside each query
        rows += [(1001 + q, v * (1 + 0.01 * rng.normal(size=24))) for q, v in rows[::20] for _ in range(40)]
    else:  # one id, itself a query, holds most rows: half of them equal
        rows += [(1000, rng.normal(size=24)) for _ in range(400)] + [(1000, rows[7][1])] * 400
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    found = {}
    for r in sorted(ann.search(frame, list_rows=100, block_rows=64).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    asked = sorted({i for i, _ in rows if i % 20 == 0})
    assert sorted(found) == asked and all(len(x) == len(set(x)) == 20 for x in found.values())
    assert sum(len(set(best_ids(rows, q)) & set(found[q])) for q in asked) >= 0.97 * 20 * len(asked)


def test_a_query_returns_proximity_matches(spark, tmp_path):
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog tonight again")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "again tonight the dog was lazy and the fox was quick and brown and jumps over it"), (2, "a quick word"),
            (3, "see: quick brown fox jumps over the lazy dog tonight again"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_hit, r.contaminated, r.n_near_items) for r in QUERIES["op6_proximity_matches"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, False, 1), 2: (0, False, 0), 3: (10, True, 1), 4: (0, False, 0)}
