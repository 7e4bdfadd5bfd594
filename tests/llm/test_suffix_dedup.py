import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haulmetrics.llm import suffix_dedup


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=90).map(lambda b: bytes(97 + x % 2 for x in b)), max_size=20), st.integers(0, 70), st.integers(1, 40))
def test_deep_shallow_order(texts, prefix, shallow):
    texts = [b"a" * prefix + t for t in texts]
    order, common = suffix_dedup.deep_shallow_sort(texts, shallow)
    assert sorted(order) == list(range(len(texts)))
    assert [texts[i] for i in order] == sorted(texts)
    for k in range(1, len(order)):
        a, b = texts[order[k - 1]], texts[order[k]]
        assert a[:common[k]] == b[:common[k]] and (a + b"\0")[common[k]:common[k] + 1] != (b + b"\1")[common[k]:common[k] + 1]


def brute_force(texts, length):
    starts = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if starts[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length, gram, max_sorted", [(40, 8, 256), (40, 8, 1), (25, 25, 256), (30, 5, 3)])
def test_removed_bytes_equal_brute_force(spark, length, gram, max_sorted):
    rng = random.Random(length + max_sorted)
    some = lambda n: " ".join(rng.choice(["ab", "cde", "fg", "h", "ijk", "é"]) for _ in range(n))
    passages, rows = [some(30) for _ in range(4)], []
    for i in range(60):
        parts = [some(rng.randint(0, 20)), rng.choice(passages)[rng.randint(0, 30):rng.randint(30, 90)], "a" * rng.randint(0, 90)]
        rows.append((i // 2 if i % 5 else None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) if i % 17 else None))
    rows += rows[:4]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(frame, length, gram, max_sorted).collect()]
    want = [(d, *x) for (d, _), x in zip(rows, brute_force([(t or "").encode() for _, t in rows], length), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_reaches_agree_however_they_are_read():
    rng = random.Random(9)
    some = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    shared = [(some(12), some(20)) for _ in range(3)]
    before, after = [], []
    for _ in range(60):
        x, y = rng.choice(shared)
        before.append(x[:rng.randint(0, 12)] + some(rng.randint(0, 3)))
        after.append((y[:rng.randint(4, 16)] + some(rng.randint(0, 5)))[:16])
    one, two = (suffix_dedup.reaches(before, after, 16, pairwise) for pairwise in (1000, 1))
    assert one[1].any() and not one[1].all()
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()
