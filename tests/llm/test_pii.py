import hashlib
import re

import numpy as np
import pytest

from haulmetrics.llm import label_model, pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    digits = [int(c) for c in value if c.isdigit() and c.isascii()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


TEXTS = ["a@b.c_x@d.e +1 (017) 555-7713 call 555-123-4567.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.004 1..2.3.4.5", "4111 1111 1111 1111 and 4111-1111-1111-1112",
         "a@b@c.de a@a a.b@c-d.e.f.. %x@y.z", "+49 30 1234567 é中😀 1.1.1.1 +5((((((", "5 6 7 " * 30, "", None, "9" * 5000, "a" * 30000 + "@b.co", "x@y.z" * 3,
         "1 " * 20000 + "4111111111111111", "+" * 500 + "12345678901", "card 5500005555555559, id 5500005555555551 5500 0055 5555 5559"]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    return {r.doc_id: r for r in pii.report(docs).collect()}


def test_base_spans_equal_brute_force(found):
    for k, text in enumerate(TEXTS):
        want = base(text)
        assert found[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [found[k][f"n_{kind}"] for kind in PATTERNS] == [sum(w.startswith(kind + ":") for w in want) for kind in PATTERNS]
        assert set(want) <= set(found[k].spans.split(",")) or not want


def test_base_spans_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.report(docs).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(base(texts[r.doc_id])).encode()).hexdigest()


def test_added_spans_do_not_overlap_base_spans(found):
    for r in found.values():
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        fixed = {tuple(s.split(":")) for s in base(TEXTS[r.doc_id])}
        fixed = {(k, int(a), int(b)) for k, a, b in fixed}
        for k, a, b in set(spans) - fixed:
            assert all(b <= x or a >= y for _, x, y in fixed)


def test_expectation_maximisation_finds_the_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(40000) < 0.7
    right = np.array([0.95, 0.85, 0.75, 0.9])
    votes = np.where(rng.random((len(truth), 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = label_model.NONE
    patterns, counts = np.unique(votes @ 3 ** np.arange(4), return_counts=True)
    model = label_model.estimate(dict(zip(patterns.tolist(), counts.tolist(), strict=True)), 4)
    assert abs(model.prior - 0.7) < 0.03
    measured = model.given[1, :, label_model.YES] / model.given[1, :, :2].sum(1)
    assert np.abs(measured - right).max() < 0.04
    assert ((model.posterior[votes @ 3 ** np.arange(4)] > 0.5) == truth).mean() > 0.93
