"""Trained models: held-out accuracy, and what each method can do that a simpler one cannot."""

import numpy as np

from haulmetrics.llm import html_extract, quality, toxicity
from haulmetrics.llm.html_blocks import leaf_blocks

FOLDER = "/root/testdata/sf0.01"


def test_machine_learns_a_pair_of_terms():
    """Neither term alone is toxic; both together are."""
    rng = np.random.default_rng(1)
    rows, toxic = [], []
    for _ in range(1200):
        a, b = (rng.random(2) < 0.5).tolist()
        noise = rng.integers(10, 1000, 5)
        rows.append(np.unique(np.concatenate((noise, [1] * a, [2] * b)).astype(np.int64)))
        toxic.append(int(a and b))
    machine = toxicity.fit(np.array(toxic), rows, rounds=600)
    f = machine.feature_of
    score = lambda *terms: float(machine.scores(np.array([f[t] for t in terms], dtype=np.int64), np.array([0, len(terms)]))[0])
    assert score(1, 2) > 0.8 and score(1) < 0.3 and score(2) < 0.3 and score() < 0.2


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r.predicted for r in scored if r.toxic], [r.predicted for r in scored if not r.toxic]
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.02
    rejected = docs.count() - toxicity.drop_toxic(docs, toxicity.train(docs, labels)).count()
    assert rejected == toxicity.score(docs, toxicity.train(docs, labels)).filter("predicted = 1").count()


def test_quality_against_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs).join(labels, "doc_id").collect()
    bad, good = [r.score for r in got if not r.quality], [r.score for r in got if r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.93
    assert np.mean([r.good == r.quality for r in got]) > 0.93


def test_chain_on_composed_pages_it_has_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    chain = html_extract.train(pages)
    test = html_extract.labelled([], 200, seed=91)
    assert np.mean([a == b for f, y in test for a, b in zip(chain.decode(f), y, strict=True)]) > 0.98


def test_leaf_blocks():
    page = ("<html><head><title>t</title></head><body><!-- <p>no</p> --><script>if (a < b) '</p>'</script><style>p{}</style>"
            "<p>one <b>two</b>\n three&amp;<br>four<p>five<li>x<li>y</ul><div>a < b</div><p title='>'>q</p><textarea>z</textarea><select><option>o</select>end")
    assert [b.text for b in leaf_blocks(page)] == ["one two three& four", "five", "x", "y", "a < b", "q", "end"]
    assert leaf_blocks("<p>a<script>never closed") and leaf_blocks("") == [] and leaf_blocks("<!-- open") == []


def test_formulas_and_long_attributes():
    long = "x > y " * 5000
    page = (f"<p>so <math><mi>a</mi><mo>+</mo><mi>b</mi></math> holds</p><p data-x=\"{long}\" data-y='{long}'>after</p>"
            "<object data=f><p>fallback</p></object><map name=m>left <a href=l>door</a></map>")
    assert [b.text for b in leaf_blocks(page)] == ["so a+b holds", "after", "fallback", "left door"]
    assert [b.text for b in leaf_blocks("<p><i '>z" + "<a" * 200_000)] == ["z" + "<a" * 200_000]


def test_page_with_everything_around_the_article(spark):
    page = ("<body><header><h2>Site</h2></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
            "<main><article><h1>Title here</h1><p>First sentence of the text, which is long enough to be one.</p><p>Second paragraph is here.</p></article></main>"
            "<aside class='sidebar'><p>Also read this story about the town.</p></aside><form><label>Mail</label></form>"
            "<section id='comments'><p>I do not agree with this article at all.</p></section><footer>&copy; Site</footer></body>")
    chain = html_extract.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert html_extract.main_text(chain, page) == "Title here\nFirst sentence of the text, which is long enough to be one.\nSecond paragraph is here."


def test_machine_learns_exactly_one_of_two_terms():
    """No term says anything alone, so only the pair test can choose them."""
    rng = np.random.default_rng(2)
    rows, toxic = [], []
    for _ in range(4000):
        a, b = (rng.random(2) < 0.5).tolist()
        rows.append(np.unique(np.concatenate((rng.integers(10, 1000, 5), [1] * a, [2] * b)).astype(np.int64)))
        toxic.append(int(a != b))
    machine = toxicity.fit(np.array(toxic), rows)
    f = machine.feature_of
    score = lambda *terms: float(machine.scores(np.array([f[t] for t in terms], dtype=np.int64), np.array([0, len(terms)]))[0])
    assert min(score(1), score(2)) > 0.7 and max(score(1, 2), score()) < 0.3
