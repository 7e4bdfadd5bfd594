"""Every stage of the pipeline, and run(), against brute force: which documents stay, how often, and with what text."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline

from .test_small_operators import filled

DOC_TYPE = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = [(1, " ".join(f"bench{k}" for k in range(14))), (2, "short item of five words")]
FOOTER = "\n".join(f"this footer line {k} stands under many pages" for k in range(3))


def corpus():
    rng, texts = random.Random(5), []
    some = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    for k in range(400):
        lines = [some(12) for _ in range(6)]
        if k % 5 == 1:
            lines[2] += " " + " ".join(rng.sample([f"vile{j}" for j in range(8)], 5))
        if k % 9 == 2:
            lines += FOOTER.split("\n")
        if k % 17 == 3:
            lines[4] += " " + ITEMS[0][1].upper().replace(" ", ", ") + "!"
        if k % 23 == 4:
            lines[4] += " Short item of five words, " + some(3)
        texts.append("\n".join(lines))
    flat = [t.replace("\n", " ") for t in texts]
    texts += [flat[k] + " tail" for k in range(5, 100, 10)] + flat[5:100:20]  # near copies of near copies, and copies
    texts += [FOOTER, ""]
    return [(k, t, "en", f"src{k % 4}", len(t)) for k, t in enumerate(texts)]


def without_toxic(docs):
    return [d for d in docs if "vile" not in d[1]]


def without_repeated_lines(docs):
    seen, out = set(), []
    for d in sorted(docs):
        lines = d[1].split("\n")
        kept = [k for k, line in enumerate(lines) if line.strip()]
        off = set()
        for p in range(len(kept)):
            for n in (1, 2):
                gram = tuple(lines[k] for k in kept[p:p + n])
                if len(gram) == n and (n == 2 or len(gram[0].split()) >= 10):
                    off |= set(kept[p:p + n]) if gram in seen else set()
                    seen.add(gram)
        text = "\n".join(line for k, line in enumerate(lines) if k not in off)
        if not kept or len(off) < len(kept):
            out.append((*d[:1], text, *d[2:4], len(text)))
    return out


def without_near_duplicates(docs):
    grams = [{tuple(w[p:p + 5]) for p in range(max(1, len(w) - 4))} if (w := d[1].split()) else set() for d in sorted(docs)]
    group = list(range(len(grams)))
    for b in range(len(grams)):
        for a in range(b):
            both = len(grams[a] & grams[b])
            if both and both / len(grams[a] | grams[b]) >= 0.75 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return [d for k, d in enumerate(sorted(docs)) if group[k] == k]


def without_contaminated(docs):
    def words(text):
        return "".join(c if c.isalnum() else " " for c in text.lower()).split()
    windows = {tuple(w[p:p + 10]) for _, t in ITEMS for w in [words(t)] for p in range(max(1, len(w) - 9))}
    return [d for d in docs if not any(tuple(w[p:p + n]) in windows for w in [words(d[1])] for n in {len(x) for x in windows} for p in range(len(w) - n + 1))]


def mixed(docs):
    sizes = Counter()
    for d in docs:
        sizes[d[3]] += len(d[1].split())
    targets = filled(dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5, 2.0)
    out = []
    for d in docs:
        rate = round(targets[d[3]] / sizes[d[3]], 9)
        out += [d] * (int(rate) + (int(hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()[:12], 16) / 2**48 < rate - int(rate)))
    return out


BRUTE = {"reject_toxic": without_toxic, "delete_repeated_lines": without_repeated_lines, "drop_near_duplicates": without_near_duplicates,
         "drop_contaminated": without_contaminated, "mix_sources": mixed}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, docs = str(tmp_path_factory.mktemp("corpus")), corpus()
    spark.createDataFrame(docs, DOC_TYPE).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d[0], int("vile" in d[1])) for d in docs if d[0] % 8], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_equal_brute_force(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(BRUTE)
    docs = corpus()
    for name, function in corpus_pipeline.STAGES:
        want = BRUTE[name](docs)
        got = function(spark, spark.createDataFrame(docs, DOC_TYPE).repartition(3), folder)
        assert Counter(map(tuple, got.collect())) == Counter(want), name
        assert Counter(want) != Counter(docs), name  # each stage has something to do
        docs = want


def test_run_equals_brute_force(spark, folder):
    want = corpus()
    for brute in BRUTE.values():
        want = brute(want)
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(want)
