"""Byte-level BPE and token alignment against the libraries, text by text."""

import hashlib
import itertools
import random
from collections import Counter

import pytest
import sentencepiece
import tiktoken
import tokenizers
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from haulmetrics.llm import byte_bpe, token_alignment
from haulmetrics.llm.queries import QUERIES

from .cases import awkward_docs

RANKS, LEVEL, PIECES = path("byte_bpe_multi_50k.tiktoken"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


def odd_texts():
    rng = random.Random(4)
    any_character = lambda: chr(rng.choice([32, 32, rng.randrange(32, 127), rng.randrange(0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x110000)]))
    return ["", " ", "  ", "a ", " a", "a  ", "\n", "a \n", "a \n b", "x▁y", "▁ a", "a ▁b", "<|endoftext|>", "<s> </s> <unk>", "\x00", "a\xa0 b", "a　 b",
            "it's  he's \t x", "ﬁ Å Å", "﻿x y", "​ a", "a\x1c b", "a\x85 b", "中 文 字", "՘ a ՘", "\U00030000b", "a,b.\nC# é.\nÉa\n\nb x\r\ny %$a. \nb", "\n,a\n b", "a" * 3000, "ab" * 900,
            *["".join(any_character() for _ in range(rng.randrange(1, 60))) for _ in range(60)],
            *["".join(rng.choice("abE  \n\n\t.,#é▁") for _ in range(rng.randrange(1, 40))) for _ in range(60)],
            *["".join(rng.choice("aabcing") for _ in range(rng.randrange(250, 900))) for _ in range(12)]]


def as_table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def texts(spark):
    return [*odd_texts(), *[r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]]


def test_ids_and_bytes_equal_the_library(spark, texts):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.vocabulary(RANKS).ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(as_table(spark, texts), RANKS), RANKS).collect()}
    for k, text in enumerate(texts):
        assert got[k].ids == library.encode_ordinary(text or ""), repr(text)
        assert bytes(got[k].bytes) == (text or "").encode()


def test_classes_of_all_characters():
    characters = [chr(c) for c in itertools.chain(range(0xD800), range(0xE000, 0x110000)) if c > 0x500]
    ranks = {bytes([b]): b for b in range(256)}
    for k, token in enumerate(f"{before}{c}".encode() for c in characters for before in "a1"):
        ranks[token] = 256 + k
    library = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    splitter = byte_bpe.splitter()
    assert [c for c in characters for before in "a1" if (len(splitter.pieces(before + c)) == 1) != (len(library.encode_ordinary(before + c)) == 1)] == []


def test_long_pieces_merge_one_after_the_other(monkeypatch):
    rng = random.Random(9)
    words = byte_bpe.vocabulary(RANKS)
    pieces = ["".join(rng.choice("aing ").strip() or "n" for _ in range(rng.randrange(2, 240))).encode() for _ in range(200)]
    short = byte_bpe.encode_pieces(words, pieces)
    monkeypatch.setattr(byte_bpe, "LONG", 1)
    assert [x.tolist() for x in byte_bpe.encode_pieces(words, pieces)] == [x.tolist() for x in short]


def test_forgetting_changes_nothing(spark, texts, monkeypatch):
    encoder = byte_bpe.Encoder(RANKS)
    want = [encoder.encode([t or ""])[0].tolist() for t in texts[:80]]
    monkeypatch.setattr(byte_bpe, "CACHED_TOKENS", 0)
    assert [encoder.encode([t or ""])[0].tolist() for t in texts[:80]] == want


def test_unknown_ids_are_refused(spark):
    with pytest.raises(Exception, match="names no token"):
        byte_bpe.decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), RANKS).collect()
    assert [bytes(r.bytes) for r in byte_bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), RANKS).collect()] == [b"", b""]


class Brute:
    """Both libraries on whole texts."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(LEVEL)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        sign = token_alignment.byte_of_sign()
        self.a_bytes = lambda i: bytes(sign[c] for c in self.a.id_to_token(i))
        self.b_bytes = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def align(self, text):
        """ids of A, ids of B, groups, links."""
        if not text:
            return [], [], [], []
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_bytes, b_bytes = [self.a_bytes(i) for i in a], [self.b_bytes(i) for i in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return [], [], [], []
        a_ends, b_ends = (list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes))
        groups, p, r = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            q, s = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append((a[p:q], b[r:s]))
            p, r = q, s
        return a, b, groups, [(x[-1], y[-1]) for x, y in groups]


def written(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 21])
def test_alignment_equals_brute_force(spark, texts, chunk_bytes):
    brute = Brute()
    aligned = [brute.align(t) for t in texts]
    counts = Counter(link for _, _, _, links in aligned for link in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    table = as_table(spark, texts)
    got = {r.doc_id: r for r in token_alignment.align(table, LEVEL, PIECES, chunk_bytes).collect()}
    reported = {r.doc_id: r for r in token_alignment.report(table, LEVEL, PIECES, chunk_bytes).collect()}
    assert len(got) == len(reported) == len(texts)
    for k, (a, b, groups, links) in enumerate(aligned):
        assert (got[k].a, got[k].b, got[k].groups) == (a, b, written(groups)), repr(texts[k])
        cuts = list(itertools.accumulate(len(x) for x, _ in groups)), list(itertools.accumulate(len(y) for _, y in groups))
        assert (got[k].cuts_a, got[k].cuts_b) == cuts
        assert tuple(reported[k]) == (k, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                                      hashlib.sha256(written(groups).encode()).hexdigest() if a else "")


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    n = docs.count()
    assert byte_bpe.encode(docs, RANKS).count() == n
    got = token_alignment.report(docs, LEVEL, PIECES).collect()
    assert len(got) == n
    assert {(r.n_a, r.groups_sha256) for r in got if r.doc_id in (2, 3)} == {(0, "")}
    for result in (byte_bpe.encode(docs.limit(0), RANKS), token_alignment.report(docs.limit(0), LEVEL, PIECES), token_alignment.align(docs.limit(0), LEVEL, PIECES)):
        assert result.count() == 0


def test_queries_give_digests(spark):
    got = QUERIES["op11_byte_bpe"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("want"))
    assert got.join(texts, "doc_id").filter("decoded_sha256 != want").count() == 0
    some = got.orderBy("doc_id").first()
    text = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(f"doc_id = {some.doc_id}").first().text
    ids = byte_bpe.Encoder(RANKS).encode([text])[0].tolist()
    assert (some.n_tokens, some.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
