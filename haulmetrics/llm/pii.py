"""Personal data by weak-supervision aggregation, in DataFrame operations only.

Candidate spans come from the base patterns and from looser ones. Regex, gazetteer and context labellers vote on
each; expectation-maximisation over the counts of vote patterns (a table of fixed size) estimates how reliable the
labellers are, kind by kind; the posteriors train a logistic span classifier. Every valid base match is a span; a
candidate beyond them is one if the classifier says so and it overlaps no base span.

Offsets are code points. The patterns match possessively and start at the edge of a run, so that a text costs time in
proportion to its length; `\\G` lets a match begin where the last one ended.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmetrics.llm.label_model import NO, NONE, YES, estimate, sigmoid
from haulmetrics.plans.staging import stage

# The base patterns, their limits, and the kinds in their order.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
CARD_DIGITS = (13, 19)
PHONE_DIGITS = (9, 15)

#: Looser forms: an address spelled with (at) and (dot), and a number of ten digits in groups without a country code.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
MUST_HOLD = {"email": "@", "phone": "+"}

TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
FOR = r"\b(?:e-?mail|mail|contact|tel|phone|call|fax|mobile|cell|card|visa|credit|ip|host|server|address|reach|write to|whatsapp)\b"
AGAINST = r"\b(?:version|v|order|isbn|issn|ref|invoice|sha|token|serial|id|build|release|section|figure|table)\b"
LABELLERS = 5
CONTEXTS = 16


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits holds."""
    doubled = F.translate(digits, "0123456789", "0246813579")
    backwards, doubled = F.reverse(digits), F.reverse(doubled)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.coalesce(
        F.when(i % 2 == 1, F.substring(backwards, i, 1)).otherwise(F.substring(doubled, i, 1)).cast("int"), F.lit(0)))
    return total % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a base match passes its kind's limits."""
    digits = _digits(value)
    n = F.length(digits)
    return (F.when(kind == "email", F.lit(True))
            .when(kind == "ip", value.rlike(OCTETS))
            .when(kind == "card", F.when(n.between(*CARD_DIGITS), luhn(F.when(n.between(*CARD_DIGITS), digits).otherwise("0"))).otherwise(False))
            .otherwise(n.between(*PHONE_DIGITS)))


def _matches(nth: int, kind: str, strict: bool) -> Column:
    """An entry per match of the `nth` pattern: its value, the text's length before it since the last match, and what stands around it."""
    pieces, values = F.col(f"pieces{nth}"), F.col(f"values{nth}")
    around = F.arrays_zip(values.alias("value"), F.slice(pieces, 1, F.size(values)).alias("before"), F.slice(pieces, 2, F.size(values)).alias("after"))
    return F.transform(around, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), i.alias("nth"), m.value.alias("value"), F.length(m.before).alias("gap"),
        F.right(m.before, F.lit(40)).alias("before"), F.left(m.after, F.lit(2)).alias("after")))


def candidates(docs: DataFrame) -> DataFrame:
    """`doc_id, text_key, kind, base, start, end, value, before, after` of all matches; `base`: a valid base match.

    Each text is read once: the matches of all patterns are one array. Rows with the same id and text count once. A null
    or empty text has none.
    """
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text").filter(F.col("text") != "")
    every = [(kind, BASE[kind], True) for kind in KINDS] + [(kind, pattern, False) for kind, pattern in LOOSE.items()]
    # a text is split only where the pattern is found
    values, pieces = [], []
    for nth, (kind, pattern, strict) in enumerate(every):
        able = F.instr("text", MUST_HOLD[kind]) > 0 if strict and kind in MUST_HOLD else F.lit(True)
        values.append(F.when(able, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"values{nth}"))
        pieces.append(F.when(F.size(f"values{nth}") > 0, F.split("text", pattern, -1)).alias(f"pieces{nth}"))
    matches = F.flatten(F.array_compact(F.array(*[_matches(nth, kind, strict) for nth, (kind, _, strict) in enumerate(every)])))
    cut = texts.select("doc_id", "text_key", "text", *values).select("doc_id", "text_key", *[f"values{nth}" for nth in range(len(every))], *pieces)
    found = cut.select("doc_id", "text_key", F.inline(matches))
    found = found.dropDuplicates(["doc_id", "text_key", "kind", "strict", "nth"])
    document = Window.partitionBy("doc_id", "text_key", "kind", "strict").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(document)
    placed = found.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return placed.withColumn("base", F.col("strict") & valid(F.col("kind"), F.col("value"))).select(
        "doc_id", "text_key", "kind", "base", "strict", "start", "end", "value", "before", "after")


def _votes() -> list[Column]:
    """One column per labeller: regex and limits, gazetteer for, context against, usual shape, clean edges."""
    kind, value, digits = F.col("kind"), F.col("value"), _digits(F.col("value"))
    before, near = F.lower("before"), F.right(F.col("before"), F.lit(1))
    shape = (F.when(kind == "email", F.element_at(F.split(F.lower(value), r"[.\])\x20]+"), -1).isin(*TOP_LEVEL))
             .when(kind == "ip", ~value.rlike(r"^(?:0|127|255)\.|(?:^|\.)0[0-9]"))
             .when(kind == "card", value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$") & ~digits.rlike(r"^0|^(.)\1+$"))
             .otherwise(value.rlike(r"\([0-9]{2,4}\)|[0-9][\x20.-][0-9]{3}[\x20.-][0-9]{4}$")))
    yes_no = lambda test: F.when(test, YES).otherwise(NO)
    return [
        yes_no(F.col("base") | (~F.col("strict") & (kind == "email"))),
        F.when(before.rlike(FOR), YES).otherwise(NONE),
        F.when(before.rlike(AGAINST), NO).otherwise(NONE),
        yes_no(F.coalesce(shape, F.lit(False))),
        F.when(near.rlike(r"[A-Za-z0-9_=/#]") | F.col("after").rlike(r"^[A-Za-z_=/]"), NO).otherwise(NONE),
    ]


def _context() -> Column:
    """The word before the span, hashed; fixed in number."""
    word = F.regexp_extract(F.lower("before"), r"([a-z]+)[^a-z]*$", 1)
    return F.pmod(F.xxhash64(word), F.lit(CONTEXTS)).cast("int")


def voted(found: DataFrame) -> DataFrame:
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    pattern = sum((vote * 3 ** k for k, vote in enumerate(_votes())), F.lit(0))
    return found.withColumn("kind_no", kind).withColumn("pattern", pattern.cast("int")).withColumn("context", _context())


def _features(kind: np.ndarray, pattern: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Weights that a span adds up: one per kind and vote of each labeller, and one per context."""
    votes = (pattern[:, None] // 3 ** np.arange(LABELLERS)) % 3
    return np.concatenate((kind[:, None] * LABELLERS * 3 + np.arange(LABELLERS) * 3 + votes, len(KINDS) * LABELLERS * 3 + context[:, None]), 1)


N_WEIGHTS = len(KINDS) * LABELLERS * 3 + CONTEXTS


def train(spans: DataFrame, rounds: int = 400, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """Weights of the span classifier (the last is the bias), from posteriors of all spans.

    What reaches the driver has at most kinds x 3^labellers x contexts rows.
    """
    table = spans.groupBy("kind_no", "pattern", "context").agg(F.count("*").alias("n")).collect()
    weights = np.zeros(N_WEIGHTS + 1)
    if not table:
        return weights
    kind, pattern, context, n = (np.array([r[k] for r in table]) for k in range(4))
    target = np.zeros(len(table))
    for k in range(len(KINDS)):
        counts: dict[int, int] = {}
        for p, c in zip(pattern[kind == k].tolist(), n[kind == k].tolist(), strict=True):
            counts[p] = counts.get(p, 0) + c
        target[kind == k] = estimate(counts, LABELLERS).posterior[pattern[kind == k]]
    features, share = _features(kind, pattern, context), n / n.sum()
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        error = (sigmoid(weights[features].sum(1) + weights[-1]) - target) * share
        gradient = np.append(np.bincount(features.ravel(), np.repeat(error, features.shape[1]), N_WEIGHTS) + decay * weights[:-1] / len(weights), error.sum())
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient ** 2 - second)
        weights -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
    return weights


def span_score(weights: np.ndarray) -> Column:
    table = F.array(*[F.lit(float(w)) for w in weights[:-1]])
    margin = F.lit(float(weights[-1])) + F.element_at(table, F.lit(len(KINDS) * LABELLERS * 3 + 1) + F.col("context"))
    for k in range(LABELLERS):
        vote = F.floor(F.col("pattern") / 3 ** k).cast("int") % 3
        margin = margin + F.element_at(table, F.col("kind_no") * (LABELLERS * 3) + F.lit(k * 3 + 1) + vote)
    return 1 / (1 + F.exp(-margin))


def find(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """All spans: `doc_id, text_key, kind, kind_no, start, end, value, base, score`.

    Everything is counted over all documents. Rows with the same id and text share their spans.
    """
    spans = stage(voted(candidates(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")))), "pii-candidates")
    scored = spans.withColumn("score", span_score(train(spans)))
    by_start = Window.partitionBy("doc_id", "text_key").orderBy("start", F.col("base").desc(), "end", "kind_no", "strict")
    earlier = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    free = (F.col("start") >= F.coalesce("_earlier", F.lit(0))) & (F.col("end") <= F.coalesce("_later", F.col("end")))
    kept = scored.withColumn("_earlier", earlier).withColumn("_later", later).filter(F.col("base") | ((F.col("score") >= limit) & free))
    return kept.select("doc_id", "text_key", "kind", "kind_no", "start", "end", "value", "base", "score")


def report(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """Per row of `docs`: `doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`."""
    spans = find(docs, limit)
    listed = spans.groupBy("doc_id", "text_key").agg(
        *[F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.collect_set(F.struct("kind_no", "start", "end", "base", "kind"))).alias("_all"))
    text = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    base = F.concat_ws(",", F.transform(F.filter("_all", lambda s: s.base), text))
    listed = listed.select("doc_id", "text_key", *[f"n_{k}" for k in KINDS], base.alias("_base"), F.concat_ws(",", F.transform("_all", text)).alias("spans"))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_key"))
    joined = rows.join(listed, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")), "left")
    return joined.select(
        F.col("_id").alias("doc_id"), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
