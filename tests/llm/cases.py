"""Tables of awkward rows, shared by the tests."""

CLASHING = ["text_key", "key", "n", "size", "score", "row", "copies", "_id", "_key", "name", "first", "hit", "kept_text", "a", "component", "bucket"]
DOC_TYPE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
LONG = "one two three four five six seven eight nine ten " * 6000


def awkward_docs(spark, empty=False):
    """Nulls in every column, empty, blank and very long texts, equal texts, repeated rows, and clashing columns."""
    texts = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG + "x"),
             (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (None, None), (7, "word"), (7, "word"), (7, "other word here"),
             (8, "line one of the text is long enough to be counted\nline two\nline one of the text is long enough to be counted"),
             (9, "mail a.b@example.com or +1 (017) 555-7713"), (10, "\x00\x01 é中\U0001f600 \x1f")]
    rows = [(i, t, "en" if k % 2 else None, "src1" if k % 3 else None, len(t) if t and k % 4 else None, *[f"{c}{k}" if k % 2 else None for c in CLASHING])
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame([] if empty else rows + rows[:1], DOC_TYPE).repartition(3)
