"""DuckDB answers to the queries that SQL can express, written out independently of the operators."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"


def mixing_sql(documents: str) -> str:
    return rf"""
sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '{SPACED}')), 0) AS size FROM {documents}),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM per_source),
filling AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / w AS fill FROM weighed),
levels AS (SELECT f.*, (SELECT sum(CASE WHEN o.fill <= f.fill THEN o.lim ELSE 0 END) FROM filling o) AS full_words,
  (SELECT sum(CASE WHEN o.fill > f.fill THEN o.w ELSE 0 END) FROM filling o) AS open_weight,
  (SELECT 1.5::DOUBLE * sum(source_size) FROM filling o) AS total FROM filling f),
level AS (SELECT max(CASE WHEN full_words + open_weight * fill <= total AND open_weight > 0 THEN (total - full_words) / open_weight END) AS high,
  min((SELECT 1.5::DOUBLE * sum(source_size) / sum(w) FROM filling)) AS even,
  bool_or(full_words + open_weight * fill <= total) AS some_full FROM levels),
aimed AS (SELECT source, source_size, least(lim, w * (SELECT CASE WHEN some_full THEN
    (SELECT (total - full_words) / open_weight FROM levels WHERE full_words + open_weight * fill <= total ORDER BY fill DESC LIMIT 1)
    ELSE even END FROM level)) AS target FROM filling),
rated AS (SELECT s.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
drawn AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN
    ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rated)"""


MIXING = f"WITH {mixing_sql('documents').strip()} SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM drawn"


def hits_sql(documents: str) -> str:
    """Tables `d` (doc_id, w: words) and `hits` (doc_id, item_id, position: a hit word)."""
    return rf"""
d AS (SELECT *, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {documents}),
items AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p + 1: p + least(len(w), 10)], ' ') AS gram
  FROM (SELECT *, unnest(range(greatest(len(w) - 9, 1))) AS p FROM items WHERE len(w) > 0)),
widths AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, n, p, array_to_string(w[p + 1: p + n], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, widths WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, unnest(range(p, p + n)) AS position FROM spots JOIN windows USING (n, gram))"""


DECONTAMINATION = f"""WITH {hits_sql('documents').strip()},
near AS (SELECT doc_id, CAST(count(DISTINCT position) AS BIGINT) AS n_hit, list(DISTINCT item_id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(array_to_string(list_sort([x::VARCHAR FOR x IN coalesce(ids, [])]), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN near USING (doc_id)"""

def lines_sql(documents: str) -> str:
    """Table `cut`: the columns of the documents, `n_lines, n_removed, n_runs, kept`."""
    return rf"""
ls AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {documents}),
fl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS spot FROM ls WHERE regexp_matches(line, '{SPACED}')),
pairs AS (SELECT doc_id, i, spot, line, lead(line) OVER (PARTITION BY doc_id ORDER BY spot) AS line2 FROM fl),
one AS (SELECT doc_id, spot, row_number() OVER (PARTITION BY line ORDER BY doc_id, spot) AS n FROM fl WHERE len(regexp_extract_all(line, '{SPACED}')) >= 10),
two AS (SELECT doc_id, spot, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, spot) AS n FROM pairs WHERE line2 IS NOT NULL),
gone AS (SELECT doc_id, spot FROM one WHERE n > 1 UNION SELECT doc_id, spot FROM two WHERE n > 1 UNION SELECT doc_id, spot + 1 FROM two WHERE n > 1),
marked AS (SELECT fl.doc_id, fl.i, fl.spot, gone.spot IS NOT NULL AS off FROM fl LEFT JOIN gone USING (doc_id, spot)),
runs AS (SELECT *, off AND NOT coalesce(lag(off) OVER (PARTITION BY doc_id ORDER BY spot), false) AS begins FROM marked),
counted AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (off) AS n_removed, count(*) FILTER (begins) AS n_runs FROM runs GROUP BY doc_id),
rest AS (SELECT ls.doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM ls LEFT JOIN marked m USING (doc_id, i) WHERE NOT coalesce(m.off, false) GROUP BY ls.doc_id),
cut AS (SELECT x.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
  CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS kept
  FROM {documents} x LEFT JOIN counted USING (doc_id) LEFT JOIN rest USING (doc_id))"""


LINE_DEDUP = f"""WITH {lines_sql('documents').strip()}
SELECT doc_id, n_lines, n_removed, n_runs, sha256(coalesce(kept, '')) AS kept_sha256 FROM cut"""

ORACLES = {"op5_mixing": MIXING, "op6_decontamination": DECONTAMINATION, "op7_line_dedup": LINE_DEDUP}
