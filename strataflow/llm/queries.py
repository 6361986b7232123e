"""Registered queries of the training-text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    hard_negatives,
    language,
    licenses,
    line_chunks,
    minhash,
    packing,
    ranked_search,
    secrets,
    simhash,
    tiling,
    toxicity,
    urls,
    weak_labels,
)
from .common import table


def op1_decontaminate(spark, d):
    found = tiling.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", F.round("coverage", 6).alias("coverage"), "n_tiles")


def op2_secrets(spark, d):
    return secrets.scan(table(spark, d, "documents"))


def op3_line_chunks(spark, d):
    cleaned = line_chunks.remove_repeated(table(spark, d, "documents"))
    return cleaned.select("doc_id", "text", "removed_lines")


def op4_simhash(spark, d):
    return simhash.simhash_components(table(spark, d, "documents"))


def op5_licenses(spark, d):
    return licenses.scan(table(spark, d, "documents"))


def op6_weak_labels(spark, d):
    return weak_labels.classify(table(spark, d, "documents"))


def op7_url_trees(spark, d):
    return urls.judge(table(spark, d, "pages"))


def op8_minhash(spark, d):
    return minhash.fingerprint_neighbours(table(spark, d, "documents"))


def op9_retrieval_packing(spark, d):
    return packing.pack(table(spark, d, "documents"))


def op10_byte_cnn(spark, d):
    return language.detect(table(spark, d, "documents"))


def op11_hilbert_negatives(spark, d):
    return hard_negatives.hard_negatives(table(spark, d, "embeddings"))


def op12_ftrl_toxicity(spark, d):
    return toxicity.score(table(spark, d, "documents"), table(spark, d, "labels"))


def op13_k2_treap(spark, d):
    return ranked_search.ranked(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_secrets,
        op3_line_chunks,
        op4_simhash,
        op5_licenses,
        op6_weak_labels,
        op7_url_trees,
        op8_minhash,
        op9_retrieval_packing,
        op10_byte_cnn,
        op11_hilbert_negatives,
        op12_ftrl_toxicity,
        op13_k2_treap,
    )
}

# Line hashes are MD5 digits, so chunk boundaries can be found in SQL too.
SQL = {
    "op3_line_chunks": """
WITH given AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (
  SELECT r, doc_id, text, i, line,
    CAST('0x' || left(md5(line), 15) AS BIGINT) % 1000003 AS h,
    length(line) - length(replace(line, ' ', '')) + 1 >= 50 AS wide
  FROM (SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) AS i FROM given)),
cuts AS (
  SELECT *, coalesce(lead(wide) OVER w, TRUE) OR wide
    OR (h + 31 * coalesce(lag(h) OVER w, 0)) % 1000003 % 2 = 0 AS cut
  FROM lines WINDOW w AS (PARTITION BY r ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM cuts),
chunks AS (
  SELECT r, doc_id, text, c, min(i) AS first_line, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM numbered GROUP BY r, doc_id, text, c HAVING count(*) > 1 OR bool_or(wide)),
owners AS (
  SELECT chunk, min((doc_id, first_line)) AS place FROM chunks GROUP BY chunk),
gone AS (
  SELECT r, c FROM chunks JOIN owners USING (chunk)
  WHERE doc_id <> place[1] OR first_line <> place[2])
SELECT g.doc_id, CASE WHEN g.text IS NOT NULL THEN coalesce(k.kept, '') END AS text,
  CAST(coalesce(k.removed, 0) AS BIGINT) AS removed_lines
FROM given g LEFT JOIN (
  SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (gone.c IS NULL) AS kept,
    count(*) FILTER (gone.c IS NOT NULL) AS removed
  FROM numbered LEFT JOIN gone USING (r, c) GROUP BY r) k USING (r)
""",
    "op11_hilbert_negatives": """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.r <> b.r),
positives AS (
  SELECT ar, anchor_id, r, vec_id, s FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY s DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER w AS INT) AS rank, n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN scored n ON n.ar = p.ar AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
WINDOW w AS (PARTITION BY p.ar, p.r ORDER BY n.s DESC, n.vec_id)
QUALIFY row_number() OVER w <= 10
""",
    "op13_k2_treap": r"""
WITH given AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
corpus AS (
  SELECT count(*) FILTER (len(words) > 0) AS docs, CAST(sum(len(words)) AS BIGINT) AS terms FROM given),
asked AS (
  SELECT i, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS i, item_id,
          unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
held AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM given)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, corpus GROUP BY term, docs),
impacts AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)) AS impact
  FROM held, corpus),
scored AS (
  SELECT i, item_id, r, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term)
  GROUP BY i, item_id, r, doc_id HAVING sum(times * w * impact) > 0)
SELECT item_id, CAST(row_number() OVER w AS INT) AS rank, doc_id, score
FROM scored WINDOW w AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER w <= 20
""",
}
