"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (op1_decontaminate, op2_run_length_dedup, op3_mix, op4_perplexity, op5_line_templates, op6_nbsvm,
               op7_language_evidence, op8_license_digests, op9_separator_scan, op10_ngram_join, op11_warc_bundles,
               op12_hard_negatives, op13_pivotal_grams)
from .tables import read_documents, read_table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    found = op1_decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
item AS (
  SELECT item_id, least(len(words), 10) AS n, words[s + 1 : s + 10] AS win
  FROM (SELECT item_id, words, unnest(range(0, greatest(len(words) - 10, 0) + 1)) AS s FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM item),
place AS (
  SELECT doc_id, s, n, words[s + 1 : s + n] AS win
  FROM (SELECT doc_id, words, n, unnest(range(0, greatest(len(words) - n + 1, 0))) AS s FROM w, sizes)),
hit AS (SELECT p.doc_id, p.s, p.n, i.item_id FROM place p JOIN item i ON p.n = i.n AND p.win = i.win),
cover AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
          FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_run_length_dedup.remove_repeats(read_documents(spark, sf_dir), length=200).drop("kept")


OP2_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, len(x) // 2 AS n_bytes FROM h),
win AS (SELECT doc_id, s, hash(substring(x, 2 * s + 1, 400)) AS k, substring(x, 2 * s + 1, 400) AS v
        FROM (SELECT doc_id, x, unnest(range(0, n_bytes - 199)) AS s FROM n WHERE n_bytes >= 200)),
often AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
twice AS (SELECT v FROM win SEMI JOIN often USING (k) GROUP BY v HAVING count(*) > 1),
hit AS (SELECT doc_id, s FROM win SEMI JOIN twice USING (v)),
edge AS (SELECT doc_id, s, s - coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) > 200 AS fresh FROM hit),
run AS (SELECT doc_id, s, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM edge),
span AS (SELECT doc_id, g, min(s) AS lo, max(s) + 200 AS hi FROM run GROUP BY ALL),
gap AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prev FROM span),
cut AS (SELECT g.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans,
               string_agg(substring(x, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo)
                 || substring(any_value(x), 2 * max(hi) + 1) AS kept
        FROM gap g JOIN n USING (doc_id) GROUP BY g.doc_id)
SELECT n.doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM n LEFT JOIN cut USING (doc_id)
"""


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mix.mix(read_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op4_perplexity.quality_rules(read_documents(spark, sf_dir))
    return found.select("doc_id", *op4_perplexity.COUNTS, "base_failed", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op5_line_templates.drop_recurring_lines(read_documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped",
                        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT row_number() OVER () AS u, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
t AS (SELECT u, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS toks
      FROM (SELECT u, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM u)),
alone AS (SELECT line FROM t WHERE len(toks) < 4 AND regexp_matches(line, '\p{L}') GROUP BY line HAVING count(*) >= 10),
p AS (SELECT u, line, toks, CAST(len(toks) AS VARCHAR) || ' ' || array_to_string(
             list_transform(toks[1:3], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS leaf
      FROM t WHERE len(toks) >= 4),
spread AS (SELECT u, leaf, line, unnest(range(0, len(toks))) AS place, unnest(toks) AS token FROM p),
fixed AS (SELECT leaf, place, token FROM spread GROUP BY ALL HAVING count(DISTINCT u) >= 10),
template AS (
  SELECT s.u, s.leaf, s.line, count(*) AS n, count(f.token) AS n_fixed,
         string_agg(CASE WHEN f.token IS NULL THEN '<*>' ELSE s.token END, ' ' ORDER BY s.place) AS template
  FROM spread s LEFT JOIN fixed f ON s.leaf = f.leaf AND s.place = f.place AND s.token = f.token
  GROUP BY s.u, s.leaf, s.line HAVING 2 * count(f.token) >= count(*)),
recurring AS (SELECT leaf, template FROM template GROUP BY ALL HAVING count(DISTINCT u) >= 10),
gone AS (SELECT line FROM template SEMI JOIN recurring USING (leaf, template) UNION SELECT line FROM alone),
each AS (SELECT doc_id, text, i, line, line IN (SELECT line FROM gone) AS hit
         FROM (SELECT doc_id, text, unnest(range(0, len(lines))) AS i, unnest(lines) AS line FROM d)),
sums AS (SELECT doc_id, text, count(*) AS n, count(*) FILTER (hit) AS n_hit,
                bool_or(hit) AND bool_or(NOT hit AND regexp_matches(line, '[^ \x09-\x0D]')) AS cut,
                string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit) AS rest
         FROM each GROUP BY doc_id, text)
SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE n END AS BIGINT) AS n_lines,
       CAST(CASE WHEN cut THEN n_hit ELSE 0 END AS BIGINT) AS n_dropped,
       sha256(CASE WHEN cut THEN coalesce(rest, '') ELSE text END) AS kept_sha256
FROM sums
"""


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    scored = op6_nbsvm.quality_scores(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op7_language_evidence.identify(read_table(spark, sf_dir, "pages"), read_documents(spark, sf_dir))
    return found.withColumnRenamed("page", "page_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_license_digests.scan(read_documents(spark, sf_dir))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(column: str) -> str:
    out = f"regexp_replace(lower({column}), {_sql_text(op8_license_digests.COPYRIGHT_LINE)}, ' ', 'g')"
    out = f"' ' || regexp_replace({out}, '[^a-z0-9]+', ' ', 'g') || ' '"
    for old, new in op8_license_digests.SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"nullif(trim({out}), '')"


OP8_SQL = rf"""
WITH known AS (
  SELECT DISTINCT sha256({_canonical_sql('text')}) AS digest, license
  FROM (VALUES {', '.join(f'({_sql_text(a)}, {_sql_text(b)})' for a, b in [*op8_license_digests.KNOWN, *op8_license_digests.full_texts()])}) t(license, text)),
part AS (
  SELECT doc_id, text, unnest(list_distinct(list_concat([text], list_concat(
         string_split_regex(text, '\n[\x20\x09-\x0D]*\n'), string_split(text, chr(10)))))) AS block
  FROM documents WHERE text IS NOT NULL),
hit AS (SELECT doc_id, block = text AS is_whole, digest, license
        FROM (SELECT *, sha256({_canonical_sql('block')}) AS digest FROM part) JOIN known USING (digest)),
found AS (SELECT doc_id, max(license) FILTER (is_whole) AS whole_license, count(DISTINCT digest) AS n_blocks,
                 array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses FROM hit GROUP BY doc_id)
SELECT doc_id, whole_license, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN found USING (doc_id)
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_separator_scan.document_tokens(read_documents(spark, sf_dir))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op10_ngram_join.similarity_classes(read_documents(spark, sf_dir), shingle=4, num=85, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[s + 1 : s + 4], ' ') AS f
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 4, 0) + 1)) AS s FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
           FROM g a JOIN g b ON a.f = b.f AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
         WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       least(w.doc_id, coalesce(m.lo, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, min(y) AS lo FROM reach GROUP BY x) m USING (doc_id)
"""


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_warc_bundles.archive(read_table(spark, sf_dir, "pages"))


# base 32 of the 160 digest bits: four letters for each five hexadecimal digits
OP11_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, upper(sha1(b)) AS h FROM p),
c AS (SELECT page_id, n, h, max(page_id) OVER (PARTITION BY h) AS top, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(floor(
          list_sum(list_transform(range(0, 5), lambda j:
            (strpos('0123456789ABCDEF', substr(h, CAST(5 * (i // 4) + j + 1 AS BIGINT), 1)) - 1) * CAST(pow(16, 4 - j) AS BIGINT)))
          / pow(32, 3 - i % 4)) AS BIGINT) % 32, 1)), '') AS digest FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM c
"""


def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").withColumn("label", label)
    return op12_hard_negatives.hard_negatives(rows, F.col("id") % 50 == 0)


OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
             CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
         AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_pivotal_grams.spelling_variants(read_documents(spark, sf_dir), min_length=6, min_count=5, ratio=5, slip_every=199)


# crc32 with its byte table made by the rule; near words by deletions: one word is the other without a code point,
# or both agree without the code point at one place
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, k:
           CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, CAST(b AS BIGINT))) AS t),
run AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{00C0}-\x{00FF}]{6,}')) AS run FROM documents),
each AS (SELECT run, hex(encode(concat(doc_id, ':', run))) AS x, count(*) AS c FROM run GROUP BY ALL),
hashed AS (
  SELECT run, c, xor(CAST(4294967295 AS BIGINT), list_reduce(
           list_transform(range(0, len(x) // 2), lambda i: CAST(('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)),
           lambda h, b: xor(h >> 8, t[CAST(xor(h, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT))) AS h
  FROM each, crc),
word AS (
  SELECT w AS word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w,
               c FROM hashed)
  WHERE length(w) >= 6 GROUP BY w HAVING sum(c) >= 5),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
        FROM (SELECT word, unnest(range(0, length(word))) AS i FROM word)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN word w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN word w ON c.rest = w.word),
best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY w.n DESC, other) AS top, max(w.n) AS top_n
         FROM near JOIN word w ON w.word = other GROUP BY near.word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * n THEN top END AS form,
                  CASE WHEN top_n >= 5 * n THEN top_n END AS form_n FROM word LEFT JOIN best USING (word)),
path(word, here, depth) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT path.word, form, depth + 1 FROM path JOIN formed f ON f.word = here WHERE form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM formed
JOIN (SELECT word, last(here ORDER BY depth) AS root FROM path GROUP BY word) USING (word)
"""


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_token_counts": op9_token_counts,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_warc_bundles": op11_warc,
    "op12_hard_negative_mining": op12_hard_negative_mining,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE: dict[str, str] = {
    "op1_benchmark_decontamination": OP1_SQL,
    "op2_suffix_array_dedup": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op8_license_scan": OP8_SQL,
    "op10_ngram_jaccard_join": OP10_SQL,
    "op11_warc_bundles": OP11_SQL,
    "op12_hard_negative_mining": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
