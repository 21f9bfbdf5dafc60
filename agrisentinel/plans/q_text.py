"""Registered queries: HTML text, scalar text/date functions, chunked
summaries and the UDF surface (I1–I22, L1–L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import summarise as SU
from ..operators import topics as TP
from ..sources.tables import table
from . import sqltext as Q
from .fixtures import view, with_views
from .registry import query
from .rounding import fround

CHUNK = 4096          # fixed value: the reference's chunk size in tokens
SMALL_CHUNK = 256     # second setting, so that many documents are split


def _chunks_sql(size):
    return f"""
SELECT doc_id, unnest(generate_series(0, len(chunks) - 1)) AS chunk_idx, unnest(chunks) AS chunk
FROM (SELECT doc_id, CASE WHEN len(tok) <= {size} THEN [text]
             ELSE list_transform(range(0, len(tok), {size}),
                                 lambda i: array_to_string(tok[i + 1:i + {size}], ' ')) END AS chunks
      FROM (SELECT doc_id, text, string_split_regex(trim(text), '\\s+') AS tok FROM documents) d) c"""


@query("i1_html_text_plain", f"""
SELECT page_id, {H.html_text_regex_sql('html', H.PLAIN_TAGS, None)} AS text FROM pages""")
def i1_plain(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.newlines_to_space(
        H.html_text_regex("html", H.PLAIN_TAGS, None)).alias("text"))


@query("i1_html_text_parsed")
def i1_parsed(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", H.html_text_parsed("html", H.PLAIN_TAGS, None).alias("text"))


@query("i2_html_text_boilerplate", f"""
SELECT page_id, {H.html_text_regex_sql('html')} AS text FROM pages""")
def i2_boilerplate(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.html_text_regex("html").alias("text"))


@query("i2_html_text_parsed")
def i2_parsed(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.html_text_parsed("html").alias("text"))


@query("i3_whitespace_collapse", """
SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents""")
def i3_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.collapse_ws("text").alias("text"))


@query("i4_newline_removal", """
SELECT doc_id, translate(text, chr(10) || chr(13), '  ') AS text FROM documents""")
def i4_newlines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.newlines_to_space("text").alias("text"))


@query("i5_blank_to_empty", """
SELECT doc_id, CASE WHEN trim(text) = '' THEN '' ELSE md5(text) END AS text_md5 FROM documents""")
def i5_blank(spark, sf):
    d = table(spark, sf, "documents")
    b = T.blank_to_empty("text")
    return d.select("doc_id", F.when(b == "", F.lit("")).otherwise(F.md5(b)).alias("text_md5"))


@query("i6_token_chunking", f"""
SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx,
       len(string_split_regex(trim(chunk), '\\s+')) AS n_tokens, md5(chunk) AS chunk_md5
FROM ({_chunks_sql(CHUNK)}) c""")
def i6_chunks(spark, sf):
    c = SU.chunk_rows(table(spark, sf, "documents"), max_tokens=CHUNK)
    return c.select("doc_id", "chunk_idx", F.size(SU.whitespace_tokens("chunk")).cast("bigint").alias("n_tokens"),
                    F.md5("chunk").alias("chunk_md5"))


@query("l3_text_to_chunks", f"""
SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx,
       len(string_split_regex(trim(chunk), '\\s+')) AS n_tokens, md5(chunk) AS chunk_md5
FROM ({_chunks_sql(SMALL_CHUNK)}) c""")
def l3_chunks(spark, sf):
    c = SU.chunk_rows(table(spark, sf, "documents"), max_tokens=SMALL_CHUNK)
    return c.select("doc_id", "chunk_idx", F.size(SU.whitespace_tokens("chunk")).cast("bigint").alias("n_tokens"),
                    F.md5("chunk").alias("chunk_md5"))


PROMPT_SQL = ("'" + T.PROMPT_HEAD.replace("\n", "' || chr(10) || '") + "' || chunk || '"
              + T.PROMPT_TAIL.replace("\n", "' || chr(10) || '") + "'")
PROMPT_SQL = PROMPT_SQL.replace("|| '' ||", "||")


@query("i7_prompt_building", f"""
SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, length(p) AS n_chars, md5(p) AS prompt_md5
FROM (SELECT doc_id, chunk_idx, {PROMPT_SQL} AS p FROM ({_chunks_sql(SMALL_CHUNK)}) c) x""")
def i7_prompt(spark, sf):
    c = SU.prompts(SU.chunk_rows(table(spark, sf, "documents"), max_tokens=SMALL_CHUNK))
    return c.select("doc_id", "chunk_idx", F.length("prompt").cast("bigint").alias("n_chars"),
                    F.md5("prompt").alias("prompt_md5"))


@query("i8_marker_extraction", f"""
SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx,
       trim(string_split(p || ' ' || regexp_extract(chunk, '[^.!?]+[.!?]*'), 'Summary:')[-1]) AS extracted
FROM (SELECT doc_id, chunk_idx, chunk, {PROMPT_SQL} AS p FROM ({_chunks_sql(SMALL_CHUNK)}) c) x""")
def i8_marker(spark, sf):
    c = SU.prompts(SU.chunk_rows(table(spark, sf, "documents"), max_tokens=SMALL_CHUNK))
    # a stand-in generation: the prompt echoed back followed by the chunk's first sentence
    gen = F.concat("prompt", F.lit(" "), F.regexp_extract("chunk", SU.SENTENCE_PATTERN, 0))
    return c.select("doc_id", "chunk_idx", T.after_marker(gen).alias("extracted"))


SUMMARY_SQL = f"""
WITH ch AS ({_chunks_sql(SMALL_CHUNK).replace('FROM documents) d) c', "FROM documents WHERE trim(text) <> '') d) c")}),
idf AS (SELECT term, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM (
          SELECT DISTINCT doc_id, unnest({Q.no_stop(Q.tok('text'))}) AS term FROM documents) t
        GROUP BY term),
se AS (SELECT doc_id, chunk_idx, unnest(generate_series(0, len(s) - 1)) AS sent_idx,
              trim(unnest(s)) AS sentence
       FROM (SELECT doc_id, chunk_idx, regexp_extract_all(chunk, '[^.!?]+[.!?]*') AS s FROM ch) x),
occ AS (SELECT doc_id, chunk_idx, sent_idx, unnest({Q.no_stop(Q.tok('sentence'))}) AS term FROM se),
sc AS (SELECT o.doc_id, o.chunk_idx, o.sent_idx, avg(i.idf) AS score FROM occ o JOIN idf i ON i.term = o.term
       GROUP BY o.doc_id, o.chunk_idx, o.sent_idx),
ranked AS (SELECT se.*, row_number() OVER (PARTITION BY se.doc_id, se.chunk_idx
                  ORDER BY (CAST(floor(coalesce(sc.score, 0.0) * CAST(100000000 AS DOUBLE) + 0.5) AS DOUBLE)
                            / CAST(100000000 AS DOUBLE)) DESC, se.sent_idx) AS rk
           FROM se LEFT JOIN sc ON sc.doc_id = se.doc_id AND sc.chunk_idx = se.chunk_idx
                              AND sc.sent_idx = se.sent_idx),
pc AS (SELECT doc_id, chunk_idx, string_agg(sentence, ' ' ORDER BY sent_idx) AS cs FROM ranked
       WHERE rk <= 4 GROUP BY doc_id, chunk_idx),
pd AS (SELECT doc_id, string_agg(cs, ' ' ORDER BY chunk_idx) AS summary FROM pc GROUP BY doc_id)
SELECT d.doc_id, coalesce(pd.summary, '') AS summary FROM documents d LEFT JOIN pd ON pd.doc_id = d.doc_id"""


@query("i9_extractive_summary", SUMMARY_SQL)
def i9_summary(spark, sf):
    d = table(spark, sf, "documents")
    return SU.extractive_summaries(d, max_tokens=SMALL_CHUNK)


@query("i12_snippet", with_views("""
SELECT doc_id, translate(substr(text, 1, 50), chr(10) || chr(13), '  ') || ' (' || url || ')' AS snippet
FROM topics""", "topics"))
def i12_snippet(spark, sf):
    return view(spark, sf, "topics").select("doc_id", T.snippet("text", "url").alias("snippet"))


@query("i15_timestamp_parse", """
SELECT event_id, strftime(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S'),
                          '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def i15_parse(spark, sf):
    e = table(spark, sf, "events").select("event_id", T.stamp("ts").alias("s"))
    return e.select("event_id", T.stamp(T.parse_timestamp("s")).alias("parsed"))


@query("i16_date_format", """
SELECT event_id, strftime(ts, '%Y%m%d') AS run_date, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp
FROM events""")
def i16_format(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", T.stamp("ts", "yyyyMMdd").alias("run_date"),
                    T.stamp("ts").alias("stamp"))


@query("i17_file_stem", """
SELECT page_id, regexp_extract(url, '([^/]+)\\.[^./]+$', 1) AS stem FROM pages""")
def i17_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.file_stem("url").alias("stem"))


LISTING = "https://news.example/listing?edition=categoryarticles&page=%d"


@query("i18_url_templating", with_views(f"""
SELECT session, page_num, printf('{LISTING}', page_num) AS url FROM page_counts""", "page_counts"))
def i18_urls(spark, sf):
    pc = view(spark, sf, "page_counts")
    return pc.select("session", "page_num", T.page_url(LISTING, "page_num").alias("url"))


@query("i18_window_urls", """
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
w AS (SELECT day, unnest([0, 6, 12, 18]) AS h FROM d)
SELECT strftime(day, '%Y-%m-%d') AS day, h,
       printf('https://feed.example/rss?datefrom=%sT%s&dateto=%sT%s',
              strftime(day, '%Y-%m-%d'), lpad(CAST(h AS VARCHAR), 2, '0') || '%3A00%3A00Z',
              strftime(day, '%Y-%m-%d'), lpad(CAST(h + 5 AS VARCHAR), 2, '0') || '%3A59%3A59Z') AS url
FROM w""")
def i18_windows(spark, sf):
    days = table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct()
    w = days.select("d", F.explode(F.array(*[F.lit(h) for h in (0, 6, 12, 18)])).alias("h"))
    day = F.date_format("d", "yyyy-MM-dd")
    start = F.concat(F.lpad(F.col("h").cast("string"), 2, "0"), F.lit("%3A00%3A00Z"))
    end = F.concat(F.lpad((F.col("h") + 5).cast("string"), 2, "0"), F.lit("%3A59%3A59Z"))
    url = F.format_string("https://feed.example/rss?datefrom=%sT%s&dateto=%sT%s", day, start,
                          day, end)
    return w.select(day.alias("day"), "h", url.alias("url"))


@query("i19_casts", """
SELECT event_id, TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k,
       CAST(user_id AS VARCHAR) AS user_text FROM events""")
def i19_casts(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id",
                    F.regexp_extract("props", r'"k": ([0-9]+)', 1).try_cast("int").alias("k"),
                    F.col("user_id").cast("string").alias("user_text"))


@query("i20_json_encode", with_views("""
SELECT topic, to_json({'topic': topic, 'count': count})::VARCHAR AS payload
FROM (SELECT topic, count(*) AS count FROM topics GROUP BY topic) s""", "topics"))
def i20_json(spark, sf):
    s = TP.topic_sizes(view(spark, sf, "topics"))
    return s.select("topic", F.to_json(F.struct("topic", "count")).alias("payload"))


@query("i21_array_transform", with_views(f"""
SELECT topic, array_to_string(list_transform(words[1:3], lambda w: upper(w)), ' | ') AS head
FROM words""", "topics", extra=__import__("agrisentinel.plans.q_topics", fromlist=["x"]).TERMS_CTES))
def i21_arrays(spark, sf):
    from .q_topics import _top_words
    w = TP.words_array(_top_words(spark, sf), k=10)
    return w.select("topic", F.array_join(F.transform(F.slice("words", 1, 3), F.upper), " | ")
                    .alias("head"))


@query("i22_missing_fill", with_views("""
SELECT row_key, coalesce(temperature_max_mean_1, -999.0)::DOUBLE AS t1,
       coalesce(precipitation_mean_sum_12, -999.0)::DOUBLE AS p12 FROM mon_wide""", "mon_wide"))
def i22_fill(spark, sf):
    w = view(spark, sf, "mon_wide")
    return w.select("row_key", T.fill_missing("temperature_max_mean_1").alias("t1"),
                    T.fill_missing("precipitation_mean_sum_12").alias("p12"))


@query("l1_expression_not_udf", with_views("""
SELECT doc_id, CASE WHEN topic = -1 THEN 'Outlier' ELSE 'Topic ' || CAST(topic AS VARCHAR) END AS label
FROM topics""", "topics"))
def l1_expr(spark, sf):
    t = view(spark, sf, "topics")
    return t.select("doc_id", F.when(F.col("topic") == -1, F.lit("Outlier")).otherwise(
        F.concat(F.lit("Topic "), F.col("topic").cast("string"))).alias("label"))


@query("l2_struct_outcome_udf")
def l2_struct(spark, sf):
    r = view(spark, sf, "responses")
    return r.select("page_id", H.fetch_outcome_parsed("status", "content_type", "html")
                    .alias("outcome")).select("page_id", "outcome.content", "outcome.error")


@query("l4_batch_encoder")
def l4_encoder(spark, sf):
    from ..operators.embed import encode_batches
    d = table(spark, sf, "documents").select("doc_id", "text")
    return encode_batches(d).select("doc_id", F.size("embedding").alias("dims"),
                                    fround(F.aggregate("embedding", F.lit(0.0),
                                                       lambda a, x: a + x * x), 6).alias("norm2"))


@query("i10_chunk_recombination", f"""
WITH s AS ({SUMMARY_SQL}),
multi AS (SELECT doc_id FROM ({_chunks_sql(SMALL_CHUNK)}) c GROUP BY doc_id HAVING count(*) > 1)
SELECT doc_id, summary FROM s WHERE doc_id IN (SELECT doc_id FROM multi)""")
def i10_recombine(spark, sf):
    d = table(spark, sf, "documents")
    multi = (d.groupBy("doc_id").agg(F.sum(SU.chunk_count("text", SMALL_CHUNK)).alias("n"))
              .where(F.col("n") > 1).select("doc_id"))
    return SU.extractive_summaries(d, max_tokens=SMALL_CHUNK).join(multi, "doc_id", "left_semi")


@query("i11_failure_to_empty", f"""
WITH s AS ({SUMMARY_SQL})
SELECT doc_id, summary FROM s WHERE summary = ''""")
def i11_empty(spark, sf):
    d = table(spark, sf, "documents")
    return SU.extractive_summaries(d, max_tokens=SMALL_CHUNK).where(F.col("summary") == "")
