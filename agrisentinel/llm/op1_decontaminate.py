"""Benchmark decontamination over a distributed positional inverted index.

Words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased.  A test item asks for its windows of ``window`` consecutive words
(one shorter window if it has fewer words, none if it has none).

1. corpus frequencies of the test terms (one pass, map-side combine);
2. for each window its two rarest terms, at their offsets;
3. the positional index: postings ``(term, doc, position)`` of those terms,
   stored as a Parquet table in the shared folder, sorted by term;
4. intersection: a posting of the rarest term fixes where the item would lie
   (document position minus item position); it survives if the list of the
   second rarest term, adjusted by its offset, has that document and place;
5. the survivors' whole windows are compared word by word in the document row.

Everything is DataFrame expressions.  Hot terms only lengthen a posting list,
which is a join key together with document and position, so no task holds a
whole list.  A window with a term that the corpus lacks occurs nowhere and is
dropped.  Null or empty texts have no words; repeated rows are judged row by
row; rows may repeat or lack an id.  Test items are told apart by id and text
(``ikey``, a hash of the words), so an id may stand for several texts, or be null.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import broadcast_if_small, materialise, own_names

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII alone take the quick way."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Array of the words of ``text``; null has none."""
    parts = F.split(F.coalesce(lower_ascii(text), F.lit("")), NON_WORD)
    return F.filter(parts, lambda w: w != "")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, ikey, words`` of the test items that have words."""
    return (items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("words"))
                 .where(F.size("words") > 0)
                 .select("item", F.xxhash64("item", "words").alias("ikey"), "words").dropDuplicates(["ikey"]))


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """Corpus frequency of each of ``terms`` (column term) that occurs."""
    found = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    return found.join(broadcast_if_small(terms, 64), "term").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


def positional_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``term, doc, tkey, pos`` (0-based) of ``terms``, stored sorted by
    term in segments of documents.  ``tkey`` tells rows of one id apart."""
    found = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("tkey"),
                        F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    found = found.join(broadcast_if_small(terms, 64), "term").select("term", "doc", "tkey", "pos")
    return materialise(found.sortWithinPartitions("term", "doc", "pos"), "op1-postings")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """One row per word of each window: ikey, w (first word), at (word's place), term."""
    size = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(size - window, F.lit(0)))
    return (items.select("ikey", "words", F.explode(starts).alias("w"))
                 .select("ikey", "w", F.posexplode(F.slice("words", F.col("w") + 1, window)).alias("o", "term"))
                 .select("ikey", "w", (F.col("w") + F.col("o")).alias("at"), "term"))


def _same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.tkey") == F.col(f"{b}.tkey"))


def candidate_places(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """``doc, tkey, ikey, shift``: where the two rarest terms of a window fit."""
    spread = _windows(items, window)
    terms = materialise(spread.select("term").distinct(), "op1-terms")
    counts = materialise(term_counts(docs, terms, text_col), "op1-counts")
    per_window = Window.partitionBy("ikey", "w")
    ranked = (spread.join(counts, "term", "left")
                    .withColumn("known", F.min(F.col("cf").isNotNull()).over(per_window)).where("known")
                    .withColumn("rank", F.row_number().over(per_window.orderBy("cf", "at"))).where("rank <= 2"))
    first = ranked.where("rank = 1").select("ikey", "w", "at", "term")
    second = ranked.where("rank = 2").select("ikey", "w", F.col("at").alias("at2"), F.col("term").alias("term2"))
    pairs = materialise(first.join(second, ["ikey", "w"], "left")
                             .select("ikey", "at", "term", "at2", "term2").distinct(), "op1-pairs")
    index = positional_index(docs, pairs.select("term").union(
        pairs.where("term2 is not null").select(F.col("term2").alias("term"))).distinct(), id_col, text_col)
    seeds = (index.join(broadcast_if_small(pairs, 96), "term")
                  .select("doc", "tkey", "ikey", (F.col("pos") - F.col("at")).alias("shift"), "at2", "term2"))
    alone = seeds.where("term2 is null").select("doc", "tkey", "ikey", "shift")
    # offset-adjusted lists: the second term must stand at shift + at2
    two = (seeds.where("term2 is not null").distinct().alias("s")
                .join(index.alias("p"), _same_doc("s", "p") & (F.col("s.term2") == F.col("p.term"))
                      & (F.col("s.shift") + F.col("s.at2") == F.col("p.pos")), "left_semi")
                .select("doc", "tkey", "ikey", "shift"))
    return two.union(alone).distinct()


def _hits(window: int) -> str:
    """SQL: places of the document that windows of the candidates cover."""
    return f"""
    flatten(transform(places, p ->
      transform(
        filter(sequence(0, greatest(size(p.words) - {window}, 0)),
               w -> p.shift + w >= 0 and p.shift + w + least(size(p.words), {window}) <= size(words)
                    and slice(p.words, w + 1, {window}) =
                        slice(words, greatest(p.shift + w, 0) + 1, least(size(p.words), {window}))),
        w -> named_struct('item', p.item, 'from', p.shift + w, 'n', least(size(p.words), {window})))))"""


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its exact phrase matches.

    Adds ``hits`` (array of item, from, n: the word positions of each occurring
    window), ``n_words, n_hit, n_items, items`` (ids as sorted strings).  Documents are read as they are; no row is dropped.
    """
    items = materialise(item_words(benchmark, item_col, item_text), "op1-items")
    places = candidate_places(docs, items, window, id_col, text_col)
    grouped = materialise(places.join(items, "ikey").groupBy("doc", "tkey").agg(
        F.collect_list(F.struct("item", "shift", "words")).alias("places")), "op1-places")
    rows = docs.withColumn("_tkey", F.xxhash64(text_col))

    def same_row() -> Column:
        return F.col(f"d.{id_col}").eqNullSafe(F.col("g.doc")) & (F.col("d._tkey") == F.col("g.tkey"))
    # only documents with a place to look at meet their places
    some = rows.alias("d").join(broadcast_if_small(grouped.select("doc", "tkey"), 40).alias("g"), same_row(), "left_semi")
    some = some.select(F.col(id_col), "_tkey", F.col(text_col).alias("_text")).dropDuplicates([id_col, "_tkey"])
    looked = (some.alias("d").join(grouped.alias("g"), same_row())
                  .select("doc", "tkey", "places", words(F.col("_text")).alias("words"))
                  .select("doc", "tkey", F.expr(_hits(window)).alias("hits")).where("size(hits) > 0"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["from"], h["from"] + h["n"] - 1))))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"].cast("string"))))
    found = materialise(looked.select("doc", "tkey", "hits", F.size(covered).cast("long").alias("n_hit"),
                                      ids.alias("items")), "op1-found")
    each = 96 + 24 * int(found.agg(F.coalesce(F.ceil(F.avg(F.size("hits"))), F.lit(0))).first()[0])
    found = found.select("doc", "tkey", *[F.col(c).alias(f"_found_{c}") for c in ("hits", "n_hit", "items")])
    out = rows.alias("d").join(broadcast_if_small(found, each).alias("g"), same_row(), "left")
    hit_type, no_items = found.schema["_found_hits"].dataType, F.array().cast("array<string>")
    return out.select("d.*", "g._found_hits", "g._found_n_hit", "g._found_items").withColumns({
        "n_words": F.size(words(F.col(text_col))).cast("long"),
        "n_hit": F.coalesce("_found_n_hit", F.lit(0).cast("long")),
        "hits": F.coalesce("_found_hits", F.array().cast(hit_type)),
        "items": F.coalesce("_found_items", no_items),
        "n_items": F.size(F.coalesce("_found_items", no_items)).cast("long"),
    }).drop("_tkey", "_found_hits", "_found_n_hit", "_found_items")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (columns as they are) without any occurring window."""
    rows, names, back = own_names(docs)
    found = contamination(rows, benchmark, window, names[id_col], names[text_col])
    return found.where(F.col("n_hit") == 0).select(*back)


def proximity_matches(docs: DataFrame, queries: DataFrame, slop: int = 10, id_col: str = "doc_id",
                      text_col: str = "text", query_col: str = "item_id", query_text: str = "text") -> DataFrame:
    """``query, doc, pos``: places of a query's rarest term with all its other
    terms at most ``slop`` words away, in any order (distinct terms)."""
    asked = (queries.select(F.col(query_col).alias("query"),
                            F.explode(F.array_distinct(words(F.col(query_text)))).alias("term")))
    terms = materialise(asked.select("term").distinct(), "op1-near-terms")
    counts = term_counts(docs, terms, text_col)
    per_query = Window.partitionBy("query")
    ranked = materialise(
        asked.join(counts, "term", "left")
             .withColumn("known", F.min(F.col("cf").isNotNull()).over(per_query)).where("known")
             .withColumns({"rank": F.row_number().over(per_query.orderBy("cf", "term")),
                           "terms": F.count(F.lit(1)).over(per_query)}), "op1-near")
    index = positional_index(docs, ranked.select("term").distinct(), id_col, text_col)
    seeds = (index.join(ranked.where("rank = 1").select("query", "term", "terms"), "term")
                  .select("query", "doc", "tkey", F.col("pos").alias("pos0"), "terms"))
    others = ranked.where("rank > 1").select("query", "term")
    near = (seeds.where("terms > 1").join(others, "query").alias("s")
                 .join(index.alias("p"), _same_doc("s", "p") & (F.col("s.term") == F.col("p.term"))
                       & (F.abs(F.col("s.pos0") - F.col("p.pos")) <= slop))
                 .groupBy("s.query", "s.doc", "s.tkey", "s.pos0", "s.terms")
                 .agg(F.countDistinct("s.term").alias("got")).where("got = terms - 1")
                 .select("query", "doc", F.col("pos0").alias("pos")))
    single = seeds.where("terms = 1").select("query", "doc", F.col("pos0").alias("pos"))
    return near.union(single).distinct()
