"""Line dedup with a fixed-depth log-template tree.

A line's leaf is its token count and its first ``depth`` tokens (a token with a
digit counts as a field ``<*>``).  Inside a leaf a token that stands at its place
in fewer than ``min_docs`` documents' lines is a variable field; the line with
its fields generalised is its template.  A template that recurs in ``min_docs``
documents or more, and has at least half of its tokens fixed, is dropped: its
lines are taken out of every document.  Copies are told apart by their text's
hash: rows of one text count as one document, so copies alone make no line recur.
A document without a word outside recurring lines has nothing of its own; it is
left whole, for document-level dedup.

Documents are counted, not lines: several lines of a document with one template
(or one token at its place) count once.

Only DataFrame expressions are used, with one plan for tables of any size:

* Lines are parsed once and stored with hashes of their text, leaf and document.
  Everything is counted on hashes, hot lines before they are shuffled.
* The text of each distinct line is shuffled to its (leaf, line), and where the leaf is
  frequent once more, to its leaf, where places and tokens are counted and marked
  without a further shuffle.  Leaves of more than ``HOT`` distinct lines are counted
  apart, by (leaf, place, token), so no task gets a whole one.
* Counts add up lines' documents.  A document with several lines of one leaf would
  count more than once; such sets of lines are counted, alike ones together, and what
  their lines share is taken off.
* The lines that go are brought back to the documents as hashes; texts are shuffled
  once, to their document's hashes.

Two lines are the same if their 64-bit hashes are.

Lines are split at \\n; a line of fewer than ``min_tokens`` tokens is a template of
its own, without fields, and one without letters always stays.
A line that repeats within a document counts once.  Null texts stay null, empty
ones empty; rows with repeated or null ids are judged row by row; extra columns
are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import broadcast_if_small, materialise, partitions, release

SPACE = r"[\x20\x09-\x0D]+"
FIELD = "<*>"
#: distinct lines of a leaf that one task may hold
HOT = 200_000


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, SPACE), lambda t: t != "")


def leaf(toks: Column, depth: int) -> Column:
    """Branch of the tree: token count and leading tokens, fields masked."""
    lead = F.transform(F.slice(toks, 1, depth), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    return F.concat_ws(" ", F.size(toks).cast("string"), lead)


def parsed_lines(docs: DataFrame, text_col: str, depth: int, min_tokens: int) -> DataFrame:
    """``doc, key, lid, short, line``: hashes of each distinct line's document, leaf and
    text; the line itself where it is long.  Lines that always stay are left out."""
    lines = docs.select(F.xxhash64(text_col).alias("doc"), F.explode(F.array_distinct(F.split(F.col(text_col), "\n"))).alias("line"))
    short = F.size("toks") < min_tokens
    return (lines.select("doc", "line", tokens(F.col("line")).alias("toks"))
                 .where(~short | F.col("line").rlike(r"\p{L}"))
                 .select("doc", "line", short.alias("short"),
                         F.when(short, F.concat(F.lit("= "), "line")).otherwise(leaf(F.col("toks"), depth)).alias("leaf"))
                 .select("doc", F.xxhash64("leaf").alias("key"), F.xxhash64("line").alias("lid"), "short",
                         F.when(~F.col("short"), F.col("line")).alias("line")))


def _line_sets(once: DataFrame, leaves: DataFrame) -> DataFrame:
    """``key, sid, docs, lid``: the lines of one frequent leaf that stand together in ``docs`` documents."""
    sets = (once.where(~F.col("short")).groupBy("doc", "key").agg(F.sort_array(F.collect_list("lid")).alias("lids"))
                .where(F.size("lids") > 1).groupBy("key", "lids").agg(F.count(F.lit(1)).alias("docs")))
    return (sets.join(leaves.select("key").hint("merge"), "key", "left_semi")
                .select("key", F.xxhash64("key", "lids").alias("sid"), "docs", F.explode("lids").alias("lid")))


def _taken_off(sets: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """``*by, c``: documents counted too often where a set's lines agree on ``by``; ``lines`` has key, lid and ``by``."""
    shared = sets.join(lines.hint("merge"), ["key", "lid"]).groupBy("sid", "docs", *by).agg(F.count(F.lit(1)).alias("m"))
    return shared.where("m > 1").groupBy(*by).agg(F.sum((1 - F.col("m")) * F.col("docs")).alias("c"))


def _cells(lines: DataFrame) -> DataFrame:
    return lines.select(*[c for c in lines.columns if c != "line"], F.posexplode(tokens(F.col("line"))).alias("place", "token"))


CELL = ["key", "place", "token"]


def _templates(lines: DataFrame, off: DataFrame, min_docs: int, apart: bool) -> DataFrame:
    """``key, lid, c, template`` of ``lines`` (key, lid, c, line) with at least half of their tokens fixed.

    The template is a hash of the places' fixed tokens and fields.  ``apart``: count
    cells by themselves; else ``lines`` and ``off`` meet by leaf and are counted there.
    """
    if apart:
        cells = _cells(lines)
        total = (cells.select(*CELL, "c").unionByName(off).groupBy(*CELL).agg(F.sum("c").alias("docs")).where(F.col("docs") >= min_docs))
        marked = cells.join(total.hint("merge"), CELL, "left").withColumn("fixed", F.col("docs").isNotNull())
    else:
        n = partitions(lines.sparkSession)
        # both by the leaf alone, so that the window and the aggregate below need no other exchange
        cells = _by_leaf(lines, off, n)
        marked = cells.withColumn("fixed", F.sum("c").over(Window.partitionBy(*CELL)) >= min_docs).where(F.col("lid").isNotNull())
    part = F.xxhash64("place", F.when(F.col("fixed"), F.col("token")).otherwise(F.lit(FIELD)))
    return (marked.groupBy("key", "lid").agg(F.max("c").alias("c"), F.count(F.lit(1)).alias("n"), F.count_if("fixed").alias("n_fixed"),
                                             F.bit_xor(part).alias("template"))
                  .where(2 * F.col("n_fixed") >= F.col("n")).select("key", "lid", "c", "template"))


def _by_leaf(lines: DataFrame, off: DataFrame, n: int) -> DataFrame:
    """Cells of ``lines`` and what is taken off them (without ``lid``), partitioned by leaf; texts travel whole."""
    whole = lines.select("key", "lid", "c", "line", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("token"))
    minus = off.select("key", F.lit(None).cast("long").alias("lid"), "c", F.lit(None).cast("string").alias("line"), "place", "token")
    met = whole.unionByName(minus).repartition(n, "key")
    toks = F.when(F.col("line").isNotNull(), F.transform(tokens(F.col("line")), lambda x, i: F.struct(i.cast("int").alias("place"), x.alias("token")))
                  ).otherwise(F.array(F.struct("place", "token")))
    return met.select("key", "lid", "c", F.explode(toks).alias("cell")).select("key", "lid", "c", "cell.place", "cell.token")


def recurring_lines(docs: DataFrame, text_col: str = "text", depth: int = 3, min_docs: int = 10,
                    min_tokens: int = 4) -> tuple[DataFrame, DataFrame]:
    """``doc, lid`` of the lines of every text (stored), and ``lid, template`` (hashes) of those that recur (stored)."""
    lines = materialise(parsed_lines(docs, text_col, depth, min_tokens), "op5-lines", compression="zstd")
    once = materialise(lines.select("doc", "key", "lid", "short").distinct(), "op5-once")  # rows of one text count once
    counts = materialise(once.groupBy("key", "lid", "short").agg(F.count(F.lit(1)).alias("c")), "op5-counts")
    alone = counts.where(F.col("short") & (F.col("c") >= min_docs)).select("lid", F.col("key").alias("template"))
    # as many lines' documents as a leaf needs at least; a document may count more than once here
    leaves = materialise(counts.where(~F.col("short")).groupBy("key").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("lines"))
                         .where(F.col("c") >= min_docs), "op5-leaves")
    sets = materialise(_line_sets(once, leaves), "op5-sets")
    known = (counts.where(~F.col("short")).drop("short").join(leaves.select("key").hint("merge"), "key", "left_semi")
                   .join(sets.select("key", "lid").distinct().withColumn("shared", F.lit(True)).hint("merge"), ["key", "lid"], "left"))
    text = lines.where(F.col("line").isNotNull()).groupBy("key", "lid").agg(F.first("line").alias("line"))
    here = materialise(text.join(known.hint("merge"), ["key", "lid"]), "op5-distinct", compression="zstd")
    off = materialise(_taken_off(sets, _cells(here.where("shared").select("key", "lid", "line")), CELL), "op5-off")
    hot = broadcast_if_small(leaves.where(F.col("lines") > HOT).select("key"), 16)  # rows / HOT of them at most
    template = _templates(here.join(hot, "key", "left_anti").drop("shared"), off.join(hot, "key", "left_anti"), min_docs, apart=False)
    if leaves.where(F.col("lines") > HOT).limit(1).count():
        template = template.unionByName(_templates(here.join(hot, "key", "left_semi").drop("shared"),
                                                   off.join(hot, "key", "left_semi"), min_docs, apart=True))
    template = materialise(template, "op5-templates")
    by = ["key", "template"]
    less = _taken_off(sets, template.select("key", "lid", "template"), by)
    recurring = (template.select(*by, "c").unionByName(less).groupBy(*by).agg(F.sum("c").alias("c"))
                         .where(F.col("c") >= min_docs).select(*by))
    gone = template.join(recurring.hint("merge"), by, "left_semi").select("lid", "template").union(alone)
    gone = materialise(gone, "op5-recurring")
    for table in (lines, counts, leaves, sets, here, off, template):
        release(table)
    return once, gone


def _judged(docs: DataFrame, text_col: str, **options) -> DataFrame:
    """``row`` (a struct of ``docs``' own columns), ``kept_text, n_lines, n_dropped``."""
    once, gone = recurring_lines(docs, text_col, **options)
    per_doc = (once.join(gone.select("lid").distinct().hint("merge"), "lid", "left_semi")
                   .groupBy("doc").agg(F.collect_set("lid").alias("gone")))
    per_doc = materialise(per_doc, "op5-documents")
    for table in (once, gone):
        release(table)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("doc"))
    rows = rows.join(per_doc.hint("merge"), "doc", "left").select(
        "row", "text", F.coalesce("gone", F.array().cast("array<long>")).alias("gone"),
        F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    is_gone = "array_contains(gone, xxhash64(l))"
    rows = rows.withColumn("hit", F.expr(f"size(filter(lines, l -> {is_gone}))"))
    own = F.expr(f"exists(lines, l -> not {is_gone} and l rlike '[^ \\\\x09-\\\\x0D]')")
    rows = rows.withColumn("cut", (F.col("hit") > 0) & own)
    kept = F.array_join(F.expr(f"filter(lines, l -> not {is_gone})"), "\n")
    return rows.select(
        "row", F.when(F.col("cut"), kept).otherwise(F.col("text")).alias("kept_text"),
        F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("cut"), F.col("hit")).otherwise(0).cast("long").alias("n_dropped"))


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``kept_text, n_lines, n_dropped`` (long), in place of columns so named."""
    added = ["kept_text", "n_lines", "n_dropped"]
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in added]
    return _judged(docs, text_col, **options).select(*own, *added)


def keep_other_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (same columns) with recurring lines taken out of ``text``."""
    new = {"text": F.col("kept_text"),
           "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row")["n_chars"])
           if "n_chars" in docs.columns else None}
    return _judged(docs, "text", **options).select(*[
        (new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
