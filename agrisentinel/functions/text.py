"""Column expressions for text, dates and files.

All are built-in Spark expressions (JVM, whole-stage codegen); none needs a
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_ws(x: Column | str) -> Column:
    """``" ".join(text.split())``."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def newlines_to_space(x: Column | str) -> Column:
    """I4: each ``\\n`` and ``\\r`` becomes a space."""
    return F.translate(_c(x), "\n\r", "  ")


def blank_to_empty(x: Column | str) -> Column:
    """A text that is empty after trimming becomes ``""``."""
    c = _c(x)
    return F.when(F.trim(c) == "", F.lit("")).otherwise(c)


# Fixed values (must equal the reference's): the summary prompt around a chunk.
PROMPT_HEAD = ("Summarize the following text in 4 sentences maximum. "
               "ONLY output the summary, do not repeat the original text or include any "
               "additional commentary:\n\n")
PROMPT_TAIL = "\n\nSummary:"
MARKER = "Summary:"


def prompt(chunk: Column | str) -> Column:
    """The instruction + chunk + marker."""
    return F.concat(F.lit(PROMPT_HEAD), _c(chunk), F.lit(PROMPT_TAIL))


def after_marker(generated: Column | str, marker: str = MARKER) -> Column:
    """I8: text after the last marker, trimmed (whole text if absent)."""
    return F.trim(F.substring_index(_c(generated), marker, -1))


def snippet(text: Column | str, url: Column | str, n: int = 50) -> Column:
    """First ``n`` characters, newlines as spaces, then `` (url)``."""
    return F.concat(newlines_to_space(F.substring(_c(text), 1, n)), F.lit(" ("), _c(url),
                    F.lit(")"))


def topic_label(topic: Column | str, words: Column | str, n: int = 3) -> Column:
    """``Outlier`` for −1, else ``Topic k: w1, w2, w3``."""
    t = _c(topic)
    return F.when(t == -1, F.lit("Outlier")).otherwise(
        F.concat(F.lit("Topic "), t.cast("string"), F.lit(": "),
                 F.array_join(F.slice(F.coalesce(_c(words), F.array().cast("array<string>")),
                                      1, n), ", ")))


def topic_name(topic: Column | str, words: Column | str, n: int = 4) -> Column:
    """``k_w1_w2_w3_w4``."""
    return F.concat_ws("_", _c(topic).cast("string"),
                       F.array_join(F.slice(_c(words), 1, n), "_"))


RSS_DATE_FORMAT = "dd MMM yyyy HH:mm:ss z"


def parse_rss_date(s: Column | str) -> Column:
    """``Mon, 09 Jun 2025 10:00:00 GMT`` → timestamp (weekday
    dropped: the Spark 3+ parser refuses ``EEE``); null if unparseable."""
    return F.try_to_timestamp(F.substring(_c(s), 6, 100), F.lit(RSS_DATE_FORMAT))


def parse_timestamp(s: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """I15."""
    return F.try_to_timestamp(_c(s), F.lit(fmt))


def stamp(ts: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Formatted timestamp text."""
    return F.date_format(_c(ts), fmt)


def file_stem(path: Column | str) -> Column:
    """Basename without extension."""
    return F.regexp_extract(_c(path), r"([^/]+)\.[^./]+$", 1)


def page_url(template: str, page: Column | str) -> Column:
    """Page number into a listing URL (``%d`` placeholder)."""
    return F.format_string(template, _c(page))


def window_url(template: str, start: Column | str, end: Column | str) -> Column:
    """Time-window bounds into a feed query string (two ``%s``)."""
    return F.format_string(template, _c(start), _c(end))


def fill_missing(x: Column | str, value: float = -999.0) -> Column:
    """Null or NaN → ``value``."""
    c = _c(x)
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(value))
