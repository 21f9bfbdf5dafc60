"""HTML → text (I1, I2) and the fetch outcome.

Two implementations of the same rule:

* ``html_text_regex`` – a chain of ``regexp_replace`` (JVM, codegen'd); the
  same chain runs in DuckDB, so it is the exactly checked form.
* ``html_text_parsed`` – a vectorised ``pandas_udf`` around the standard
  library's ``html.parser`` (a real tokenizer: handles ``>`` inside
  attributes, unclosed tags, entities).  Arrow batches, one parser per row.

Rule: drop comments and the contents of the dropped tags, optionally keep
only the first preferred container (``main``) when present, decode a fixed
entity list, join text with spaces and collapse whitespace.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Fixed values (must equal the reference's): tags removed before extraction
# in boilerplate mode, and the preferred container.
BOILERPLATE_TAGS = ("script", "style", "header", "footer", "nav", "aside", "form", "noscript")
PLAIN_TAGS = ("script", "style")
PREFERRED = "main"

# Entities decoded on both engines; ``&amp;`` last so it is decoded once.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def html_text_regex(html: Column | str, drop: Sequence[str] = BOILERPLATE_TAGS,
                    prefer: str | None = PREFERRED) -> Column:
    """I1 (``drop=PLAIN_TAGS, prefer=None``) / I2 (defaults) as regexes."""
    x = F.regexp_replace(_c(html), r"(?is)<!--.*?-->", " ")
    for tag in drop:
        x = F.regexp_replace(x, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    if prefer:
        inner = F.regexp_extract(x, rf"(?is)<{prefer}\b[^>]*>(.*?)</{prefer}\s*>", 1)
        x = F.when(x.rlike(rf"(?is)<{prefer}\b"), inner).otherwise(x)
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for ent, ch in ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def html_text_regex_sql(col: str, drop: Sequence[str] = BOILERPLATE_TAGS,
                        prefer: str | None = PREFERRED) -> str:
    """DuckDB twin of ``html_text_regex``."""
    x = f"regexp_replace({col}, '(?is)<!--.*?-->', ' ', 'g')"
    for tag in drop:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    if prefer:
        x = (f"(CASE WHEN regexp_matches({x}, '(?is)<{prefer}\\b') "
             f"THEN regexp_extract({x}, '(?is)<{prefer}\\b[^>]*>(.*?)</{prefer}\\s*>', 1) "
             f"ELSE {x} END)")
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for ent, ch in ENTITIES:
        esc = ch.replace("'", "''")
        x = f"replace({x}, '{ent}', '{esc}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _extract(html: str | None, drop: frozenset, prefer: str | None) -> str | None:
    from html.parser import HTMLParser

    if html is None:
        return None

    class _Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.main_parts = [], []
            self.skip = 0
            self.in_main = 0
            self.main_done = False

        def handle_starttag(self, tag, attrs):
            if tag in drop:
                self.skip += 1
            elif prefer and tag == prefer and not self.main_done:
                self.in_main += 1

        def handle_endtag(self, tag):
            if tag in drop and self.skip:
                self.skip -= 1
            elif prefer and tag == prefer and self.in_main:
                self.in_main -= 1
                if not self.in_main:
                    self.main_done = True

        def handle_data(self, data):
            if self.skip:
                return
            self.parts.append(data)
            if self.in_main:
                self.main_parts.append(data)

    p = _Text()
    p.feed(html)
    p.close()
    parts = p.main_parts if (prefer and p.main_done or p.in_main) else p.parts
    return " ".join(" ".join(parts).split())


def html_text_parsed(html: Column | str, drop: Sequence[str] = BOILERPLATE_TAGS,
                     prefer: str | None = PREFERRED) -> Column:
    """I1/I2 with a real HTML tokenizer, vectorised over Arrow batches."""
    dropset, pref = frozenset(drop), prefer

    @F.pandas_udf(StringType())
    def _udf(s: pd.Series) -> pd.Series:
        return s.map(lambda h: _extract(h, dropset, pref))

    return _udf(_c(html))


FETCH_OUTCOME = StructType([StructField("content", StringType()),
                            StructField("error", StringType())])


def fetch_outcome(status: Column | str, content_type: Column | str, html: Column | str,
                  mode: str = "contains", drop: Sequence[str] = BOILERPLATE_TAGS,
                  prefer: str | None = PREFERRED) -> Column:
    """``struct<content, error>`` for a fetched page.

    Non-200 → HTTP error text; content type not HTML (``mode`` ``contains``
    as in the JSON scraper, ``startswith`` as in the CSV one) → error;
    otherwise the extracted text.
    """
    st, ct = _c(status), _c(content_type)
    html_ok = ct.contains("text/html") if mode == "contains" else ct.startswith("text/html")
    prefix = "Non-HTML content: " if mode == "contains" else "Invalid Content-Type: "
    err = (F.when(st != 200, F.concat(F.lit("HTTP error "), st.cast("string")))
             .when(~html_ok, F.concat(F.lit(prefix), ct)))
    content = F.when(err.isNull(), html_text_regex(html, drop, prefer))
    return F.struct(content.alias("content"), err.alias("error"))


def fetch_outcome_parsed(status: Column | str, content_type: Column | str,
                         html: Column | str, mode: str = "contains",
                         drop: Sequence[str] = BOILERPLATE_TAGS,
                         prefer: str | None = PREFERRED) -> Column:
    """L2: the same outcome from a vectorised UDF returning a struct (real
    HTML tokenizer); one Arrow batch in, one struct column out."""
    dropset, pref = frozenset(drop), prefer

    @F.pandas_udf(FETCH_OUTCOME)
    def _udf(st: pd.Series, ct: pd.Series, h: pd.Series) -> pd.DataFrame:
        content, error = [], []
        for s, c, x in zip(st, ct, h):
            c = c or ""
            ok_type = ("text/html" in c) if mode == "contains" else c.startswith("text/html")
            if s != 200:
                content.append(None)
                error.append(f"HTTP error {s}")
            elif not ok_type:
                content.append(None)
                error.append(("Non-HTML content: " if mode == "contains"
                              else "Invalid Content-Type: ") + c)
            else:
                content.append(_extract(x, dropset, pref))
                error.append(None)
        return pd.DataFrame({"content": content, "error": error})

    return _udf(_c(status), _c(content_type), _c(html))


# --- links by container (A7, L3) ----------------------------------------------------------

# Fixed values (HTML standard): elements without contents, which never stay open.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def first_links(html: str | None, selector: str) -> list[tuple[int, str]]:
    """``(container position, href)``: the first link inside each container.

    ``selector`` is ``tag``, ``.class`` or ``tag.class``; a class is one of the
    element's classes.  Containers count in the order of their start tags, nested ones
    too (an inner one's first link may also be the outer one's).  An end tag closes
    the nearest open element of its name with all that is open inside; without one it
    is ignored; what is never closed ends with the page.  A container without a link
    gives no row.
    """
    from html.parser import HTMLParser

    want_tag, _, want_class = selector.partition(".")
    stack: list[tuple[str, int | None]] = []    # open elements; a container with its position
    links: list[str | None] = []

    class _Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            attrs = dict(reversed(attrs))
            place = None
            if (not want_tag or tag == want_tag) and (not want_class or want_class in (attrs.get("class") or "").split()):
                place = len(links)
                links.append(None)
            if tag == "a" and "href" in attrs:
                for _, at in stack:
                    if at is not None and links[at] is None:
                        links[at] = attrs["href"] or ""
            if tag not in VOID_TAGS:
                stack.append((tag, place))

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in VOID_TAGS:
                stack.pop()

        def handle_endtag(self, tag):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    return

    if html:
        p = _Links(convert_charrefs=True)
        p.feed(html)
        p.close()
    return [(i, url) for i, url in enumerate(links) if url is not None]


@F.udtf(returnType="pos int, url string", useArrow=True)
class ContainerLinks:
    """Table function: a page in, the first link of each container out."""

    def eval(self, html: str, selector: str):
        yield from first_links(html, selector)


def container_links(pages: DataFrame, selector: str, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """``id_col, pos, url`` per container with a link; pages without one give no row."""
    p = pages.select(F.col(id_col), F.col(html).alias("_html"))
    return p.lateralJoin(ContainerLinks(F.col("_html").outer(), F.lit(selector))).select(id_col, "pos", "url")
