"""DuckDB spellings of the term expressions in ``operators.terms``."""

from __future__ import annotations

from ..functions.stopwords import spark_stop_words


def tok(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def stop_list() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in spark_stop_words())


def no_stop(t: str) -> str:
    return f"list_filter({t}, lambda x: x NOT IN ({stop_list()}))"


def with_bigrams(t: str) -> str:
    """``t`` must be a column name (it is repeated)."""
    return (f"list_concat({t}, list_transform(range(1, len({t})), "
            f"lambda i: {t}[i] || ' ' || {t}[i + 1]))")


def terms_cte(src: str, id_cols: str, text: str = "text") -> str:
    """``(id_cols..., term)`` occurrences: tokens → stop words → + bigrams."""
    return f"""
SELECT {id_cols}, unnest({with_bigrams('c')}) AS term
FROM (SELECT {id_cols}, {no_stop(tok(text))} AS c FROM {src}) s"""
