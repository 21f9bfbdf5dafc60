"""Language identification by Bayesian evidence fusion.

Three kinds of evidence on a web page are combined in one posterior per language:

* text: naive Bayes over hashed byte 3-grams of the visible text (counts by
  language summed by Spark over all labelled documents), tempered so that long
  pages do not drown the rest;
* the declared markup language (``<html lang=..>``), through how often pages
  whose text is language l declare d (grouped aggregation, smoothed);
* the host prior, smoothed hierarchically: host -> address suffix -> all pages,
  each level's counts by first-pass text language smoothed towards the next.  A
  page's own count is taken out of its host's and suffix's.

Null or empty html has no text evidence and no declaration, a null url has no
host: priors decide.  Repeated rows are pages of their own; without any labelled
document the result has null languages.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .tables import broadcast_if_small, materialise

U = np.uint64
DIMS = 1 << 15
TEMPER = 64.0  # a text counts as at most so many independent 3-grams
KAPPA = 5.0
HIDDEN = re.compile(rb"(?is)<(script|style|nav|footer|header)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")


def gram_places(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 3-grams of all texts and how many each text has."""
    size = np.diff(off)
    n = max(0, len(buf) - 2)
    v = buf.astype(np.uint64)
    key = (v[:n] << U(16)) | (v[1: n + 1] << U(8)) | v[2: n + 2]
    place = (H.mix(key) >> U(49)).astype(np.int64)
    inside = np.ones(n, bool)
    for j in (1, 2):
        cut = off[1:-1] - j
        inside[cut[(cut >= 0) & (cut < n)]] = False
    owner = np.repeat(np.arange(len(size)), size)[:n]
    return place[inside], np.bincount(owner[inside], minlength=len(size))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), dtype=object)
        for name in sorted(set(lang)):
            buf, off = H.text_bytes(pc.take(batch.column(1), pa.array(np.flatnonzero(lang == name))))
            total = held.setdefault(name, np.zeros(DIMS, np.int64))
            for i, j in H.chunks(off):
                total += np.bincount(gram_places(buf[off[i]: off[j]], off[i: j + 1] - off[i])[0], minlength=DIMS)
    for name, total in held.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(total[used])],
                                         names=["lang", "place", "c"])


def text_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their log-likelihood per hashed 3-gram; DIMS numbers
    a language, so its size is bounded by the number of languages."""
    counts = (docs.where(F.col(lang_col).isNotNull())
                  .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
                  .mapInArrow(_count, "lang string, place long, c long")
                  .groupBy("lang", "place").agg(F.sum("c").alias("c")).toArrow())
    lang = np.array(counts.column("lang").to_pylist(), dtype=object)
    names = sorted(set(lang))
    table = np.full((len(names), DIMS), 0.5)
    for i, name in enumerate(names):
        pick = lang == name
        table[i, counts.column("place").to_numpy()[pick]] += counts.column("c").to_numpy()[pick]
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _evidence(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [HIDDEN.sub(b" ", x.encode() if x else b"") for x in batch.column(1).to_pylist()]
            texts = pa.array([b" ".join(x.split()) for x in pages], pa.binary())
            buf, off = H.text_bytes(texts)
            out, grams = [], []
            for i, j in H.chunks(off):
                place, per = gram_places(buf[off[i]: off[j]], off[i: j + 1] - off[i])
                edge = np.r_[0, np.cumsum(per)]
                sums = np.stack([np.r_[0.0, np.cumsum(row[place], dtype=np.float64)] for row in model])
                got = (sums[:, edge[1:]] - sums[:, edge[:-1]]).T
                out.append(got * (np.minimum(per, TEMPER) / np.maximum(per, 1))[:, None])
                grams.append(per)
            ll = np.round(np.concatenate(out), 6) if out else np.zeros((0, len(model)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1, dtype=np.int32) * len(model)), pa.array(ll.ravel()))
            per = np.concatenate(grams) if grams else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(per), flat],
                                             names=["page", "host", "declared", "grams", "ll"])
    return run


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """``page, host, suffix, declared, text_lang, lang, probability`` per page."""
    names, model = text_model(docs)
    url = F.lower(F.col(url_col))
    host = F.nullif(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract(F.col(html_col), r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(html_col).alias("html"),
                        host.alias("host"), declared.alias("declared"))
    if not names:
        return rows.select("page", "host", F.substring_index("host", ".", -1).alias("suffix"), "declared",
                           F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"),
                           F.lit(None).cast("double").alias("probability"))
    seen = rows.mapInArrow(_evidence(model), "page long, host string, declared string, grams long, ll array<double>")
    codes = F.array(*[F.lit(x) for x in names])
    best = F.array_position("ll", F.array_max("ll")).cast("int")
    seen = materialise(seen.withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "text_lang": F.when(F.col("grams") > 0, F.element_at(codes, best))}), "op7-evidence")
    told = seen.where("text_lang is not null")

    def by(keys: list[str], name: str) -> DataFrame:
        """Counts per key of each language, as an array in the order of names."""
        return told.where(F.col(keys[0]).isNotNull() if keys else F.lit(True)).groupBy(*keys).agg(
            F.array(*[F.sum((F.col("text_lang") == x).cast("double")) for x in names]).alias(name))
    all_counts = [float(x or 0) for x in (by([], "n").first()["n"] or [])] or [0.0] * len(names)
    prior = [(c + 1) / (sum(all_counts) + len(names)) for c in all_counts]
    hosts = materialise(by(["host"], "host_n"), "op7-hosts")
    suffixes = materialise(by(["suffix"], "suffix_n"), "op7-suffixes")
    claims = materialise(by(["declared"], "declared_n"), "op7-declared")
    width = 64 + 8 * len(names)
    out = (seen.join(broadcast_if_small(suffixes, width), "suffix", "left")
               .join(broadcast_if_small(claims, width), "declared", "left")
               .join(broadcast_if_small(hosts, width), "host", "left"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    zero = F.array(*[F.lit(0.0)] * len(names))
    own = F.array(*[F.coalesce((F.col("text_lang") == x).cast("double"), F.lit(0.0)) for x in names])

    def without_own(c: str):
        return F.when(F.col(c).isNull(), zero).otherwise(F.zip_with(c, own, lambda a, b: F.greatest(a - b, F.lit(0.0))))

    def smooth(counts, above):
        return F.zip_with(counts, above, lambda c, p: (c + KAPPA * p) / (total(counts) + KAPPA))
    out = out.withColumns({"hn": without_own("host_n"), "sn": without_own("suffix_n"), "dn": without_own("declared_n")})
    out = out.withColumn("sp", smooth(F.col("sn"), F.array(*[F.lit(p) for p in prior])))
    out = out.withColumn("hp", smooth(F.col("hn"), F.col("sp")))
    # P(declares d | text language l), smoothed to 1 / (number of languages + 1)
    claim = F.zip_with("dn", F.array(*[F.lit(c) for c in all_counts]),
                       lambda c, n: F.log((c + 1) / (n + len(names) + 1)))
    claim = F.when(F.col("declared").isNull(), zero).otherwise(claim)
    out = out.withColumn("claim", claim)
    out = out.withColumn("post", F.expr("""transform(ll, (x, i) -> x + claim[i] + ln(hp[i]))"""))
    out = out.withColumn("top", F.array_max("post"))
    weight = F.aggregate(F.transform("post", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda s, x: s + x)
    return out.select("page", "host", "suffix", "declared", "text_lang",
                      F.element_at(codes, F.array_position("post", F.col("top")).cast("int")).alias("lang"),
                      F.round(1 / weight, 6).alias("probability"))
