"""Document vectors and projections.

* ``encode_batches`` – the encoder hook: ``mapInPandas`` over Arrow batches,
  one encoder per Python worker; the built-in encoder hashes tokens into a
  fixed-width, L2-normalised vector (numpy), and any callable
  ``list[str] -> np.ndarray`` can replace it (e.g. a sentence encoder).
* ``tfidf_vectors`` – Spark ML ``HashingTF`` + ``IDF`` + ``Normalizer``
  (the IDF fit is one distributed aggregation).
* ``pca_project`` – Spark ML ``PCA``: the covariance is a tree aggregation
  of a d×d matrix (d = vector width), never of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 64


def hashing_encoder(dims: int = DIMS) -> Callable[[list[str]], np.ndarray]:
    """Token hashing (xxhash64 of lower-case word tokens, signed), L2-normed."""
    import re

    import xxhash

    pat = re.compile(r"[^\W\d_]{2,}|\d{2,}", re.UNICODE)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype=np.float32)
        for i, t in enumerate(texts):
            for tok in pat.findall((t or "").lower()):
                h = xxhash.xxh64_intdigest(tok)
                out[i, h % dims] += 1.0 if (h >> 63) == 0 else -1.0
            n = np.linalg.norm(out[i])
            if n > 0:
                out[i] /= n
        return out
    return encode


def encode_batches(df: DataFrame, text: str = "text", id_col: str = "doc_id",
                   encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder
                   ) -> DataFrame:
    """``id, embedding array<float>`` via the encoder hook."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder_factory()
        for b in batches:
            vecs = enc(b[text].tolist())
            yield pd.DataFrame({id_col: b[id_col], "embedding": list(vecs)})

    id_type = dict(df.dtypes)[id_col]
    return df.select(id_col, text).mapInPandas(run, f"{id_col} {id_type}, embedding array<float>")


def tfidf_vectors(df: DataFrame, text: str = "text", dims: int = 1 << 12,
                  out: str = "features") -> DataFrame:
    """J1 (Spark ML): hashed term frequencies weighted by IDF, unit length."""
    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[\p{L}\p{N}_]{2,}",
                         gaps=False, toLowercase=True)
    toks = tok.transform(df)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims).transform(toks)
    idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(tf).transform(tf)
    return Normalizer(inputCol="_tfidf", outputCol=out, p=2.0).transform(idf).drop(
        "_tok", "_tf", "_tfidf")


def pca_project(df: DataFrame, vec: str = "embedding", k: int = 5, out: str = "coords",
                normalise: bool = True) -> DataFrame:
    """Unit vectors (cosine geometry) projected on k principal
    components; returns ``array<double>`` coordinates."""
    v = df.withColumn("_v", array_to_vector(F.col(vec)))
    if normalise:
        v = Normalizer(inputCol="_v", outputCol="_vn", p=2.0).transform(v).drop("_v") \
            .withColumnRenamed("_vn", "_v")
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).withColumn(out, vector_to_array("_p")).drop("_v", "_p")
