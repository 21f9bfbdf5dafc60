"""Registered queries: evaluation of a predictions table."""

from __future__ import annotations

from ..operators import evaluate as V
from .fixtures import view, with_views
from .registry import query
from .rounding import fround, sround as R

CELLS = """CAST(count_if(label = 0 AND prediction = 0) AS BIGINT) AS tn,
       CAST(count_if(label = 0 AND prediction = 1) AS BIGINT) AS fp,
       CAST(count_if(label = 1 AND prediction = 0) AS BIGINT) AS fn,
       CAST(count_if(label = 1 AND prediction = 1) AS BIGINT) AS tp, count(*) AS n"""

AUC_SQL = f"""(SELECT {R("sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg))", 8)} FROM (
   SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    - neg AS neg_below
   FROM (SELECT score, CAST(count_if(label = 1) AS DOUBLE) AS pos,
                CAST(count_if(label = 0) AS DOUBLE) AS neg
         FROM scored WHERE score IS NOT NULL GROUP BY score) s) c)"""


@query("d10_confusion_matrix", with_views(f"SELECT {CELLS} FROM scored", "scored"))
def d10_confusion(spark, sf):
    return V.confusion(view(spark, sf, "scored"))


@query("d10_confusion_long", with_views("""
SELECT c.label, c.prediction, CAST(coalesce(n.count, 0) AS BIGINT) AS count
FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(label, prediction)) c
LEFT JOIN (SELECT CAST(label AS INTEGER) AS label, CAST(prediction AS INTEGER) AS prediction,
                  count(*) AS count FROM scored GROUP BY 1, 2) n
  ON n.label = c.label AND n.prediction = c.prediction""", "scored"))
def d10_long(spark, sf):
    return V.confusion_long(view(spark, sf, "scored"))


@query("d11_accuracy", with_views(f"""
SELECT {R("avg(CAST(label = prediction AS DOUBLE))", 8)} AS accuracy FROM scored""", "scored"))
def d11_accuracy(spark, sf):
    return V.metrics(view(spark, sf, "scored")).select(fround("accuracy", 8).alias("accuracy"))


@query("d12_precision_recall_f1_auc", with_views(f"""
SELECT {R("tp / nullif(tp + fp, 0)", 8)} AS precision, {R("tp / nullif(tp + fn, 0)", 8)} AS recall,
       {R("2 * tp / nullif(2 * tp + fp + fn, 0)", 8)} AS f1, {AUC_SQL} AS auc
FROM (SELECT {CELLS} FROM scored) m""", "scored"))
def d12_prf_auc(spark, sf):
    e = V.evaluate(view(spark, sf, "scored"))
    return e.select(fround("precision", 8).alias("precision"), fround("recall", 8).alias("recall"),
                    fround("f1", 8).alias("f1"), fround("auc", 8).alias("auc"))


@query("m13_evaluate_predictions", with_views(f"""
SELECT tn, fp, fn, tp, n, {R("(tn + tp) / nullif(n, 0)", 8)} AS accuracy,
       {R("tp / nullif(tp + fp, 0)", 8)} AS precision, {R("tp / nullif(tp + fn, 0)", 8)} AS recall,
       {R("2 * tp / nullif(2 * tp + fp + fn, 0)", 8)} AS f1, {AUC_SQL} AS auc
FROM (SELECT {CELLS} FROM scored) m""", "scored"))
def m13_evaluate(spark, sf):
    e = V.evaluate(view(spark, sf, "scored"))
    return e.select("tn", "fp", "fn", "tp", "n",
                    *[fround(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")])
