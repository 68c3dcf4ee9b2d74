"""Classification metrics from (label, prediction, score) columns.

The confusion matrix is one ``agg`` of four conditional counts; precision,
recall, F1 and the class report are derived from that single row with
division-by-zero giving 0.  ROC AUC is the exact tie-aware rank form computed
from per-score class counts and an ordered prefix sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import constants as K
from tarmac.operators.cumulative import exclusive_prefix
from tarmac.operators.joins import materialize


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _count(condition, weight: str | None):
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0)).cast("long")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              weight: str | None = None) -> DataFrame:
    """tn, fp, fn, tp (and n) in one pass; ``weight`` counts rows that stand for several."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(
        _count((y == 0) & (p == 0), weight).alias("tn"),
        _count((y == 0) & (p == 1), weight).alias("fp"),
        _count((y == 1) & (p == 0), weight).alias("fn"),
        _count((y == 1) & (p == 1), weight).alias("tp"),
    ).withColumn("n", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))


def class_metrics(conf: DataFrame, digits: int | None = None) -> DataFrame:
    """accuracy, precision, recall, F1 of the positive class; 0 on zero division."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    prec = _div(tp, tp + fp)
    rec = _div(tp, tp + fn)
    out = conf.select(
        _div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )
    if digits is not None:
        out = out.select(*[F.round(c, digits).alias(c) for c in out.columns])
    return out


def class_report(conf: DataFrame, names=K.CLASS_NAMES) -> DataFrame:
    """precision/recall/F1/support per class, accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    # class 0 ("negative" as positive): precision tn/(tn+fn), recall tn/(tn+fp)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    f0, f1 = _div(2 * tn, 2 * tn + fn + fp), _div(2 * tp, 2 * tp + fp + fn)
    s0, s1 = tn + fp, tp + fn
    acc = _div(tp + tn, n)
    w0, w1 = _div(s0, n), _div(s1, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), s.cast("long").alias("support"))

    rows = F.array(
        row(names[0], p0, r0, f0, s0),
        row(names[1], p1, r1, f1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", p0 * w0 + p1 * w1, r0 * w0 + r1 * w1, f0 * w0 + f1 * w1, n),
    )
    return conf.select(F.explode(rows).alias("r")).select("r.*")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """F16: exact ROC AUC with ties counted half (Mann-Whitney form).

    AUC = sum over distinct scores s of pos(s) * (neg(< s) + neg(s)/2) / (P * N).
    Per-score counts come from a grouped aggregate; neg(< s) is an exact
    ordered prefix sum (see ``cumulative``).  Null if a class is absent.
    """
    per_score = (df.filter(F.col(score).isNotNull())
                   .groupBy(F.col(score).cast("double").alias("s"))
                   .agg(_count(F.col(label) == 1, weight).alias("pos"),
                        _count(F.col(label) == 0, weight).alias("neg")))
    # Kept: the cuts and the sums below read it, not the input.
    per_score, _n = materialize(per_score)
    ranked = exclusive_prefix(per_score, "s", ["neg"], buckets=buckets)
    return ranked.agg(
        F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2.0)).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
    ).select(F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")).alias("roc_auc"),
             F.col("_p").alias("positives"), F.col("_n").alias("negatives"))
