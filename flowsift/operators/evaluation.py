"""Confusion counts and the metric family, per group or in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.columns import safe_div


def confusion(rows: DataFrame, by: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))


def metrics() -> dict[str, Column]:
    """Metric columns over tp, fp, tn and fn, all in doubles."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    p, n = tp + fn, tn + fp
    recall, tnr, acc = safe_div(tp, p), safe_div(tn, n), safe_div(tp + tn, p + n)
    chance = safe_div((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), (p + n) * (p + n))
    return {
        "positives": p, "negatives": n, "support": p + n, "recall": recall, "tnr": tnr, "precision": safe_div(tp, tp + fp), "npv": safe_div(tn, tn + fn),
        "fpr": safe_div(fp, n), "fdr": safe_div(fp, fp + tp), "for": safe_div(fn, fn + tn), "fnr": safe_div(fn, fn + tp), "accuracy": acc,
        "balanced_accuracy": (recall + tnr) / 2, "f1_score": safe_div(2 * tp, 2 * tp + fp + fn), "kappa": 1 - safe_div(1 - acc, 1 - chance),
        "mcc": safe_div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.withColumns(metrics())


def total_confusion(counts: DataFrame, by: list[str]) -> DataFrame:
    """Micro totals over what is not in by."""
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
