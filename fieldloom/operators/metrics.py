"""Scores of classifiers and regressions, as sorted windows over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import both_finite, finite, ratio
from .windows import running_sums


def pr_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One row for each distinct score as the threshold: ``threshold, positives, tp, n, precision, recall, f1``.

    ``positives`` are those at this very score. Rows without a finite score or
    without a truth are left out. Rows are first counted per score; sums over
    scores run in pieces of their range.
    """
    by = df.filter(finite(F.col(score)) & F.col(truth).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold"))
    by = by.agg(F.sum(F.col(truth).cast("long")).alias("positives"), F.count("*").alias("c"))
    whole = by.agg(F.sum("positives").alias("all"))
    run = running_sums(by, "threshold", ["positives", "c"], descending=True).withColumnsRenamed({"run_positives": "tp", "run_c": "n"}).crossJoin(F.broadcast(whole))
    p, r = F.col("tp") / F.col("n"), ratio(F.col("tp"), F.col("all"), 0.0)
    return run.select("threshold", "positives", "tp", "n", p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-12))).alias("f1"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Each score's share of the positives is its step of recall. 0 without a positive."""
    return curve.agg(ratio(F.sum(F.col("positives") * F.col("precision")), F.sum("positives"), 0.0).alias("average_precision"))


def best_f1(curve: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return curve.agg(best.alias("b")).select("b.threshold", "b.f1")


def roc_auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Rank-sum form with mean ranks for ties; null if a class is missing."""
    by = df.filter(finite(F.col(score)) & F.col(truth).isNotNull()).groupBy(F.col(score).cast("double").alias("s"))
    by = by.agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count("*").alias("c"))
    t = running_sums(by, "s", ["c"], before=True).withColumn("rank", F.col("run_c") + (F.col("c") + 1) / 2).agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("pos"), F.sum("c").alias("n"))
    return t.select(F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos"))).alias("roc_auc"))


def event_metrics(df: DataFrame, event: str, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Per event and threshold: areas, overlap, union, found, recall, precision, IoU, scores inside and outside.

    Events without a positive go; precision is 0 where nothing is predicted.
    """
    grid = df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")))
    y, p = F.col(truth) == 1, F.col(score) >= F.col("threshold")
    g = grid.groupBy(event, "threshold").agg(
        F.count_if(y).alias("true_area"), F.count_if(p).alias("predicted_area"), F.count_if(y & p).alias("overlap"), F.count_if(y | p).alias("union"),
        F.avg(F.when(y, F.col(score))).alias("mean_in"), F.avg(F.when(~y, F.col(score))).alias("mean_out"), F.max(F.when(y, F.col(score))).alias("max_in"), F.max(F.when(~y, F.col(score))).alias("max_out"),
    ).filter("true_area > 0")
    o = F.col("overlap")
    return g.select("*", (o > 0).cast("int").alias("found"), ratio(o, F.col("true_area")).alias("recall"), ratio(o, F.col("predicted_area"), 0.0).alias("precision"), ratio(o, F.col("union"), 0.0).alias("iou"), ratio(F.col("predicted_area"), F.col("true_area")).alias("area_ratio"))


def metrics_by_threshold(metrics: DataFrame) -> DataFrame:
    """Means over the events of found, recall, precision, IoU and area ratio at each threshold."""
    return metrics.groupBy("threshold").agg(*[F.avg(c).alias("mean_" + c) for c in ("found", "recall", "precision", "iou", "area_ratio")], F.count("*").alias("events"))


def with_metadata(metrics: DataFrame, metadata: DataFrame, event: str) -> DataFrame:
    """Every event's metrics with what is known of it; an event without metadata stays."""
    return metrics.join(metadata, event, "left")


def mask_stats(df: DataFrame, mask: str, label: str) -> DataFrame:
    """Positive cells, all labelled ones and the share of positives in each mask."""
    y = F.col(label) > 0
    return df.groupBy(mask).agg(F.count_if(y).alias("positives"), F.count(label).alias("cells"), F.avg(y.cast("double")).alias("share"))


def threshold_scores(score: Column, truth: Column, threshold: float) -> dict[str, Column]:
    p, y = score >= threshold, truth == 1
    tp, precision, recall = F.count_if(p & y), ratio(F.count_if(p & y), F.count_if(p), 0.0), ratio(F.count_if(p & y), F.count_if(y), 0.0)
    return {"precision": precision, "recall": recall, "f1": ratio(2 * tp, F.count_if(p) + F.count_if(y), 0.0)}


def residual_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Over the rows in which both are finite."""
    y, f = both_finite(F.col(truth), F.col(predicted))
    return df.agg((1 - F.try_divide(F.sum((y - f) * (y - f)), F.var_pop(y) * F.count(y))).alias("r2"), F.sqrt(F.avg((y - f) * (y - f))).alias("rmse"), F.try_divide(F.covar_pop(y, f), F.stddev_pop(y) * F.stddev_pop(f)).alias("corr"))
