"""Exact classifier metrics: rows with equal scores are one row before anything is ranked."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import safe_divide
from ledgerlens.operators.prefix import running_sums, segmented_sums
from ledgerlens.operators.quantiles import distinct_edges, values_of


def confusion(scores: DataFrame, threshold: float, by: Sequence[str] = (), undefined: str = "zero") -> DataFrame:
    """tp, fp, tn, fn and what follows from them at ``p >= threshold``; undefined ratios are 0 or NULL."""
    hit, y = F.col("p") >= threshold, F.col("label") == 1
    out = scores.groupBy(*by).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    blank = F.lit(0.0) if undefined == "zero" else F.lit(None).cast("double")
    part = lambda a, b: F.round(F.coalesce(safe_divide(a, b), blank), 6)
    return out.withColumns(
        {
            "precision": part(tp, tp + fp),
            "recall": part(tp, tp + fn),
            "f1": part(2 * tp, 2 * tp + fp + fn),
            "accuracy": part(tp + tn, tp + fp + tn + fn),
            "fpr": part(fp, fp + tn),
            "fnr": part(fn, fn + tp),
        }
    )


def score_counts(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by, "p").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"))


def curve(scores: DataFrame) -> DataFrame:
    """One row a distinct score, from the highest: true and false positives down to it.

    Distinct scores may be as many as rows, so the running sums are distributed.
    """
    counts = score_counts(scores)
    run = running_sums(counts, [F.desc("p")], {"tp": F.col("positives"), "n_above": F.col("n")})
    return run.withColumn("fp", F.col("n_above") - F.col("tp"))


def pr_points(scores: DataFrame) -> DataFrame:
    c = curve(scores)
    total = scores.agg(F.sum("label").alias("y")).first()["y"] or 0
    return c.select("p", F.round(F.col("tp") / F.col("n_above"), 6).alias("precision"), F.round(safe_divide(F.col("tp"), F.lit(total)), 6).alias("recall"))


def roc_points(scores: DataFrame) -> DataFrame:
    c = curve(scores)
    row = scores.agg(F.sum("label").alias("y"), F.count("*").alias("n")).first()
    y, n = row["y"] or 0, row["n"]
    return c.select("p", F.round(safe_divide(F.col("fp"), F.lit(n - y)), 6).alias("fpr"), F.round(safe_divide(F.col("tp"), F.lit(y)), 6).alias("tpr"))


def ranking(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision (step-wise), ROC-AUC with ties and Brier score, for each group."""
    if by:
        run = segmented_sums(score_counts(scores, by), by, [F.desc("p")], {"tp": F.col("positives"), "n_above": F.col("n")})
    else:
        run = curve(scores)
    neg_above = F.col("n_above") - F.col("tp")
    own_neg = F.col("n") - F.col("positives")
    ap = F.sum(F.col("positives") * F.col("tp") / F.col("n_above")) / F.sum("positives")
    above = F.sum(F.col("positives") * (neg_above - own_neg / 2))
    pairs = F.sum("positives").cast("double") * F.sum(own_neg)
    brier = F.sum(F.col("positives") * (1 - F.col("p")) ** 2 + own_neg * F.col("p") ** 2) / F.sum("n")
    return run.groupBy(*by).agg(F.round(ap, 6).alias("average_precision"), F.round(1 - above / pairs, 6).alias("roc_auc"), F.round(brier, 6).alias("brier"), F.sum("n").cast("long").alias("n"))


def threshold_grid(scores: DataFrame) -> DataFrame:
    """Precision, recall and F1 at 0.01 ... 0.99: one row a hundredth, then sums from the top."""
    bucket = F.floor(F.round(F.col("p") * 100, 9)).cast("int")
    counts = scores.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("y"))
    grid = scores.sparkSession.range(1, 100).select(F.col("id").cast("int").alias("b"))
    total = W.partitionBy()
    up = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, 0)
    both = counts.join(grid, "b", "full").fillna(0, ["n", "y"])
    run = both.withColumns({"predicted": F.sum("n").over(up), "tp": F.sum("y").over(up), "all_y": F.sum("y").over(total)})
    zero = F.lit(0.0)
    return run.where("b BETWEEN 1 AND 99").select(
        (F.col("b") / 100).alias("threshold"),
        F.col("predicted").cast("long").alias("predicted"),
        F.round(F.coalesce(safe_divide(F.col("tp"), F.col("predicted")), zero), 6).alias("precision"),
        F.round(F.coalesce(safe_divide(F.col("tp"), F.col("all_y")), zero), 6).alias("recall"),
        F.round(F.coalesce(safe_divide(2 * F.col("tp"), F.col("predicted") + F.col("all_y")), zero), 6).alias("f1"),
    )


def select_threshold(grid: DataFrame) -> DataFrame:
    return grid.orderBy(F.desc("f1"), F.desc("precision"), "threshold").limit(1)


def calibration(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and rate by quantile bin of the score."""
    edges = distinct_edges(values_of(scores, ["p"], [i / bins for i in range(1, bins)]).get("p"))
    bin_ = sum(((F.col("p") > e).cast("int") for e in edges), F.lit(0))
    return scores.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 5).alias("mean_p"), F.round(F.avg("label"), 5).alias("rate"))


def compare_models(long_scores: DataFrame, threshold: float, base: str, other: str) -> DataFrame:
    """Metrics of two models on the same rows ``(model, p, label)``: values and differences."""
    m = confusion(long_scores, threshold, ["model"]).join(ranking(long_scores, ["model"]), "model")
    names = ("precision", "recall", "f1", "fpr", "average_precision", "roc_auc")
    long = m.select("model", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("r")).select("model", "r.*")
    at = lambda name: F.max(F.when(F.col("model") == name, F.col("value")))
    out = long.groupBy("metric").agg(at(base).alias("base"), at(other).alias("other"))
    d = F.col("other") - F.col("base")
    return out.withColumns({"delta": F.round(d, 5), "relative": F.round(safe_divide(d, F.col("base")), 4)})


def accept(comparison: DataFrame, regression: float = 0.02, least_recall: float = 0.8) -> DataFrame:
    """Non-inferiority: no guarded metric falls by more than ``regression`` and recall stays high enough."""
    worst = F.min(F.when(F.col("metric").isin("precision", "recall", "f1", "average_precision"), F.col("delta")))
    recall = F.max(F.when(F.col("metric") == "recall", F.col("other")))
    out = comparison.agg(worst.alias("worst_delta"), recall.alias("recall"))
    ok = (F.col("worst_delta") >= -regression) & (F.col("recall") >= least_recall)
    return out.withColumn("decision", F.when(ok, "accept").otherwise("reject"))


#: Why a ratio isn't defined.
NO_PREDICTED, NO_ACTUAL, NEITHER = "no positive predictions", "no positive labels", "precision or recall is undefined"


def undefined_reasons(confusion_rows: DataFrame) -> DataFrame:
    """``confusion(..., undefined="null")`` with ``reasons``: for each metric that is NULL, why; F1 is 0 where
    precision and recall are both there and 0, and NULL where either isn't."""
    predicted, actual = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    why = F.array_compact(F.array(F.when(predicted == 0, f"precision: {NO_PREDICTED}"), F.when(actual == 0, f"recall: {NO_ACTUAL}"), F.when((predicted == 0) | (actual == 0), f"f1: {NEITHER}")))
    f1 = F.when((predicted > 0) & (actual > 0), F.coalesce("f1", F.lit(0.0)))
    return confusion_rows.withColumns({"f1": f1, "reasons": F.array_join(why, "; ")})


def split_report(scores: DataFrame, threshold: float, parts: Sequence[str] = ("train", "validation", "test"), split: str = "split") -> DataFrame:
    """``metric``, its value in each part, and how far each part falls below the one before it (``gap_*``)."""
    m = confusion(scores, threshold, [split]).join(ranking(scores, [split]), split)
    names = ("precision", "recall", "f1", "average_precision", "roc_auc")
    long = m.select(split, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("r")).select(split, "r.*")
    out = long.groupBy("metric").agg(*[F.max(F.when(F.col(split) == p, F.col("value"))).alias(p) for p in parts])
    return out.withColumns({f"gap_{a}_{b}": F.round(F.col(a) - F.col(b), 6) for a, b in zip(parts, parts[1:], strict=False)})
