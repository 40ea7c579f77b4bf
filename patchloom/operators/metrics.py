"""Multilabel evaluation on long predictions ``(sid, k, y, score)``.

All threshold curves start from one row per (label, score) with the counts of
positives and negatives, so ties and copies collapse before any shuffle, and the
cumulative counts run per score range (see ``ordering``), never per label.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.functions.scalar import focal_loss_element, round_half_even
from patchloom.operators.lookup import attach
from patchloom.operators.ordering import BUCKET, offsets, range_buckets, running_sums
from patchloom.session import local_table, written


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def thresholds_table(spark, thresholds: Mapping[int, float]) -> DataFrame:
    """Thresholds per label as a table ``(k, threshold)``."""
    rows = [(int(k), float(t)) for k, t in thresholds.items()]
    return local_table(spark, rows, "k int, threshold double")


def with_threshold(pred: DataFrame, thresholds: float | DataFrame) -> DataFrame:
    """Add the ``threshold`` of each row's label."""
    if isinstance(thresholds, DataFrame):
        spread = [c for c in ("sid", "score") if c in pred.columns]
        return attach(pred, thresholds.select("k", "threshold"), ["k"], spread)
    return pred.withColumn("threshold", F.lit(float(thresholds)))


def binarise(pred: DataFrame, thresholds: float | DataFrame = 0.5) -> DataFrame:
    """``yhat = 1`` where the score reaches the threshold of its label."""
    out = with_threshold(pred, thresholds)
    return out.withColumn("yhat", (F.col("score") >= F.col("threshold")).cast("int"))


def focal_loss(
    df: DataFrame,
    alpha: float | Sequence[float] = 1.0,
    gamma: float = 2.0,
    reduction: str = "mean",
    logit: str = "logit",
    target: str = "y",
    label: str = "k",
) -> DataFrame:
    """Focal loss over the table: one ``loss`` row for mean and sum, else per row."""
    per_row = focal_loss_element(
        F.col(logit), F.col(target), alpha, gamma, F.col(label) if label in df.columns else None
    )
    if reduction == "none":
        return df.withColumn("loss", per_row)
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {reduction}")
    return df.agg((F.avg if reduction == "mean" else F.sum)(per_row).alias("loss"))


def epoch_metrics(df: DataFrame, loss: str = "loss", batch: str = "batch") -> DataFrame:
    """Mean of batch mean losses, and element accuracy in percent at 0.5."""
    right = ((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("long")
    per_batch = df.groupBy(batch).agg(
        F.avg(loss).alias("__l"), F.sum(right).alias("__c"), F.count(F.lit(1)).alias("__n")
    )
    return per_batch.agg(
        F.avg("__l").alias("loss"),
        (F.sum("__c") / F.sum("__n") * 100).alias("accuracy"),
        F.count(F.lit(1)).alias("batches"),
    )


def confusion(pred: DataFrame, thresholds: float | DataFrame = 0.5) -> DataFrame:
    """Counts per label: samples, targets, predictions and both."""
    hat = F.col("score") >= F.col("threshold")
    y = F.col("y") > 0
    return (
        with_threshold(pred, thresholds)
        .groupBy("k", "threshold")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(y).alias("targets"),
            F.count_if(hat).alias("predictions"),
            F.count_if(y & hat).alias("tp"),
        )
    )


def _label_scores(counts: DataFrame) -> DataFrame:
    tp, t, p, n = (F.col(c) for c in ("tp", "targets", "predictions", "n"))
    return counts.withColumns(
        {
            "accuracy": _ratio(n - (t - tp) - (p - tp), n),
            "precision": _zero(_ratio(tp, p)),
            "recall": _zero(_ratio(tp, t)),
            "f1": _zero(_ratio(2 * tp, t + p)),
        }
    )


def label_metrics(pred: DataFrame, thresholds: float | DataFrame = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 per label (0 where undefined)."""
    return _label_scores(confusion(pred, thresholds)).drop("n")


def by_score(pred: DataFrame) -> DataFrame:
    """``pos`` and ``neg`` per (label, score), the only reading of the predictions that curves need.

    The table is written, as splitters, offsets, running sums and totals all start from it.
    """
    pos, neg = F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)
    return written(pred.groupBy("k", "score").agg(pos.alias("pos"), neg.alias("neg")))


def cumulative(counts: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    """``by_score`` rows with ``tp`` and ``fp``, the positives and negatives at or above the score."""
    cut = range_buckets(counts, ["k"], ["score"], rows_per_bucket)
    sums = {"tp": F.sum("pos"), "fp": F.sum("neg")}
    before = None if cut.single else offsets(cut.df, ["k"], sums, descending=True)
    return running_sums(cut.df, ["k"], "score", {"tp": "pos", "fp": "neg"}, before, descending=True)


def _auroc(tp: Column, pos: Column, neg: Column, p: Column, n: Column) -> Column:
    # each negative is beaten by the positives above it, and by half of its ties
    wins = F.sum((tp - pos / 2) * neg)
    return F.try_divide(wins, p.cast("double") * n)


def auroc(pred: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    """Area under the ROC curve per label, ties counting half; one class: NULL."""
    return cumulative(by_score(pred), rows_per_bucket).groupBy("k").agg(
        _auroc(F.col("tp"), F.col("pos"), F.col("neg"), F.sum("pos"), F.sum("neg")).alias("auroc")
    )


def _average_precision() -> Column:
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos").cast("double"))


def average_precision(pred: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    """Sum of precision times the step in recall, without interpolation."""
    return cumulative(by_score(pred), rows_per_bucket).groupBy("k").agg(_average_precision().alias("ap"))


def _label_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("k").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))


def pr_curve(pred: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    """A point per distinct score, and the end point ``(recall 0, precision 1)``."""
    counts = by_score(pred)
    run = cumulative(counts, rows_per_bucket)
    totals = _label_totals(counts)
    points = attach(run, totals, ["k"], ["score"]).select(
        "k",
        F.col("score").alias("threshold"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        # without positives recall is 1 everywhere, as for an empty curve
        F.coalesce(_ratio(F.col("tp"), F.col("__p")), F.lit(1.0)).alias("recall"),
    )
    end = totals.select(
        "k",
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def roc_curve(pred: DataFrame, drop: bool = True, rows_per_bucket: int | None = None) -> DataFrame:
    """ROC points per label from ``(0, 0)``; collinear middle points are dropped.

    A middle point goes when the step that follows it repeats its own step.  The
    following step comes from a window inside the range bucket, and for the last
    score of a bucket from a small table of each bucket's first step.
    """
    counts = by_score(pred)
    run = cumulative(counts, rows_per_bucket)
    totals = _label_totals(counts)
    points = attach(run, totals, ["k"], ["score"])
    if drop:
        inside = Window.partitionBy("k", BUCKET).orderBy(F.col("score").desc())
        across = Window.partitionBy("k").orderBy(F.col(BUCKET).desc())
        heads = run.groupBy("k", BUCKET).agg(
            F.max_by("pos", "score").alias("pos"), F.max_by("neg", "score").alias("neg")
        )
        heads = heads.select(
            "k", BUCKET, *[F.lead(c).over(across).alias(f"__far_{c}") for c in ("pos", "neg")]
        )
        points = points.withColumns({f"__next_{c}": F.lead(c).over(inside) for c in ("pos", "neg")})
        points = attach(points, heads, ["k", BUCKET], ["score"])
        next_pos = F.coalesce("__next_pos", "__far_pos")
        next_neg = F.coalesce("__next_neg", "__far_neg")
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bends = (next_pos != F.col("pos")) | (next_neg != F.col("neg"))
        points = points.where(first | next_pos.isNull() | bends)
    curve = points.select(
        "k",
        F.col("score").alias("threshold"),
        _ratio(F.col("fp"), F.col("__n")).alias("fpr"),
        _ratio(F.col("tp"), F.col("__p")).alias("tpr"),
    )
    start = totals.select(
        "k",
        F.lit(float("inf")).alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return curve.unionByName(start)


def tune_thresholds(
    pred: DataFrame, nan_first: bool = False, rows_per_bucket: int | None = None
) -> DataFrame:
    """Threshold with the largest F1 per label; the lowest wins ties.

    With ``nan_first`` a score without a true positive at or above it (F1 is 0/0
    there) beats every number, and the lowest such score is taken.
    """
    counts = by_score(pred)
    run, totals = cumulative(counts, rows_per_bucket), _label_totals(counts)
    p = F.col("__p")
    undefined = F.lit(float("nan")) if nan_first else F.lit(0.0)
    f1 = F.when(F.col("tp") == 0, undefined).otherwise(_ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + p))
    scored = attach(run, totals, ["k"], ["score"]).select("k", "score", f1.alias("f1"))
    # the best value first, then its lowest score: numbers alone, so both stay hash aggregates
    best = scored.groupBy("k").agg(F.max("f1").alias("__best"))
    ties = attach(scored, best, ["k"], ["score"], how="inner").where(F.col("f1") == F.col("__best"))
    return ties.groupBy("k").agg(F.min("score").alias("threshold"), F.max("f1").alias("f1"))


def _label_table(
    pred: DataFrame, thresholds: float | DataFrame, rows_per_bucket: int | None
) -> DataFrame:
    """All label scores, AP and AUROC from one pass over the cumulative counts."""
    run = with_threshold(cumulative(by_score(pred), rows_per_bucket), thresholds)
    hit = F.col("score") >= F.col("threshold")
    counts = run.groupBy("k", "threshold").agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("targets"),
        F.sum(F.when(hit, F.col("pos") + F.col("neg")).otherwise(0)).alias("predictions"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        _average_precision().alias("ap"),
        _auroc(F.col("tp"), F.col("pos"), F.col("neg"), F.sum("pos"), F.sum("neg")).alias("auroc"),
    )
    return _label_scores(counts)


def label_report(
    pred: DataFrame,
    names: Mapping[int, str],
    thresholds: float | DataFrame = 0.5,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """The per-label report; ``Class`` is the name with its rounded threshold."""
    table = _label_table(pred, thresholds, rows_per_bucket)
    pairs = [F.lit(x) for item in names.items() for x in item]
    name = F.element_at(F.create_map(*pairs), F.col("k").cast("int"))
    shown = round_half_even("threshold", 2).cast("string")
    return table.select(
        F.concat(name, F.lit(" ("), shown, F.lit(")")).alias("Class"),
        F.col("targets").alias("Targets"),
        F.col("predictions").alias("Predictions"),
        F.col("accuracy").alias("Accuracy"),
        F.col("precision").alias("Precision"),
        F.col("recall").alias("Recall"),
        F.col("f1").alias("F1"),
        F.col("ap").alias("AP"),
        F.col("auroc").alias("AUROC"),
    )


def global_metrics(
    pred: DataFrame,
    thresholds: float | DataFrame = 0.5,
    compat_map: bool = False,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Macro and target-weighted scores, Hamming loss, subset and overall accuracy.

    ``compat_map`` takes the average precision on binarised scores, as the
    published tables do.
    """
    labels = _label_table(pred, thresholds, rows_per_bucket)
    if compat_map:
        prevalence = _ratio(F.col("targets"), F.col("n"))
        p, r = F.col("precision"), F.col("recall")
        labels = labels.withColumn("ap", p * r + (1 - r) * prevalence)
    right = F.col("yhat") == F.col("y").cast("int")
    per_sample = (
        binarise(pred, thresholds).groupBy("sid").agg(F.bool_and(right).cast("double").alias("subset"))
    )
    subset = per_sample.agg(F.avg("subset").alias("subset"))
    weight = F.col("targets").cast("double")

    def weighted(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * weight), F.sum(weight))

    overall = F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")
    # the label rows and the one sample row meet in a single aggregate
    return labels.unionByName(subset, allowMissingColumns=True).agg(
        overall.alias("overall_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
        F.avg("ap").alias("macro_map"),
        weighted("ap").alias("weighted_map"),
        (1 - overall).alias("hamming_loss"),
        F.max("subset").alias("subset_accuracy"),
    )


def compare_domains(a: DataFrame, b: DataFrame, on: str = "k", value: str = "auroc") -> DataFrame:
    """Difference of a metric between two test sets per class, three decimals."""
    left = a.select(on, F.col(value).alias("in_domain"))
    right = b.select(on, F.col(value).alias("cross_domain"))
    return left.join(right, on).withColumn(
        "difference", round_half_even(F.col("in_domain") - F.col("cross_domain"), 3)
    )
