"""Evaluation queries over the derived predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patchloom.functions.scalar import focal_loss_element, sigmoid
from patchloom.operators import metrics as M
from patchloom.operators.ordering import (
    assign_batches,
    head_n,
    range_buckets,
    running_extreme_before,
    top_by,
)
from patchloom.operators.runlog import best_epochs, running_best
from patchloom.plans.fixtures import view, with_views
from patchloom.plans.registry import query


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round floating results, whose last bits depend on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


THRESHOLDS = {0: 0.45, 1: 0.5, 2: 0.55, 3: 0.6, 4: 0.4}
TH_SQL = "select * from (values (0, 0.45e0), (1, 0.5e0), (2, 0.55e0), (3, 0.6e0), (4, 0.4e0)) t(k, threshold)"
ALPHA = [0.25, 0.5, 0.75, 1.0, 1.25]
LOGIT = "ln((score + 0.001e0) / (1.001e0 - score))"
NAMES = {0: "af1", 1: "Qal", 2: "Qaf", 3: "Qat", 4: "Qc"}


def logits(spark, d) -> DataFrame:
    return view(spark, d, "pred").withColumn("logit", F.expr(LOGIT))


@query("sigmoid", with_views("pred", f"select sid, k, round(1e0 / (1e0 + exp(-({LOGIT}))), 6) as p from pred"))
def _sigmoid(spark, d):
    return logits(spark, d).select("sid", "k", F.round(sigmoid(F.col("logit")), 6).alias("p"))


@query(
    "binarise",
    with_views(
        "pred",
        "select sid, k, case when score >= threshold then 1 else 0 end as yhat from pred join th using (k)",
        th=TH_SQL,
    ),
)
def _binarise(spark, d):
    th = M.thresholds_table(spark, THRESHOLDS)
    return M.binarise(view(spark, d, "pred"), th).select("sid", "k", "yhat")


FOCAL_SQL = (
    "(1 - exp(-bce)) * (1 - exp(-bce)) * bce"
)
BCE_SQL = f"select *, greatest({LOGIT}, 0) - {LOGIT} * y + ln(1 + exp(-abs({LOGIT}))) as bce from pred"


@query(
    "focal_loss_none",
    with_views("pred", f"select sid, k, round(0.25 * {FOCAL_SQL}, 6) as loss from b", b=BCE_SQL),
)
def _focal_none(spark, d):
    out = M.focal_loss(logits(spark, d), 0.25, 2.0, "none")
    return rounded(out.select("sid", "k", "loss"), 6, "loss")


@query(
    "focal_loss_mean",
    with_views("pred", f"select round(avg((0.25 + 0.25 * k) * {FOCAL_SQL}), 6) as loss from b", b=BCE_SQL),
)
def _focal_mean(spark, d):
    return rounded(M.focal_loss(logits(spark, d), ALPHA, 2.0, "mean"), 6, "loss")


@query(
    "focal_loss_sum",
    with_views("pred", "select round(sum(0.5 * (1 - exp(-bce)) * bce), 4) as loss from b", b=BCE_SQL),
)
def _focal_sum(spark, d):
    return rounded(M.focal_loss(logits(spark, d), 0.5, 1.0, "sum"), 4, "loss")


@query(
    "epoch_metrics",
    with_views(
        "pred",
        """select round(avg(l), 6) as loss, round(sum(c) * 100e0 / sum(n), 6) as accuracy, count(*) as batches
 from (select batch, avg(loss) as l, sum(c) as c, count(*) as n from j group by batch)""",
        b=BCE_SQL,
        o="select o_orderkey as sid, floor((row_number() over (order by o_orderkey) - 1) / 32) as batch from orders",
        j=f"""select batch, {FOCAL_SQL} as loss, case when (score >= 0.5) = (y = 1) then 1 else 0 end as c
 from b join o using (sid)""",
    ),
)
def _epoch(spark, d):
    samples = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("sid"))
    batches = assign_batches(samples, 32, "sid", drop_last=False)
    pred = logits(spark, d).withColumn("loss", focal_loss_element(F.col("logit"), F.col("y")))
    return rounded(M.epoch_metrics(pred.join(batches, "sid")), 6, "loss", "accuracy")


COUNTS_SQL = """select k, threshold, count(*) as n, sum(y) as targets,
 sum(case when score >= threshold then 1 else 0 end) as predictions,
 sum(case when score >= threshold and y = 1 then 1 else 0 end) as tp from pred join th using (k) group by k, threshold"""
LABEL_SQL = """select k, threshold, cast(targets as bigint) as targets, cast(predictions as bigint) as predictions,
 cast(tp as bigint) as tp, n, 1 - (targets + predictions - 2 * tp) / n as accuracy,
 case when predictions = 0 then 0 else tp / predictions end as precision,
 case when targets = 0 then 0 else tp / targets end as recall,
 case when targets + predictions = 0 then 0 else 2 * tp / (targets + predictions) end as f1 from c"""
CURVE_SQL = """select k, score, sum(y) as pos, sum(1 - y) as neg from pred group by k, score"""
CUM_SQL = """select *, sum(pos) over w as tp, sum(neg) over w as fp,
 sum(pos) over (partition by k) as p, sum(neg) over (partition by k) as n from s
 window w as (partition by k order by score desc rows unbounded preceding)"""
AP_SQL = "select k, sum(pos * (tp / (tp + fp))) / any_value(p) as ap from cu group by k"
# average-rank form, unlike the cumulative form of the operator
AUC_SQL = """select k, (sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2)
 / (sum(y) * (count(*) - sum(y))) as auroc from (
 select k, y, rank() over (partition by k order by score)
  + (count(*) over (partition by k, score) - 1) / 2 as r from pred) group by k"""


@query(
    "label_metrics",
    with_views(
        "pred",
        """select k, threshold, targets, predictions, tp, round(accuracy, 6) as accuracy,
 round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from l""",
        th=TH_SQL,
        c=COUNTS_SQL,
        l=LABEL_SQL,
    ),
)
def _label(spark, d):
    th = M.thresholds_table(spark, THRESHOLDS)
    out = M.label_metrics(view(spark, d, "pred"), th)
    return rounded(out, 6, "accuracy", "precision", "recall", "f1")


@query("auroc", with_views("pred", "select k, round(auroc, 6) as auroc from a", a=AUC_SQL))
def _auroc(spark, d):
    return rounded(M.auroc(view(spark, d, "pred")), 6, "auroc")


@query(
    "average_precision",
    with_views("pred", "select k, round(ap, 6) as ap from ap", s=CURVE_SQL, cu=CUM_SQL, ap=AP_SQL),
)
def _ap(spark, d):
    return rounded(M.average_precision(view(spark, d, "pred")), 6, "ap")


@query(
    "pr_curve",
    with_views(
        "pred",
        """select k, score as threshold, round(tp / (tp + fp), 6) as precision, round(tp / p, 6) as recall from cu
 union all select distinct k, null, 1e0, 0e0 from pred""",
        s=CURVE_SQL,
        cu=CUM_SQL,
    ),
)
def _pr(spark, d):
    return rounded(M.pr_curve(view(spark, d, "pred")), 6, "precision", "recall")


@query(
    "roc_curve",
    with_views(
        "pred",
        """select k, score as threshold, round(fp / n, 6) as fpr, round(tp / p, 6) as tpr from e
 where first or last or tp2 - 2 * tp + tp0 <> 0 or fp2 - 2 * fp + fp0 <> 0
 union all select distinct k, cast('inf' as double), 0e0, 0e0 from pred""",
        s=CURVE_SQL,
        cu=CUM_SQL,
        e="""select *, lag(tp) over w as tp0, lead(tp) over w as tp2, lag(fp) over w as fp0, lead(fp) over w as fp2,
 row_number() over w = 1 as first, lead(k) over w is null as last from cu
 window w as (partition by k order by score desc)""",
    ),
)
def _roc(spark, d):
    return rounded(M.roc_curve(view(spark, d, "pred")), 6, "fpr", "tpr")


TUNE_SQL = """select k, score as threshold, f1, row_number() over (partition by k order by f1 desc, score) as r
 from (select k, score, case when tp = 0 then 0 else 2 * tp / (tp + fp + p) end as f1 from cu)"""


@query(
    "tune_thresholds",
    with_views(
        "pred",
        "select k, threshold, round(f1, 6) as f1 from t where r = 1",
        s=CURVE_SQL,
        cu=CUM_SQL,
        t=TUNE_SQL,
    ),
)
def _tune(spark, d):
    return rounded(M.tune_thresholds(view(spark, d, "pred")), 6, "f1")


@query(
    "tune_thresholds_nan_first",
    with_views(
        "pred",
        "select k, threshold, round(f1, 6) as f1 from t where r = 1",
        s=CURVE_SQL,
        cu=CUM_SQL,
        t="""select k, score as threshold, f1, row_number() over (partition by k order by f1 is null desc, f1 desc, score) as r
 from (select k, score, case when tp > 0 then 2 * tp / (tp + fp + p) end as f1 from cu)""",
    ),
)
def _tune_nan(spark, d):
    """Undefined values come back as NULL."""
    tuned = M.tune_thresholds(view(spark, d, "pred"), nan_first=True)
    return rounded(tuned.withColumn("f1", F.nanvl("f1", F.lit(None).cast("double"))), 6, "f1")


def _global_sql(ap: str) -> str:
    w = "sum({0} * targets) / sum(targets)"
    return f"""select round(sum(accuracy * n) / sum(n), 6) as overall_accuracy,
 round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1,
 round({w.format('precision')}, 6) as weighted_precision, round({w.format('recall')}, 6) as weighted_recall,
 round({w.format('f1')}, 6) as weighted_f1, round(avg({ap}), 6) as macro_map, round({w.format(ap)}, 6) as weighted_map,
 round(1 - sum(accuracy * n) / sum(n), 6) as hamming_loss,
 round((select avg(ok) from su), 6) as subset_accuracy from l join ap using (k)"""


GLOBAL = dict(
    th=TH_SQL,
    c=COUNTS_SQL,
    l=LABEL_SQL,
    s=CURVE_SQL,
    cu=CUM_SQL,
    ap=AP_SQL,
    su="""select sid, min(case when (score >= threshold) = (y = 1) then 1 else 0 end) as ok
 from pred join th using (k) group by sid""",
)


@query("global_metrics", with_views("pred", _global_sql("ap"), **GLOBAL))
def _global(spark, d):
    out = M.global_metrics(view(spark, d, "pred"), M.thresholds_table(spark, THRESHOLDS))
    return rounded(out, 6, *out.columns)


@query(
    "global_metrics_compat_map",
    with_views("pred", _global_sql("(precision * recall + (1 - recall) * targets / n)"), **GLOBAL),
)
def _global_compat(spark, d):
    th = M.thresholds_table(spark, THRESHOLDS)
    out = M.global_metrics(view(spark, d, "pred"), th, compat_map=True)
    return rounded(out, 6, *out.columns)


NAME_SQL = "case k " + " ".join(f"when {k} then '{n}'" for k, n in NAMES.items()) + " end"


@query(
    "label_report",
    with_views(
        "pred",
        f"""select {NAME_SQL} || ' (' || cast(round(threshold, 2) as varchar) || ')' as Class, targets as Targets,
 predictions as Predictions, round(accuracy, 6) as Accuracy, round(precision, 6) as Precision,
 round(recall, 6) as Recall, round(f1, 6) as F1, round(ap, 6) as AP, round(auroc, 6) as AUROC
 from l join ap using (k) join au using (k)""",
        th=TH_SQL,
        c=COUNTS_SQL,
        l=LABEL_SQL,
        s=CURVE_SQL,
        cu=CUM_SQL,
        ap=AP_SQL,
        au=AUC_SQL,
    ),
)
def _report(spark, d):
    out = M.label_report(view(spark, d, "pred"), NAMES, M.thresholds_table(spark, THRESHOLDS))
    return rounded(out, 6, "Accuracy", "Precision", "Recall", "F1", "AP", "AUROC")


SHIFT_SQL = "select sid, k, y, (score * 7 + (sid * 13 + k) % 5) / 11 as score from pred"


@query(
    "compare_domains",
    with_views(
        "pred",
        """select k, round(a.auroc, 6) as in_domain, round(b.auroc, 6) as cross_domain,
 round(a.auroc - b.auroc, 3) as difference from a join b using (k)""",
        a=AUC_SQL,
        p2=SHIFT_SQL,
        b=AUC_SQL.replace("from pred", "from p2"),
    ),
)
def _compare(spark, d):
    pred = view(spark, d, "pred")
    other = pred.withColumn("score", F.expr("(score * 7 + (sid * 13 + k) % 5) / 11"))
    out = M.compare_domains(M.auroc(pred), M.auroc(other))
    return rounded(out, 6, "in_domain", "cross_domain")


@query(
    "running_best",
    with_views(
        "runlog",
        """select run, epoch, loss, coalesce(loss < before, true) as new_best from (
 select *, min(loss) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as before
 from runlog)""",
    ),
)
def _best(spark, d):
    return running_best(view(spark, d, "runlog")).select("run", "epoch", "loss", "new_best")


@query(
    "best_epochs",
    with_views(
        "runlog",
        """select run, arg_min(epoch, loss) as best_epoch, min(loss) as best_loss from (
 select *, row_number() over (partition by run, loss order by epoch) as r from runlog) where r = 1 group by run""",
    ),
)
def _best_epochs(spark, d):
    return best_epochs(view(spark, d, "runlog")).select("run", "best_epoch", "best_loss")


@query(
    "assign_batches",
    """select o_orderkey as sid, cast(floor((r - 1) / 32) as bigint) as batch from (
 select o_orderkey, row_number() over (order by md5(concat('7:', cast(o_orderkey as varchar))), o_orderkey) as r,
 count(*) over () as n from orders) where floor((r - 1) / 32) < floor(n / 32)""",
)
def _batches(spark, d):
    samples = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("sid"))
    return assign_batches(samples, 32, "sid", seed=7)


@query(
    "top_by_group",
    with_views(
        "pred",
        """select k, sid as best_sid from (
 select k, sid, row_number() over (partition by k order by score desc, sid) as r from pred) where r = 1""",
    ),
)
def _top(spark, d):
    return top_by(view(spark, d, "pred"), ["k"], "score", "sid", "sid", "best_sid")


@query("head_n", with_views("pred", "select sid, k, score from pred order by sid, k limit 320"))
def _head(spark, d):
    return head_n(view(spark, d, "pred").select("sid", "k", "score"), 320, ["sid", "k"])
