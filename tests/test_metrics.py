import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.functions.scalar import bce_with_logits, sigmoid
from patchloom.operators import labels as L, metrics as M
from patchloom.operators.runlog import best_epochs, running_best


def frame(spark, rows):
    return spark.createDataFrame(rows, "sid int, k int, y int, score double")


@pytest.fixture(scope="module")
def pred(spark):
    rng = random.Random(1)
    rows = []
    for sid in range(400):
        for k in range(3):
            y = int(rng.random() < 0.2 + 0.2 * k)
            rows.append((sid, k, y, round(min(0.99, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2)))
    return frame(spark, rows).cache()


def arrays(pred, k):
    rows = pred.where(F.col("k") == k).collect()
    return np.array([r["y"] for r in rows]), np.array([r["score"] for r in rows])


def pairwise_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean())


@pytest.mark.parametrize("size", [None, 20])
def test_auroc_and_ap(pred, size):
    auc = {r["k"]: r["auroc"] for r in M.auroc(pred, size).collect()}
    ap = {r["k"]: r["ap"] for r in M.average_precision(pred, size).collect()}
    for k in range(3):
        y, s = arrays(pred, k)
        assert auc[k] == pytest.approx(pairwise_auc(y, s))
        want, last = 0.0, 0.0
        for t in sorted(set(s), reverse=True):
            hat = s >= t
            recall = (hat & (y == 1)).sum() / y.sum()
            want += (recall - last) * (hat & (y == 1)).sum() / hat.sum()
            last = recall
        assert ap[k] == pytest.approx(want)


def test_auroc_of_negated_scores(pred):
    a = {r["k"]: r["auroc"] for r in M.auroc(pred).collect()}
    b = {r["k"]: r["auroc"] for r in M.auroc(pred.withColumn("score", -F.col("score"))).collect()}
    for k in a:
        assert a[k] + b[k] == pytest.approx(1.0)


def test_one_class_label_has_no_auroc(spark):
    p = frame(spark, [(1, 0, 1, 0.2), (2, 0, 1, 0.6)])
    assert M.auroc(p).first()["auroc"] is None
    assert M.average_precision(p).first()["ap"] == 1.0


@pytest.mark.parametrize("size", [None, 20])
def test_roc_drops_collinear_points_only(pred, size):
    full = M.roc_curve(pred, drop=False).collect()
    short = M.roc_curve(pred, rows_per_bucket=size).collect()
    for k in range(3):
        a = sorted((r["fpr"], r["tpr"]) for r in full if r["k"] == k)
        b = sorted((r["fpr"], r["tpr"]) for r in short if r["k"] == k)
        assert b[0] == (0, 0) and b[-1] == (1, 1) and len(b) <= len(a)
        # the area under the polyline does not change
        area = [np.trapezoid([y for _, y in c], [x for x, _ in c]) for c in (a, b)]
        assert area[0] == pytest.approx(area[1])


@pytest.mark.parametrize("size", [None, 20])
def test_tuned_threshold_is_best(pred, size):
    tuned = {r["k"]: (r["threshold"], r["f1"]) for r in M.tune_thresholds(pred, rows_per_bucket=size).collect()}
    for k in range(3):
        y, s = arrays(pred, k)
        f1 = {}
        for t in set(s):
            hat = s >= t
            f1[t] = 2 * (hat & (y == 1)).sum() / (hat.sum() + y.sum())
        best = max(f1.values())
        assert tuned[k][1] == pytest.approx(best)
        assert tuned[k][0] == min(t for t, v in f1.items() if v == best)


def test_tune_nan_first(spark):
    p = frame(spark, [(1, 0, 0, 0.9), (2, 0, 0, 0.8), (3, 0, 1, 0.5), (4, 0, 0, 0.1)])
    assert M.tune_thresholds(p).first()["threshold"] == 0.5
    assert M.tune_thresholds(p, nan_first=True).first()["threshold"] == 0.8


def test_pr_curve_end_point(pred):
    rows = M.pr_curve(pred).where("k = 1 and threshold is null").collect()
    assert [(r["precision"], r["recall"]) for r in rows] == [(1.0, 0.0)]


# One published test of 1,536 samples: targets, predictions, true positives per class.
COUNTS = {
    "af1": (571, 543, 399),
    "Qal": (949, 1106, 816),
    "Qaf": (13, 11, 1),
    "Qat": (61, 7, 2),
    "Qc": (749, 693, 635),
    "Qca": (432, 427, 314),
    "Qr": (1433, 1515, 1423),
}


def test_published_counts_give_published_metrics(spark):
    rows = []
    for k, (t, p, tp) in enumerate(COUNTS.values()):
        kinds = [(1, 0.9)] * tp + [(0, 0.9)] * (p - tp) + [(1, 0.1)] * (t - tp)
        kinds += [(0, 0.1)] * (1536 - len(kinds))
        rows += [(i, k, y, s) for i, (y, s) in enumerate(kinds)]
    g = M.global_metrics(frame(spark, rows), 0.5, compat_map=True).first()
    want = {
        "overall_accuracy": 0.8763020833,
        "macro_precision": 0.6343095285,
        "macro_recall": 0.6051438667,
        "macro_f1": 0.6042655879,
        "weighted_precision": 0.8289735800,
        "weighted_recall": 0.8531368821,
        "weighted_f1": 0.8379907742,
        "macro_map": 0.5443746980,
        "weighted_map": 0.7822954052,
        "hamming_loss": 0.1236979167,
    }
    for name, value in want.items():
        assert g[name] == pytest.approx(value, abs=1e-9), name
    # on two-valued scores the plain form is the same thing
    plain = M.global_metrics(frame(spark, rows), 0.5).first()
    assert plain["macro_map"] == pytest.approx(want["macro_map"], abs=1e-9)


def test_label_report_names(spark, pred):
    th = M.thresholds_table(spark, {0: 0.405, 1: 0.5, 2: 0.555})
    names = {r["Class"] for r in M.label_report(pred, {0: "a", 1: "b", 2: "c"}, th).collect()}
    assert names == {"a (0.4)", "b (0.5)", "c (0.56)"}


def test_no_prediction_gives_zero(spark):
    r = M.label_metrics(frame(spark, [(1, 0, 1, 0.1), (2, 0, 0, 0.2)]), 0.5).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0, 0, 0, 0.5)


def test_empty_input(spark):
    empty = frame(spark, [])
    for fn in (M.auroc, M.average_precision, M.pr_curve, M.roc_curve, M.tune_thresholds, M.label_metrics):
        assert fn(empty).count() == 0


def test_loss_is_stable(spark):
    df = spark.createDataFrame([(800.0, 0), (-800.0, 1), (0.0, 1)], "logit double, y int")
    out = df.select(bce_with_logits(F.col("logit"), F.col("y")), sigmoid(F.col("logit"))).collect()
    assert [r[0] for r in out] == pytest.approx([800.0, 800.0, np.log(2)])
    assert [r[1] for r in out] == pytest.approx([1.0, 0.0, 0.5])
    with pytest.raises(ValueError):
        M.focal_loss(df, reduction="median")


# Published class weights before and after scaling to sum 1.
WEIGHTS = [4.356945, 3.339365, 26.898281, 12.570186, 3.771544, 5.04784, 2.743478]
SCALED = [0.074189, 0.056862, 0.458017, 0.214042, 0.064221, 0.085953, 0.046715]


def test_published_weights_scale():
    assert np.array(WEIGHTS) / sum(WEIGHTS) == pytest.approx(SCALED, abs=2e-5)


def test_class_weights(spark):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 5 == 0)) for i in range(20)], "p int, a int, b int")
    raw = {r["class"]: r["weight"] for r in L.class_weights(labels, ["a", "b"], sqrt=False, scale=False).collect()}
    assert raw == {"a": 4.0, "b": 10.0}
    scaled = L.class_weights(labels, ["a", "b"]).collect()
    assert sum(r["weight"] for r in scaled) == pytest.approx(1.0)


@pytest.mark.parametrize("size", [None, 30])
def test_box_stats_against_numpy(spark, size):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else "b", rng.random() ** 4) for i in range(900)]
    df = spark.createDataFrame(rows, "unit string, proportion double")
    for r in L.box_stats(df, rows_per_bucket=size).collect():
        v = np.array([x for u, x in rows if u == r["unit"]])
        q1, q2, q3 = np.percentile(v, [25, 50, 75])
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, q2, q3))
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (r["whisker_low"], r["whisker_high"]) == pytest.approx((inside.min(), inside.max()))


def test_histogram_against_numpy(spark):
    rng = random.Random(4)
    values = [round(rng.random(), 2) for _ in range(500)] + [0.0, 1.0]
    df = spark.createDataFrame([("u", v) for v in values], "unit string, proportion double")
    got = {r["bin"]: r["n"] for r in L.histogram(df).collect()}
    counts, _ = np.histogram(values, np.histogram_bin_edges(values, 10))
    assert [got.get(i + 1, 0) for i in range(10)] == counts.tolist()
    flat = spark.createDataFrame([("u", 0.5)] * 4, "unit string, proportion double")
    assert [tuple(r) for r in L.histogram(flat).select("n", "percent").collect()] == [(4, 100.0)]


@pytest.mark.parametrize("size", [None, 3])
def test_running_best(spark, size):
    log = [("a", 1, 3.0, 50.0), ("a", 2, 2.0, 40.0), ("a", 3, 2.0, 60.0), ("a", 4, 1.0, 60.0), ("b", 1, 9.0, 0.0)]
    df = spark.createDataFrame(log, "run string, epoch int, loss double, accuracy double")
    got = {(r["run"], r["epoch"]): (r["new_best"], r["new_best_accuracy"]) for r in running_best(df, rows_per_bucket=size).collect()}
    assert got == {
        ("a", 1): (True, True),
        ("a", 2): (True, False),
        ("a", 3): (False, True),
        ("a", 4): (True, False),
        ("b", 1): (True, False),
    }
    best = {r["run"]: (r["best_epoch"], r["best_accuracy_epoch"]) for r in best_epochs(df).collect()}
    assert best == {"a": (4, 3), "b": (1, 1)}
