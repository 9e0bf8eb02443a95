import random

import pytest
from pyspark.sql import functions as F

from duotext.operators import metrics as mt
from duotext.operators import training_log as tl


def table(spark, matrix):
    """Rows of a confusion matrix (rows true, columns predicted)."""
    rows = [(t, p) for t, line in enumerate(matrix) for p, n in enumerate(line) for _ in range(n)]
    return spark.createDataFrame(rows, "y_true int, y_pred int")


@pytest.fixture(scope="module")
def binary(spark):
    return table(spark, [[40, 10], [5, 45]])


def test_binary_by_hand(binary):
    r = mt.summary(binary).first()
    assert r["cohen_kappa"] == pytest.approx(0.7)
    assert r["roc_auc"] == pytest.approx(0.85)
    assert r["f1"] == pytest.approx(6 / 7)
    assert r["weighted_f1"] == pytest.approx(0.849624, abs=1e-6)
    assert r["accuracy"] == pytest.approx(0.85)
    per = {x["cls"]: x["f1"] for x in mt.precision_recall_f1_accuracy(binary).collect()}
    assert per[0] == pytest.approx(16 / 19) and per[1] == pytest.approx(6 / 7)


def test_single_metric_functions(binary):
    assert mt.accuracy(binary).first()[0] == pytest.approx(0.85)
    assert mt.percent_accuracy(binary).first()[0] == pytest.approx(85)
    assert mt.binary_f1(binary).first()[0] == pytest.approx(6 / 7)
    assert mt.cohen_kappa(binary).first()[0] == pytest.approx(0.7)
    assert mt.roc_auc_hard(binary).first()[0] == pytest.approx(0.85)


def test_zero_cells_and_predicted_only_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "y_true int, y_pred int")
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in mt.confusion_counts(df).collect()}
    assert len(cells) == 9 and cells[0, 2] == 1 and cells[2, 0] == 0
    rows = {(r["y_true"], r["y_pred"]): r["share"] for r in mt.confusion_row_normalized(df).collect()}
    assert rows[2, 0] == 0.0 and rows[0, 2] == 0.5
    joint = {(r["y_pred"], r["y_true"]): r["share"] for r in mt.confusion_joint_T(df).collect()}
    assert joint[2, 0] == pytest.approx(1 / 3) and sum(joint.values()) == pytest.approx(1)


def test_degenerate_metrics(spark):
    r = mt.summary(table(spark, [[5, 0], [0, 0]])).first()
    assert r["cohen_kappa"] is None and r["roc_auc"] is None and r["f1"] == 0.0 and r["accuracy"] == 1.0


def test_perfect_predictions(spark):
    r = mt.summary(table(spark, [[5, 0, 0], [0, 3, 0], [0, 0, 2]])).first()
    assert r["weighted_f1"] == r["accuracy"] == r["cohen_kappa"] == 1.0


def test_prediction_distribution_keeps_absent_classes(binary):
    got = {r["cls"]: r["share"] for r in mt.prediction_distribution(binary, "y_pred", [0, 1, 7]).collect()}
    assert got == {0: 0.45, 1: 0.55, 7: 0.0}


@pytest.mark.parametrize("levels", [1, 3, 1000])
def test_roc_of_scores_by_pairs(spark, levels):
    rnd = random.Random(levels)
    rows = [(rnd.randrange(2), rnd.randrange(levels) / 7) for _ in range(400)]
    df = spark.createDataFrame(rows, "y_true int, score double")
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    got = mt.roc_auc_scores(df, bucket_rows=10).first()["roc_auc"]
    assert got == pytest.approx(wins / (len(pos) * len(neg)))


def test_roc_of_hard_scores_agrees(binary):
    assert mt.roc_auc_scores(binary.withColumn("score", F.col("y_pred"))).first()[0] == pytest.approx(0.85)


def test_batch_mean_is_not_the_mean(spark):
    rows = [(0, 1, 1), (0, 1, 1), (0, 1, 1), (1, 1, 0)]
    df = spark.createDataFrame(rows, "batch int, y_true int, y_pred int").withColumn("loss", F.lit(1.0) - F.col("y_pred"))
    assert mt.batch_mean_metric(df, "batch").first()[0] == 0.5
    assert mt.batch_mean_metric(df, "batch", "recall").first()[0] == 0.5
    assert mt.batch_mean_metric(df, "batch", "loss").first()[0] == 0.5
    assert mt.loss_over_dataset(df, "batch").first()[0] == 0.25


def test_majority_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(2,), (1,), (1,), (2,), (0,)], "label int")
    assert tuple(mt.majority_baseline(df).first()) == (1, 0.4)


def test_report_kinds(binary):
    assert mt.metric_report(binary).columns == ["accuracy", "f1"]
    assert mt.metric_report(binary, kind="binary").columns == ["cohen_kappa", "f1", "roc_auc"]
    with pytest.raises(ValueError):
        mt.metric_report(binary, kind="loss")
    with pytest.raises(ValueError):
        mt.metric_report(binary, kind="other")


def test_best_so_far_by_hand(spark):
    losses = [1.2, 0.9, 0.9, 0.95, 0.4]
    df = spark.createDataFrame(list(enumerate(losses, 1)), "epoch int, valid_loss double")
    flagged = tl.best_so_far(df)
    assert [r["saved"] for r in flagged.orderBy("epoch").collect()] == [False, True, False, False, True]
    assert tuple(tl.select_checkpoint(flagged).first()) == (5, 0.4)
    never = tl.best_so_far(df.withColumn("valid_loss", F.lit(1.0)))
    assert tl.select_checkpoint(never).count() == 0


def test_published_log_as_series(spark):
    # fixed values: evaluation accuracy of a published eight-epoch run
    accuracy = [0.5088, 0.6424, 0.7366, 0.8188, 0.8884, 0.9170, 0.9402, 0.9464]
    log = spark.createDataFrame([(float(i), a, None) for i, a in enumerate(accuracy, 1)],
                                "epoch double, eval_accuracy double, eval_f1 double")
    long = tl.rows_to_series(log, "epoch", ["epoch", "eval_accuracy", "eval_f1"])
    series = {k: [r["value"] for r in long.where(F.col("key") == k).orderBy("epoch").collect()]
              for k in ("epoch", "eval_accuracy", "eval_f1")}
    assert series == {"epoch": [float(i) for i in range(1, 9)], "eval_accuracy": accuracy, "eval_f1": []}
    assert [r["eval_accuracy"] for r in tl.epoch_series(log, "eval_accuracy").collect()] == accuracy


def test_published_scores(spark, sf_dir):
    # golden values of the three-class frame at scale 0.01
    from duotext.catalog import frames

    if not sf_dir.endswith("sf0.01"):
        pytest.skip("values are for scale 0.01")
    df = frames.scored(spark, sf_dir)
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in mt.confusion_counts(df).collect()}
    assert [[cells[i, j] for j in range(3)] for i in range(3)] == [[69, 71, 69], [49, 39, 63], [55, 45, 40]]
    r = mt.summary(df).first()
    assert r["accuracy"] == pytest.approx(0.296) and r["cohen_kappa"] == pytest.approx(-0.057959, abs=1e-6)
    assert r["weighted_f1"] == pytest.approx(0.299780, abs=1e-6)
