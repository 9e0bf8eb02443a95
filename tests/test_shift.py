import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_metrics import table

from duotext.operators import shift


def weights(spark, values):
    return spark.createDataFrame([(i, float(v), False) for i, v in enumerate(values)], "cls int, w double, degenerate boolean")


def as_dict(frame):
    return {r["cls"]: r["w"] for r in frame.collect()}


def test_binary_by_hand(spark):
    validation = table(spark, [[40, 10], [5, 45]])
    test = spark.createDataFrame([(0,)] * 7 + [(1,)] * 3, "y_pred int")
    w = shift.shift_weights(validation, test)
    assert as_dict(w) == pytest.approx({0: 12 / 7, 1: 2 / 7})
    probs = spark.createDataFrame([(1, [0.3, 0.7]), (2, [0.1, 0.9])], "row_id int, probs array<double>")
    out = shift.update_probs(probs, w).orderBy("row_id").collect()
    assert out[0]["new_probs"] == pytest.approx([0.72, 0.28]) and out[0]["new_pred"] == 0
    assert out[1]["new_probs"] == pytest.approx([0.4, 0.6]) and out[1]["new_pred"] == 1


def test_same_distribution_gives_ones(spark):
    validation = table(spark, [[30, 38, 29], [25, 22, 32], [35, 21, 18]])
    assert as_dict(shift.shift_weights(validation, validation)) == pytest.approx({0: 1, 1: 1, 2: 1})


def test_three_classes_golden(spark):
    validation = table(spark, [[30, 38, 29], [25, 22, 32], [35, 21, 18]])
    test = spark.createDataFrame([(c,) for c, n in enumerate((83, 74, 93)) for _ in range(n)], "y_pred int")
    expected = {0: 0.385806, 1: 2.354839, 2: 0.358710}
    assert as_dict(shift.shift_weights(validation, test)) == pytest.approx(expected, abs=1e-6)


def test_singular_matrix(spark):
    validation = table(spark, [[10, 0], [5, 0]])
    w = shift.shift_weights(validation, validation)
    assert all(r["w"] == 0.0 and r["degenerate"] for r in w.collect())
    # as in the definition, every row then falls to class 0
    probs = spark.createDataFrame([(1, [0.3, 0.7])], "row_id int, probs array<double>")
    assert shift.update_probs(probs, w).first()["new_pred"] == 0


def test_class_that_is_only_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (0, 2)], "y_true int, y_pred int")
    assert [r["cls"] for r in shift.shift_weights(df, df).orderBy("cls").collect()] == [0, 1, 2]


def test_negative_weights_are_clipped(spark):
    validation = table(spark, [[40, 10], [5, 45]])
    test = spark.createDataFrame([(0,)] * 99 + [(1,)], "y_pred int")
    raw = shift.shift_weights(validation, test, clip=False)
    assert as_dict(raw)[1] < 0
    assert as_dict(shift.clip_negative(raw)) == pytest.approx(as_dict(shift.shift_weights(validation, test)))


def test_zero_row(spark):
    probs = spark.createDataFrame([(1, [1.0, 0.0])], "row_id int, probs array<double>")
    r = shift.update_probs(probs, weights(spark, [0, 2])).first()
    assert r["new_probs"] == [0.0, 2.0] and r["new_pred"] == 1


def test_inputs(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "row_id int, probs array<double>")
    w = weights(spark, [1, 3])
    assert shift.adjust_probs(df, w, input="logits").first()["new_probs"] == pytest.approx([0.25, 0.75])
    assert shift.adjust_probs(df, w, input="logits_raw").first()["new_probs"] == [1.0, 3.0]
    assert shift.apply_class_weights(df.withColumn("probs", F.array(F.lit(0.5), F.lit(0.5))), w).first()["weighted"] == [0.5, 1.5]
    with pytest.raises(ValueError):
        shift.adjust_probs(df, w, input="other")


def test_before_and_after(spark):
    validation = table(spark, [[40, 10], [5, 45]]).withColumn("probs", F.array(F.lit(0.5), F.lit(0.5)))
    right = F.col("y_pred") == 1
    test = table(spark, [[60, 20], [10, 10]]).withColumn("probs", F.when(right, F.array(F.lit(0.2), F.lit(0.8))).otherwise(F.array(F.lit(0.9), F.lit(0.1))))
    out = {r["stage"]: r for r in shift.shift_corrected_evaluation(validation, test).collect()}
    assert out["before"]["f1"] == pytest.approx(2 * 10 / (2 * 10 + 20 + 10))
    assert set(out) == {"before", "after"}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(1, 50), min_size=3, max_size=3), min_size=3, max_size=3))
def test_solution_solves(matrix):
    joint = np.array(matrix, dtype=float).T / np.sum(matrix)
    w, degenerate = shift.solve_weights(joint, joint.sum(axis=1), clip=False)
    assert degenerate or np.allclose(joint @ w, joint.sum(axis=1))
