import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from duotext import functions as fn
from duotext.operators import pairs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_softmax(spark):
    p = one(spark, fn.softmax(arr(1000, 1001, 999), 3))
    e = [math.exp(v) for v in (-1, 0, -2)]
    assert p == pytest.approx([v / sum(e) for v in e])
    assert sum(p) == pytest.approx(1)


def test_first_maximum_wins(spark):
    assert one(spark, fn.argmax_label(arr(1, 3, 3))) == 1


def test_one_hot_and_back(spark):
    assert one(spark, fn.one_hot(F.lit(2), 3)) == [0.0, 0.0, 1.0]
    assert one(spark, fn.argmax_label(fn.one_hot(F.lit(2), 3))) == 2
    assert one(spark, fn.class_at(F.lit(1), [5, 9])) == 9


def test_normalize(spark):
    assert one(spark, fn.normalize_scores(arr(1, 3), 2)) == [0.25, 0.75]
    assert one(spark, fn.normalize_scores(arr(0, 0), 2)) == [0.0, 0.0]


def test_zero_row_takes_the_weights(spark):
    new = fn.weighted_posterior(arr(1, 0), [F.lit(0.0), F.lit(2.0)], 2)
    assert one(spark, new) == [0.0, 2.0]
    assert one(spark, fn.argmax_label(new)) == 1


@pytest.mark.parametrize("seconds, text", [
    (59.5, "0:01:00"), (60.5, "0:01:00"), (3661.4, "1:01:01"), (90000, "1 day, 1:00:00"),
    (172800, "2 days, 0:00:00"), (0, "0:00:00"),
])
def test_elapsed(spark, seconds, text):
    assert one(spark, fn.elapsed(F.lit(seconds))) == text


def test_cross_entropies(spark):
    assert one(spark, fn.nll(arr(0, 0), F.lit(1), 2)) == pytest.approx(math.log(2))
    assert one(spark, fn.bce(arr(1, 0), F.lit(0), 2)) == 0.0
    assert one(spark, fn.bce(arr(0, 1), F.lit(0), 2)) == 200.0  # both logs clamped


@pytest.mark.parametrize("label, binary, merged", [("0", 0, 0), ("1", 0, 0), ("2", 1, 2), (None, None, None), ("7", 1, 7)])
def test_recodes(spark, label, binary, merged):
    value = F.lit(label).cast("string")
    assert one(spark, fn.binarize(value)) == binary
    assert one(spark, fn.neutral_to_zero(value)) == merged


def test_bad_label_fails(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([("x",)], "label string").transform(pairs.label_to_int).collect()


def test_letters(spark):
    values = [("h", 0), ("n", 0), ("c", 1), ("other", 1), (None, None)]
    out = pairs.letter_label(spark.createDataFrame(values, "label string, want int")).collect()
    assert all(r["label"] == r["want"] for r in out)


def test_pair_text_of_missing_sides(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "context string, target string")
    assert [r["text"] for r in pairs.pair_text(df).collect()] == ["a [SEP] b", " [SEP] b", "a [SEP] "]


def test_filters(spark):
    rows = [("gold", "0"), ("gold", "2"), ("silver", "0"), ("silver", "2"), ("silver", None)]
    df = spark.createDataFrame(rows, "tier string, label string")
    assert [tuple(r) for r in pairs.silver_minority_only(df).collect()] == [rows[0], rows[1], rows[3]]
    exact = spark.createDataFrame([([0.8, 0.2],), ([0.81, 0.19],)], "probs array<double>")
    assert pairs.confident_rows(exact).count() == 1  # strictly above


def test_unions_keep_duplicates(spark):
    df = spark.createDataFrame([("a",), ("a",)], "target string")
    out = pairs.union_tiers(df, df)
    assert out.count() == 4 and {r["tier"] for r in out.collect()} == {"gold", "silver"}
    both = pairs.append_pseudo_labels(df, df)
    assert {r["origin"]: r["count"] for r in both.groupBy("origin").count().collect()} == {"train": 2, "pseudo": 2}
