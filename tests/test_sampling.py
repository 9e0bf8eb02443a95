import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duotext.operators import copies, pairs
from duotext.operators import sampling as sp


def classes(spark, n0, n1, parts=3):
    return spark.range(n0 + n1).withColumn("label", F.when(F.col("id") < n0, 0).otherwise(1)).repartition(parts)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n0=st.integers(1, 300), n1=st.integers(1, 60))
def test_majority_upsampling_doubles_the_majority(spark, n0, n1):
    out = sp.upsample_to_majority(classes(spark, n0, n1), "label", "id")
    rows = out.collect()
    assert len(rows) == 2 * n0
    assert sum(r["label"] == 0 for r in rows) == n0
    assert len({(r["id"], r["draw_no"]) for r in rows}) == len(rows)
    assert {r["id"] for r in rows if r["label"] == 1} <= set(range(n0, n0 + n1))


def test_sampling_does_not_depend_on_partitions(spark):
    def run(parts):
        df = classes(spark, 500, 70, parts)
        a = sp.upsample_to_majority(df, "label", "id", bucket_rows=20)
        b = sp.inject_null_context(df.withColumn("context", F.lit("x")), 0.3, "id")
        c = sp.shuffle_rows(df, "id", position="place", bucket_rows=20)
        d = sp.batch_ids(df, 16, "id", order="random", bucket_rows=20)
        return [sorted(map(tuple, x.collect())) for x in (a, b, c, d)]

    assert run(1) == run(17)


def test_factor_rounds_half_to_even(spark):
    out = sp.upsample_by_factor(classes(spark, 9, 5), "label", "id")  # 6.5 -> 6
    assert out.where("label = 1").count() == 6
    assert out.where("label = 0").count() == 9


def test_two_classes_are_needed(spark):
    with pytest.raises(ValueError, match="two classes"):
        sp.upsample_to_majority(spark.range(9).withColumn("label", F.col("id") % 3), "label", "id")
    with pytest.raises(ValueError, match="two classes"):
        sp.upsample_to_majority(spark.range(9).withColumn("label", F.when(F.col("id") > 3, 1)), "label", "id")
    with pytest.raises(ValueError, match="no minority"):
        sp.upsample_to_majority(spark.range(9).withColumn("label", F.lit(0)), "label", "id")


def test_other_majority_class(spark):
    out = sp.upsample_to_majority(classes(spark, 5, 50), "label", "id", majority=1)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 50, 1: 50}


def test_one_row_pool_with_many_draws(spark, monkeypatch):
    # a single minority row takes every draw; its copies are cut into chunks
    monkeypatch.setattr(copies, "COPIES_PER_TASK", 100)
    monkeypatch.setattr(sp, "COPIES_PER_TASK", 100)
    out = sp.upsample_to_majority(classes(spark, 1234, 1), "label", "id").where("label = 1")
    assert sorted(r["draw_no"] for r in out.collect()) == list(range(1234))


def test_poisson_counts(spark):
    df = classes(spark, 4000, 1000)
    out = sp.upsample_to_majority(df, "label", "id", mode="poisson")
    n = out.where("label = 1").count()
    assert abs(n - 4000) < 5 * 4000**0.5
    assert out.where("label = 0").count() == 4000
    zero = 1000 - out.where("label = 1").select("id").distinct().count()
    assert 4 < zero < 40  # 1000 * exp(-4) = 18.3
    counts = spark.range(400).select(sp.poisson_copies(5_000.0, F.md5(F.col("id").cast("string"))).alias("n"))
    mean, spread = counts.agg(F.avg("n"), F.stddev("n")).first()
    assert abs(mean - 5_000) < 20 and 55 < spread < 90


@pytest.mark.parametrize("n, blank", [(436, 109), (3, 0), (4, 1), (100, 25)])
def test_null_contexts_are_exact(spark, n, blank):
    df = spark.range(n).withColumn("context", F.lit("x"))
    assert sp.inject_null_context(df, 0.25, "id").where("context = ''").count() == blank


def test_null_contexts_after_upsampling(spark):
    df = classes(spark, 40, 10).withColumn("context", F.lit("x"))
    up = sp.upsample_to_majority(df, "label", "id")
    assert sp.inject_null_context(up, 0.25, ["id", "draw_no"]).where("context = ''").count() == 20


def test_shuffle_order_is_its_position(spark):
    df = spark.range(300)
    ordered = [r["id"] for r in sp.shuffle_rows(df, "id").collect()]
    placed = {r["position"]: r["id"] for r in sp.shuffle_rows(df, "id", position="position").collect()}
    assert ordered == [placed[i] for i in range(300)] and ordered != list(range(300))


def test_batches(spark):
    out = sp.batch_ids(spark.range(70), 32, "id", bucket_rows=10)
    assert all(r["batch_id"] == r["id"] // 32 for r in out.collect())
    sizes = sp.batch_ids(spark.range(70), 32, "id", order="random").groupBy("batch_id").count().collect()
    assert {r["batch_id"]: r["count"] for r in sizes} == {0: 32, 1: 32, 2: 6}
    assert sp.steps_per_epoch(spark.range(70), 32).first()["steps"] == 2


def test_split_shares(spark):
    out = sp.random_split(spark.range(5000), "id")
    assert abs(out.where("split = 'train'").count() / 5000 - 0.9) < 0.02


def test_take_and_rest_partition_the_input(spark):
    df, wanted = spark.range(100), spark.range(0, 200, 3)
    took = {r["id"] for r in pairs.take_indices(df, wanted, "id").collect()}
    rest = {r["id"] for r in pairs.remaining_rows(df, wanted, "id").collect()}
    assert took | rest == set(range(100)) and not took & rest and took == set(range(0, 100, 3))


def test_row_ids_of_equal_rows(spark, monkeypatch):
    rows = [("a", None)] * 700 + [("a", "")] * 3 + [("a1:1:b", "c"), ("a", "1:1:bc")]
    ids = {}
    for limit in (100_000, 64):
        monkeypatch.setattr(copies, "COPIES_PER_TASK", limit)
        out = pairs.with_row_id(spark.createDataFrame(rows, "context string, target string").repartition(5)).collect()
        ids[limit] = {r["row_id"] for r in out}
        assert len(out) == len(rows) == len(ids[limit])
        assert sorted(map(repr, [(r["context"], r["target"]) for r in out])) == sorted(map(repr, rows))
    assert ids[64] == ids[100_000]


def test_pairs_of_a_long_thread(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TURNS_PER_CHUNK", 8)
    turns = [(1, t, f"m{t}") for t in range(-20, 100) if t not in (7, 15, 16, 50)] + [(2, 0, "x"), (2, 1, None), (2, 2, "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, text string").repartition(5)
    got = {(r["conv_id"], r["turn"], r["context"], r["target"]) for r in pairs.consecutive_pairs(df).collect()}
    by = {(c, t): m for c, t, m in turns}
    assert got == {(c, t, by[c, t - 1], m) for c, t, m in turns if (c, t - 1) in by}
