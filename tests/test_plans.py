"""What the plans must look like, and what a stream may pass through."""

import json

import pytest
from pyspark.sql import functions as F

from duotext import streaming as sg
from duotext.catalog import frames
from duotext.operators import encoding, metrics, ordering, pairs, sampling, shift


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    return frames.steps(spark, sf_dir)


def test_row_operators_do_not_shuffle(spark, sf_dir, steps):
    scored = frames.scored(spark, sf_dir)
    weights = shift.shift_weights(*frames.halves(scored))
    texts = frames.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    vocab = encoding.build_vocab(texts, "text", 1000)
    blank = sampling.inject_null_context(steps.withColumn("context", F.lit("x")), 0.25, "row_id")
    for df in (
        shift.update_probs(scored, weights), blank,
        sampling.random_split(steps, "row_id"), pairs.confident_rows(scored),
        ordering.exact_k_by_hash(steps, 100, "row_id", 1),
        sampling.upsample_poisson(frames.imbalanced(spark, sf_dir), "label", "row_id"),
    ):
        assert "Exchange" not in plan(df) and "Python" not in plan(df)
    assert "Exchange" not in plan(encoding.encode_text(texts, vocab))


def test_score_plans_do_not_grow_with_the_classes(spark):
    k = 1_000
    rows = spark.range(10).select("id", F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: (i * 7 % 13).cast("double")).alias("probs"))
    weights = spark.range(k).select(F.col("id").cast("int").alias("cls"), F.lit(2.0).alias("w"))
    out = shift.update_probs(rows, weights, input="logits")
    text = plan(out)
    assert text.count("exp(") <= 4
    assert all(sum(r["new_probs"]) == pytest.approx(1) for r in out.collect())


def test_too_many_classes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(metrics, "MAX_CLASSES", 2)
    few, many = (spark.range(30).select((F.col("id") % n).alias("y_true"), (F.col("id") % (n + 1)).alias("y_pred")) for n in (1, 5))
    assert metrics.confusion_counts(few).count() == 4
    with pytest.raises(Exception, match="more than 2 classes"):
        metrics.confusion_counts(many).collect()


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    text = plan(pairs.class_partition(frames.imbalanced(spark, sf_dir), 1))
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)]" in text
    assert "quality" not in text
    report = plan(metrics.metric_report(frames.scored(spark, sf_dir)))
    assert "vec_id" not in report


def test_metrics_shuffle_partial_aggregates_only(spark, sf_dir):
    text = plan(metrics.summary(frames.scored(spark, sf_dir)))
    scan = text[text.rindex("Exchange"):]  # the exchange next to the scan
    assert "partial_count" in scan


def test_ranking_shuffles_the_rows_once(spark, steps):
    text = plan(ordering.global_index(steps, ["ts", "row_id"], bucket_rows=500))
    data_side = text[:text.index("BroadcastExchange")]
    assert data_side.count("Exchange") == 1 and "SinglePartition" not in data_side
    grouped = plan(ordering.running_sum(steps, ["ts", "row_id"], {"s": "loss"}, "run", bucket_rows=500))
    assert "SinglePartition" not in grouped


def test_no_cross_joins(spark, sf_dir):
    import __spark_entry__ as contract

    for name in ("confusion_counts", "adjust_probs", "dynamic_pad", "metric_report_loss", "prediction_distribution"):
        text = plan(contract.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_streams_pass_through(spark, sf_dir, tmp_path, monkeypatch):
    rows = [("a b", f"c {i}", str(i % 3)) for i in range(20)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(json.dumps(dict(zip(("context", "target", "label"), r))) for r in rows))
    source = spark.readStream.schema("context string, target string, label string").json(str(tmp_path / "in"))
    fixed = spark.createDataFrame(rows, "context string, target string, label string")
    vocab = encoding.build_vocab(fixed, ["context", "target"], 100)
    weights = spark.createDataFrame([(0, 1.0), (1, 3.0)], "cls int, w double")

    def chain(df):
        out = sg.binarize_01(sg.encode_pair(df, vocab, max_length=12))
        out = out.withColumn("probs", F.array(F.lit(0.5), F.lit(0.5)))
        return sg.random_split(sg.update_probs(out, weights), "target").drop("context")

    # the size of the vocabulary makes no difference to a stream
    monkeypatch.setattr(encoding, "INLINE_VOCAB", 1)
    query = (chain(source).writeStream.format("memory").queryName("passed").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    monkeypatch.undo()
    assert sorted(map(str, spark.table("passed").collect())) == sorted(map(str, chain(fixed).collect()))
