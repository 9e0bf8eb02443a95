"""The package's data model on top of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duotext.functions import scores as sc
from duotext.operators.pairs import consecutive_pairs

CLASSES = 3
TURNS = 1_000_000_000  # turns that a row id has room for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_id() -> Column:
    """Conversation and turn in one number; fails where a conversation has more turns than there is room for."""
    many = F.raise_error(F.lit(f"a turn is not below {TURNS}"))
    return F.col("conv_id") * TURNS + F.when(F.col("turn") < TURNS, F.col("turn")).otherwise(many)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns: row_id, context, target, label ('0'..'2'), tier."""
    made = consecutive_pairs(table(spark, sf_dir, "conversations"))
    return made.select(
        _row_id().alias("row_id"), "context", "target",
        ((F.col("conv_id") * 7 + F.col("turn")) % 3).cast("string").alias("label"),
        F.when(F.col("conv_id") % 2 == 0, "gold").otherwise("silver").alias("tier"),
    )


def tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = pairs(spark, sf_dir)
    return p.where("tier = 'gold'"), p.where("tier = 'silver'")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class scores: row_id, y_true, scores."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"), (F.col("label") % CLASSES).cast("int").alias("y_true"),
        F.array(*[10 * F.col("embedding")[i].cast("double") for i in range(CLASSES)]).alias("scores"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with probabilities and the predicted class."""
    p = logits(spark, sf_dir).withColumn("probs", sc.softmax(F.col("scores"), CLASSES))
    return p.withColumn("y_pred", sc.argmax_label(F.col("scores")))


def halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validation (even keys) and test (odd keys)."""
    return df.where(F.col("row_id") % 2 == 0), df.where(F.col("row_id") % 2 == 1)


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary predictions with probabilities that agree with them."""
    top = (505 + (F.col("doc_id") * 37) % 490) / 1000
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("toxic").alias("y_true"), (1 - F.col("quality")).alias("y_pred"),
        F.when(F.col("quality") == 1, F.array(top, 1 - top)).otherwise(F.array(1 - top, top)).alias("probs"),
    )


def imbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"))


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in three classes, label as digit text."""
    cls = F.when(F.col("toxic") == 1, "0").when(F.col("quality") == 0, "1").otherwise("2")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("row_id"), "text", "n_chars", cls.alias("label"), F.col("toxic").alias("y_true")
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step log: run, epoch, ts, row_id, phase, loss, accuracy, seconds."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "ts", F.col("user_id").alias("run"),
        F.dayofmonth("ts").alias("epoch"),
        F.when(F.col("event_id") % 5 == 0, "valid").otherwise("train").alias("phase"),
        F.col("value").alias("loss"),
        ((F.col("event_id") % 10) / 10).alias("accuracy"),
        ((F.col("event_id") % 7) * 0.5 + 0.25).cast("double").alias("seconds"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a binary label and a second, finer one."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("hidden_state"),
        (F.col("label") >= 5).cast("int").alias("label"), (F.col("label") % CLASSES).cast("int").alias("stance"),
    )
