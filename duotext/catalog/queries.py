"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duotext import functions as fn
from duotext.catalog import frames as fr
from duotext.operators import encoding, learning, metrics, ordering, pairs, sampling, shift, training_log
from duotext.plans import recipes
from duotext.runtime import cut_lineage, scratch_path
from duotext.sources import artifacts, readers, versions
from duotext.streaming import step_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K = fr.CLASSES
PAIR_COLUMNS = ["context", "target", "label"]


def query(f: Query) -> Query:
    QUERIES[f.__name__.removesuffix("_")] = f
    return f


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def long_form(df: DataFrame, array: str, value: str, *keys: str) -> DataFrame:
    """(keys, pos, value) of an array of doubles."""
    return df.select(*keys, F.posexplode(array).alias("pos", value)).withColumn(value, F.round(value, 6))


def joined(ids: str) -> Column:
    return F.array_join(ids, ",")


# -- sources and sinks: the pair table written as files and read back --------------

def _csv_out(df: DataFrame, path: str) -> None:
    (
        df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )


@query
def read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    fr.pairs(spark, sf_dir).select(*PAIR_COLUMNS).write.json(path)
    return readers.read_jsonl(spark, path)


@query
def read_annotated_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "annotated")
    _csv_out(_annotated(spark, sf_dir).withColumn("note", F.upper("annotation")), path)
    columns = ["row_id", "context", "target", "annotation", "note"]
    return readers.read_annotated_csv(spark, path, columns, columns[:4], {"annotation": "label"}).withColumn(
        "row_id", F.col("row_id").cast("bigint")
    )


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.element_at(F.array(*[F.lit(x) for x in ("h", "n", "c", "other")]), (F.col("row_id") % 4 + 1).cast("int"))
    return fr.pairs(spark, sf_dir).select("row_id", "context", "target", letters.alias("annotation"))


@query
def read_csv_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    stance = sampling.random_split(
        pairs.label_to_int(pairs.pair_text(fr.pairs(spark, sf_dir), out="all_text")), "row_id"
    )
    files = {}
    for split in ("train", "val"):
        files[split] = scratch_path(spark, split)
        _csv_out(stance.where(F.col("split") == split).select("all_text", "label"), files[split])
    return readers.read_csv_splits(spark, files)


@query
def read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, line breaks and quotes included, as CSV files and back."""
    path = scratch_path(spark, "records")
    docs = fr.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    _csv_out(docs, path)
    return readers.read_records(spark, path, docs.schema).select(
        "doc_id", F.length("text").alias("length"), F.md5("text").alias("digest"), "source"
    )


@query
def read_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "tiered")
    split = sampling.random_split(fr.pairs(spark, sf_dir), "row_id")
    present = [("gold", "train"), ("gold", "val"), ("silver", "train"), ("silver", "val")]
    for tier, part in present:
        kept = split.where((F.col("tier") == tier) & (F.col("split") == part))
        kept.select(*PAIR_COLUMNS).write.json(f"{root}/{tier}/{part}.jsonl")
    return readers.read_tiered(spark, root, present)


@query
def write_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "artifact")
    artifacts.write_artifact(pairs.binarize_01(fr.pairs(spark, sf_dir)), path)
    return metrics.row_count(artifacts.read_artifact(spark, path), ["tier", "label"])


@query
def read_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "artifact")
    artifacts.write_artifact(fr.scored(spark, sf_dir), path)
    return artifacts.read_artifact(spark, path).select("row_id", "y_true", "y_pred")


@query
def materialize_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "once")
    artifacts.materialize_if_absent(spark, path, lambda: fr.imbalanced(spark, sf_dir))
    # the second call finds the stored copy and never computes this one
    return artifacts.materialize_if_absent(spark, path, lambda: fr.imbalanced(spark, sf_dir).where("false"))


@query
def recipe_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "recipes")
    p = fr.pairs(spark, sf_dir)
    for tier in ("gold", "silver"):
        rows = p.where(F.col("tier") == tier).drop("tier")
        artifacts.write_recipe(pairs.binarize_01(rows), root, tier, "train", 2)
        artifacts.write_recipe(pairs.label_to_int(rows), root, tier, "train", 3, null_ratio=0.25)
    kept = artifacts.read_recipe(spark, root, tier="gold", num_label=3)
    return kept.select("row_id", "label", "tier", "num_label", "null_ratio")


# -- projections -------------------------------------------------------------------

@query
def pair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_text(fr.pairs(spark, sf_dir)).select("row_id", "text")


@query
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.drop_columns(fr.pairs(spark, sf_dir))


@query
def label_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.label_to_int(fr.document_labels(spark, sf_dir)).select("row_id", "label")


@query
def binarize_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.binarize_01(fr.document_labels(spark, sf_dir)).select("row_id", "label")


@query
def merge_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.merge_neutral(fr.document_labels(spark, sf_dir)).select("row_id", "label")


@query
def letter_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.letter_label(_annotated(spark, sf_dir), "annotation").select("row_id", "label")


@query
def select_model_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.select_model_columns(pairs.binarize_01(fr.pairs(spark, sf_dir)), ["row_id", "target", "label"])


@query
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(fr.scored(spark, sf_dir), "probs", "prob", "row_id")


@query
def argmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.scored(spark, sf_dir).select("row_id", "y_pred")


@query
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fr.scored(spark, sf_dir).select("row_id", fn.confidence(F.col("probs")).alias("conf")), "conf")


@query
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = fr.logits(spark, sf_dir).withColumn("hot", fn.one_hot(F.col("y_true"), K))
    return long_form(hot.withColumn("back", fn.argmax_label(F.col("hot"))), "hot", "value", "row_id", "back")


@query
def class_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.scored(spark, sf_dir).select("row_id", fn.class_at(F.col("y_pred"), [10, 20, 30]).alias("cls"))


@query
def format_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = fr.steps(spark, sf_dir).groupBy("run").agg(F.sum("seconds").alias("seconds"))
    return total.select("run", fn.elapsed(F.col("seconds")).alias("took"))


@query
def normalize_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every seventh row sums to zero
    x = F.when(F.col("row_id") % 7 == 0, F.array_repeat(F.lit(0.0), K)).otherwise(
        F.array(*[F.abs(F.col("scores")[i]) for i in range(K)])
    )
    made = fr.logits(spark, sf_dir).withColumn("x", x).withColumn("x", fn.normalize_scores(F.col("x"), K))
    return long_form(made, "x", "share", "row_id")


# -- encoding ----------------------------------------------------------------------

def _whole_vocab(df: DataFrame, *columns: str) -> DataFrame:
    return encoding.build_vocab(df, columns, None)


@query
def build_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.build_vocab(fr.table(spark, sf_dir, "documents"), "text", 50_000)


def _encoded(df: DataFrame) -> DataFrame:
    return df.select("row_id", joined("input_ids").alias("ids"), joined("attention_mask").alias("mask"))


@query
def encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pairs.pair_text(fr.pairs(spark, sf_dir))
    return _encoded(encoding.encode_text(texts, _whole_vocab(texts, "text")))


@query
def encode_text_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pairs.pair_text(fr.pairs(spark, sf_dir))
    return _encoded(encoding.encode_text(texts, _whole_vocab(texts, "text"), inline=1_000))


@query
def encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fr.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return _encoded(encoding.encode_text(docs, _whole_vocab(docs, "text")))


@query
def encode_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fr.pairs(spark, sf_dir)
    return _encoded(encoding.encode_pair(rows, _whole_vocab(rows, "context", "target")))


@query
def encode_pair_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a length that most pairs exceed
    rows = fr.pairs(spark, sf_dir)
    return _encoded(encoding.encode_pair(rows, _whole_vocab(rows, "context", "target"), max_length=96))


@query
def pair_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = fr.pairs(spark, sf_dir).select(
        "row_id", F.size(fn.tokens(F.col("target"))).alias("la"), F.size(fn.tokens(F.col("context"))).alias("lb")
    )
    return encoding.pair_truncation(sizes, "la", "lb", 101)


@query
def pad_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fr.pairs(spark, sf_dir)
    lists = encoding.token_ids(rows, _whole_vocab(rows, "target"), {"input_ids": "target"}, "row_id", 14)
    return _encoded(encoding.pad_and_mask(lists, 16))


@query
def dynamic_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fr.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), "text")
    return _encoded(encoding.encode_text(texts, _whole_vocab(texts, "text"), pad="longest"))


@query
def unknown_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    # conversations, with the vocabulary of the documents
    turns = fr.table(spark, sf_dir, "conversations").select((F.col("conv_id") * fr.TURNS + F.col("turn")).alias("row_id"), "text")
    vocab = _whole_vocab(fr.table(spark, sf_dir, "documents"), "text")
    return rounded(encoding.unknown_share(encoding.encode_text(turns, vocab)), "unknown_share")


@query
def embed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = learning.embed_rows(pairs.pair_text(fr.pairs(spark, sf_dir)))
    norm = F.sqrt(F.aggregate("hidden_state", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    slots = [F.round(F.col("hidden_state")[i].cast("double"), 6).alias(f"slot_{i}") for i in (0, 300, 767)]
    return made.select("row_id", F.size("hidden_state").alias("width"), F.round(norm, 6).alias("norm"), *slots)


@query
def embed_rows_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of a loaded model, with one that SQL can repeat: sum of the real ids modulo 1000, and their number."""
    def load() -> Callable:
        def run(input_ids, attention_mask):  # noqa: ANN001, ANN202
            real = (input_ids * attention_mask).sum(axis=1) % 1_000
            return np.stack([real, attention_mask.sum(axis=1)], axis=1).astype("float32")

        return run

    rows = fr.pairs(spark, sf_dir)
    encoded = encoding.encode_pair(rows, _whole_vocab(rows, "context", "target"), max_length=128)
    made = learning.embed_rows(encoded, make_predict_fn=load, shapes=[[128], [128]])
    return made.select("row_id", F.col("hidden_state")[0].cast("int").alias("total"), F.col("hidden_state")[1].cast("int").alias("n"))


@query
def pack_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = learning.pack_features(fr.vectors(spark, sf_dir))
    return packed.select("row_id", "label", learning.vector_to_array("features").alias("v")).select(
        "row_id", "label", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total")
    )


# -- filters, joins, unions ----------------------------------------------------------

@query
def silver_minority_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.silver_minority_only(fr.pairs(spark, sf_dir)).select("row_id", "tier", "label")


@query
def label_isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.label_isin(_annotated(spark, sf_dir), label="annotation").select("row_id", "annotation")


@query
def class_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.class_partition(fr.imbalanced(spark, sf_dir), 1)


@query
def confident_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.confident_rows(fr.scored(spark, sf_dir)).select("row_id", "y_pred")


@query
def attach_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fr.scored(spark, sf_dir)
    return pairs.attach_predictions(scored.select("row_id", "y_true"), scored.select("row_id", "y_pred"))


@query
def take_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fr.scored(spark, sf_dir)
    return pairs.take_indices(scored.select("row_id", "y_true"), pairs.confident_rows(scored))


@query
def remaining_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fr.scored(spark, sf_dir)
    return pairs.remaining_rows(scored.select("row_id", "y_true"), pairs.confident_rows(scored))


@query
def consecutive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.consecutive_pairs(fr.table(spark, sf_dir, "conversations"))


@query
def union_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, silver = fr.tiers(spark, sf_dir)
    return pairs.union_tiers(gold.drop("tier"), silver.drop("tier")).select("row_id", "tier", "label")


@query
def append_pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, pool = fr.halves(fr.scored(spark, sf_dir))
    labelled = train.select("row_id", F.col("y_true").alias("label"))
    return pairs.append_pseudo_labels(labelled, pairs.confident_rows(pool).select("row_id", F.col("y_pred").alias("label")))


@query
def with_row_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    # event type and hour repeat, so the table is full of equal rows
    rows = fr.table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("hour"))
    return pairs.with_row_id(rows)


# -- sampling and ordering -----------------------------------------------------------

@query
def upsample_to_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.upsample_to_majority(fr.imbalanced(spark, sf_dir), "label", "row_id")


@query
def upsample_by_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.upsample_by_factor(fr.imbalanced(spark, sf_dir), "label", "row_id")


@query
def upsample_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.upsample_poisson(fr.imbalanced(spark, sf_dir), "label", "row_id")


@query
def inject_null_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.inject_null_context(fr.pairs(spark, sf_dir), 0.25, "row_id").select("row_id", "context")


@query
def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffle_rows(fr.steps(spark, sf_dir).select("row_id", "run"), "row_id", position="position")


@query
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_split(fr.steps(spark, sf_dir).select("row_id"), "row_id")


@query
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batch_ids(fr.steps(spark, sf_dir).select("row_id"), 32, "row_id")


@query
def batch_ids_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batch_ids(with_row_id(spark, sf_dir).select("row_id"), 32, "row_id")


@query
def batch_ids_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batch_ids(fr.steps(spark, sf_dir).select("row_id"), 32, "row_id", order="random")


@query
def steps_per_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.steps_per_epoch(fr.steps(spark, sf_dir), 8)


@query
def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.global_index(fr.steps(spark, sf_dir).select("ts", "row_id"), ["ts", "row_id"])


@query
def global_index_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    # three values of the leading key share all rows
    rows = fr.steps(spark, sf_dir).select((F.col("row_id") % 3).alias("part"), "row_id")
    return ordering.global_index(rows, ["part", "row_id"])


@query
def running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fr.steps(spark, sf_dir).select("ts", "row_id", "loss")
    out = ordering.running_sum(rows, ["ts", "row_id"], {"running_loss": "loss"}, count="step")
    return rounded(out.select("row_id", "step", "running_loss"), "running_loss", places=4)


@query
def running_sum_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fr.steps(spark, sf_dir).select("run", "ts", "row_id", "loss")
    out = ordering.running_sum(rows, ["ts", "row_id"], {"running_loss": "loss"}, "run", count="step")
    return rounded(out.select("run", "row_id", "step", "running_loss"), "running_loss", places=4)


@query
def exact_k_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.exact_k_by_hash(fr.steps(spark, sf_dir).select("row_id"), lambda n: n // 3, "row_id", 7)


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fr.steps(spark, sf_dir).select("run", "row_id", (F.col("loss") / 10).alias("loss"))
    return training_log.best_so_far(rows, "loss", "row_id", "run")


@query
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir)


@query
def select_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_log.select_checkpoint(_flagged(spark, sf_dir), "row_id", "run")


def _arriving(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """The step log as a stream of files that were written one after another, each a range of row ids; one per micro-batch."""
    path, steps = scratch_path(spark, "arriving"), fr.steps(spark, sf_dir)
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = [None, *sorted(set(steps.agg(F.percentile_approx("row_id", shares, 10_000)).first()[0] or [])), None]
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = steps if low is None else steps.where(F.col("row_id") >= low)
        part = part if high is None else part.where(F.col("row_id") < high)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def best_so_far_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of ``best_so_far``, from micro-batches with the state of each run."""
    steps = _arriving(spark, sf_dir).withColumn("loss", F.col("loss") / 10)
    flagged = step_log.best_so_far_stream(steps, "loss", "row_id", "run")
    out = scratch_path(spark, "flags")
    step_log.write_flags(flagged, out, scratch_path(spark, "flags-checkpoint"), availableNow=True).awaitTermination()
    return spark.read.schema(flagged.schema).parquet(out).select("run", "row_id", "loss", "saved")


@query
def epoch_stats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``epoch_stats`` after the last micro-batch."""
    out = scratch_path(spark, "epochs")
    step_log.write_epoch_stats(_arriving(spark, sf_dir), out, scratch_path(spark, "epochs-checkpoint"), availableNow=True).awaitTermination()
    return rounded(spark.read.parquet(versions.versions(spark, out)[-1]), "train_loss", "valid_loss", "valid_accuracy")


# -- evaluation ------------------------------------------------------------------------

@query
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.row_count(fr.pairs(spark, sf_dir), "tier")


@query
def distinct_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_classes(fr.document_labels(spark, sf_dir))


@query
def prediction_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.prediction_distribution(fr.scored(spark, sf_dir), "y_pred", [0, 1, 2, 3]), "share")


@query
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_counts(fr.scored(spark, sf_dir))


@query
def confusion_joint_T(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion_joint_T(fr.scored(spark, sf_dir)), "share")


@query
def confusion_row_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion_row_normalized(fr.scored(spark, sf_dir)), "share")


@query
def one_vs_rest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.one_vs_rest_counts(fr.scored(spark, sf_dir))


@query
def precision_recall_f1_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.precision_recall_f1_accuracy(fr.scored(spark, sf_dir))
    return rounded(out, "precision", "recall", "f1", "accuracy")


@query
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.accuracy(fr.scored(spark, sf_dir)), "accuracy")


@query
def weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.weighted_f1(fr.scored(spark, sf_dir)), "weighted_f1")


@query
def binary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.binary_f1(fr.flags(spark, sf_dir)), "f1")


@query
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cohen_kappa(fr.scored(spark, sf_dir)), "cohen_kappa")


@query
def roc_auc_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc_hard(fr.flags(spark, sf_dir)), "roc_auc")


@query
def roc_auc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc_scores(fr.document_labels(spark, sf_dir), score="n_chars"), "roc_auc")


@query
def percent_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.percent_accuracy(fr.flags(spark, sf_dir)), "percent_accuracy")


@query
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cross_entropy(fr.logits(spark, sf_dir), K), "cross_entropy")


@query
def cross_entropy_double_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cross_entropy(fr.logits(spark, sf_dir), K, double_softmax=True), "cross_entropy")


@query
def binary_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.binary_cross_entropy(fr.scored(spark, sf_dir), K), "binary_cross_entropy")


def _batched_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batch_ids(fr.flags(spark, sf_dir), 16, "row_id")


@query
def batch_mean_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.batch_mean_metric(_batched_flags(spark, sf_dir), "batch_id"), "accuracy")


@query
def batch_mean_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.batch_mean_metric(_batched_flags(spark, sf_dir), "batch_id", "f1"), "f1")


@query
def batch_mean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("row_id") % 2 == 0, "train").otherwise("valid")
    rows = _batched_flags(spark, sf_dir).withColumn("loss", fn.nll(F.col("probs"), F.col("y_true"), 2)).withColumn("phase", phase)
    made = metrics.batch_mean_report(rows, "batch_id")
    return rounded(made, *[c for c in made.columns if c != "phase"])


@query
def loss_over_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fr.logits(spark, sf_dir).withColumn("loss", fn.nll(F.col("scores"), F.col("y_true"), K))
    return rounded(metrics.loss_over_dataset(sampling.batch_ids(rows, 32, "row_id"), "batch_id"), "loss")


@query
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.majority_baseline(pairs.label_to_int(fr.document_labels(spark, sf_dir))), "accuracy")


@query
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.metric_report(fr.scored(spark, sf_dir)), "accuracy", "f1")


@query
def metric_report_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.metric_report(fr.flags(spark, sf_dir), kind="binary"), "cohen_kappa", "f1", "roc_auc")


@query
def metric_report_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _batched_flags(spark, sf_dir).withColumn("loss", fn.nll(F.col("probs"), F.col("y_true"), 2))
    out = metrics.metric_report(rows, kind="loss", batch="batch_id")
    return rounded(out, "loss", "accuracy", "f1", "roc_auc")


@query
def epoch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(training_log.epoch_stats(fr.steps(spark, sf_dir)), "train_loss", "valid_loss", "valid_accuracy")


@query
def rows_to_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = training_log.epoch_stats(fr.steps(spark, sf_dir))
    return rounded(training_log.rows_to_series(stats, "epoch", ["train_loss", "valid_loss", "valid_accuracy"]), "value")


@query
def epoch_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = rounded(training_log.epoch_stats(fr.steps(spark, sf_dir)), "valid_accuracy")
    return training_log.epoch_series(stats, "valid_accuracy")


# -- label shift -------------------------------------------------------------------------

@query
def shift_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shift.shift_weights(*fr.halves(fr.scored(spark, sf_dir))), "w")


@query
def shift_weights_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shift.shift_weights(*fr.halves(fr.flags(spark, sf_dir)), clip=False), "w")


@query
def shift_weights_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a model that always says 0: the confusion matrix has an empty row
    rows = fr.flags(spark, sf_dir).withColumn("y_pred", F.lit(0))
    return shift.shift_weights(*fr.halves(rows))


@query
def clip_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = fr.table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("cls")).agg(
        F.avg(F.col("embedding")[0].cast("double")).alias("w")
    )
    return rounded(shift.clip_negative(weights), "w")


def _test_and_weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    validation, test = fr.halves(fr.scored(spark, sf_dir))
    return test, shift.shift_weights(validation, test)


@query
def apply_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(shift.apply_class_weights(*_test_and_weights(spark, sf_dir)), "weighted", "value", "row_id")


@query
def adjust_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(shift.adjust_probs(*_test_and_weights(spark, sf_dir)), "new_probs", "prob", "row_id")


@query
def update_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift.update_probs(*_test_and_weights(spark, sf_dir)).select("row_id", "y_pred", "new_pred")


@query
def shift_corrected_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shift.shift_corrected_evaluation(*fr.halves(fr.flags(spark, sf_dir)))
    return rounded(out, "f1", "cohen_kappa", "roc_auc")


# -- learning ------------------------------------------------------------------------------

def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.pack_features(fr.vectors(spark, sf_dir)).drop("hidden_state")


def _thirds(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(df.where(F.col("row_id") % 3 == i) for i in range(3))


def _slopes(model: object, df: DataFrame, total: float, **names: str) -> DataFrame:
    """Derivatives of the loss at the fitted weights, which are zero at its minimum."""
    made = learning.loss_slopes(model, df, 1.0 / total, **names)
    # no minus zero
    return made.select("cls", "pos", (F.round("slope", 4) + F.lit(0.0)).alias("slope"))


def _scored(model: object, test: DataFrame, label: str = "label") -> DataFrame:
    """Unseen rows with prediction and probabilities, scored once and stored: a filter on the scores would score the rows again."""
    both = learning.predict_proba(model, learning.predict(model, test, "y_pred"))
    return cut_lineage(both.select("row_id", F.col(label).alias("label"), "y_pred", "probs"), "scored")


def _held_out(scored: DataFrame, k: int) -> DataFrame:
    """One row per unseen row: is the prediction the class of the largest of k probabilities that add up to 1?"""
    total = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    return scored.select(
        "row_id", "label", F.size("probs").alias("k"), F.round(total, 6).alias("total"),
        (F.col("probs")[F.col("y_pred")] == F.array_max("probs")).alias("best"),
    ).where(F.col("k") == k)


@query
def fit_linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on all rows; ``predict`` and ``predict_proba`` score unseen ones."""
    train = _features(spark, sf_dir)
    return _slopes(learning.fit_linear_probe(train), train, train.count())


def _with_bias(model: object, train: DataFrame, held_out: DataFrame, k: int) -> DataFrame:
    """The rows with the mean distance of probabilities from labels, by class: zero for fitted output biases and no others."""
    far = [F.abs(F.avg(F.col("probs")[c] - (F.col("label") == c).cast("double"))) for c in range(k)]
    bias = learning.predict_proba(model, train).agg(F.round(F.greatest(*far), 3).alias("bias"))
    return held_out.withColumn("bias", bias.scalar())


@query
def fit_mlp_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = fr.halves(_features(spark, sf_dir))
    model = learning.fit_mlp_head(train, [64, 64, 2])
    return _with_bias(model, train, _held_out(_scored(model, test), 2), 2)


def _plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components of each vector as features, so that SQL can repeat the fit."""
    return learning.pack_features(fr.vectors(spark, sf_dir).withColumn("hidden_state", F.slice("hidden_state", 1, 2))).select("row_id", "features", "label")


@query
def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on one half, applied to the other."""
    train, test = fr.halves(_plane(spark, sf_dir))
    return learning.predict(learning.fit_logistic(train), test).select("row_id", "label", "prediction")


@query
def predict_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = fr.halves(_plane(spark, sf_dir))
    return long_form(learning.predict_proba(learning.fit_logistic(train), test), "probs", "prob", "row_id")


@query
def train_and_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on a third, weigh by a second, and evaluate on the last before and after the correction."""
    train, validation, test = _thirds(_plane(spark, sf_dir))
    model = learning.fit_logistic(train)

    def scored(df: DataFrame) -> DataFrame:
        both = learning.predict_proba(model, learning.predict(model, df, "y_pred"))
        return both.select("row_id", F.col("label").alias("y_true"), "y_pred", "probs")

    report = shift.shift_corrected_evaluation(scored(validation), scored(test))
    return rounded(report, "f1", "cohen_kappa", "roc_auc")


@query
def self_train_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, pool = fr.halves(fr.scored(spark, sf_dir))
    grown, rest, converged = learning.self_train_step(
        train.select("row_id", F.col("y_true").alias("label")), pool.select("row_id"), pool.select("row_id", "probs")
    )
    left = rest.select("row_id", F.lit(-1).alias("label"), F.lit("pool").alias("origin"))
    return grown.unionByName(left).withColumn("converged", F.lit(converged))


@query
def self_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row ended and under which label, and when the loop stopped."""
    train, pool = fr.halves(_plane(spark, sf_dir))
    _, grown, rest, history = learning.self_train(train, pool.drop("label"), threshold=0.55, min_moved=5)
    left = rest.select("row_id", F.lit(None).cast("int").alias("label"), F.lit("pool").alias("origin"))
    return grown.select("row_id", "label", "origin").unionByName(left).withColumns(
        {"rounds": F.lit(len(history)), "converged": F.lit(history[-1]["converged"])}
    )


@query
def two_phase_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of the losses that both phases minimise, fitted on all rows: a third of them gold and the rest silver."""
    df = _features(spark, sf_dir)
    gold, silver = df.where(F.col("row_id") % 3 == 0), df.where(F.col("row_id") % 3 != 0)
    first, second = learning.phase_fits(gold, silver, label="stance", tie=0.1, classes=3)
    n, n_gold = df.count(), gold.count()
    slopes = learning.loss_slopes(first, df, 1 / n, "stance").withColumn("phase", F.lit(1)).unionByName(
        learning.loss_slopes(second, gold, 1 / (0.1 * n_gold), "stance", center=first).withColumn("phase", F.lit(2))
    )
    return slopes.select("phase", "cls", "pos", (F.round("slope", 6) + F.lit(0.0)).alias("slope"))


@query
def two_phase_fit_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both phases as one fit weighted by exposure, on all rows."""
    df = _features(spark, sf_dir)
    gold, silver = df.where(F.col("row_id") % 3 == 0), df.where(F.col("row_id") % 3 != 0)
    weighed = gold.withColumn("times", F.lit(9)).unionByName(silver.withColumn("times", F.lit(2)))
    weight = weighed.agg(F.sum("times")).first()[0]
    return _slopes(learning.two_phase_fit(gold, silver, label="stance"), weighed, weight, label="stance", weight="times")


@query
def two_phase_fit_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, silver, test = _thirds(_features(spark, sf_dir))
    return _held_out(_scored(learning.two_phase_fit(gold, silver, label="stance"), test, "stance"), 3)


@query
def transfer_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on all rows, half of them for the source task and half for the target task."""
    source, target = fr.halves(_features(spark, sf_dir))
    model = learning.transfer_fit(source, target, "stance", "label")
    first, stack, second = model.stages
    stacked = stack.transform(first.transform(target)).select("row_id", "label", "stacked")
    return _slopes(second, stacked, target.count(), features="stacked")


@query
def transfer_fit_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target, test = _thirds(_features(spark, sf_dir))
    return _held_out(_scored(learning.transfer_fit(source, target, "stance", "label"), test), 2)


@query
def fit_text_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows; is the model better on them than the class that is most frequent there?"""
    # the texts are joined with their labels once, not for each pass over them
    df = cut_lineage(pairs.label_to_int(fr.document_labels(spark, sf_dir)).select("row_id", "text", "label"), "labelled")
    train, test = fr.halves(df)
    model = learning.fit_text_classifier(train)
    scored = _scored(model, test)
    predicted = scored.select(F.col("label").alias("y_true"), "y_pred")
    reached = metrics.accuracy(predicted).scalar() > metrics.majority_baseline(predicted, "y_true").select("accuracy").scalar()
    return _with_bias(model, train, _held_out(scored, 3), 3).withColumn("beats_majority", reached)


# -- recipes ---------------------------------------------------------------------------------

@query
def prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and silver training rows, each upsampled, with a quarter of the contexts blanked, under an encoding of its own."""
    root, store = scratch_path(spark, "corpus"), scratch_path(spark, "store")
    out = None
    for tier, rows in zip(("gold", "silver"), fr.tiers(spark, sf_dir), strict=True):
        rows.select(*PAIR_COLUMNS).write.json(f"{root}/{tier}/train.jsonl")
        made = recipes.prepare(
            spark, root, store, tier, "train", upsampling=True, num_label=2, null_ratio=0.25, vocab_size=None
        )
        width = made["hidden"].select("row_id", "draw_no", F.size("hidden_state").alias("width"))
        part = made["tokens"].join(width, ["row_id", "draw_no"]).select(
            F.lit(tier).alias("tier"), "row_id", "draw_no", "label", joined("input_ids").alias("ids"), joined("attention_mask").alias("mask"), "width"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def prepared_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes of both tiers under one encoding, read back as partitions of one table; the second call finds them stored."""
    root, store = scratch_path(spark, "corpus"), scratch_path(spark, "store")
    for tier, rows in zip(("gold", "silver"), fr.tiers(spark, sf_dir), strict=True):
        rows.select(*PAIR_COLUMNS).write.json(f"{root}/{tier}/train.jsonl")
    words = recipes.fit_encoding(recipes.keyed_source(spark, root, store, "gold", "train"), store, "words", vocab_size=None)
    for _ in range(2):
        for tier, n in (("gold", 2), ("silver", 2), ("silver", 3)):
            recipes.prepare(spark, root, store, tier, "train", words, num_label=n, output_vectors=False, max_length=64)
    return recipes.read_prepared(spark, words, num_label=2).groupBy("tier", "num_label", "upsampled", "label").agg(
        F.count("*").alias("n"), F.sum(F.size("input_ids")).alias("ids")
    )


@query
def prepare_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation rows under one encoding, fitted on the training rows."""
    root, store = scratch_path(spark, "corpus"), scratch_path(spark, "store")
    gold = sampling.random_split(fr.tiers(spark, sf_dir)[0], "row_id")
    for split in ("train", "val"):
        gold.where(F.col("split") == split).select(*PAIR_COLUMNS).write.json(f"{root}/gold/{split}.jsonl")
    encoding_ = recipes.fit_encoding(recipes.keyed_source(spark, root, store, "gold", "train"), store, "words", vocab_size=None)
    out = None
    for split in ("train", "val"):
        made = recipes.prepare(spark, root, store, "gold", split, encoding_)
        width = made["hidden"].select("row_id", F.size("hidden_state").alias("width"))
        part = made["tokens"].join(width, "row_id").select(
            F.lit(split).alias("split"), "row_id", "label", joined("input_ids").alias("ids"), "width")
        out = part if out is None else out.unionByName(part)
    return out


@query
def prepare_gold_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.prepare_gold_silver(*fr.tiers(spark, sf_dir)).select("row_id", "tier", "label")


@query
def prepare_minority_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.prepare_minority_boost(*fr.tiers(spark, sf_dir)).select("row_id", "tier", "label", "draw_no")


@query
def prepare_annotated_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recipes.prepare_annotated_test(_annotated(spark, sf_dir), "annotation")
    return out.select("row_id", F.col("annotation").alias("label"))
