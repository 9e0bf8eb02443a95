"""Vectors, classifiers and self-training on ``pyspark.ml``.

Fitting runs as distributed gradient aggregation; scoring is a map over the rows.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from inspect import signature
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duotext.functions import scores as sc
from duotext.functions import text as tx
from duotext.functions.hashing import as_list
from duotext.operators.newton import Logistic, fit_logistic
from duotext.operators.pairs import append_pseudo_labels
from duotext.runtime import cut_lineage
from duotext.schema import VECTOR_SIZE

MIN_MOVED = 50  # fixed value: fewer moved rows end self-training
THRESHOLD = 0.8  # fixed value: confidence above which a row is moved


# -- vectors ---------------------------------------------------------------------

@dataclass(frozen=True)
class DocumentFrequencies:
    """How many of ``documents`` texts have a term in each slot of a vector."""

    documents: int
    counts: tuple[int, ...]

    def weights(self) -> list[float]:
        return [math.log((self.documents + 1) / (n + 1)) for n in self.counts]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(slot, n, self.documents) for slot, n in enumerate(self.counts)]
        return spark.createDataFrame(rows, "slot int, n bigint, documents bigint")

    @staticmethod
    def of(table: DataFrame) -> DocumentFrequencies:
        rows = sorted(table.collect())
        return DocumentFrequencies(rows[0]["documents"], tuple(r["n"] for r in rows))


def embed_rows(
    df: DataFrame, text: str = "text", make_predict_fn: Callable | None = None,
    inputs: Sequence[str] = ("input_ids", "attention_mask"), shapes: Sequence[Sequence[int]] | None = None,
    batch_size: int = 32, size: int = VECTOR_SIZE, out: str = "hidden_state", idf: DocumentFrequencies | None = None,
) -> DataFrame:
    """One vector per row.

    With ``make_predict_fn`` (a function that loads a model and returns a batch
    function over numpy arrays) the model runs over Arrow batches of ``inputs``; a
    batch of ``batch_size`` rows is what one call sees.  Without it, vectors are
    hashed term counts of ``text`` (a term's slot: the first 8 hex digits of its md5 modulo ``size``) times the
    logarithm of (n + 1) / (texts with the slot + 1): those of ``idf`` (see ``fit_idf``; the same for all splits), or
    else of this table.
    """
    if make_predict_fn is not None:
        udf = predict_batch_udf(
            make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
            input_tensor_shapes=[list(s) for s in shapes] if shapes else None,
        )
        return df.withColumn(out, udf(*inputs))
    model = fit_idf(df, text, size) if idf is None else idf
    weights, width, counts_of = np.array(model.weights()), len(model.counts), _slot_counts

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(tokens: pa.Array) -> pa.Array:
        vectors, at = np.empty((len(tokens), width), np.float32), 0
        for counts in counts_of(tokens, width):
            vectors[at:at + len(counts)] = counts * weights
            at += len(counts)
        ends = pa.array(np.arange(len(tokens) + 1) * width, pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))

    return df.withColumn(out, embed(tx.tokens(F.col(text))))


def _slot_counts(tokens: pa.Array, size: int, rows: int = 512) -> Iterator[np.ndarray]:
    """Counts of the slots of each token list, for some lists at a time; each distinct token is hashed once."""
    for start in range(0, len(tokens), rows):
        part = tokens.slice(start, rows)
        words = part.flatten().dictionary_encode()
        slots = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % size for w in words.dictionary.to_pylist()], np.int64)
        cells = pc.list_parent_indices(part).to_numpy() * size + (slots[words.indices.to_numpy()] if len(words) else 0)
        yield np.bincount(cells, minlength=len(part) * size).reshape(len(part), size)


def fit_idf(df: DataFrame, text: str = "text", size: int = VECTOR_SIZE) -> DocumentFrequencies:
    """Document frequencies of hashed terms; a task sends one row per slot."""
    counts_of = _slot_counts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for counts in counts_of(batch.column(0), size):
                total[:size] += (counts > 0).sum(0)
                total[size] += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1), pa.int32()), pa.array(total)], ["slot", "n"])

    rows = df.select(tx.tokens(F.col(text)).alias("tokens")).mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = dict(map(tuple, rows.collect()))
    return DocumentFrequencies(found.get(size, 0), tuple(found.get(i, 0) for i in range(size)))


def pack_features(df: DataFrame, col: str = "hidden_state", out: str = "features") -> DataFrame:
    """An array column as the vector column that learners read."""
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


# -- classifiers -----------------------------------------------------------------

MAX_ITER = 10_000  # a safeguard: a fit that gets there has not converged, and fails


def iterations(model: Model | Logistic) -> int:
    """Iterations that a fit took."""
    if isinstance(model, Logistic):
        return model.iterations
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    summary = last.summary
    return (summary() if callable(summary) else summary).totalIterations


def _converged(model: Model, max_iter: int) -> Model:
    if (took := iterations(model)) >= max_iter:
        raise RuntimeError(f"the fit has not converged after {took} iterations")
    return model


def fit_linear_probe(
    train: DataFrame, label: str = "label", features: str = "features", C: float = 1.0, max_iter: int = MAX_ITER,
    n: int | None = None,
) -> Model:
    """L2 logistic regression to convergence; ``regParam = 1 / (C n)`` gives the usual inverse strength C.

    ``n``, the number of rows, is counted unless given.
    """
    n = train.count() if n is None else n
    return _converged(LogisticRegression(
        featuresCol=features, labelCol=label, maxIter=max_iter, regParam=1.0 / (C * n), elasticNetParam=0.0,
        standardization=False,
    ).fit(train), max_iter)


def fit_mlp_head(
    train: DataFrame, layers: Sequence[int], label: str = "label", features: str = "features", seed: int = 42,
    max_iter: int = MAX_ITER,
) -> PipelineModel:
    """A classifier with one hidden layer, ``layers = [inputs, hidden, classes]``, over standardised inputs.

    Differs from a hand-trained tanh head: the hidden units are sigmoids, the
    optimiser is L-BFGS and there is no dropout.  Inputs of small scale, such as the components of vectors of length
    one, would leave all units nearly linear and L-BFGS creeping; standardised ones need far fewer passes.
    """
    scaler = StandardScaler(inputCol=features, outputCol="__scaled", withMean=True, withStd=True).fit(train)
    learner = MultilayerPerceptronClassifier(layers=list(layers), featuresCol="__scaled", labelCol=label, seed=seed, maxIter=max_iter)
    return PipelineModel(stages=[scaler, _converged(learner.fit(scaler.transform(train)), max_iter)])


def predict(model: Model | Logistic, df: DataFrame, out: str = "prediction") -> DataFrame:
    """The input columns and the predicted class."""
    if isinstance(model, Logistic):
        return df.withColumn(out, sc.argmax_label(model.probs()))
    scored = model.transform(df)
    return scored.select(*df.columns, F.col(model_column(model, "predictionCol")).cast("int").alias(out))


def predict_proba(model: Model | Logistic, df: DataFrame, out: str = "probs") -> DataFrame:
    """The input columns and the probabilities of all classes."""
    if isinstance(model, Logistic):
        return df.withColumn(out, model.probs())
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array(F.col(model_column(model, "probabilityCol"))).alias(out))


def model_column(model: Model, name: str) -> str:
    """Output column of a model, or of the last stage of a pipeline."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    return last.getOrDefault(name)


def phase_fits(
    gold: DataFrame, silver: DataFrame, label: str = "label", features: str = "features", C: float = 1.0, tie: float = 1.0,
    classes: int = 2,
) -> tuple[Logistic, Logistic]:
    """The models after two phases: mixed data first, then gold alone.

    The second phase starts at the weights of the first and stays tied to them: its penalty is
    the squared distance from them, divided by ``2 * tie``.  The smaller ``tie``, the less gold moves them.
    """
    columns = [label, features]
    mixed = cut_lineage(gold.select(*columns, F.lit(True).alias("gold")).unionByName(silver.select(*columns, F.lit(False).alias("gold"))), "phases")
    first = fit_logistic(mixed, label, features, C, classes)
    return first, fit_logistic(mixed.where("gold"), label, features, tie, classes, start=first, center=first)


def two_phase_fit(
    gold: DataFrame, silver: DataFrame, label: str = "label", features: str = "features", phase1: int = 2,
    phase2: int = 7, C: float = 1.0, max_iter: int = MAX_ITER,
) -> Model:
    """Mixed data for ``phase1`` passes, then gold for ``phase2``, as one fit weighted by exposure (``phase_fits`` keeps them apart)."""
    def weighted(df: DataFrame, times: int) -> DataFrame:
        return df.select(label, features, F.lit(float(times)).alias("weight"))

    mixed = weighted(gold, phase1 + phase2).unionByName(weighted(silver, phase1))
    n = mixed.agg(F.sum("weight")).first()[0]
    return _converged(LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="weight", maxIter=max_iter, regParam=1.0 / (C * n),
        standardization=False, family="multinomial",
    ).fit(mixed), max_iter)


def transfer_fit(
    source: DataFrame, target: DataFrame, source_label: str = "label", target_label: str = "label",
    features: str = "features", C: float = 1.0, max_iter: int = MAX_ITER,
) -> PipelineModel:
    """Fit on a source task, then on the target task with the source's probabilities as extra features."""
    def learner(n: int, label: str, inputs: str, prefix: str) -> LogisticRegression:
        return LogisticRegression(
            featuresCol=inputs, labelCol=label, maxIter=max_iter, regParam=1.0 / (C * n), standardization=False,
            predictionCol=f"{prefix}prediction", probabilityCol=f"{prefix}probability",
            rawPredictionCol=f"{prefix}raw",
        )

    first = _converged(learner(source.count(), source_label, features, "source_").fit(source), max_iter)
    stack = VectorAssembler(inputCols=[features, "source_probability"], outputCol="stacked")
    stacked = stack.transform(first.transform(target))
    second = _converged(learner(target.count(), target_label, "stacked", "").fit(stacked), max_iter)
    return PipelineModel(stages=[first, stack, second])


def fit_text_classifier(
    train: DataFrame, text: str = "text", label: str = "label", num_features: int = 1 << 16, max_iter: int = MAX_ITER,
    reg: float = 0.01,
) -> PipelineModel:
    """Text to class, end to end and to convergence, for two or more classes.

    The weighted term counts are stored once; all passes of the fit read those.
    """
    terms = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"\s+"),
        HashingTF(numFeatures=num_features, inputCol="__words", outputCol="__tf"),
        IDF(inputCol="__tf", outputCol="__tfidf"),
    ]).fit(train)
    rows = cut_lineage(terms.transform(train).select(label, "__tfidf"), "text-terms")
    learner = LogisticRegression(
        featuresCol="__tfidf", labelCol=label, family="multinomial", maxIter=max_iter, regParam=reg
    )
    return PipelineModel(stages=[*terms.stages, _converged(learner.fit(rows), max_iter)])


def _times(x: Column, factor: Column) -> Column:
    return F.transform(x, lambda v: v * factor)


def loss_slopes(
    model: Model | Logistic, df: DataFrame, reg: float, label: str = "label", features: str = "features", weight: str | None = None,
    center: Logistic | None = None,
) -> DataFrame:
    """Derivative of the regularised mean log loss by each coefficient: ``(cls, pos, slope)``.

    All zero at the optimum.  ``pos`` -1 is the intercept, which is not regularised.  Two
    classes of a binomial model share one coefficient row, that of class 1.  The penalty is centred at
    the weights of ``center``, if given.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    own = isinstance(model, Logistic)
    coefficients, k = (model.weights[:, 1:], model.classes) if own else (model.coefficientMatrix.toArray(), model.numClasses)
    if center is not None:
        coefficients = coefficients - center.weights[:, 1:]
    classes = [1] if len(coefficients) == 1 else list(range(k))
    scored = predict_proba(model, df, "__p").select(
        w.alias("w"), F.concat(F.array(F.lit(1.0)), vector_to_array(F.col(features))).alias("x"),
        F.array(*[F.col("__p")[c] - (F.col(label) == c).cast("double") for c in classes]).alias("r"),
    )
    # summed as one vector per class inside the tasks
    sums = scored.select("w", *[
        array_to_vector(_times(F.col("x"), F.col("r")[i])).alias(f"g{i}") for i in range(len(classes))
    ]).agg(F.sum("w").alias("n"), *[Summarizer.mean(F.col(f"g{i}"), F.col("w")).alias(f"g{i}") for i in range(len(classes))])
    rows = [
        sums.select(F.lit(c).alias("cls"), F.posexplode(F.zip_with(
            vector_to_array(F.col(f"g{i}")), F.array(F.lit(0.0), *[F.lit(float(reg * v)) for v in coefficients[i]]), lambda a, b: a + b
        )).alias("pos", "slope")) for i, c in enumerate(classes)
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("pos", F.col("pos") - 1)


# -- self-training ---------------------------------------------------------------

def _split_by_confidence(scored: DataFrame, probs: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to move, rows to keep, one row with their numbers)."""
    # a row without a score is not confident
    sure = F.coalesce(sc.confidence(F.col(probs)) > threshold, F.lit(False))
    sizes = scored.agg(F.count_if(sure).alias("moved"), F.count_if(~sure).alias("left"))
    return scored.where(sure), scored.where(~sure), sizes


def self_train_step(
    train: DataFrame, pool: DataFrame, scores: DataFrame, key: str | Sequence[str] = "row_id",
    threshold: float = THRESHOLD, min_moved: int = MIN_MOVED, probs: str = "probs", label: str = "label",
) -> tuple[DataFrame, DataFrame, bool]:
    """Move confidently scored pool rows to the training rows, labelled by their best class.

    ``scores`` holds one probability array per pool key.  Returns the new training
    rows, the remaining pool, and whether fewer than ``min_moved`` rows moved (they
    are still added).
    """
    scored = pool.join(scores.select(*as_list(key), probs), as_list(key), "left")
    sure, unsure, sizes = _split_by_confidence(scored, probs, threshold)
    pseudo = sure.withColumn(label, sc.argmax_label(F.col(probs)))
    return (
        append_pseudo_labels(train, pseudo),
        unsure.select(*pool.columns),
        sizes.first()["moved"] < min_moved,
    )


def self_train(
    train: DataFrame, pool: DataFrame, fit: Callable[..., Model | Logistic] = fit_logistic,
    threshold: float = THRESHOLD, min_moved: int = MIN_MOVED, max_rounds: int | None = None, label: str = "label",
) -> tuple[Model | Logistic, DataFrame, DataFrame, list[dict]]:
    """Fit, score the pool, move the confident rows; repeat until few rows move or the pool is empty.

    The training rows are stored once; each round scores the pool once and writes the
    result to the shared folder, so plans do not grow with the rounds and lost executors
    cost no earlier round.  A ``fit`` with a parameter ``start`` goes on from the model of the round before
    (the learners of ``pyspark.ml`` take no initial weights in Python; they fit anew).  Returns the last
    model, training rows, remaining pool and one record per round, with the ``iterations`` of its fit, whose
    ``converged`` tells why it ended (false only under ``max_rounds``).
    """
    history: list[dict] = []
    train, model = cut_lineage(train, "self-train"), None
    warm = "start" in signature(fit).parameters
    for step in count(1):
        model = fit(train, start=model) if warm else fit(train)
        scored = cut_lineage(predict_proba(model, pool, "__probs"), f"self-train-{step}")
        sure, unsure, sizes = _split_by_confidence(scored, "__probs", threshold)
        size = sizes.first()
        train = append_pseudo_labels(train, sure.withColumn(label, sc.argmax_label(F.col("__probs"))))
        pool = unsure.select(*pool.columns)
        converged = size["moved"] < min_moved or size["left"] == 0
        history.append({
            "round": step, "iterations": iterations(model), "moved": size["moved"], "left": size["left"], "converged": converged
        })
        if converged or step == max_rounds:
            break
    return model, train, pool, history


# functions that hash terms travel to the executors with the query
cloudpickle.register_pickle_by_value(sys.modules[__name__])
