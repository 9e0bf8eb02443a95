"""Whole preparations as one call, each a single lazy plan up to the point where it is stored."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from duotext.operators import pairs
from duotext.operators.encoding import VOCAB_SIZE, build_vocab, encode_pair
from duotext.operators.learning import DocumentFrequencies, embed_rows, fit_idf
from duotext.operators.sampling import SEED, inject_null_context, upsample_and_blank, upsample_by_factor
from duotext.runtime import cut_lineage, path_exists
from duotext.schema import MAX_LENGTH, VECTOR_SIZE
from duotext.sources import versions
from duotext.sources.artifacts import RECIPE_COLUMNS, materialize_if_absent, read_recipe
from duotext.sources.readers import read_tiered


def recipe_name(tier: str, split: str, upsampling: bool, num_label: int, null_ratio: float) -> str:
    """The recipe spelled out: ``<tier>_[null_context_][upsample_]<n>-label_<split>``."""
    marks = ("null_context_" if null_ratio else "") + ("upsample_" if upsampling else "")
    return f"{tier}_{marks}{num_label}-label_{split}"


def prepare_pairs(
    df: DataFrame, upsampling: bool = False, num_label: int = 2, null_ratio: float = 0.0, seed: int = SEED,
    key: str = "row_id", keys: DataFrame | None = None,
) -> DataFrame:
    """Recode, upsample and blank contexts of a pair table.

    ``keys``: the key and label columns of ``df`` as a stored table, if there is one; else it is written here for upsampling.
    """
    if num_label not in (2, 3):
        raise ValueError("num_label must be 2 or 3")
    recode = pairs.binarize_01 if num_label == 2 else pairs.label_to_int
    out = recode(df)
    if upsampling:
        narrow = cut_lineage(out.select(key, "label"), "keys") if keys is None else recode(keys)
        return upsample_and_blank(out, narrow, null_ratio, "label", key, seed)
    return inject_null_context(out, null_ratio, [key], seed, keys=keys)


@dataclass(frozen=True)
class Encoding:
    """A stored vocabulary and inverse document frequencies; tables made with it lie in its folder."""

    path: str
    vocab: DataFrame
    idf: DocumentFrequencies


def fit_encoding(
    train: DataFrame, store: str, name: str, columns: Sequence[str] = ("context", "target"),
    vocab_size: int | None = VOCAB_SIZE, vector_size: int = VECTOR_SIZE, overwrite: bool = False,
) -> Encoding:
    """Vocabulary and document frequencies of a training table, to be applied to every split and tier.

    A stored encoding of that name is reused.  Replacing one fails while tables made with it
    are stored, since their ids would mean other tokens.
    """
    spark, path = train.sparkSession, f"{store}/{name}"
    if overwrite and path_exists(spark, f"{path}/tables"):
        raise ValueError(f"{path} is in use: delete the tables made with it first, or take another name")
    materialize_if_absent(spark, f"{path}/vocab", lambda: build_vocab(train, columns, vocab_size), overwrite)
    materialize_if_absent(spark, f"{path}/idf", lambda: fit_idf(pairs.pair_text(train), size=vector_size).table(spark), overwrite)
    return load_encoding(spark, path)


def load_encoding(spark: SparkSession, path: str) -> Encoding:
    """A stored encoding."""
    return Encoding(path, spark.read.parquet(f"{path}/vocab"), DocumentFrequencies.of(spark.read.parquet(f"{path}/idf")))


def _source(
    spark: SparkSession, root: str, store: str, tier: str, split: str, file_type: str, overwrite: bool = False
) -> tuple[str, str]:
    """Paths of the stored keyed rows of one tier and split and of their (row_id, label), as of the present files."""
    files, recipe = [f"{root}/{tier}/{split}.{file_type}"], {"tier": tier, "split": split, "file_type": file_type}

    def read() -> DataFrame:
        return pairs.with_row_id(read_tiered(spark, root, [(tier, split)], file_type).drop("tier", "split"))

    rows = versions.current(spark, f"{store}/sources/{tier}_{split}", read, files, recipe, overwrite)
    keys = versions.current(spark, f"{store}/keys/{tier}_{split}", lambda: spark.read.parquet(rows).select("row_id", "label"), [rows])
    return rows, keys


def keyed_source(
    spark: SparkSession, root: str, store: str, tier: str, split: str, file_type: str = "jsonl", overwrite: bool = False
) -> DataFrame:
    """The rows of one tier and split with their keys; parsed and keyed once for all recipes, again if the file changes."""
    return spark.read.parquet(_source(spark, root, store, tier, split, file_type, overwrite)[0])


def prepare(
    spark: SparkSession, root: str, store: str, tier: str, split: str, encoding: Encoding | None = None,
    upsampling: bool = False, num_label: int = 2, output_vectors: bool = True, overwrite: bool = False,
    file_type: str = "jsonl", null_ratio: float = 0.0, seed: int = SEED, max_length: int = MAX_LENGTH,
    vocab_size: int | None = VOCAB_SIZE, make_predict_fn: Callable | None = None,
) -> dict[str, DataFrame]:
    """Read, prepare and encode one tier and split; store tokens and, unless told not to, vectors.

    ``encoding`` is the one fitted on the training table (``fit_encoding``).  Without it one
    named after the split and the state of its file is fitted on this split, with ``vocab_size`` tokens.  Tables are stored
    as partitions of their recipe (``read_prepared`` reads several) in versions that know their inputs: what is
    made of the same file in the same way is reused, a changed file is prepared again; ``overwrite`` does so in any case.
    """
    keys = ["row_id", *(["draw_no"] if upsampling else [])]
    rows, narrow = _source(spark, root, store, tier, split, file_type, overwrite)
    source = spark.read.parquet(rows)
    if encoding is None:
        mark = rows.rsplit("/", 1)[1].removeprefix("version=")
        encoding = fit_encoding(source, store, f"{tier}_{split}_{mark}", vocab_size=vocab_size)
    recipe = {"tier": tier, "split": split, "num_label": num_label, "upsampled": upsampling, "null_ratio": float(null_ratio)}
    more = {"seed": seed, "max_length": max_length, "encoding": encoding.path}

    def stored(kind: str, compute: Callable[[], DataFrame], made_of: list[str], **said: object) -> str:
        folder = versions.recipe_path(f"{encoding.path}/tables/{kind}", recipe, RECIPE_COLUMNS)
        return versions.current(spark, folder, compute, made_of, recipe | more | said, overwrite, staging=f"{encoding.path}/staging")

    def tokens() -> DataFrame:
        ready = prepare_pairs(source, upsampling, num_label, null_ratio, seed, keys=spark.read.parquet(narrow))
        return encode_pair(ready, encoding.vocab, key=keys, max_length=max_length)

    encoded = stored("tokens", tokens, [rows, f"{encoding.path}/vocab"])
    out = {"tokens": spark.read.parquet(encoded)}
    if output_vectors:
        def vectors() -> DataFrame:
            shape = [[max_length], [max_length]]
            given = out["tokens"] if make_predict_fn else pairs.pair_text(out["tokens"])
            made = embed_rows(given, make_predict_fn=make_predict_fn, shapes=shape, idf=encoding.idf)
            return made.select(*keys, "hidden_state", "label")

        model = getattr(make_predict_fn, "__qualname__", None)
        out["hidden"] = spark.read.parquet(stored("hidden", vectors, [encoded, f"{encoding.path}/idf"], model=model))
    return out


def read_prepared(spark: SparkSession, encoding: Encoding, kind: str = "tokens", **recipe: object) -> DataFrame:
    """The prepared tables of an encoding (``tokens`` or ``hidden``) whose recipes match, with the recipe's columns."""
    return read_recipe(spark, f"{encoding.path}/tables/{kind}", **recipe)


def prepare_gold_silver(gold: DataFrame, silver: DataFrame) -> DataFrame:
    """Gold and silver rows with the binary label."""
    return pairs.binarize_01(pairs.union_tiers(gold, silver))


def minority_boosted(gold: DataFrame, silver: DataFrame) -> DataFrame:
    """All gold rows and the silver minority class, with the binary label."""
    return pairs.binarize_01(pairs.silver_minority_only(pairs.union_tiers(gold, silver)))


def prepare_minority_boost(
    gold: DataFrame, silver: DataFrame, factor: float = 1.3, key: str = "row_id", seed: int = SEED
) -> DataFrame:
    """The same for training: the minority redrawn to ``factor`` times its size."""
    return upsample_by_factor(minority_boosted(gold, silver), "label", key, factor, seed)


def prepare_annotated_test(annotated: DataFrame, annotation: str = "label") -> DataFrame:
    """Rows annotated h, n or c, with the binary label."""
    return pairs.letter_label(pairs.label_isin(annotated, label=annotation), annotation, annotation)
