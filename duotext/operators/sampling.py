"""Rebalancing, perturbing, shuffling, splitting and batching, all by seeded hash.

The sample drawn for a seed depends on the row keys only, never on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotext.functions.hashing import as_list, hash_int, hash_key
from duotext.operators.copies import COPIES_PER_TASK, spread_copies
from duotext.operators.ordering import BUCKET_ROWS, exact_k_condition, global_index, hash_index
from duotext.runtime import cut_lineage

SEED = 123  # fixed value: seed of the resampling steps
DRAWS_PER_TASK = 1_000_000
MAX_POISSON_RATE = 1_000  # the inverted distribution is a literal of about this length


def _class_sizes(df: DataFrame, label: str, majority: int) -> tuple[int, int, int]:
    """(majority rows, minority rows, minority class); fails on a third class."""
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().limit(64).collect()}
    others = [c for c in sizes if c != majority]
    if None in sizes or len(others) > 1:
        raise ValueError(f"upsampling needs two classes, {majority} and one other; found {sorted(map(str, sizes))}")
    if not others:
        raise ValueError("no minority rows to draw from")
    return sizes.get(majority, 0), sizes[others[0]], others[0]


def _draw_counts(
    keys: DataFrame, key: Sequence[str], pool: int, draws: int, seed: int, bucket_rows: int
) -> tuple[DataFrame, bool]:
    """(key, __n): how often each of the ``pool`` keys is drawn, if at all, in ``draws`` draws with replacement; may a count be high?

    Draw j takes the key at position ``md5(seed:draw:j) mod pool`` of the hash order.  Draws
    are counted per position, so all join keys are unique however small the pool is.
    """
    spark = keys.sparkSession
    numbered = hash_index(keys.select(*key), key, seed, "__at", n=pool, bucket_rows=bucket_rows)
    tasks = max(draws // DRAWS_PER_TASK + 1, min(draws // 1_000, spark.sparkContext.defaultParallelism))
    drawn = (
        spark.range(0, draws, 1, tasks)
        .groupBy((hash_int(hash_key(f"{seed}:draw", "id")) % pool).alias("__at"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    return numbered.join(drawn, "__at").select(*key, "__n"), draws / pool > COPIES_PER_TASK / 4


def _copied(df: DataFrame, hits: DataFrame, label: str, key: Sequence[str], majority: int, minority: int, may_be_hot: bool) -> DataFrame:
    """Majority rows as they are (draw -1) and minority rows as often as ``hits`` says; whole rows are shuffled once."""
    hit = df.where(F.col(label) == minority).join(hits, list(key)).select(*df.columns, "__n")
    copies = spread_copies(hit, "__n", "draw_no", may_be_hot)
    return df.where(F.col(label) == majority).withColumn("draw_no", F.lit(-1).cast("bigint")).unionByName(copies)


def _with_draws(
    df: DataFrame, label: str, key: Sequence[str], majority: int, minority: int, pool: int, draws: int,
    seed: int, bucket_rows: int,
) -> DataFrame:
    """Majority rows plus ``draws`` draws with replacement from the minority."""
    hits, may_be_hot = _draw_counts(df.where(F.col(label) == minority), key, pool, draws, seed, bucket_rows)
    if may_be_hot:  # rows with few and with many copies are joined apart, to counts that are stored
        hits = cut_lineage(hits, "draws")
    return _copied(df, hits, label, key, majority, minority, may_be_hot)


def upsample_and_blank(
    df: DataFrame, keys: DataFrame, ratio: float, label: str, key: str | Sequence[str], seed: int = SEED,
    majority: int = 0, context: str = "context", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``upsample_to_majority``, then ``inject_null_context`` on what it returns, with one read of the whole rows.

    Everything is decided on ``keys``, the (key, label) of ``df`` as a stored narrow table: how often a row is
    drawn, and from the hash order of (key, draw) which of the resulting rows lose their context.  The draws and that key
    table are written once each; then every whole row is read once, and the minority is shuffled once.
    """
    key = as_list(key)
    big, small, minority = _class_sizes(keys, label, majority)
    found, may_be_hot = _draw_counts(keys.where(F.col(label) == minority), key, small, big, seed, bucket_rows)
    hits = cut_lineage(found, "draws")
    out = _copied(df, hits, label, key, majority, minority, may_be_hot)
    if not ratio:
        return out
    narrow = keys.select(*key, label)
    drawn = cut_lineage(_copied(narrow, hits, label, key, majority, minority, may_be_hot).select(*key, "draw_no"), "drawn-keys")
    return inject_null_context(out, ratio, [*key, "draw_no"], seed, context, keys=drawn)


def upsample_to_majority(
    df: DataFrame, label: str, key: str | Sequence[str], seed: int = SEED, majority: int = 0,
    mode: str = "exact", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Draw the minority with replacement until it is as large as the majority.

    The draws replace the minority rows.  ``draw_no`` numbers the copies of a row
    and is -1 on majority rows, so (key, draw_no) is unique.  ``mode='poisson'`` draws the same
    number in expectation without any shuffle.
    """
    big, small, minority = _class_sizes(df, label, majority)
    if mode == "poisson":
        return _poisson(df, label, as_list(key), majority, minority, big / small, seed)
    return _with_draws(df, label, as_list(key), majority, minority, small, big, seed, bucket_rows)


def upsample_by_factor(
    df: DataFrame, label: str, key: str | Sequence[str], factor: float = 1.3, seed: int = SEED,
    majority: int = 0, mode: str = "exact", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Redraw the minority ``round(factor * n)`` times (half to even) with replacement."""
    _, small, minority = _class_sizes(df, label, majority)
    draws = round(small * factor)
    if mode == "poisson":
        return _poisson(df, label, as_list(key), majority, minority, draws / small, seed)
    return _with_draws(df, label, as_list(key), majority, minority, small, draws, seed, bucket_rows)


def poisson_copies(rate: float, digest: Column) -> Column:
    """Poisson(rate) count of a row by inverting the distribution at its hash.

    A high rate is a sum of counts at lower rates, each at a hash of its own.
    """
    if rate > MAX_POISSON_RATE:
        parts = math.ceil(rate / MAX_POISSON_RATE)
        own = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.md5(F.concat(digest, F.lit(":"), i.cast("string"))))
        return F.aggregate(own, F.lit(0), lambda total, d: total + poisson_copies(rate / parts, d))
    top = math.ceil(rate + 12 * math.sqrt(rate) + 24)
    mass = [math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) if rate > 0 else float(i == 0)
            for i in range(top)]
    steps, total = [], 0.0
    for m in mass:
        total += m
        steps.append(total)
    u = hash_int(digest, 13) / float(16**13)
    return F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= u))


def _poisson(
    df: DataFrame, label: str, key: Sequence[str], majority: int, minority: int, rate: float, seed: int
) -> DataFrame:
    copies = poisson_copies(rate, hash_key(f"{seed}:poisson", *key))
    count = F.when(F.col(label) == majority, 1).otherwise(copies)
    first = F.when(F.col(label) == majority, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")
    return (
        df.where(F.col(label).isin(majority, minority))
        .withColumn("__n", count)
        .where(F.col("__n") > 0)
        .withColumn("draw_no", F.explode(F.sequence(first, first + F.col("__n") - 1)))
        .drop("__n")
    )


def upsample_poisson(
    df: DataFrame, label: str, key: str | Sequence[str], seed: int = SEED, majority: int = 0,
    factor: float | None = None,
) -> DataFrame:
    """Shuffle-free upsampling: each minority row is copied a Poisson number of times."""
    if factor is None:
        return upsample_to_majority(df, label, key, seed, majority, mode="poisson")
    return upsample_by_factor(df, label, key, factor, seed, majority, mode="poisson")


def inject_null_context(
    df: DataFrame, ratio: float, key: str | Sequence[str], seed: int = SEED, context: str = "context",
    keys: DataFrame | None = None,
) -> DataFrame:
    """Blank the context (to the empty text) of exactly ``int(ratio * n)`` rows.

    ``keys``, a table of the keys of ``df``, spares the passes over an expensive ``df``.
    """
    if ratio == 0.0:
        return df
    chosen = exact_k_condition(df if keys is None else keys, lambda n: int(ratio * n), key, seed)
    return df.withColumn(context, F.when(chosen, "").otherwise(F.col(context)))


def shuffle_rows(
    df: DataFrame, key: str | Sequence[str], seed: int = SEED, position: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The rows in seeded hash order.

    With ``position`` the place of each row is a column, for sinks that do not keep order.
    """
    keys = as_list(key)
    if position:
        return hash_index(df, keys, seed, position, bucket_rows=bucket_rows)
    return df.orderBy(hash_key(seed, *keys), *keys)


def random_split(
    df: DataFrame, key: str | Sequence[str], train_tenths: int = 9, seed: int = SEED, out: str = "split"
) -> DataFrame:
    """Mark each row ``train`` or ``val`` by hash, 90/10 unless said; no shuffle."""
    bucket = hash_int(hash_key(seed, *as_list(key))) % 10
    return df.withColumn(out, F.when(bucket < train_tenths, "train").otherwise("val"))


def batch_ids(
    df: DataFrame, size: int, key: str | Sequence[str], order: str = "sequential", seed: int = SEED,
    out: str = "batch_id", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Cut the rows into batches of ``size``: in key order, or ``order='random'`` in hash order."""
    if order == "sequential":
        placed = global_index(df, key, "__place", bucket_rows=bucket_rows)
    elif order == "random":
        placed = hash_index(df, key, seed, "__place", bucket_rows=bucket_rows)
    else:
        raise ValueError("order must be 'sequential' or 'random'")
    return placed.withColumn(out, F.floor(F.col("__place") / size)).drop("__place")


def steps_per_epoch(df: DataFrame, batch_size: int) -> DataFrame:
    """Whole batches in the table, as one row."""
    return df.agg(F.floor(F.count(F.lit(1)) / batch_size).alias("steps"))
