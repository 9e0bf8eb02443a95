"""Global positions, running values and exact-k samples without a one-partition window.

A global order is cut into buckets that are monotone in the order.  Each bucket is
ranked by itself (one shuffle of the data), and a table with one row per bucket
carries what came before it.  Two kinds of buckets are used:

* value order: cut points are composite tuples of the whole order key, read from a
  bounded hash sample.  A single value that fills a third of the table is cut too,
  as long as the order ends in a unique column.
* hash order: a prefix of the seeded md5, uniform by construction.

Cut points only balance the work; they never change a result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duotext.functions.hashing import as_list, hash_key

BUCKET_ROWS = 2_000_000  # rows one task should rank
MIN_BUCKET_ROWS = 1_000  # not worth a task of their own below this
MAX_BUCKETS = 16_384  # bounds the cut points on the driver and the carry table
SAMPLE_PER_BUCKET = 24
MAX_DIGITS = 4  # 16**4 hash buckets
BOUNDARY_ROWS = 4_096  # rows of the last hash bucket that may be listed
BUCKET = "__bucket"
_DIGEST = "__digest"


def _bucket_goal(df: DataFrame, n: int, bucket_rows: int) -> int:
    cores = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(-(-n // bucket_rows), min(cores, n // min(MIN_BUCKET_ROWS, bucket_rows)))
    return max(1, min(MAX_BUCKETS, wanted))


def _sortable(df: DataFrame, name: str) -> Column:
    """The column as BIGINT, DOUBLE or STRING in the same order."""
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        # field by field: a cast to TIMESTAMP would bend the order where the session zone skips an hour
        whole = F.unix_date(col.cast("date")).cast("bigint") * 86_400 + F.hour(col) * 3_600 + F.minute(col) * 60
        return whole * 1_000_000 + (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("bigint")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col.cast("bigint")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return col.cast("double")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (col.cast(f"decimal(37,{kind.scale})") * F.lit(10**kind.scale)).cast("bigint")
    if isinstance(kind, T.StringType):
        return col
    raise TypeError(f"cannot order by {name}: {kind.simpleString()}")


def _cut_points(keys: DataFrame, n: int, goal: int) -> list[tuple]:
    """At most ``goal - 1`` ascending key tuples, from a hash sample of the distinct keys."""
    scale = 1 << 30
    share = min(scale, math.ceil(scale * SAMPLE_PER_BUCKET * goal / n))
    drawn = keys.where(F.pmod(F.xxhash64(*keys.columns), F.lit(scale)) < share).distinct().collect()
    rows = sorted({
        tuple(r) for r in drawn
        if all(v is not None and not (isinstance(v, float) and not math.isfinite(v)) for v in r)
    })
    picks = {len(rows) * i // goal for i in range(1, goal)} - {0}
    return [rows[i] for i in sorted(picks) if i < len(rows)]


def with_range_bucket(
    df: DataFrame, order: Sequence[str], n: int | None = None, bucket_rows: int = BUCKET_ROWS
) -> tuple[DataFrame, int]:
    """Add the bucket number of each row: how many cut tuples are at or below its key.

    The first order column is searched in the cut values by ``Bucketizer`` (binary
    search in the JVM).  That is all, except for a value so frequent that several
    cuts fall on it: its rows are searched, again by halving, in the full tuples.
    If the order begins with a text, all rows are searched in the full tuples.
    """
    order = list(order)
    n = df.count() if n is None else n
    goal = _bucket_goal(df, n, bucket_rows)
    parts = [_sortable(df, c).alias(f"o{i}") for i, c in enumerate(order)]
    keys = df.select(*parts)
    cuts = _cut_points(keys, n, goal) if goal > 1 else []
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0)), 1

    fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in keys.schema)

    def at_most_key(own: Column, longest: int) -> Column:
        """How many of the tuples of an ascending list are at or below the row's key."""
        def halve(pos: Column, step: Column) -> Column:
            fits = pos + step <= F.size(own)
            return F.when(fits, F.when(F.element_at(own, pos + step) <= F.col("__key"), pos + step).otherwise(pos)).otherwise(pos)

        steps = [1 << b for b in reversed(range(longest.bit_length()))]
        return F.reduce(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)

    def tuples(rows: Sequence[tuple]) -> list[dict]:
        return [{f"o{i}": v for i, v in enumerate(c)} for c in rows]

    if isinstance(df.schema[order[0]].dataType, T.StringType):
        found = at_most_key(_literal(tuples(cuts), f"array<struct<{fields}>>"), len(cuts))
        keyed = df.withColumn("__key", F.struct(*parts))
        bucket = F.when(parts[0].isNotNull(), found).otherwise(F.lit(0))  # NULL keys sort first
        return keyed.withColumn(BUCKET, bucket).drop("__key"), len(cuts) + 1

    firsts = sorted({float(c[0]) for c in cuts})
    slot = {v: i + 1 for i, v in enumerate(firsts)}
    same: list[list[dict]] = [[] for _ in range(len(firsts) + 2)]  # last slot: NaN sorts above all
    for c in cuts:
        same[slot[float(c[0])]] += tuples([c])
    crowded = [len(s) > 1 for s in same]

    # each key is computed once per row, below the search
    keyed = df.withColumns({"__key": F.struct(*parts), "__first": parts[0].cast("double")})
    keyed = Bucketizer(
        splits=[-math.inf, *firsts, math.inf], inputCol="__first", outputCol="__slot", handleInvalid="keep"
    ).transform(keyed)
    at = F.col("__slot").cast("int") + 1
    if any(crowded):
        # the literals are folded once; slots with one cut need no list
        lists = _literal([s if c else [] for s, c in zip(same, crowded, strict=True)], f"array<array<struct<{fields}>>>")
        below = _literal(list(accumulate((len(s) for s in same[:-1]), initial=0)), "array<int>")
        upto = _literal(list(accumulate(len(s) for s in same)), "array<int>")
        searched = F.element_at(below, at) + at_most_key(F.element_at(lists, at), max(map(len, same)))
        bucket = F.when(F.element_at(_literal(crowded, "array<boolean>"), at), searched).otherwise(F.element_at(upto, at))
    else:
        # one cut per value; rows beyond the last split (NaN) belong behind the last cut
        bucket = F.least(F.col("__slot").cast("int"), F.lit(len(cuts)))
    # NULL keys sort first
    out = keyed.withColumn(BUCKET, F.coalesce(F.when(F.col("__first").isNotNull(), bucket), F.lit(0)))
    return out.drop("__key", "__first", "__slot"), len(cuts) + 1


def _literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind, {"mode": "FAILFAST"})


def scan_buckets(
    bucketed: DataFrame,
    buckets: int,
    order: Sequence[str],
    group: Sequence[str] = (),
    count: str | None = None,
    sums: Mapping[str, str] | None = None,
    earlier_min: Mapping[str, str] | None = None,
    totals_of: DataFrame | None = None,
) -> DataFrame:
    """Rank inside each bucket, then add what earlier buckets (of the same group) carry.

    ``totals_of`` is a cheaper table with the same bucket totals, if there is one.
    """
    sums, earlier_min = sums or {}, earlier_min or {}
    # a struct key keeps NULL groups together in the window and in the join
    work = bucketed.withColumn("__group", F.struct(*group)) if group else bucketed
    by = (["__group"] if group else []) + [BUCKET]
    inner = Window.partitionBy(*by).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)

    out = work
    if count:
        out = out.withColumn(count, F.row_number().over(inner).cast("bigint"))
    for name, col in sums.items():
        out = out.withColumn(name, F.sum(col).over(upto))
    for name, col in earlier_min.items():
        out = out.withColumn(name, F.min(col).over(before))
    if buckets == 1:
        return out.drop("__group", BUCKET)

    totals, carry = [], []
    # one row per bucket (per group), so this window is over at most MAX_BUCKETS rows a group
    past = Window.partitionBy(*by[:-1]).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    if count:
        totals.append(F.count(F.lit(1)).alias("__c"))
        carry.append(F.coalesce(F.sum("__c").over(past), F.lit(0)).alias("__c"))
    for i, col in enumerate(sums.values()):
        totals.append(F.sum(col).alias(f"__s{i}"))
        carry.append(F.sum(f"__s{i}").over(past).alias(f"__s{i}"))
    for i, col in enumerate(earlier_min.values()):
        totals.append(F.min(col).alias(f"__m{i}"))
        carry.append(F.min(f"__m{i}").over(past).alias(f"__m{i}"))
    carried = (work if totals_of is None else totals_of).groupBy(*by).agg(*totals).select(*by, *carry)
    # without groups the carry table has one row per bucket, hence a proven bound
    out = out.join(carried if group else F.broadcast(carried), by, "left")
    if count:
        out = out.withColumn(count, F.col(count) + F.col("__c"))
    for i, name in enumerate(sums):
        out = out.withColumn(name, F.when(F.col(f"__s{i}").isNull(), F.col(name))
                             .otherwise(F.coalesce(F.col(name), F.lit(0)) + F.col(f"__s{i}")))
    for i, name in enumerate(earlier_min):
        out = out.withColumn(name, F.least(name, f"__m{i}"))
    keep = [*bucketed.columns, *([count] if count else []), *sums, *earlier_min]
    return out.select(*[c for c in keep if c != BUCKET])


def global_index(
    df: DataFrame,
    order: str | Sequence[str],
    out: str = "position",
    n: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """0-based position of each row in value order.

    The order should end in a unique column; rows that tie completely get positions
    of their own, but which copy gets which one is not defined.
    """
    keys = as_list(order)
    bucketed, buckets = with_range_bucket(df, keys, n, bucket_rows)
    ranked = scan_buckets(bucketed, buckets, keys, count=out)
    return ranked.withColumn(out, F.col(out) - 1)


def hash_index(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int | str,
    out: str = "position",
    n: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """0-based position of each row in the seeded hash order; ``key`` must be unique."""
    keys = as_list(key)
    n = df.count() if n is None else n
    goal = _bucket_goal(df, n, bucket_rows)
    digits = min(MAX_DIGITS, math.ceil(math.log(goal, 16))) if goal > 1 else 0
    hashed = df.withColumn(_DIGEST, hash_key(seed, *keys))
    bucket = F.substring(_DIGEST, 1, digits) if digits else F.lit("")
    ranked = scan_buckets(hashed.withColumn(BUCKET, bucket), 16**digits, [_DIGEST, *keys], count=out)
    return ranked.withColumn(out, F.col(out) - 1).drop(_DIGEST)


def running_sum(
    df: DataFrame,
    order: str | Sequence[str],
    sums: Mapping[str, str],
    group: str | Sequence[str] = (),
    count: str | None = None,
    n: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Running totals in value order: ``sums`` maps an output name to the summed column.

    ``count`` names an optional 1-based step number.  ``group`` restarts the totals;
    a group may be any share of the table, since its rows are spread over the buckets.
    """
    keys = as_list(order)
    bucketed, buckets = with_range_bucket(df, keys, n, bucket_rows)
    return scan_buckets(bucketed, buckets, keys, as_list(group), count, sums)


def earlier_minimum(
    df: DataFrame,
    order: str | Sequence[str],
    value: str,
    out: str,
    group: str | Sequence[str] = (),
    n: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The smallest ``value`` of all strictly earlier rows of the group, NULL on the first."""
    keys = as_list(order)
    bucketed, buckets = with_range_bucket(df, keys, n, bucket_rows)
    return scan_buckets(bucketed, buckets, keys, as_list(group), earlier_min={out: value})


def exact_k_condition(
    df: DataFrame, k: int | Callable[[int], int], key: str | Sequence[str], seed: int | str
) -> Column:
    """A row-wise condition that holds for exactly the k rows first in hash order.

    Histograms over hash prefixes find the k-th hash; no more than 16**4 counts or
    ``BOUNDARY_ROWS`` keys reach the driver, and applying the condition needs no
    shuffle at all.  ``k`` may be a function of the row count.  ``key`` must be unique.
    """
    keys = as_list(key)
    hashed = df.select(hash_key(seed, *keys).alias(_DIGEST), *keys)
    prefix, left = "", None
    while True:
        inside = hashed.where(F.col(_DIGEST).startswith(prefix)) if prefix else hashed
        width = len(prefix) + MAX_DIGITS
        histogram = dict(inside.groupBy(F.substring(_DIGEST, 1, width).alias("p")).count().collect())
        if left is None:
            n = sum(histogram.values())
            left = k(n) if callable(k) else k
            if left <= 0:
                return F.lit(False)
            if left >= n:
                return F.lit(True)
        for prefix in sorted(histogram):
            if left <= histogram[prefix]:
                break
            left -= histogram[prefix]
        if histogram[prefix] <= BOUNDARY_ROWS:
            break
        if width >= 32:
            raise ValueError(f"{keys} is not unique: {histogram[prefix]} rows share one hash")
    last = (
        hashed.where(F.col(_DIGEST).startswith(prefix)).orderBy(_DIGEST, *keys).limit(left).collect()[-1]
    )
    digest = hash_key(seed, *keys)
    own = F.struct(*[F.col(c) for c in keys])
    limit = F.struct(*[F.lit(last[c]).cast(df.schema[c].dataType).alias(c) for c in keys])
    return (digest < last[_DIGEST]) | ((digest == last[_DIGEST]) & (own <= limit))


def exact_k_by_hash(
    df: DataFrame, k: int | Callable[[int], int], key: str | Sequence[str], seed: int | str
) -> DataFrame:
    """A sample of exactly k rows without replacement."""
    return df.where(exact_k_condition(df, k, key, seed))
