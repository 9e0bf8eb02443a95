import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from duotext.operators import ordering as od

SMALL = 40  # rows per bucket: forces many buckets on little data


def skewed(n=3000, seed=1):
    """A third of the rows share one value; NULL and NaN occur; the id is unique."""
    rnd = random.Random(seed)
    rows = []
    for i in rnd.sample(range(10 * n), n):
        u = rnd.random()
        k = 7.0 if u < 0.34 else None if u < 0.36 else math.nan if u < 0.38 else rnd.uniform(-50, 50)
        rows.append((k, i, rnd.choice(["a", "b", None]), rnd.randrange(100)))
    return rows


def nulls_first(value):
    return (0, 0.0) if value is None else (2, 0.0) if math.isnan(value) else (1, value)


@pytest.mark.parametrize("parts", [1, 17])
def test_global_index_of_skewed_keys(spark, parts):
    rows = skewed()
    df = spark.createDataFrame(rows, "k double, id long, g string, v long").repartition(parts)
    got = {r["id"]: r["position"] for r in od.global_index(df, ["k", "id"], bucket_rows=SMALL).collect()}
    expected = sorted(rows, key=lambda r: (nulls_first(r[0]), r[1]))
    assert got == {r[1]: i for i, r in enumerate(expected)}


def test_hot_value_is_cut(spark):
    df = spark.createDataFrame(skewed(), "k double, id long, g string, v long")
    bucketed, n = od.with_range_bucket(df, ["k", "id"], bucket_rows=SMALL)
    sizes = [r["count"] for r in bucketed.groupBy(od.BUCKET).count().collect()]
    assert n > 50 and max(sizes) < 6 * SMALL


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "int", "float", "string_tail"])
def test_key_types(spark, kind):
    n = 500
    base = spark.range(n).withColumn("id", (F.col("id") * 7919) % n)
    when = F.timestamp_micros(F.col("id") * 86_400_123_456)
    first = {
        "timestamp": when, "timestamp_ntz": when.cast("timestamp_ntz"), "date": when.cast("date"),
        "int": F.col("id").cast("int"), "float": F.col("id").cast("float"), "string_tail": F.lit(5),
    }[kind]
    df = base.withColumn("k", first).withColumn("t", F.format_string("%05d", "id"))
    out = od.global_index(df, ["k", "t" if kind == "string_tail" else "id"], bucket_rows=SMALL)
    assert all(r["position"] == r["id"] for r in out.collect())


def test_longs_beyond_double_precision(spark):
    big = 1 << 60
    df = spark.range(2000).withColumn("k", F.lit(big) + (F.col("id") * 37) % 2000)
    out = od.global_index(df, "k", bucket_rows=SMALL)
    assert all(r["position"] == r["k"] - big for r in out.collect())


@pytest.mark.parametrize("kind", ["decimal(18,4)", "decimal(5,0)"])
def test_decimal_order(spark, kind):
    df = spark.range(1500).select("id", ((F.col("id") * 37 % 1500 - 700) / (1 if kind.endswith("0)") else 16)).cast(kind).alias("k"))
    found = [r["id"] for r in od.global_index(df, ["k", "id"], bucket_rows=SMALL).orderBy("position").collect()]
    assert found == [r["id"] for r in sorted(df.collect(), key=lambda r: (r["k"], r["id"]))]


@pytest.mark.parametrize("bucket_rows", [5, 50, 10_000])
def test_text_order(spark, bucket_rows):
    texts = [f"{'a' if i % 3 else ''}{i % 7}\u00e9\U0001f600\"{i % 400}" for i in range(1200)] + ["", "\uffff", "z\\"] * 3
    rows = [(t, i) for i, t in enumerate(texts)] + [(None, -1)]
    df = spark.createDataFrame(rows, "s string, id int").repartition(6)
    found = [(r["s"], r["id"]) for r in od.global_index(df, ["s", "id"], bucket_rows=bucket_rows).orderBy("position").collect()]
    assert found == sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))


@pytest.mark.parametrize("parts", [1, 17])
def test_running_sum_and_minimum_by_group(spark, parts):
    rows = skewed(seed=2)
    df = spark.createDataFrame(rows, "k double, id long, g string, v long").repartition(parts)
    sums = od.running_sum(df, ["k", "id"], {"total": "v"}, "g", count="step", bucket_rows=SMALL)
    mins = od.earlier_minimum(df, ["k", "id"], "v", "low", "g", bucket_rows=SMALL)
    got = {r["id"]: (r["step"], r["total"]) for r in sums.collect()}
    low = {r["id"]: r["low"] for r in mins.collect()}
    for g in ("a", "b", None):
        total, least = 0, None
        for step, r in enumerate(sorted((r for r in rows if r[2] == g), key=lambda r: (nulls_first(r[0]), r[1])), 1):
            total += r[3]
            assert got[r[1]] == (step, total)
            assert low[r[1]] == least
            least = r[3] if least is None else min(least, r[3])
    assert sums.columns == [*df.columns, "step", "total"]


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("parts", [1, 17])
def test_hash_index(spark, parts):
    df = spark.range(3000).repartition(parts)
    got = {r["id"]: r["position"] for r in od.hash_index(df, "id", 42, bucket_rows=SMALL).collect()}
    expected = sorted(range(3000), key=lambda i: digest(42, i))
    assert got == {k: i for i, k in enumerate(expected)}


@pytest.mark.parametrize("k", [0, 1, 57, 2999, 3000, 4000])
def test_exact_k(spark, k, monkeypatch):
    # one digit a level and tiny boundary buckets: several refinements
    monkeypatch.setattr(od, "MAX_DIGITS", 1)
    monkeypatch.setattr(od, "BOUNDARY_ROWS", 3)
    df = spark.range(3000)
    got = {r["id"] for r in od.exact_k_by_hash(df, k, "id", 5).collect()}
    assert got == set(sorted(range(3000), key=lambda i: digest(5, i))[:k])


def test_exact_k_of_empty_table(spark):
    assert od.exact_k_by_hash(spark.range(0), lambda n: n // 2, "id", 5).count() == 0


def test_exact_k_needs_a_unique_key(spark, monkeypatch):
    monkeypatch.setattr(od, "BOUNDARY_ROWS", 3)
    with pytest.raises(ValueError, match="not unique"):
        od.exact_k_by_hash(spark.range(100).select(F.lit(1).alias("id")), 5, "id", 5)


def test_empty_table_has_no_positions(spark):
    assert od.global_index(spark.range(0), "id").count() == 0
    assert od.hash_index(spark.range(0), "id", 1).count() == 0


def test_dates_are_real(spark):
    # the order key of a zone-less time ignores the session zone
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = [dt.datetime(2024, 3, 10, 1, 59), dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 3, 0)]
        df = spark.range(3).selectExpr(
            "id", "element_at(array(" + ",".join(f"timestamp_ntz'{t}'" for t in times) + "), cast(id as int) + 1) as ts"
        )
        keys = [r[0] for r in df.orderBy("ts").select(od._sortable(df, "ts")).collect()]
        assert keys == sorted(keys) and keys[2] - keys[1] == 30 * 60 * 1_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
