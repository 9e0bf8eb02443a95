"""URL rules by a sort-merge range join of reversed hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duotext.llm.texts import folded, leading, let, stored

#: Keys sampled for the cuts of the key range; buckets of the sweep, made of them.
SAMPLE, BUCKETS = 4096, 256


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for NULL or no ``://``."""
    return folded(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``: a host and its subdomains are one interval of keys, from the
    host's key up to that key with its last ``.`` replaced by ``/``, the next character."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, stack) for each place where the stack of active hosts changes: it holds from that key up to the next.

    ``stack`` lists the rules of all hosts whose interval is open, as (path, rule, verdict).
    A host's interval opens with the rules of its ancestors below its own and closes with
    those of its ancestors alone.  The ancestors are found by joining on the host's own
    shorter keys, so rules meet rules without comparing all pairs.
    """
    named = rules.select(
        reversed_key(folded(F.col("host"))).alias("key"),
        F.struct(F.col("path"), F.concat("host", "path").alias("rule"), F.col("verdict")).alias("entry"),
    )
    labels = F.split(F.rtrim(F.col("key"), F.lit(".")), r"\.")
    hosts = named.select("key").distinct()
    above = hosts.select(
        F.col("key").alias("host"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("key"),
    )
    found = above.join(named, "key").groupBy("host").agg(
        F.sort_array(F.collect_list("entry")).alias("opened"),
        F.sort_array(F.collect_list(F.when(F.col("key") != F.col("host"), F.col("entry")))).alias("closed"),
    )
    return found.select(F.explode(F.array(
        F.struct(F.col("host").alias("key"), F.col("opened").alias("stack")),
        F.struct(F.concat(F.expr("left(host, length(host) - 1)"), F.lit("/")).alias("key"), F.col("closed").alias("stack")),
    )).alias("e")).select("e.*")


def _bucket(cuts: list[str], key: Column) -> Column:
    """How many cuts are at most the key: a binary search over a constant of the plan."""
    listed = F.array(*[F.lit(c) for c in cuts])
    return leading(len(cuts), lambda i: F.get(listed, i) <= key)


def _cuts(keyed: DataFrame) -> tuple[list[str], list[int]]:
    """(lower ends of the buckets after the first, sub-buckets of every bucket) from a sample of about ``SAMPLE`` rows.

    Rows are drawn by their hash at a rate set by their number, and equal ones are counted in the
    tasks, so that about ``SAMPLE`` records in all reach the driver, whatever the number of partitions or of copies.
    """
    rate = min(1.0, SAMPLE / max(1, keyed.count()))
    drawn = keyed.where(F.pmod("salt", F.lit(1 << 32)) < int(rate * (1 << 32))).groupBy("key", "salt").count()
    sample = sorted(((r["key"].encode(), r["count"]) for r in drawn.collect()))
    width, cuts, weights, held = max(1.0, sum(n for _, n in sample) / BUCKETS), [], [0], 0
    for i, (key, n) in enumerate(sample):
        if weights[-1] and held >= width and key != sample[i - 1][0]:
            cuts.append(key.decode())
            weights.append(0)
            held = 0
        weights[-1] += n
        held += n
    return cuts, [max(1, round(n / width)) for n in weights]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``.

    ``rules``: host, path, verdict.  A rule fits its host and all subdomains if the path of
    the URL starts with the rule's; the longest (host and path together; of equals the
    greatest) wins.  Otherwise rule is NULL and the verdict is ``default``; so it is for
    NULL, empty and malformed URLs, whose host and path are empty.

    URLs and the places where the stack of active rules changes are sorted together by
    reversed host, and one pass carries the last stack on to each URL.  The key range is
    cut into buckets by a bounded sample of keys; each bucket starts with the stack that is
    active at its lower end.  A key that fills several buckets of the sample is dealt over
    as many sub-buckets, each with the same events, so no host is one task's work.
    """
    urls = pages.select("page_id", host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = urls.withColumn("key", reversed_key(F.col("host")))
    salt = F.xxhash64("key", "path", "page_id")
    cuts, sizes = _cuts(keyed.select("key", salt.alias("salt")))
    parts = F.array(*[F.lit(n) for n in sizes])
    dealt = keyed.withColumn("bucket", _bucket(cuts, F.col("key"))).select(
        "bucket", F.pmod(salt, F.get(parts, F.col("bucket"))).cast("int").alias("part"), "key", F.lit(1).alias("kind"),
        F.lit(None).cast("array<struct<path:string,rule:string,verdict:string>>").alias("stack"), "page_id", "host", "path",
    )
    events = stored(rule_events(rules).withColumn("bucket", _bucket(cuts, F.col("key"))))
    # the stack at the lower end of each bucket: that of the last event before it.  The last event of each bucket is
    # an aggregate, so that the one window over all buckets sees a row per bucket, however many rules there are
    spark = pages.sparkSession
    edges = spark.createDataFrame([(i + 1, c) for i, c in enumerate(cuts)], "bucket int, key string")
    last = events.groupBy("bucket").agg(F.max_by("stack", "key").alias("stack"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = spark.range(len(cuts) + 1).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(last), "bucket", "left")
    start = every.select("bucket", F.last("stack", ignorenulls=True).over(before).alias("stack")).join(F.broadcast(edges), "bucket").select("bucket", "key", "stack")
    opening = events.select("bucket", "key", "stack", F.lit(0).alias("kind")).unionByName(start.withColumn("kind", F.lit(-1)))
    spread = opening.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("bucket")) - 1)))
    none = F.lit(None).cast("string")
    sweep = dealt.unionByName(
        spread.select("bucket", "part", "key", "kind", "stack", *[none.alias(c) for c in ("host", "path")],
                      F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"))
    )
    order = Window.partitionBy("bucket", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = sweep.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    fits = F.filter(F.coalesce("stack", F.array().cast("array<struct<path:string,rule:string,verdict:string>>")), lambda r: F.startswith(F.col("path"), r["path"]))
    best = let(fits, lambda found: F.array_max(F.transform(found, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))))
    return active.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
