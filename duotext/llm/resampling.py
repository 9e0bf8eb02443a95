"""Importance resampling towards a target distribution: array-scored weights, drawn by a distributed radix sort."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duotext.llm.texts import groups, map_texts, stored, terms

#: Rows of one piece of a counting-sort pass (as a power of two), and the most bits of a digit.
PIECE_BITS, DIGIT_BITS = 16, 12
#: A memo of words is emptied beyond so many.
MEMO = 400_000


class Buckets(dict):
    """Bucket of a feature: crc32 of its bytes modulo ``count``."""

    def __init__(self, count: int):
        super().__init__()
        self.count = count

    def __missing__(self, feature: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.count
        return found

    def of(self, words: list[bytes], runs: int) -> np.ndarray:
        """Buckets of all runs of 1 to ``runs`` words, repeats included."""
        found = [np.fromiter(map(self.__getitem__, words), np.int64, len(words))]
        for n in range(2, min(runs, len(words)) + 1):
            joined = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
            found.append(np.fromiter(map(self.__getitem__, joined), np.int64, len(words) - n + 1))
        return np.concatenate(found)


def bucket_counts(texts: DataFrame, buckets: int = 10_000, runs: int = 1) -> np.ndarray:
    """How many features of all texts fall into each bucket.  A task sends at most one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in groups(batch, "text"):
                for text in part:
                    total += np.bincount(memo.of(terms(text), runs), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both smoothed by one feature per bucket."""
    size, all_source, all_target = len(source), float(source.sum()) + len(source), float(target.sum()) + len(target)
    ratio = [(float(t) + 1) * all_source / ((float(s) + 1) * all_target) for s, t in zip(source, target, strict=True)]
    return np.fromiter((math.floor(1000 * math.log(r)) for r in ratio), np.int64, size)


def weigh(docs: DataFrame, benchmark: DataFrame, buckets: int = 10_000, runs: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features, 0 without any."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, buckets, runs), bucket_counts(benchmark, buckets, runs)))

    def make():
        memo = Buckets(buckets)

        def work(texts: list[bytes]):
            n_words, n_features, weight = [], [], []
            for text in texts:
                words = terms(text)
                found = memo.of(words, runs)
                n_words.append(len(words))
                n_features.append(len(found))
                weight.append(int(gain.value[found].sum()) // max(1, len(found)))
            return n_words, n_features, weight

        return work

    return map_texts(docs, make, "n_words bigint, n_features bigint, weight bigint", ("doc_id",))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate) of the first 32 bits of sha256 over the seed and the id (NULL: no characters)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def digits(fields: Sequence[tuple[str, int]], most: int = DIGIT_BITS) -> list[Column]:
    """Digits of a composite key, least significant first, as equally wide as can be.

    ``fields`` are (column of non-negative BIGINTs, bits), least significant first; a digit may
    hold the end of one field and the beginning of the next.
    """
    total = sum(bits for _, bits in fields)
    passes = max(1, -(-total // most))
    width, out = -(-total // passes), []
    for start in range(0, max(total, 1), max(width, 1)):
        digit, at = F.lit(0).cast("bigint"), 0
        for name, bits in fields:
            low, high = max(start, at), min(start + width, at + bits)
            if low < high:
                part = F.shiftright(name, low - at).bitwiseAND(F.lit((1 << (high - low)) - 1))
                digit += F.shiftleft(part, low - start)
            at += bits
        out.append(digit.cast("int"))
    return out


def radix_ranks(rows: DataFrame, fields: Sequence[tuple[str, int]], most: int = DIGIT_BITS, piece: int = PIECE_BITS) -> DataFrame:
    """``rows`` with ``place`` BIGINT, 0 to n - 1, by the composite key of ``fields`` (see ``digits``).

    Least significant digit first, one stable counting sort each: rows are counted by digit and piece (a run of
    2**``piece`` places of the order so far), prefix sums over (digit, piece) give where the rows
    of a piece with a digit go, and the rows of one such cell follow in their present order.  A pass
    shuffles each row once, by cell, so that neither a hot digit nor a hot key meets in one task; the
    table of digit totals, at most 2**``most`` rows, is the only one that is summed in one.
    """
    now = stored(rows).withColumn("place", F.monotonically_increasing_id())
    for digit in digits(fields, most):
        now = now.withColumns({"__digit": digit, "__piece": F.shiftright("place", piece)})
        cells = now.groupBy("__digit", "__piece").agg(F.count("*").alias("__n"))
        earlier = Window.partitionBy("__digit").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        smaller = Window.orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)
        totals = cells.groupBy("__digit").agg(F.sum("__n").alias("__n")).select("__digit", F.coalesce(F.sum("__n").over(smaller), F.lit(0)).alias("__smaller"))
        starts = cells.withColumn("__earlier", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).join(F.broadcast(totals), "__digit").select(
            "__digit", "__piece", (F.col("__smaller") + F.col("__earlier")).alias("__start")
        )
        turn = F.row_number().over(Window.partitionBy("__digit", "__piece").orderBy("place")) - 1
        moved = now.withColumn("__turn", turn).join(starts, ["__digit", "__piece"])
        now = stored(moved.select(*rows.columns, (F.col("__start") + F.col("__turn")).alias("place")))
    return now


def _key(scored: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The rows with the fields of (score descending, doc_id ascending and NULL last, n_features) as non-negative numbers."""
    whole = scored.withColumns({
        "high": F.coalesce(F.shiftright("doc_id", 32), F.lit(0).cast("bigint")),
        "low": F.coalesce(F.col("doc_id").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0).cast("bigint")),
        "nameless": F.col("doc_id").isNull().cast("bigint"),
    })
    least = whole.agg(
        F.min("high"), F.max("high"), F.min("low"), F.max("low"), F.max("nameless"), F.max("n_features"), F.min("score"), F.max("score")
    ).first()
    if least[0] is None:
        return whole.withColumn("down", F.lit(0).cast("bigint")), []
    high, high_most, low, low_most, nameless, features, worst, best = map(int, least)
    if high != high_most:
        low, low_most = 0, (1 << 32) - 1
    keyed = whole.withColumns({"high": F.col("high") - high, "low": F.col("low") - low, "down": best - F.col("score")})
    sizes = [("n_features", features), ("low", low_most - low), ("high", high_most - high), ("nameless", nameless), ("down", best - worst)]
    return keyed, [(name, n.bit_length()) for name, n in sizes if n]


def resample(
    docs: DataFrame, benchmark: DataFrame, percent: int = 10, min_words: int = 20, buckets: int = 10_000, runs: int = 1, seed: int = 2024
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank BIGINT), one row per document: a draw without replacement towards ``benchmark``.

    score is the document's weight plus Gumbel noise of its id.  Of the N documents with at least
    ``min_words`` words the floor(``percent`` * N / 100) highest scores are drawn, ties to the smaller
    doc_id; rank is 1, 2, 3, ... in that order and NULL for all others.

    NULL and empty texts have no features and weight 0.  A NULL doc_id is hashed like an empty one
    and comes after all others at ties.  Rows that repeat an id are rows of their own; equal scores of one id go
    by n_features.  Texts of any length are read once per pass.  An empty benchmark or table of documents is allowed.

    What reaches the driver are ``buckets`` counts and the bounds of the key.
    """
    scored = weigh(docs, benchmark, buckets, runs).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = stored(scored)
    able = F.col("n_words") >= min_words
    keyed, fields = _key(scored.where(able).select("doc_id", "n_features", "weight", "score"))
    drawn = keyed.count() * percent // 100
    ranked = radix_ranks(keyed, fields).withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    shown = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*shown, "rank").unionByName(scored.where(~able).select(*shown, F.lit(None).cast("bigint").alias("rank")))
