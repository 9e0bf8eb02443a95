"""SimHash near-duplicates: pigeonhole blocks of 64-bit fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotext.llm.components import components
from duotext.llm.texts import map_texts, stored

BITS = 64
#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 16


def simhash(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: A-Z lower-cased, word shingles with repeats, XXH64 with seed 42.

    Fewer words than a shingle has: the whole sequence is one.  No word: 0.
    """
    words = text.lower().split()  # of bytes: ASCII letters, and exactly the white space \x20 \x09-\x0D
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1:].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(last), _CHUNK):
        part = last[at:at + _CHUNK]
        hashes = [digest(whole[s:e], 42) for s, e in zip(starts[at:at + len(part)].tolist(), part, strict=True)]
        votes += np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(last)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` BIGINT, the SimHash of each text."""
    return map_texts(docs, lambda: lambda texts: [[simhash(t, shingle) for t in texts]], "fp bigint", keep)


def _mask(bits: range) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def links(prints: DataFrame, distance: int = 2, blocks: int = 4, direct: int = 256) -> DataFrame:
    """Edges (a, b) over the distinct values of ``fp`` that connect exactly what pairs of at most ``distance`` differing bits connect.

    Pigeonhole: of ``blocks`` equal runs of bits a close pair agrees in at least
    ``blocks - distance``, so it meets under one of the masks of that many runs; rows that
    meet are joined and the Hamming distance verified.  With 4 blocks and distance 2 a key
    has 32 bits, so that chance meetings stay rare up to billions of texts.

    Blocks with more than ``direct`` members are not joined (their pairs grow with the
    square).  For them two fingerprints are within 2 bits exactly if some value is within
    1 bit of both: each member is listed under itself and its 64 one-bit neighbours, and all
    members of such a list (65 at most) are linked to its smallest.  That is linear and
    links nothing else, since two members of a list differ in 2 bits or fewer.
    """
    if distance != 2 or not 2 < blocks <= BITS:
        raise ValueError("distance must be 2, with 3 to 64 blocks")
    width = [range(BITS * i // blocks, BITS * (i + 1) // blocks) for i in range(blocks)]
    masks = [sum(_mask(r) for r in chosen) for chosen in combinations(width, blocks - distance)]
    distinct = stored(prints.select("fp").distinct())
    key = F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)
    ]))
    keyed = distinct.select("fp", key.alias("k")).select("fp", "k.mask", "k.bits")
    sizes = keyed.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keyed.join(sizes, ["mask", "bits"]))
    few = met.where(F.col("n") <= direct).drop("n")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = (
        few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["mask", "bits"])
        .where((F.col("a") < F.col("b")) & close).select("a", "b")
    )
    around = F.explode(F.array("fp", *[F.col("fp").bitwiseXOR(F.lit(_mask(range(b, b + 1)))) for b in range(BITS)]))
    lists = (
        met.where(F.col("n") > direct).select("fp").distinct().select("fp", around.alias("middle"))
        .groupBy("middle").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
    )
    stars = lists.select("a", F.explode("members").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    fingerprint: 16 lowercase hex digits.  component_id: the smallest doc_id that can be
    reached over links of at most ``distance`` bits (its own included).  Empty and NULL
    texts have fingerprint zero and are linked like any other.  Rows that repeat an id
    stay rows; a NULL id never is a smallest one, so a component of NULL ids alone has NULL.

    Texts are read once; equal fingerprints are one node of the graph, so groups of exact
    copies cost nothing but the last join, which adaptive execution can split.
    """
    prints = stored(fingerprints(docs, shingle))
    roots = components(links(prints, distance))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, F.col("fp") == F.col("node"), "left")
    nodes = stored(nodes.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stored(nodes.join(least, "root").select(F.col("fp").alias("fp_"), "component_id"))
    return prints.join(found, F.col("fp") == F.col("fp_")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``.

    Groups are the components of ``near_duplicates``.  The row of the smallest doc_id stays; rows
    without id lose against any other, and rows that share an id go by a digest of all their
    columns.  So rows that repeat an id but differ in their texts are rows of their own, while of
    rows that are equal in every column one stays.

    Whole rows are shuffled once, by (id, digest); equal ones are combined in the tasks before.
    """
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.md5(F.to_json(F.struct("*"))).alias("digest"))
    keyed = docs.select(key.alias("key"), "text", F.struct("*").alias("row"))
    prints = stored(fingerprints(keyed.select("key", "text"), shingle, ("key",)))
    roots = components(links(prints, distance))
    nodes = prints.groupBy("fp").agg(F.min("key").alias("key")).join(roots, F.col("fp") == F.col("node"), "left")
    first = stored(nodes.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("key").alias("key")).select("key"))
    once = keyed.groupBy("key").agg(F.any_value("row").alias("row"))
    return once.join(first, "key", "left_semi").select("row.*")
