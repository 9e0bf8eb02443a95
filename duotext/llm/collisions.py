"""Embedding near-duplicates: collision counts over sorted one-dimensional projections."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotext.llm.components import components
from duotext.llm.texts import stored

#: Projections that count collisions, half the width of a window as a multiple of a close pair's spread, and the recall aimed at.
COUNTED, WINDOW, RECALL = 24, 2.0, 0.9995
#: Projections that cut groups which are too large, candidates for one cut, and the window of a cut in the same unit.
CUTTING, TRIED, CUT_WINDOW = 32, 8, 3.0
#: Vectors of a group that are compared at a time; a group above it is cut as long as that helps.
GROUP = 4096
#: Quantiles by which cuts are chosen, and the largest share of queries that a useful cut may send to both sides.
_STEPS, _SPILL = 20, 0.7
_BLOCK, _SOME = 256, 1 << 14


def spread(similarity: float) -> float:
    """Standard deviation of the difference of two unit vectors of that cosine along a Gaussian direction: their distance."""
    return math.sqrt(2 - 2 * similarity)


def needed_collisions(counted: int = COUNTED, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair just close enough reaches with probability ``recall``.

    The difference of such a pair along a Gaussian direction is normal with the pair's distance as its
    deviation, so it stays within ``window`` deviations with the same probability in each projection.
    """
    p = math.erf(window / math.sqrt(2))
    chance = [math.comb(counted, c) * p**c * (1 - p) ** (counted - c) for c in range(counted + 1)]
    return next((c for c in range(counted, 0, -1) if sum(chance[c:]) >= recall), 0)


def _directions(seed: int, dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dim, node, unit, cuts): the vector at length 1 as bytes of doubles, and its projections for cuts.

    node is a digest of label and vector, the same for equal rows; NULL for a vector or label that links with nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[int, np.ndarray] = {}
        for batch in batches:
            nodes, dims, units, cuts = [], [], [], []
            lists, labels = batch.column(2), batch.column(1).to_pylist()
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # NULL components become NaN
            null = lists.is_null().to_numpy(zero_copy_only=False)
            for i, label in enumerate(labels):
                x = values[offsets[i]:offsets[i + 1]]
                top = np.abs(x).max(initial=0.0)
                if null[i] or label is None or not np.isfinite(top) or top == 0:  # a NaN makes the maximum one
                    nodes.append(None), dims.append(None), units.append(None), cuts.append(None)
                    continue
                scaled = x / top
                unit = scaled / np.sqrt(scaled @ scaled)
                if len(x) not in axes:
                    axes[len(x)] = _directions(5, len(x), CUTTING)
                nodes.append(hashlib.md5(f"{label}:".encode() + (x + 0.0).tobytes()).hexdigest())
                dims.append(len(x)), units.append(unit.tobytes()), cuts.append((unit @ axes[len(x)]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(nodes, pa.string()),
                pa.array(units, pa.binary()), pa.array(cuts, pa.list_(pa.float32())),
            ], ["vec_id", "label", "dim", "node", "unit", "cuts"])

    source = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = "vec_id bigint, label " + source.schema["label"].dataType.simpleString()
    return source.mapInArrow(run, f"{kinds}, dim int, node string, unit binary, cuts array<float>")


def visits(nodes: DataFrame, similarity: float, group: int = GROUP) -> DataFrame:
    """(leaf, home, node, unit, times): each vector at home in one group, and as a query in all that its windows reach.

    Groups begin as (label, dimension).  As long as one has more than ``group`` vectors at home it is cut at
    the middle of two of its next ``TRIED`` projections, those of the widest middle half.  A query whose window
    around its own projection reaches over a cut visits both sides; a vector is at home on one.
    So a close pair is lost at a cut only if it differs by more than the window there.  A group is left
    whole if the cuts would send most queries to both sides: what is close there is dense, and is compared in pieces.
    Each round reads the quantiles of the large groups (one aggregate) and writes the routes again.
    """
    reach = CUT_WINDOW * spread(similarity)

    def candidate(axis: int) -> Column:
        """A cut halfway between the quartiles, so that either side gets about a quarter at least."""
        q = F.col(f"q{axis}")
        low, high = q[_STEPS // 4 - 1], q[_STEPS * 3 // 4 - 1]
        near = F.filter(q, lambda x: F.abs(x - (low + high) / 2) <= reach)
        return F.struct((high - low).alias("width"), F.lit(axis).alias("axis"), ((low + high) / 2).alias("at"), (F.size(near) / (_STEPS - 1)).alias("spill"))

    def sides(i: int) -> Column:
        """The sides of a cut that a row goes to, its own first; one where there is no cut."""
        cut = F.get("by", F.lit(i))
        along = F.get("cuts", cut["axis"]).cast("double")
        own = (along >= cut["at"]).cast("int")
        def to(side: Column, is_own: bool) -> Column:
            return F.struct(side.alias("side"), F.lit(is_own).alias("own"))

        both = F.when(F.abs(along - cut["at"]) <= reach, F.array(to(own, True), to(1 - own, False))).otherwise(F.array(to(own, True)))
        return F.when(cut.isNull(), F.array(to(F.lit(0), True))).otherwise(both)

    now = stored(nodes.select(
        F.concat_ws(":", "dim", F.col("label").cast("string")).alias("leaf"), F.lit(True).alias("home"), F.lit(False).alias("dense"),
        "node", "unit", "times", "cuts",
    ))
    for step in count():
        tried = [(step * TRIED + i) % CUTTING for i in range(TRIED)]
        shares = F.array(*[F.lit(i / _STEPS) for i in range(1, _STEPS)])
        sizes = now.where("home and not dense").groupBy("leaf").agg(
            F.count("*").alias("n"), *[F.percentile_approx(F.col("cuts")[t].cast("double"), shares, 1000).alias(f"q{t}") for t in tried]
        ).where(F.col("n") > group)
        candidates = F.array(*map(candidate, tried))
        best = F.filter(F.sort_array(candidates, asc=False), lambda c: c["spill"] <= _SPILL)
        large = stored(sizes.select(F.col("leaf").alias("leaf_"), F.slice(best, 1, 2).alias("by")))
        if large.isEmpty():
            return now.select("leaf", "home", "node", "unit", "times")
        routed = now.join(large, F.col("leaf") == F.col("leaf_"), "left")

        # a home row is a query too, so the visits to other sides come from it
        split = routed.withColumn("s0", F.explode(sides(0))).withColumn("s1", F.explode(sides(1)))
        same = F.col("by").isNull() | (F.size("by") == 0)
        now = stored(split.select(
            F.when(same, F.col("leaf")).otherwise(F.concat_ws(":", "leaf", "s0.side", "s1.side")).alias("leaf"),
            (F.col("home") & F.col("s0.own") & F.col("s1.own")).alias("home"),
            (F.col("dense") | F.coalesce(F.size("by") == 0, F.lit(False))).alias("dense"), "node", "unit", "times", "cuts",
        ))


def _pairs(asking: np.ndarray, asked: np.ndarray, similarity: float, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (asking, asked) of the links of one group, by blocks of queries: enough collisions, then the cosine."""
    half = WINDOW * spread(similarity)
    axes = _directions(6, asked.shape[1], COUNTED)
    data, along = asked @ axes, asking @ axes
    order = np.argsort(data, axis=0, kind="stable")
    data = np.take_along_axis(data, order, 0)
    order = np.ascontiguousarray(order.T)
    for start in range(0, len(asking), _BLOCK):
        part = along[start:start + _BLOCK]
        counts = np.zeros((len(part), len(asked)), np.uint8)
        for p in range(COUNTED):
            low = np.searchsorted(data[:, p], part[:, p] - half, "left")
            high = np.searchsorted(data[:, p], part[:, p] + half, "right")
            for row, a, b in zip(counts, low.tolist(), high.tolist(), strict=True):
                row[order[p, a:b]] += 1
        q, d = np.nonzero(counts >= need)
        q += start
        close = np.concatenate([np.einsum("ij,ij->i", asking[q[i:i + _SOME]], asked[d[i:i + _SOME]]) for i in range(0, len(q), _SOME)] or [np.zeros(0)])
        yield q[close >= similarity], d[close >= similarity]


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component numbers (the smallest member) after adding the links a - b."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            deeper = root[root]
            if (deeper == root).all():
                break
            root = deeper


def linked(visiting: DataFrame, similarity: float, group: int = GROUP) -> DataFrame:
    """(node, root, links): links of a node that one task found, and the smallest node it reaches there.

    A pair is looked at once: the node with the smaller digest asks, in the group where the other is at home.
    Queries and home rows of a group are dealt over pieces of about ``group``, and each pair of
    pieces is one task's group.
    """
    sizes = visiting.groupBy("leaf").agg(F.count_if("home").alias("homes"), F.count("*").alias("visitors"))
    sizes = stored(sizes.where("homes > 0 and visitors > 1").select(
        F.col("leaf").alias("leaf_"), F.ceil(F.col("homes") / group).cast("int").alias("down"), F.ceil(F.col("visitors") / group).cast("int").alias("across")
    ))
    rows = visiting.join(sizes, F.col("leaf") == F.col("leaf_"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    piece = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asking = rows.select("leaf", "node", "unit", "times", F.lit(False).alias("home"), piece("across").alias("i"), F.explode(up_to("down")).alias("j"))
    asked = rows.where("home").select("leaf", "node", "unit", "times", F.lit(True).alias("home"), F.explode(up_to("across")).alias("i"), piece("down").alias("j"))
    need = needed_collisions()

    def compare(table: pa.Table) -> pa.Table:
        names = np.array(table.column("node").to_pylist())
        order = np.argsort(names, kind="stable")
        table, names = table.take(pa.array(order)), names[order]
        home = table.column("home").to_numpy(zero_copy_only=False)
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(len(names), -1)
        times = table.column("times").to_numpy()
        found, root = np.zeros(len(names), np.int64), np.arange(len(names))
        asks, homes = np.flatnonzero(~home), np.flatnonzero(home)
        for q, d in _pairs(unit[asks], unit[homes], similarity, need):
            q, d = asks[q], homes[d]
            once = names[q] < names[d]
            q, d = q[once], d[once]
            found += np.bincount(q, times[d], len(names)).astype(np.int64) + np.bincount(d, times[q], len(names)).astype(np.int64)
            root = _joined(root, q, d)
        hit = np.flatnonzero(found)
        return pa.table({"node": pa.array(names[hit].tolist(), pa.string()), "root": pa.array(names[root[hit]].tolist(), pa.string()), "links": found[hit]})

    return asking.unionAll(asked).groupBy("leaf", "i", "j").applyInArrow(compare, "node string, root string, links bigint")


def near_duplicates(embeddings: DataFrame, similarity: float = 0.98, group: int = GROUP) -> DataFrame:
    """(vec_id, n_links, component_id BIGINT, kept BOOLEAN), one row per row of ``embeddings``.

    Rows of one label link if the cosine of their vectors, in doubles, is at least ``similarity``.
    n_links: other rows linked directly; component_id: the smallest vec_id reachable, its own included;
    kept: is that its own.  A NULL label, and a vector that is NULL, empty, zero or holds a NULL or
    non-finite component, links with nothing, nor do vectors of different lengths.  Rows that repeat an id or a vector are
    rows of their own; a NULL vec_id never is a smallest one, has no component_id of its own and is not kept.

    Equal vectors of a label are one node of the graph, so exact copies cost nothing but the last join.
    Close pairs are found with a probability of at least about 0.99 each (``needed_collisions`` and ``visits``), closer ones with more;
    none below the similarity is linked.
    """
    rows = stored(unit_vectors(embeddings))
    valid = rows.where(F.col("node").isNotNull())
    nodes = stored(valid.groupBy("node").agg(
        F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("unit").alias("unit"), F.any_value("cuts").alias("cuts"),
        F.count("*").alias("times"), F.min("vec_id").alias("least"),
    ))
    found = stored(linked(visits(nodes, similarity, group), similarity, group))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy(F.col("node").alias("node_")).agg(F.sum("links").alias("links"))
    known = nodes.select("node", "times", "least").join(links, F.col("node") == F.col("node_"), "left").drop("node_")
    known = known.join(roots.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left")
    known = stored(known.select("node", "least", F.coalesce("root", "node").alias("root"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    answer = stored(known.join(least, "root").select(F.col("node").alias("node_"), "links", "component"))
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.select("vec_id", "node").join(answer, F.col("node") == F.col("node_"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
