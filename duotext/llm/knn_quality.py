"""Quality by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotext.llm.texts import map_texts, stored, training_row

#: Hashed features and words of a text that give one; a memo of words is emptied beyond so many.
DIMENSIONS, MEMO = 4096, 400_000
_UPPER, _DIGIT, _LETTER = re.compile(r"[A-Z]+"), re.compile(r"[0-9]+"), re.compile(r"[a-z\x80-\xff]+")
_RUN = re.compile(r"(.)\1+")
#: Texts compared with all neighbours at a time.
_BLOCK = 512


def shape(word: bytes) -> str:
    """Upper case A, digits 0, all other letters a, runs as one; other characters stay."""
    text = _UPPER.sub("A", _DIGIT.sub("0", _LETTER.sub("a", word.decode("latin-1"))))
    return _RUN.sub(r"\1", text)[:12]


class Features:
    """Hashed counts of word shapes, pairs of neighbouring shapes and repeated lines of a text."""

    def __init__(self):
        self.memo: dict[bytes, str] = {}

    def counts(self, text: bytes) -> dict[int, float]:
        """Feature and weight (1 + log of its count); a text without words has the one feature of emptiness."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        words = text.split()
        shapes = []
        for word in words:
            found = self.memo.get(word)
            if found is None:
                found = self.memo[word] = shape(word)
            shapes.append(found)
        seen = Counter(shapes)
        seen.update(f"{a} {b}" for a, b in zip(shapes, shapes[1:], strict=False))
        lines = [x for x in text.split(b"\n") if x.strip()]
        seen["<again>"] = 4 * (len(lines) - len(set(lines)))
        seen[f"<length {len(words).bit_length()}>"] = 1
        seen[f"<words {10 * len(set(words)) // max(1, len(words))}>"] = 2
        out: dict[int, float] = {}
        for name, n in seen.items():
            if n:
                slot = zlib.crc32(name.encode()) % DIMENSIONS
                out[slot] = out.get(slot, 0.0) + 1 + float(np.log(n))
        return out


class Votes:
    """Labelled vectors in the space of the strongest singular directions, and their votes."""

    def __init__(self, rows: list[dict[int, float]], labels: list[int], rank: int = 48, neighbours: int = 25):
        self.neighbours = min(neighbours, len(rows))
        self.labels = np.array(labels, np.float32)
        counted = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, row in enumerate(rows):
            counted[i, list(row)] = list(row.values())
        self.idf = np.log((1 + len(rows)) / (1 + (counted > 0).sum(0))).astype(np.float32) + 1
        weighted = counted * self.idf
        weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
        # randomised range finder, two power steps
        rank = max(1, min(rank, len(rows)))
        basis = weighted @ np.random.default_rng(7).standard_normal((DIMENSIONS, rank + 8)).astype(np.float32)
        for _ in range(2):
            basis = weighted @ (weighted.T @ np.linalg.qr(basis)[0])
        self.axes = np.ascontiguousarray(np.linalg.svd(np.linalg.qr(basis)[0].T @ weighted, full_matrices=False)[2][:rank].T)
        self.points = self.unit(weighted @ self.axes)

    @staticmethod
    def unit(vectors: np.ndarray) -> np.ndarray:
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)

    def score(self, rows: list[dict[int, float]]) -> list[float]:
        """Share of label 1 among the nearest labelled texts, each weighing its cosine to the fourth power."""
        out: list[float] = []
        for at in range(0, len(rows), _BLOCK):
            part = rows[at:at + _BLOCK]
            latent = np.stack([np.array(list(r.values()), np.float32) * self.idf[list(r)] @ self.axes[list(r)] for r in part])
            cosine = self.unit(latent) @ self.points.T
            near = np.argpartition(-cosine, self.neighbours - 1, axis=1)[:, :self.neighbours]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3).astype(np.float64) ** 4
            out += np.round((weight * self.labels[near]).sum(1) / weight.sum(1), 6).tolist()
        return out


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1500, fold: int = 0) -> Votes | None:
    """Votes of at most ``per_label`` texts of each quality, the first by a hash of their ids.

    Only rows whose crc32(doc_id as text) modulo 5 is not ``fold`` are learned from.  None
    without such rows.  What reaches the driver is bounded by ``per_label``: ids, then
    hashed feature counts of those texts.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & training_row(F.col("doc_id"), fold))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    first = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    chosen = stored(first[0].unionByName(first[1]))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        features = Features()
        return lambda group: [[{k: float(v) for k, v in features.counts(t).items()} for t in group]]

    rows = map_texts(texts, make, "features map<int,double>", ("doc_id", "quality")).dropDuplicates(["doc_id"]).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    return Votes([r["features"] for r in rows], [r["quality"] for r in rows])


def quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_label: int = 1500, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep``, held_out BOOLEAN, score DOUBLE, predicted INT for each document.

    score, 0 to 1, is the weighted vote of the nearest labelled texts over exact cosines;
    without labelled texts it is 0.5.  predicted: 1 if the score is at least ``threshold``.
    The text alone decides the score; NULL and empty texts are scored like any other.
    held_out: crc32(doc_id as text) modulo 5 is 0 (false for a NULL id).

    The broadcast model is bounded: 2 * ``per_label`` vectors of 48 numbers, and 4096 by 48 axes.
    """
    model = fit(docs, labels, per_label)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    held = ~training_row(F.col("doc_id"), 0)
    names = tuple(dict.fromkeys((*keep, "doc_id")))

    def make():
        votes, features = shipped.value, Features()
        if votes is None:
            return lambda texts: [[0.5] * len(texts)]
        return lambda texts: [votes.score([features.counts(t) for t in texts])]

    made = map_texts(docs, make, "score double", names).withColumn("held_out", held)
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int")).select(*keep, "held_out", "score", "predicted")
