"""Ranked lexical search: posting lists in geometric blocks with coordinatewise-maximum summaries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from duotext.llm.texts import map_texts, shared_copy, stored, terms

#: Bytes of item texts that are searched for at a time, cells of a shard's table, documents of a shard and of a block.
ITEM_BYTES, CELLS, SHARD, BLOCK = 1 << 20, 1 << 22, 4096, 32
#: Directions onto which documents are projected to compare them.
SKETCH = 16
#: Lists of one item are cut down in so many groups before they meet.
_SALTS = 64
#: Fixed values of the score.
SCALE, FREE, BY_LENGTH = 1_000_000_000, 25, 75


def index(docs: DataFrame, vocabulary: Sequence[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs), one row per document: its number of terms, and those of ``vocabulary`` by position with their counts."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    width = len(vocabulary)

    def make():
        number = known.value

        def work(texts: list[bytes]):
            sizes, found = [], []
            for text in texts:
                words = terms(text)
                sizes.append(len(words))
                found.append(np.array([number.get(w, -1) for w in words], np.int64))
            ids = np.concatenate(found)
            key = np.repeat(np.arange(len(texts)) * width, sizes)[ids >= 0] + ids[ids >= 0]
            cells, counts = np.unique(key, return_counts=True)
            ends = pa.array(np.searchsorted(cells, np.arange(len(texts) + 1) * width), pa.int32())
            positions = pa.array(cells % max(1, width), pa.int32())
            return sizes, pa.ListArray.from_arrays(ends, positions), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))

        return work

    return map_texts(docs, make, "n bigint, terms array<int>, tfs array<int>", ("doc_id",))


@dataclass
class Statistics:
    """Documents with a term, all their terms, and documents that hold each term of the vocabulary."""

    documents: int
    length: int
    holders: np.ndarray

    def weights(self) -> np.ndarray:
        ratio = (2 * self.documents + 2) / (2 * self.holders.astype(np.float64) + 1)
        return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)

    def norm(self, n: np.ndarray) -> np.ndarray:
        return FREE + BY_LENGTH * n * self.documents // max(1, self.length)


def statistics(indexed: DataFrame, width: int) -> Statistics:
    """Of all indexed documents; a task sends one row per term at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["term", "n"])

    holders = np.zeros(width, np.int64)
    for r in indexed.select("terms").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        holders[r["term"]] = r["n"]
    whole = indexed.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Statistics(whole[0], whole[1], holders)


class Best:
    """The ``k`` best (score, document) of an item so far, ties to the smaller id, NULL last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.nameless, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, nameless: np.ndarray, doc: np.ndarray) -> None:
        """Scores below ``least`` can't be among the best."""
        can = score >= self.least
        if not can.any():
            return
        score, nameless, doc = (np.concatenate(p) for p in ((self.score, score[can]), (self.nameless, nameless[can]), (self.doc, doc[can])))
        first = np.lexsort((doc, nameless, -score))[:self.k]
        self.score, self.nameless, self.doc = score[first], nameless[first], doc[first]
        if len(first) == self.k:
            self.least = int(self.score[-1])


class Shard:
    """Some documents as rows of impacts, and their posting lists, blocked when a search needs them."""

    def __init__(
        self, terms_: np.ndarray, rows: np.ndarray, impacts: np.ndarray, doc: np.ndarray, nameless: np.ndarray, width: int, axes: np.ndarray,
        beside: list[np.ndarray],
    ):
        """``beside``: for each term, the terms of all items that hold it, ascending: what its summaries are asked for."""
        self.doc, self.nameless, self.beside = doc, nameless, beside
        self.table = np.zeros((len(doc), width))  # whole numbers, exact as doubles
        self.table[rows, terms_] = impacts
        self.top = self.table.max(0, initial=0)
        order = np.argsort(terms_, kind="stable")
        self.rows, self.ends = rows[order], np.searchsorted(terms_[order], np.arange(width + 1))
        sketch = self.table @ axes
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def blocked(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents of the term block by block, starts of the blocks, summaries).

        Each document of the list goes to the most similar of evenly spaced pivots of the list; a
        summary holds the largest impact among the documents of a block for each term of ``beside``.
        """
        if term not in self.blocks:
            rows = self.rows[self.ends[term]:self.ends[term + 1]]
            count = -(-len(rows) // BLOCK)
            if count > 1:
                pivots = self.sketch[rows[np.linspace(0, len(rows) - 1, count).astype(int)]]
                rows = rows[np.argsort((self.sketch[rows] @ pivots.T).argmax(1), kind="stable")]
            starts = np.arange(0, len(rows), BLOCK)
            self.blocks[term] = rows, starts, np.maximum.reduceat(self.table[np.ix_(rows, self.beside[term])], starts, axis=0)
        return self.blocks[term]

    def search(self, wanted: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Bring ``best`` up to date for an item whose terms ``wanted``, ascending, weigh ``weights``.

        A document's score is at most the sum of its terms' largest contributions, so once the smallest
        of those sum to less than the least score of the best, lists of these terms alone hold
        nothing new.  In the other lists, the largest contributions first, a block is left out only if
        its summary's score is below that least score.
        """
        most = weights * self.top[wanted]
        order = np.argsort(most, kind="stable")
        rest, seen = np.cumsum(most[order]), np.zeros(len(self.doc), bool)
        for at in range(len(order) - 1, -1, -1):
            if rest[at] < best.least or not most[order[at]]:
                break
            term = int(wanted[order[at]])
            rows, starts, summaries = self.blocked(term)
            hold = summaries[:, np.searchsorted(self.beside[term], wanted)] @ weights >= best.least
            if not hold.any():
                continue
            chosen = rows if hold.all() else rows[np.repeat(hold, np.diff(np.append(starts, len(rows))))]
            chosen = chosen[~seen[chosen]]
            seen[chosen] = True
            score = (self.table[np.ix_(chosen, wanted)] @ weights).astype(np.int64)
            best.add(score, self.nameless[chosen], self.doc[chosen])


def _beside(items: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For each term, the terms of all items that hold it."""
    holders: list[list[np.ndarray]] = [[] for _ in range(width)]
    for positions in items:
        for term in positions.tolist():
            holders[term].append(positions)
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in holders]


def _shards(batches: Iterator[pa.RecordBatch], width: int, stats: Statistics) -> Iterator[tuple]:
    """(term, row, impact, document, is its id NULL) arrays of up to ``SHARD`` documents, fewer for a wide vocabulary."""
    size = max(64, min(SHARD, CELLS // max(1, width)))
    waiting: list[pa.RecordBatch] = []

    def joined() -> tuple:
        table = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        lists, ids = table.column("terms"), table.column("doc_id")
        sizes = np.diff(lists.offsets.to_numpy())
        rows = np.repeat(np.arange(len(table)), sizes)
        tf = table.column("tfs").flatten().to_numpy().astype(np.int64)
        norm = stats.norm(table.column("n").to_numpy())
        nameless = ids.is_null().to_numpy(zero_copy_only=False)
        return lists.flatten().to_numpy(), rows, SCALE * tf // (1000 * tf + 8 * norm[rows]), ids.fill_null(0).to_numpy(), nameless

    held = 0
    for batch in batches:
        while len(batch):
            part, batch = batch.slice(0, size - held), batch.slice(size - held)
            waiting.append(part)
            held += len(part)
            if held == size:
                yield joined()
                waiting, held = [], 0
    if held:
        yield joined()


def _search(indexed: DataFrame, wanted: list[tuple[np.ndarray, np.ndarray]], width: int, stats: Statistics, k: int) -> DataFrame:
    """(item INT, doc_id, score): the best of each task for each item."""
    shipped = indexed.sparkSession.sparkContext.broadcast((wanted, stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, stats = shipped.value
        axes = np.random.default_rng(11).standard_normal((width, SKETCH))
        found, beside = [Best(k) for _ in items], _beside([positions for positions, _ in items], width)
        for terms_, rows, impacts, doc, nameless in _shards(batches, width, stats):
            shard = Shard(terms_, rows, impacts, doc, nameless, width, axes, beside)
            for (positions, weights), best in zip(items, found, strict=True):
                shard.search(positions, weights, best)
        sizes = [len(b.doc) for b in found]
        docs = pa.array(np.concatenate([b.doc for b in found]), pa.int64(), mask=np.concatenate([b.nameless for b in found]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(found)), sizes), pa.int32()), docs, pa.array(np.concatenate([b.score for b in found]))],
            ["item", "doc_id", "score"],
        )

    return indexed.mapInArrow(run, "item int, doc_id bigint, score bigint")


def _batches(items: DataFrame) -> Iterator[list[Row]]:
    """The distinct items, in parts of about ``ITEM_BYTES`` of text."""
    distinct = items.select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // ITEM_BYTES
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for i in range(parts):
        yield distinct.where(part == i).collect()


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank INT, doc_id, score): the ``k`` documents of the highest score above 0 for each item, exactly.

    Terms, weights and scores are whole numbers (see ``Statistics`` and ``_shards``).  Statistics are those of all
    documents.  Each task holds the documents it reads in shards, clusters each posting list that it needs into
    blocks of similar documents and skips a block only if its summary proves that none of them can be among
    the best of the task so far; what tasks find is cut to ``k`` an item in two steps.  No text is shuffled.

    Equal scores go by ascending doc_id, NULL last; rows that repeat an id are documents of their own.
    NULL and empty texts hold no terms: as documents they are found by nothing, as items they find nothing.
    Items that repeat id and text count once.  Items are searched ``ITEM_BYTES`` of text at a time, each part
    with an index of its own vocabulary, so that what is broadcast stays bounded.
    """
    found = []
    for part in _batches(items):
        counted = [Counter(terms(bytes(r["text"] or b""))) for r in part]
        vocabulary = sorted(set().union(*counted))
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        indexed = shared_copy(index(docs, vocabulary), "postings")
        stats = statistics(indexed, len(vocabulary))
        weight = stats.weights()
        wanted = []
        for terms_ in counted:
            positions = np.array(sorted(number[t] for t in terms_), np.int64)
            wanted.append((positions, weight[positions] * np.array([terms_[vocabulary[i]] for i in positions], np.float64)))
        best = _search(indexed.where(F.size("terms") > 0), wanted, len(vocabulary), stats, k)
        order = [F.desc("score"), F.col("doc_id").isNull(), F.col("doc_id")]
        salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(_SALTS))).orderBy(*order)
        few = best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
        ranked = stored(few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k))
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)], "item int, item_id bigint")
        found.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
