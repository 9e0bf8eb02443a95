"""Vocabulary and fixed-length encoding of texts and text pairs.

The ``INLINE_VOCAB`` most frequent tokens of a vocabulary are a broadcast dictionary of checked
size, so nearly all tokens are encoded by a map over Arrow batches without a shuffle.  Only
if a vocabulary is larger are the tokens that the dictionary misses joined, each once per
chunk of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duotext.functions import text as tx
from duotext.functions.hashing import as_list
from duotext.operators.ordering import global_index
from duotext.runtime import cut_lineage
from duotext.schema import MAX_LENGTH

INLINE_VOCAB = 1 << 20
DICTIONARY_BYTES = 64 << 20  # a dictionary of fewer tokens is broadcast if they take more
CHUNK_ROWS = 4096  # rows that ask together for the ids of rare tokens
VOCAB_SIZE = 50_000
_BANDS = 8  # bands of counts per doubling


def build_vocab(df: DataFrame, columns: str | Sequence[str] = "text", size: int | None = VOCAB_SIZE) -> DataFrame:
    """The ``size`` most frequent tokens as ``(token, n, id)``, or all (``None``); ties go by token.

    Counting combines on the map side, so a token that makes up a third of the corpus
    costs no more than any other.  The counts are written to the shared folder: the
    corpus is read once, and a histogram of the counts (a few hundred bands) tells
    which ones can be in the top, so that only about ``size`` rows are sorted.
    """
    words = None
    for c in as_list(columns):
        part = df.select(F.explode(tx.tokens(F.col(c))).alias("token"))
        words = part if words is None else words.unionAll(part)
    counts = cut_lineage(words.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    if size is None:
        placed = global_index(counts.withColumn("__rank", -F.col("n")), ["__rank", "token"], "__at")
        return placed.select("token", "n", (F.col("__at") + tx.FIRST_TOKEN_ID).cast("int").alias("id"))
    bands = counts.groupBy(F.floor(F.log2("n") * _BANDS).alias("band")).agg(
        F.count(F.lit(1)).alias("tokens"), F.min("n").alias("least")
    )
    enough, least = 0, 0
    for b in sorted(bands.collect(), key=lambda r: -r["band"]):
        enough, least = enough + b["tokens"], b["least"]
        if enough >= size:
            break
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(size)
    # over at most `size` rows
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return top.select("token", "n", (rank + tx.FIRST_TOKEN_ID - 1).cast("int").alias("id"))


def unknown_share(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Share of the unknown id among the tokens of encoded rows, as one row."""
    tokens = F.filter(ids, lambda i: (i == tx.UNK_ID) | (i >= tx.FIRST_TOKEN_ID))
    unknown = F.size(F.filter(ids, lambda i: i == tx.UNK_ID))
    share = F.sum(unknown) / F.nullif(F.sum(F.size(tokens)), F.lit(0))
    return df.agg(F.coalesce(share, F.lit(0.0)).alias("unknown_share"))


def _dictionary(vocab: DataFrame, most: int | None) -> tuple[pa.Array, pa.Array, bool]:
    """(tokens, ids, is that the whole vocabulary) of the ``most`` most frequent tokens (``None``: all), fewer if they exceed ``DICTIONARY_BYTES``."""
    while most is not None:
        held = vocab.agg(
            F.count_if(F.col("id") >= tx.FIRST_TOKEN_ID + most).alias("rest"),
            F.sum(F.when(F.col("id") < tx.FIRST_TOKEN_ID + most, F.octet_length("token") + 8)).alias("bytes"),
        ).first()
        if (held["bytes"] or 0) <= DICTIONARY_BYTES:
            break
        most //= 2
    head = vocab if most is None else vocab.where(F.col("id") < tx.FIRST_TOKEN_ID + most)
    rows = head.select(F.col("token").cast("string"), F.col("id").cast("int")).toArrow().combine_chunks()
    first = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
    return first[0], first[1], most is None or not held["rest"]


def _numbers(lists: pa.Array, tokens: pa.Array, ids: pa.Array) -> pa.Array:
    """Ids of token lists, NULL for tokens that are not among ``tokens``.

    The distinct words of the lists are what is hashed, and ``tokens`` are looked up among them: an index of
    all ``tokens`` for each batch would take more memory and time than the batch.
    """
    words = lists.flatten().dictionary_encode()
    at = pc.index_in(tokens, value_set=words.dictionary)
    known = at.is_valid()
    found = np.full(len(words.dictionary), -1, np.int32)
    # of a repeated token the first id counts: it is written last
    found[at.filter(known).to_numpy()[::-1]] = ids.filter(known).to_numpy()[::-1]
    return pa.array(found, mask=found < 0).take(words.indices)


def _lists(like: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` cut into lists as long as those of ``like``."""
    return pa.ListArray.from_arrays(pc.subtract(like.offsets, like.offsets[0]), values)


def token_ids(
    df: DataFrame, vocab: DataFrame, columns: Mapping[str, str], key: str | Sequence[str],
    limit: int = MAX_LENGTH, inline: int | None = None,
) -> DataFrame:
    """Add, for each ``{output: text column}``, the ids of the text's first ``limit`` tokens.

    ``limit`` is the fixed encoded length: no id behind it can reach an output row.
    Unknown tokens get the unknown id.  The ``inline`` most frequent tokens (default
    ``INLINE_VOCAB``, of ``DICTIONARY_BYTES`` at most) are a broadcast dictionary, looked up for whole Arrow
    batches: a map over the rows.  Only if the vocabulary is larger, the distinct tokens of each chunk of rows that
    the dictionary misses are joined with the rest of it.  A stream can't pass a
    join, so for it the dictionary holds the whole vocabulary, whatever its size.
    """
    cut = {out: tx.first_tokens(F.col(c), limit) for out, c in columns.items()}
    tokens, ids, whole = _dictionary(vocab, None if df.isStreaming else INLINE_VOCAB if inline is None else inline)
    shipped = df.sparkSession.sparkContext.broadcast((tokens, ids))
    if not whole:
        rest = vocab.where(F.col("id") >= tx.FIRST_TOKEN_ID + len(tokens)).select("token", "id")
        return _joined_ids(df, rest, cut, as_list(key), shipped)
    numbers, lists, unknown = _numbers, _lists, tx.UNK_ID

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def lookup(texts: pa.Array) -> pa.Array:
        return lists(texts, numbers(texts, *shipped.value).fill_null(unknown))

    return df.withColumns({out: lookup(c) for out, c in cut.items()})


def _joined_ids(df: DataFrame, rest: DataFrame, cut: Mapping[str, Column], keys: list[str], shipped: Broadcast) -> DataFrame:
    """The ids where the vocabulary has more than the dictionary: ``rest``.

    Rows are dealt over chunks of about ``CHUNK_ROWS`` by a hash of their keys.  Each chunk asks once for each of
    its distinct missing tokens; a token of every text is asked for once per chunk and never by frequent
    tokens, which the dictionary holds.  Then a chunk's lists meet the ids found for it; no
    text travels with them.
    """
    chunks = max(1, -(-df.count() // CHUNK_ROWS))
    lists = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(chunks)).alias("__chunk"), *[c.alias(out) for out, c in cut.items()])
    outs, numbers, as_lists, unknown = list(cut), _numbers, _lists, tx.UNK_ID

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for out in outs:
                tokens = batch.column(out)
                chunk = batch.column("__chunk").take(pc.list_parent_indices(tokens))
                unseen = pc.is_null(numbers(tokens, *shipped.value))
                parts.append(pa.table({"__chunk": chunk, "token": tokens.flatten()}).filter(unseen))
            yield from pa.concat_tables(parts).group_by(["__chunk", "token"]).aggregate([]).to_batches()

    found = lists.select("__chunk", *outs).mapInArrow(missing, "__chunk bigint, token string").distinct().join(rest, "token")

    def fill(rows: pa.Table, words: pa.Table) -> pa.Table:
        words = words.combine_chunks()
        more = [words.column(c).combine_chunks() for c in ("token", "id")]
        more = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in more]
        for out in outs:
            tokens = rows.column(out).combine_chunks()
            known = numbers(tokens, *shipped.value)
            if words.num_rows:
                known = pc.coalesce(known, numbers(tokens, *more))
            rows = rows.set_column(rows.schema.get_field_index(out), out, as_lists(tokens, known.fill_null(unknown)))
        return rows.drop_columns(["__chunk"])

    schema = T.StructType([*df.select(*keys).schema.fields, *[T.StructField(out, T.ArrayType(T.IntegerType())) for out in outs]])
    made = lists.groupBy("__chunk").cogroup(found.select("__chunk", "token", F.col("id").cast("int").alias("id")).groupBy("__chunk")).applyInArrow(fill, schema)
    made = made.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(made, same, "left").drop(*[f"__{k}" for k in keys])


def encode_text(
    df: DataFrame, vocab: DataFrame, text: str = "text", key: str | Sequence[str] = "row_id",
    max_length: int = MAX_LENGTH, pad: str = "max_length", inline: int | None = None,
) -> DataFrame:
    """One text to ``input_ids`` and ``attention_mask``: ``bos tokens eos``, cut and padded.

    ``pad='longest'`` pads to the longest row of the table instead of ``max_length``.
    """
    found = token_ids(df, vocab, {"__ids": text}, key, max_length - 2, inline)
    ids = F.concat(F.array(F.lit(tx.BOS_ID)), F.col("__ids"), F.array(F.lit(tx.EOS_ID)))
    if pad == "longest":
        length = longest_row(df, text, max_length)
    elif pad == "max_length":
        length = max_length
    else:
        raise ValueError("pad must be 'max_length' or 'longest'")
    return pad_and_mask(found.withColumn("input_ids", ids).drop("__ids"), length)


def longest_row(df: DataFrame, text: str, max_length: int = MAX_LENGTH) -> Column:
    """Encoded length of the longest row, as a scalar subquery over token counts only."""
    size = F.least(F.size(tx.tokens(F.col(text))) + 2, F.lit(max_length))
    return df.agg(F.max(size).cast("int").alias("longest")).scalar()


def pad_and_mask(df: DataFrame, length: int | Column, ids: str = "input_ids", mask: str = "attention_mask") -> DataFrame:
    """Pad the ids to ``length`` and add the mask (1 real, 0 pad)."""
    plain = F.col(ids)
    return df.withColumns({ids: tx.padded(plain, length), mask: tx.attention(plain, length)})


def pair_truncation(
    df: DataFrame, first: str, second: str, budget: int, out: tuple[str, str] = ("kept_first", "kept_second")
) -> DataFrame:
    """Lengths kept of two segments when the longest gives way first."""
    a, b = tx.truncated_lengths(F.col(first), F.col(second), budget)
    return df.withColumns({out[0]: a, out[1]: b})


def encode_pair(
    df: DataFrame, vocab: DataFrame, first: str = "target", second: str = "context",
    key: str | Sequence[str] = "row_id", max_length: int = MAX_LENGTH, inline: int | None = None,
) -> DataFrame:
    """Two segments to one row of ids, target first: ``bos A eos eos B eos``, cut to ``max_length``."""
    budget = max_length - 4
    found = token_ids(df, vocab, {"__a": first, "__b": second}, key, budget, inline)
    # both segments were cut at the budget already, which leaves the truncation rule unchanged
    cut = pair_truncation(
        found.withColumns({"__la": F.size("__a"), "__lb": F.size("__b")}), "__la", "__lb", budget, ("__ka", "__kb")
    )
    eos = F.lit(tx.EOS_ID)
    ids = F.concat(
        F.array(F.lit(tx.BOS_ID)), F.slice("__a", F.lit(1), F.col("__ka")), F.array(eos, eos),
        F.slice("__b", F.lit(1), F.col("__kb")), F.array(eos),
    )
    scratch = ["__a", "__b", "__la", "__lb", "__ka", "__kb"]
    return pad_and_mask(cut.withColumn("input_ids", ids).drop(*scratch), max_length)


# functions that look tokens up travel to the executors with the query
cloudpickle.register_pickle_by_value(sys.modules[__name__])
