"""What the operators share: stored steps, and Arrow batches of texts in and columns out."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duotext.runtime import shared_dir

#: Texts are handed to Python functions in groups of about this many bytes (or one text).
GROUP_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the folder of ``spark.checkpoint.dir``.

    An executor that is lost later costs no recomputation.  Without that setting a local
    session (tests) takes a folder of its own, and a cluster session fails.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shared_copy(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet files in the same folder, read back; they are deleted when the session ends."""
    spark = df.sparkSession
    stored(spark.range(1))  # names the folder
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame, taken: Sequence[str]) -> tuple[DataFrame, list[F.Column]]:
    """``docs`` with other names for columns called like one of ``taken``, and what selects them under their own names again."""
    used = {c.lower() for c in (*docs.columns, *taken)}
    names = []
    for c in docs.columns:
        name = c
        while name.lower() in map(str.lower, taken) or (name != c and name.lower() in used):
            name = f"{name}_"
        used.add(name.lower())
        names.append(name)
    return docs.toDF(*names), [F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)]


def folded(word_text: F.Column) -> F.Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(word_text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: F.Column) -> F.Column:
    """The maximal runs of ``[^\\x20\\x09-\\x0D]`` as an array; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


#: Digits, letters and all bytes from 0x80 on stay, A-Z in lower case; everything else separates.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def let(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def leading(n: int, fits: Callable[[F.Column], F.Column]) -> F.Column:
    """How many of the indexes 0 to n - 1 fit, where all that fit come first: a binary search in the plan."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]) if n else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & fits(at + step - 1), at + step).otherwise(at))


def training_row(doc_id: F.Column, remainder: int) -> F.Column:
    """Is crc32 of the id as text, modulo 5, another than ``remainder``?  True for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != remainder, F.lit(True))


def groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of bounded bytes, each with its texts as UTF-8 (NULL: empty)."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + GROUP_BYTES, "right")))
        yield batch.slice(start, end - start), [t or b"" for t in texts.slice(start, end - start).to_pylist()]
        start = end


def map_texts(
    docs: DataFrame, make: Callable[[], Callable[[list[bytes]], Sequence[Sequence]]], added: str, keep: Sequence[str],
    text_col: str = "text",
) -> DataFrame:
    """The columns ``keep`` and those of the DDL string ``added``, row by row from the text.

    ``make`` runs once per task and returns the function that turns a list of UTF-8 texts
    into one sequence (or Arrow array of the type) per added column.  Added columns replace kept ones of the same name.
    """
    new = T.StructType.fromDDL(added)
    names = [c for c in keep if c not in new.names]
    column = text_col
    while column not in names and column in docs.columns and column != text_col or column in new.names:
        column = f"_{column}"
    source = docs.select(*names, *[F.col(text_col).alias(column)] * (column not in names))
    schema = T.StructType([source.schema[c] for c in names] + new.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        gc.disable()  # memos of many small objects and no cycles: searching for garbage would only take time
        try:
            for batch in batches:
                for part, texts in groups(batch, column):
                    made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(work(texts), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(part.columns[:len(names)] + made, names + new.names)
        finally:
            gc.enable()

    return source.mapInArrow(run, schema)
