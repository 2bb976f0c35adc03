"""Helpers shared by the training-data operators: Arrow batches, hashed words, document packs."""
from __future__ import annotations

import ctypes
import inspect
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barloom.session import cut_lineage

#: Bytes of text packed into one row by ``pack_documents``; one longer document is a row of its own.
PACK_BYTES = 4_000_000
#: Documents in a pack at most; a row's number within its pack takes 16 bits.
PACK_DOCS = 60_000
#: Rows and bytes of one Arrow batch handed to Python.
ARROW_ROWS = 500
ARROW_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Returns what a finished task held to the machine.

    Spark keeps Python workers for later stages, several an executor; without this each would hold on to
    the largest amount that any stage took.
    """
    for words in WordHashes.remembered:
        words.clear()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def freeing(run: Callable) -> Callable:
    """``run`` (over batches) and ``give_back`` at its end."""
    def batches_then_free(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return batches_then_free


def freeing_groups(fn: Callable) -> Callable:
    """``fn`` (of one group's table, or of two cogrouped ones) and ``give_back`` after every call."""
    def one(rows: pa.Table) -> pa.Table:
        try:
            return fn(rows)
        finally:
            give_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return fn(left, right)
        finally:
            give_back()

    return one if len(inspect.signature(fn).parameters) == 1 else two


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict] | dict], schema: str) -> DataFrame:
    """Run ``fn`` on every Arrow batch of ``df``; it returns a dict of columns."""
    bound_batches(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield columns_batch(fn(batch), arrow)

    return df.mapInArrow(freeing(run), schema)


def map_texts(docs: DataFrame, fn: Callable[[pa.RecordBatch], dict], made: str, id_col: str, text_col: str,
              carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, the columns that ``fn`` makes of (doc_id, text), then the text and carried columns where asked for.

    Carried columns may have any names: they travel under numbers.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    kept = ["doc_id", *["text"] * with_text, *(f"_{i}" for i in range(len(carry)))]
    schema = StructType([*plain.select(*kept).schema.fields, *StructType.fromDDL(made).fields])
    arrow = arrow_schema(spark, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = columns_batch(fn(batch), arrow)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *out.columns], names=[*kept, *out.schema.names])

    found = plain.mapInArrow(freeing(run), schema)
    names = [f.name for f in StructType.fromDDL(made)]
    return found.select("doc_id", *names, *["text"] * with_text, *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)))


def kept(df: DataFrame) -> DataFrame:
    """A frame that several steps read: kept on the executors' disks once computed.

    Its lineage stays, so what a lost executor held is computed again; costly passes over
    all texts are written tables (``cut_lineage``) instead.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def number_in_order(df: DataFrame, order: list, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with every row's place (from 1) in the order of the columns ``order``.

    Rows are dealt to range partitions by sampled borders and written once; partitions are
    numbered apart and lifted by the sizes of those before them (a row a partition). Rows that tie
    are spread as well, in any order.
    """
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_order_{i}" for i in range(len(order))]
    keyed = df.select("*", *(c.alias(n) for c, n in zip(order, names, strict=True)), F.monotonically_increasing_id().alias("_spread"))
    ways = [*(F.col(n) for n in names), F.col("_spread")]
    placed = cut_lineage(keyed.repartitionByRange(max(conf, parts or 0), *ways).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lifted = placed.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*ways)) + F.col("_before")
    return lifted.withColumn(name, place).drop(*names, "_spread", "_part", "_before")


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def columns_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_mod(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: Hashes that sample rows are chosen by have so many bits, so that the smallest share still chooses some.
SHARE_BITS = 62


def share_hash(column: str):
    """A hash of a column of SHARE_BITS bits; rows under ``share_bound(share)`` are about that share of all."""
    return F.xxhash64(column).bitwiseAND(F.lit((1 << SHARE_BITS) - 1))


def share_bound(share: float) -> int:
    return int(min(1.0, share) * float(1 << SHARE_BITS))


class WordHashes(dict):
    """Word (bytes) -> hash of 32 bits or, by another function, 64; remembered up to a bounded number of words, until the task ends."""

    #: All of a Python worker's, which ``give_back`` empties.
    remembered: list[WordHashes] = []

    def __init__(self, limit: int = 150_000, function: Callable[[bytes], int] = zlib.crc32):
        super().__init__()
        self.limit, self.function = limit, function
        self.remembered.append(self)

    def __missing__(self, word):
        value = self.function(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pack_documents(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents gathered into rows of about ``PACK_BYTES``: pack, n_docs, n_bytes, blob.

    A row is compressed Arrow data (doc_id, UTF-8 text, then the carried columns) and is
    written to the shared folder, so that a pack's number stays the same for every later pass.
    """
    bound_batches(docs.sparkSession)
    schema = "pack bigint, n_docs bigint, n_bytes bigint, blob binary"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        first = TaskContext.get().partitionId() << 23
        held: list[pa.RecordBatch] = []
        docs_, size, number = 0, 0, 0

        def row():
            inner = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, inner.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(inner)
            return columns_batch({"pack": [first + number], "n_docs": [docs_], "n_bytes": [size], "blob": [sink.getvalue().to_pybytes()]}, arrow)

        for batch in batches:
            lengths = [len(t) for t in text_bytes(batch.column(1))]
            start = 0
            for i, n in enumerate(lengths):
                if docs_ and (size + n > PACK_BYTES or docs_ >= PACK_DOCS):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield row()
                    held, docs_, size, number, start = [], 0, 0, number + 1, i
                docs_, size = docs_ + 1, size + n
            if len(lengths) > start:
                held.append(batch.slice(start))
        if docs_:
            yield row()

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    return cut_lineage(plain.mapInArrow(freeing(run), schema))


def unpack_table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def unpack(blob: bytes) -> tuple[list[int], list[bytes]]:
    inner = unpack_table(blob)
    return inner.column("doc_id").to_pylist(), text_bytes(inner.column("text"))
