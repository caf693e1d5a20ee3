"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Python workers are used again and again: what a batch took goes back to the system, not to a pool of the worker's
pa.set_memory_pool(pa.system_memory_pool())

#: Text that is turned into Python objects at once.
PART_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder: the session's, else, on one machine only, a new one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))


def kept(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As kept(), but as Parquet: compressed, and read by column. For wide tables; it stays as long as the folder."""
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets go of what past steps shuffled: Spark deletes those files once the driver's JVM has collected their plans,
    which it does only when its heap is full. Tables of kept() and written() stay. What the driver's Python no longer
    uses goes back to the system too: the C library would keep it, next to the JVM's memory."""
    spark.sparkContext._jvm.System.gc()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def identity(text: Column) -> Column:
    """A 64-bit mark that tells rows with one id but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 of every text; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def slices(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about most_bytes at most (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if total and total + size > most_bytes:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches in runs of about PART_BYTES of text."""
    for batch in batches:
        yield from slices(batch, text, PART_BYTES)


def only_listed(docs: DataFrame, listed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that `listed` (columns mr_id, mr_mark: the id and identity() of a text) names, each once.

    Rows that repeat an id and a text are one document: one of them stays. Columns and their order are those of docs.
    """
    named = docs.alias("d")
    mark = identity(F.col(f"d.`{text_col}`"))
    here = F.col(f"d.`{id_col}`")
    stay = named.join(listed.alias("l"), here.eqNullSafe(F.col("l.mr_id")) & (mark == F.col("l.mr_mark")), "left_semi")
    again = docs.groupBy(F.col(f"`{id_col}`").alias("mr_id"), identity(F.col(f"`{text_col}`")).alias("mr_mark")).count().where("count > 1")
    again = kept(again.select("mr_id", "mr_mark"))
    if again.isEmpty():
        return stay
    repeated = again.alias("r")
    same = here.eqNullSafe(F.col("r.mr_id")) & (mark == F.col("r.mr_mark"))
    stay = stay.alias("d")
    once = stay.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col])
    return stay.join(repeated, same, "left_anti").unionByName(once)


class Marks:
    """A bitmap over the keys of a table: it tells most other keys apart, never one of its own.

    Its size follows the number of keys, a byte a key, up to MOST words of 64 bits. Beyond two keys a byte it would tell
    little apart: every key passes, and the join that follows decides (at that size Spark makes it a Bloom-filter join).
    """

    LEAST, MOST = 1 << 10, 1 << 17

    def __init__(self, keys: DataFrame, *columns: str):
        self.columns = columns
        n = keys.count()
        self.size = min(self.MOST, max(self.LEAST, 1 << (max(1, n) - 1).bit_length() >> 3))
        self.words = None
        if n > 16 * self.size:
            return
        words = [0] * self.size
        marked = keys.groupBy(self._word().alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), self._bit())).alias("bits"))
        for k, bits in marked.toLocalIterator():  # MOST rows at most
            words[k] = bits
        # written as text, which Spark folds into one literal
        self.words = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def _word(self) -> Column:
        return F.pmod(F.xxhash64(*self.columns), F.lit(self.size)).cast("int")

    def _bit(self) -> Column:
        return F.pmod(F.hash(*self.columns), F.lit(64)).cast("int")

    def has(self) -> Column:
        if self.words is None:
            return F.lit(True)
        return F.get(self.words, self._word()).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), self._bit())) != 0
