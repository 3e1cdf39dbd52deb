"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import importable

#: The white space that separates words in every contract of this package (Java, RE2 and Python syntax).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the numpy code handles at a time (a larger document is handled alone).
PIECE_BYTES = 2 << 20
#: Bytes of an Arrow batch that a worker gets.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of units, about, that a task remembers with their token ids.
STORE_BYTES = 24 << 20
#: Spark's switch by which a statement's shuffle files go when it ends, and not when the driver's JVM next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local run has a temporary
    folder, and any other an error, as executors wouldn't see each other's files."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.gettempdir()}/reportloom-{spark.sparkContext.applicationId}"
    return where.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends at the latest."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    store, where = _hadoop(spark, path)
    store.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, later reads are column-pruned and have size statistics. Its
    shuffles' files are deleted with its job, so disks hold those of one job at a time."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place in its group by the order, from 0 (_index), and the group's number of rows (_size).

    Rows are range-sorted over all groups, so a group of any size is spread, and written with their place in their partition;
    what is counted and joined then is a row for each (partition, group). ``scratch_tables`` holds the tables that it reads."""
    held = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_id", F.monotonically_increasing_id())
    held = written(held, name)
    held_part = F.shiftright("_id", 33)
    runs = held.groupBy(F.col(group), held_part.alias("_part")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = written(runs.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_size")), name)
    out = held.withColumn("_part", held_part).join(runs, [group, "_part"]).withColumn("_index", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")
    out.scratch_tables = [held, runs]
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        store, where = _hadoop(df.sparkSession, df.scratch)
        store.delete(where, True)


def held_out(doc_id: str, modulus: int) -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by ``modulus``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == 2


def sampled_ids(df: DataFrame, doc_id: str, most: int, by: str | None = None, most_values: int = 200) -> DataFrame:
    """At most ``most`` ids in the order of their hash: a fixed sample, read from ids alone. With ``by``, as many of each
    of its ``most_values`` most frequent values.

    Rows whose hash lies beyond four times the share that the sample needs are dropped before anything is ordered, so what is
    sorted is of the sample's size, whatever the table's, and nothing but a count comes to the driver.
    """
    rows = df.select(F.col(doc_id).alias("_id"), *([F.col(by).alias("_v")] if by else []), F.xxhash64(F.col(doc_id)).alias("_h"))
    part = F.pmod("_h", F.lit(1 << 30)) / float(1 << 30)
    if by is None:
        share = min(1.0, 4.0 * most / max(1, df.count()))
        return rows.filter(part < share).distinct().orderBy("_h", "_id").limit(most).select(F.col("_id").alias(doc_id))
    counts = rows.groupBy("_v").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_v").limit(most_values)
    quota = counts.select("*", F.greatest(F.lit(1), F.floor(F.lit(most) / F.count("*").over(Window.partitionBy()))).alias("_q"))
    at = Window.partitionBy("_v").orderBy("_h", "_id")
    held = rows.join(F.broadcast(quota), "_v").filter(part < 4.0 * F.col("_q") / F.col("_n")).distinct().withColumn("_k", F.row_number().over(at))
    return held.filter(F.col("_k") <= F.col("_q")).select(F.col("_id").alias(doc_id))


def lean(run):
    """``run`` (batches to batches) for mapInArrow, with small memory: the session's Arrow batches have ``BATCH_BYTES`` at
    most from here on, and a worker hands back what a task leaves unused, as workers wait for later tasks."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")

    def held(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return held


def hand_back() -> None:
    """Gives this process's unused memory back to the system; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with at most ``limit`` bytes of text each, or one row; and their texts, null as ''."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = plain(batch.column(column))
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, upto - at), texts.slice(at, upto - at)
            at = upto


class UnitStore:
    """Units (texts that are encoded on their own) and their token ids: what a task has solved it doesn't solve again. The
    store is a task's own, so nothing outlives it in a worker, and it is emptied before it holds more than ``most`` bytes."""

    def __init__(self, solve, kind, most: int = STORE_BYTES):
        self.solve, self.kind, self.most = solve, np.dtype(kind), most  # solve(units): their ids end to end, sizes, scores
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.start, self.used = np.zeros(1 << 16, self.kind), np.zeros(1 << 13, np.int64), 0
        self.total = np.zeros(1 << 13)
        self.bytes = 0
        self._add([""], np.zeros(0, self.kind), np.zeros(1, np.int64), np.zeros(1))

    def _add(self, units, ids, sizes, totals) -> None:
        base, n = len(self.place), len(units)
        self.place.update(zip(units, range(base, base + n), strict=True))
        self.ids = _room(self.ids, self.used + len(ids))
        self.start, self.total = _room(self.start, base + n + 1), _room(self.total, base + n)
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[base : base + n + 1] = self.used + np.concatenate([[0], np.cumsum(sizes)])
        self.total[base : base + n] = totals
        self.used += len(ids)
        # a text object, its slot and its rows; beyond ASCII a character takes up to four bytes
        self.bytes += 170 * n + 4 * sum(map(len, units)) + self.kind.itemsize * len(ids)

    def places(self, units: list[str]) -> np.ndarray:
        """Numbers of distinct units in the store; they hold until the next call."""
        if self.bytes > self.most:
            self.clear()
        places = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(places < 0)
        if len(new):
            own = [units[k] for k in new.tolist()]
            places[new] = len(self.place) + np.arange(len(new))
            self._add(own, *self.solve(own))
        return places

    def sizes(self, places: np.ndarray) -> np.ndarray:
        return self.start[places + 1] - self.start[places]

    def spelled(self, places: np.ndarray) -> np.ndarray:
        """The ids of the units at these places, end to end."""
        return self.ids[ragged(self.start[places], self.sizes(places))]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """The array, or a longer one that begins with it and holds n values at least."""
    if n <= len(x):
        return x
    out = np.zeros(max(n, len(x) + len(x) // 2), x.dtype)
    out[: len(x)] = x
    return out


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts end to end, and the n + 1 offsets of the texts in them."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[0], starts[0]+1, ... for each of the runs, end to end."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def arrow_type(schema: str):
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
