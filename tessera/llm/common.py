"""Helpers shared by the training-data operators: scratch tables, samples, text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; longer texts are cut into windows where an operator allows it.
BLOCK_BYTES = 4 << 20
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one, but only if all runs in this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
        at = _LOCAL[0]
    return at.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and a lost executor can't lose it.

    The shuffles of the write are of no use after it; their files go at once (the setting for that is put back).
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(at, compression="zstd")
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out._kept_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def level(seed: int, *columns: str) -> Column:
    """A geometric level 0, 1, 2, ... (probability 1/2, 1/4, ...) drawn from the columns by hashing."""
    draw = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 40))
    return F.floor(F.lit(40.0) - F.log2(draw.cast("double") + F.lit(1.0))).cast("int")


def level_floors(totals: list[tuple], budget: float) -> dict:
    """From rows (group, level, weight): for each group the lowest and highest level of a run that fits the budget, as high and then as long as can be.

    A level that doesn't fit alone is passed over if it is above the run and ends the run otherwise. A group without a level that fits is left out.
    """
    runs: dict = {}
    for group, at, weight in sorted(totals, key=lambda r: -r[1]):
        low, high, left, open_ = runs.get(group, (None, None, budget, True))
        if not open_:
            continue
        if weight <= left:
            runs[group] = (at, at if high is None else high, left - weight, True)
        else:
            runs[group] = (low, high, left, high is None)
    return {g: (low, high) for g, (low, high, *_) in runs.items() if low is not None}


def drawn(rows: DataFrame, budget: Callable[[int], float], seed: int) -> DataFrame:
    """Of rows (group, text, weight) those of a sample, drawn by a hash of the text, that weighs at most budget(number of groups) in each group.

    Equal rows are drawn together; if a group is left without a sample since too many are equal, all are made distinct.
    """
    for distinct in (False, True):
        if distinct:
            rows = rows.dropDuplicates(["group", "text"])
        levelled = rows.withColumn("level", level(seed, "text"))
        totals = [tuple(r) for r in levelled.groupBy("group", "level").agg(F.sum("weight")).collect()]  # at most 41 for a group
        floors = level_floors(totals, budget(len({r[0] for r in totals})))
        if len(floors) == len({r[0] for r in totals}):
            break
    chosen = rows.sparkSession.createDataFrame([(g, *f) for g, f in floors.items()], f"g {rows.schema['group'].dataType.simpleString()}, low int, high int")
    return levelled.join(chosen, levelled["group"] == chosen["g"]).where("level between low and high").select("group", "text")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The (UTF-8) bytes of a string or binary array and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(pa.scalar("").cast(column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(spark: SparkSession) -> None:
    """For queries and pipelines, not operators: fewer rows in an Arrow batch than Spark's default, for small executors (Spark bounds its bytes anyway)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def release() -> None:
    """Return this process's free memory to the system; else what was held once counts for as long as it lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run):
    """``run`` (over an iterator of batches), returning free memory to the system when a task is done: Python workers live on."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes; a longer row comes alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that close inputs get unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between ASCII white space, A-Z in lower case, and the n + 1 offsets of the texts' words."""
    n = len(offsets) - 1
    solid = ~_BLANK[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    first[at] = solid[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    where = np.flatnonzero(solid)
    inside = where - starts[np.cumsum(first)[where] - 1]
    power = np.full(int(inside.max()) + 1, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    value = (_LOWER[raw[where]].astype(np.uint64) + np.uint64(1)) * power[inside]
    return mixed(np.add.reduceat(value, np.searchsorted(where, starts))), np.searchsorted(starts, offsets)


class HashIndex:
    """Open-addressing index of distinct uint64 keys; lookups run over whole arrays. Key 2**64 - 1 is reserved."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.at = np.full(1 << bits, self.EMPTY), np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self.slots(keys)
        while len(todo):
            free = self.keys[slot] == self.EMPTY
            self.at[slot[free]] = todo[free]  # of several for one slot the last stays
            won = free & (self.at[slot] == todo)
            self.keys[slot[won]] = keys[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys as given when built, -1 where there is none."""
        slot = self.slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], np.int32(-1))
        todo = np.flatnonzero((there != keys) & (there != self.EMPTY))
        while len(todo):
            slot_, want = (slot[todo] + 1) & self.mask, keys[todo]
            slot[todo] = slot_
            there = self.keys[slot_]
            hit = there == want
            out[todo[hit]] = self.at[slot_[hit]]
            todo = todo[~hit & (there != self.EMPTY)]
        return out


def numbered(rows: DataFrame, order: list[Column], name: str, at: str) -> DataFrame:
    """The rows, kept, with their place (from 0) in this order as column ``at``; equal rows follow each other in any order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    laid = tied.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie").withColumn(at, F.monotonically_increasing_id())
    out = keep(laid, name)
    part = F.shiftright(at, 33)
    offsets, before = [], 0
    for p, n in sorted(tuple(r) for r in out.groupBy(part.alias("_part")).count().collect()):  # a row for each partition
        offsets.append((p, before - (p << 33)))
        before += n
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part2 long, _offset long"))
    return out.join(table, part == F.col("_part2")).withColumn(at, F.col(at) + F.col("_offset")).drop("_part2", "_offset")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
