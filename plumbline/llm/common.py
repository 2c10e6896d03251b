"""Helpers of the corpus operators: UTF-8 buffers and word hashes in numpy, Arrow batches, and exact prefix sums in Spark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import checkpoint_root, durable

__all__ = ["durable", "arrow_batches", "pieces", "utf8", "words", "byte_hashes", "normalised", "mix", "Powers", "window_hashes", "prefix_sums", "stored", "only"]

# A task's numpy arrays are eight to sixteen times the bytes in hand; so many bytes of text are taken at once.
PIECE_BYTES = 2_000_000

SPACE_SEPARATED = np.ones(256, dtype=bool)
SPACE_SEPARATED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALPHANUMERIC = np.ones(256, dtype=bool)
ALPHANUMERIC[0x00:0x30] = ALPHANUMERIC[0x3A:0x61] = ALPHANUMERIC[0x7B:0x80] = False

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def arrow_batches(spark: SparkSession, records: int = 512) -> None:
    """Keep Arrow batches small enough for rows with long texts; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > records:
        spark.conf.set(key, str(records))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (n + 1) and validity of a string or binary column; a null text is empty and not valid."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    if not valid.all():  # a null may keep bytes in the buffer
        column = column.fill_null(b"")
        return utf8(column)[:2] + (valid,)
    return raw[off[0]: off[-1]], off - off[0], valid


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts are together about ``limit`` bytes; one longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, off, _ = utf8(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and low bits of hashes are well spread."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1024)
            for name, base in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WORD_POWERS = Powers(0x9E3779B97F4A7C15)
_WINDOW_POWERS = Powers(0xC2B2AE3D27D4EB4F)


def byte_hashes(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray, fold: np.ndarray = SAME):
    """Words of many texts at once.

    ``inside`` marks the bytes that belong to words and ``fold`` maps bytes before hashing. Returns the start and end of every
    word in ``data``, its 64-bit hash, and for each text the index of its first word (n + 1 values).
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    w = inside[fold[data]]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[off] = True
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    starts = np.flatnonzero(w & (~before | cut[:-1]))
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    ends = np.flatnonzero(w & (~after | cut[1:])) + 1
    first = np.searchsorted(starts, off)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), first
    length = ends - starts
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    up, _ = _WORD_POWERS.to(int(length.max()) + 1)
    h = np.add.reduceat(_BYTES[fold[data[w]]] * up[place], at)
    return starts, ends, mix(h + length.astype(np.uint64)), first


def normalised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words one after the other with one space behind each, and where each word begins there (n + 1 values)."""
    length = ends - starts
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length + 1, out=to[1:])
    out = np.full(int(to[-1]), 32, np.uint8)
    if len(starts):
        shift = np.repeat(to[:-1] - starts, length)
        source = np.arange(int(length.sum())) + np.repeat(starts - (np.cumsum(length) - length), length)
        out[source + shift] = data[source]
    return out, to


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive symbols (windows that cross texts are for the caller to leave out)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WINDOW_POWERS.to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], dtype=np.uint64, out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Running sum of ``value`` before each row of its group, in ``order``, for groups of any size.

    Rows are range-partitioned by group and order, so a group may spread over many tasks; the totals of (task, group), of which
    there are at most tasks + groups, give the offsets. ``df`` must be cheap to read twice and give the same rows each time.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group + order]
    dealt = durable(df.repartitionByRange(n, *keys).withColumn("_task", F.spark_partition_id()))
    totals = dealt.groupBy(*group, "_task").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_task").alias("_t"),
                           F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group], F.col("_task") == F.col("_t"))
    inside = Window.partitionBy("_task", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.join(totals, same)
            .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_task", "_t", "_offset", *[f"_g_{c}" for c in group]))


def hex_long(text_hash: Column, digits: int = 13) -> Column:
    """The first ``digits`` (at most 15) hexadecimal digits as a long; the same number in any SQL that has md5."""
    return F.conv(F.substring(text_hash, 1, digits), 16, 10).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have (names are told apart without case)."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it again: a cut of the lineage that takes less disk than rows."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


# Up to so many 8-byte ids travel to every task; a longer list is joined by a shuffle.
ID_LIST = 2_000_000


def only(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` that occur in ``ids`` (distinct rows, few bytes each): sent to every task if there are few, else a shuffle join."""
    return df.join(F.broadcast(ids) if ids.count() <= ID_LIST else ids, on, "left_semi")
