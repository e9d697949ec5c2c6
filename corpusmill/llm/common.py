"""Shared pieces: tables in the shared folder, Arrow text buffers, rolling hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

U64 = np.uint64
MULT = 0x9E3779B97F4A7C15


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (in local mode) one made here where it is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks, and the next stage shares their limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, UTF-8 bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(ends):
        ends = np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends - ends[0], whole[ends[0] : ends[-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash can be used."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(MULT))


def window_hashes(data: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of every window of each width, by doubling; width w gives len(data) - w + 1 values."""
    n, level, length = len(data), _BYTE[data], 1
    made: dict[int, tuple[int, np.ndarray | None]] = {w: (0, None) for w in widths}
    while True:
        for w, (have, h) in made.items():
            if w & length and n >= have + length:
                made[w] = (
                    have + length,
                    level if h is None else h[: n - have - length + 1] * U64(pow(MULT, length, 1 << 64)) + level[have:]
                )
        if 2 * length > max(widths) or n < 2 * length:
            break
        level = level[:-length] * U64(pow(MULT, length, 1 << 64)) + level[length:]
        length *= 2
    return [mix(made[w][1]) if made[w][0] == w and n >= w else np.zeros(0, U64) for w in widths]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    if len(x) < width:
        return x[:0]
    length = 1
    while 2 * length <= width:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    rest = width - length
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def tiles(n: int, overlap: int, size: int = 1 << 18) -> Iterator[tuple[int, int, int]]:
    """(start, end with overlap, number of window starts) covering n bytes; small enough for the CPU's caches."""
    for a in range(0, max(0, n - overlap), size):
        starts = min(size, n - overlap - a)
        yield a, a + starts + overlap, starts
