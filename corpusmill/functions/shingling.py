"""Character shingles of texts in Arrow batches: each different shingle of a run of texts is hashed once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

K, STRIDE, PRIME = 5, 2, (1 << 31) - 1
WIDEST = 4 * K  # bytes of a shingle


def runs(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets, UTF-8 bytes) of runs of about `most` bytes; a longer text is one run."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b, ends[a : b + 1] - ends[a], whole[ends[a] : ends[b]]
        a = b


def coded(ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(first place of each row, and the end; code of the shingle at each place; the different shingles by code).

    A row has a place at every second character that K - 1 others follow, or one place where it has fewer than K.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    first = np.searchsorted(at, ends)  # of each row, in characters
    sizes = np.diff(first)
    places = np.maximum(sizes - K, 0) // STRIDE + 1
    begins = np.concatenate([[0], np.cumsum(places)])
    char = np.repeat(first[:-1] - STRIDE * begins[:-1], places) + STRIDE * np.arange(begins[-1])
    at = np.concatenate([at, np.full(K + 1, len(data))])
    start, stop = at[char], np.minimum(at[np.minimum(char + K, len(at) - 1)], np.repeat(ends[1:], places))
    wide = np.maximum(stop - start, 0)
    held = np.concatenate([data, np.zeros(WIDEST, np.uint8)])
    code = np.empty(len(wide), np.int64)
    shingles: list[bytes] = []
    short = wide < 8
    if short.any():  # up to seven bytes and their number are one whole number
        s, w = (start, wide) if short.all() else (start[short], wide[short])
        words = np.ndarray(len(data) + 1, ">u8", held, strides=(1,))  # the eight bytes from each place
        w = w.astype(np.uint64)
        drop = (np.uint64(8) - np.maximum(w, np.uint64(1))) * np.uint64(8)
        key = np.where(w > 0, words[s].astype(np.uint64) >> drop, np.uint64(0)) | (w << np.uint64(56))
        met = pa.array(key).dictionary_encode()
        code[short] = met.indices.to_numpy()
        shingles += [(v & (1 << 56) - 1).to_bytes(v >> 56, "big") for v in met.dictionary.to_pylist()]
    if not short.all():
        s, w = start[~short], wide[~short]
        raw = np.zeros((len(s), WIDEST + 1), np.uint8)
        raw[:, 0] = w
        for i in range(WIDEST):
            raw[:, i + 1] = np.where(i < w, held[s + i], 0)
        kind = pa.binary(WIDEST + 1)
        met = pa.FixedSizeBinaryArray.from_buffers(kind, len(s), [None, pa.py_buffer(raw)]).dictionary_encode()
        code[~short] = met.indices.to_numpy() + len(shingles)
        shingles += [x[1 : 1 + x[0]] for x in met.dictionary.to_pylist()]
    return begins, code, shingles


def minima(begins: np.ndarray, code: np.ndarray, shingles: list[bytes], factors: list[tuple[int, int]]) -> np.ndarray:
    """rows x factors: the least (h * a + b) mod PRIME over a row's shingles, h being 32 bits of md5 mod PRIME."""
    h = np.frombuffer(b"".join(hashlib.md5(x).digest()[:4] for x in shingles), ">u4").astype(np.uint64) % np.uint64(PRIME)
    a, b = (np.array(x, np.uint64) for x in zip(*factors, strict=True))
    table = np.empty((len(h), len(a)), np.uint32)
    for i in range(0, len(h), 512):
        x = h[i : i + 512, None] * a + b  # below PRIME * PRIME
        y = ((x & np.uint64(PRIME)) + (x >> np.uint64(31))).astype(np.uint32)  # below 2 * PRIME
        np.minimum(y, y - np.uint32(PRIME), out=table[i : i + 512])
    out = np.empty((len(begins) - 1, len(a)), np.uint32)
    for row, (s, e) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
        low = table.take(code[s : min(e, s + 4096)], axis=0).min(axis=0)
        for p in range(s + 4096, e, 4096):
            np.minimum(low, table.take(code[p : min(e, p + 4096)], axis=0).min(axis=0), out=low)
        out[row] = low
    return out


def _mapped(docs: DataFrame, name: str, kind: T.DataType, of) -> DataFrame:
    """docs(text, ...) with text replaced by of(begins, code, shingles) of each row"""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(others)
            for a, b, ends, data in runs(batch.column(len(others))):
                part = rest.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, of(*coded(ends, data))], names=[*others, name])

    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(name, kind)])
    return docs.select(*others, "text").mapInArrow(run, schema)


def with_minima(docs: DataFrame, factors: list[tuple[int, int]], name: str = "sig") -> DataFrame:
    """docs(text, ...) with an array of minima in place of text; rows without text go."""

    def of(begins, code, shingles) -> pa.Array:
        values = minima(begins, code, shingles, factors).astype(np.int64)
        ends = np.arange(len(values) + 1, dtype=np.int32) * len(factors)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))

    return _mapped(docs.filter("text IS NOT NULL"), name, T.ArrayType(T.LongType()), of)


def with_counts(docs: DataFrame, name: str = "n") -> DataFrame:
    """docs(text, ...) with the number of different shingles in place of text."""

    def of(begins, code, shingles) -> pa.Array:
        row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        pair = np.sort(row * len(shingles) + code)
        first = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
        return pa.array(np.bincount(first // max(1, len(shingles)), minlength=len(begins) - 1).astype(np.int64))

    return _mapped(docs, name, T.LongType(), of)
