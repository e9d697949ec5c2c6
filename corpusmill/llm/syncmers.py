"""Document fingerprints from closed syncmers.

A k-byte substring is a closed syncmer if the least of its s-byte substrings' hashes stands first or last in it.
Whether it is chosen depends on its own bytes alone, so shared passages give shared anchors wherever they stand.
A fingerprint is a one-permutation min-hash of the anchors: 64 slots, each with the least anchor hash dealt to it.

Defined results: null and empty texts have the fingerprint of no anchors (all slots empty); two of those have
likeness 1, one of them and any other text 0. A text shorter than k bytes is one anchor. Equal texts have equal
fingerprints. Repeated rows each get their own row; columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MULT, U64, mix, sliding_min, table, text_buffers, tiles, window_hashes

K, S, SLOTS = 24, 10, 64
NONE = np.uint32(0xFFFFFFFF)


def closed_syncmers(data: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(starts, 64-bit hashes) of all closed syncmers of a run of bytes."""
    at, hashes = [], []
    for a, b, n in tiles(len(data), k - 1):
        small, large = window_hashes(data[a:b], (s, k))
        least = sliding_min(small, k - s + 1)[:n]
        where = np.flatnonzero((small[:n] == least) | (small[k - s : k - s + n] == least))
        at.append(where + a)
        hashes.append(large[where])
    return (np.concatenate(at), np.concatenate(hashes)) if at else (np.zeros(0, np.int64), np.zeros(0, U64))


def document_anchors(ends: np.ndarray, data: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start within the row's text, hash); rows shorter than k bytes are one anchor."""
    at, hashes = closed_syncmers(data, k, s)
    row = np.searchsorted(ends, at, "right") - 1
    inside = at + k <= ends[row + 1] if len(at) else np.zeros(0, bool)
    at, row, hashes = at[inside], row[inside], hashes[inside]
    sizes = np.diff(ends)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        raw = data.tobytes()
        own = [int.from_bytes(hashlib.blake2b(raw[ends[i] : ends[i + 1]], digest_size=8).digest(), "little") for i in short]
        row, at, hashes = np.concatenate([row, short]), np.concatenate([at, ends[short]]), np.concatenate([hashes, np.array(own, U64)])
    return row, at - ends[row], hashes


def sketches(ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """rows x SLOTS of uint32: the least anchor hash of each slot, NONE where there is none."""
    row, _, h = document_anchors(ends, data)
    h = mix(h * U64(MULT))
    cell = row * SLOTS + (h >> U64(58)).astype(np.int64)
    value = (h & U64(0xFFFFFFFF)).astype(np.uint32)
    value[value == NONE] = 0
    order = np.argsort((cell.astype(U64) << U64(32)) | value)
    cell, value = cell[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else []
    out = np.full((len(ends) - 1) * SLOTS, NONE, np.uint32)
    out[cell[first]] = value[first]
    return out.reshape(-1, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the slots used by either in which both hold the same anchor; 1 where neither has any."""
    used = ((a != NONE) | (b != NONE)).sum(axis=1)
    same = ((a == b) & (a != NONE)).sum(axis=1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def as_hex(x: np.ndarray) -> list[str]:
    raw = x.astype(">u4").tobytes()
    width = 4 * SLOTS
    return [raw[i : i + width].hex() for i in range(0, len(raw), width)]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(pa.array(texts, pa.large_string()))


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """One row (doc_id, start byte, anchor) per closed syncmer: join on anchor for positional matching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, h = document_anchors(*text_buffers(b.column(1)), k, s)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).take(pa.array(row)), "start": at, "anchor": h.view(np.int64)})

    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("anchor", T.LongType())]
    )
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def located(passages: DataFrame, docs: DataFrame, least: float = 0.5, most_broadcast: int = 4_000_000) -> DataFrame:
    """passages(item_id, text), docs(doc_id, text) -> item_id, doc_id, start, anchors, share: where passages stand.

    Anchors of equal bytes meet, and those that agree on where the passage would begin (a byte, from 0) count together;
    places with `least` of the passage's anchors are returned. Anchors of passages are counted, and broadcast up to
    `most_broadcast`. Passages without text are nowhere; a null id is an id like others.
    """
    asked = anchors(passages.select(F.col("item_id").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("item_id"), F.col("start").alias("inside"), "anchor"
    )
    asked = asked.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("item_id")))  # a passage's anchors are few
    known = F.broadcast(asked) if asked.limit(most_broadcast + 1).count() <= most_broadcast else asked
    met = anchors(docs).join(known, "anchor").withColumn("start", F.col("start") - F.col("inside"))
    found = met.groupBy("item_id", "doc_id", "start").agg(F.countDistinct("inside").alias("anchors"), F.first("of").alias("of"))
    return found.select(
        "item_id", "doc_id", "start", "anchors", F.round(F.col("anchors") / F.col("of"), 6).alias("share")
    ).filter(F.col("share") >= least)


def whole_passages(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """passages(item_id, text), docs(doc_id, text) -> item_id, doc_id, start: the first place (a byte) of each passage in
    each document that holds all of it, a row for each row of either.

    Anchors say which document may hold which passage, and the texts of those are compared: anchors leave the ends of a
    passage open, and may agree at several places. Passages so short that they may have no anchor are looked up in every
    document; an empty one stands at the start of each.
    """
    long = F.octet_length("text") >= 2 * K  # an anchor begins at one of K - S places in a row at least
    asked = passages.select("item_id", F.col("text").alias("passage"), F.md5("text").alias("_key"), long.alias("_long"))
    wanted = passages.filter(long).select(F.md5("text").alias("item_id"), "text").distinct()
    near = located(wanted, docs, least=1.0).select(F.col("item_id").alias("_key"), F.col("doc_id").alias("_doc")).distinct()
    texts = docs.select("doc_id", "text")
    met = texts.join(near, F.col("doc_id").eqNullSafe(F.col("_doc"))).join(asked.filter("_long"), "_key")
    brief = texts.crossJoin(F.broadcast(asked.filter("NOT _long")))  # passages of a few bytes
    columns = ["item_id", "doc_id", "text", "passage"]
    both = met.select(*columns).unionByName(brief.select(*columns)).filter(F.contains("text", "passage"))
    start = F.octet_length(F.left("text", F.instr("text", F.col("passage")) - 1)).cast("long")
    return both.select("item_id", "doc_id", start.alias("start"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fingerprint) per row of docs; a scan, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fingerprint": as_hex(sketches(*text_buffers(b.column(1))))})

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(part: pa.Table) -> pa.Table:
    """A range of documents in descending order, with the head of the next range as its last row."""
    part = part.sort_by([("head", "ascending"), ("doc_id", "descending"), ("mark", "ascending"), ("text", "ascending")])
    n = part.num_rows - sum(part.column("head").to_pylist())
    ids = part.column("doc_id").to_pylist()[:n]
    texts = [x or "" for x in part.column("text").to_pylist()[: n + 1]]
    out = {f.split()[0]: [] for f in EDITED.split(", ")}
    sizes = np.array([len(x) for x in texts[:n]], np.int64)
    step, a = 4 << 20, 0
    marks = np.concatenate([[0], np.cumsum(sizes)])
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(marks, marks[a] + step, "right")) - 1))
        own = texts[a : b + 1]
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(own[:-1], own[1:], strict=True)]
        plain, changed = sketches(*joined(own)), sketches(*joined(edited))
        out["doc_id"] += ids[a:b]
        out["n_chars"] += sizes[a:b].tolist()
        out["edited_sha256"] += [hashlib.sha256(x.encode()).hexdigest() for x in edited]
        out["fingerprint"] += as_hex(plain[:-1])
        out["edited_fingerprint"] += as_hex(changed)
        out["near_edited"] += likeness(plain[:-1], changed).tolist()
        out["near_next"] += likeness(plain[:-1], plain[1:]).tolist()
        a = b
    kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
    return pa.table(out, schema=pa.schema(list(zip(out, kinds, strict=True))))


class Ranges:
    """Runs of documents by descending id, then by the hash of the text, cut after given keys (~id, hash)."""

    def __init__(self, keys: list[tuple[int, int]]):
        keys = sorted(set(keys))
        self.ids, self.marks = np.array([k for k, _ in keys], np.int64), np.array([m for _, m in keys], np.int64)

    def of(self, ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Number of the range of each document: how many cuts lie before it."""
        low, high = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        for i in np.flatnonzero(high > low):  # cuts within the rows of one id
            low[i] += np.searchsorted(self.marks[low[i] : high[i]], marks[i], "left")
        return low


def _placed(docs: DataFrame, ranges: Ranges, columns: list[str], heads: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """Adds the number of each row's range; with heads, also copies of the rows that another range needs as its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = ~b.column(0).fill_null(LEAST).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            part = ranges.of(ids, marks)
            flags = np.zeros(len(ids), np.int32)
            if heads is not None:
                extra = np.array(
                    [i for i, x in enumerate(zip(ids.tolist(), marks.tolist(), strict=True)) if x in heads], np.int64
                )
                to = np.array([heads[ids[i], marks[i]] for i in extra.tolist()], np.int64)
                part, flags = np.concatenate([part, to]), np.concatenate([flags, np.ones(len(extra), np.int32)])
                b = b.take(pa.array(np.concatenate([np.arange(len(ids)), extra])))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(part.astype(np.int32)), pa.array(flags)], names=[*columns, "part", "head"]
            )

    added = [T.StructField("part", T.IntegerType()), T.StructField("head", T.IntegerType())]
    return docs.select(*columns).mapInArrow(run, T.StructType([*(docs.schema[c] for c in columns), *added]))


LEAST = -(2**63)
PER_RANGE = 24  # keys a range among which the cuts are chosen


def compared(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likenesses.

    Documents go by descending doc_id (equal ids: by the text's hash, then by text; a null id last) into ranges of about
    part_bytes; the text moves once. The head of each range is sent also to the range before it, and the first document
    to the last. Cuts are chosen among the keys of least hash, PER_RANGE a range, so rows of one id, or without one, are
    cut as others are. The driver sees those keys (16 bytes each) and the heads of the ranges only.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"),
        F.coalesce("text", F.lit("")).alias("text")
    )
    total, n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], EDITED)
    parts = int(max(1, min(n, total // part_bytes)))
    key = [F.coalesce(F.bitwise_not("doc_id"), F.lit(~LEAST)).alias("k"), "mark"]
    ranges = Ranges([])
    if parts > 1:
        every = max(1, n // (PER_RANGE * parts))
        chosen = docs.select(*key).filter(
            F.pmod(F.xxhash64("k", "mark"), F.lit(every)) == 0
        ).toArrow().sort_by([("k", "ascending"), ("mark", "ascending")])
        at = np.unique(np.linspace(0, len(chosen), parts + 1).astype(np.int64)[1:-1])
        picked = chosen.take(pa.array(at[at < len(chosen)]))
        ranges = Ranges(list(zip(picked.column("k").to_pylist(), picked.column("mark").to_pylist(), strict=True)))
    tops = _placed(docs, ranges, ["doc_id", "mark"]).select(
        "part", F.struct(*key).alias("top")
    ).groupBy("part").agg(F.min("top").alias("top")).collect()
    order = sorted((r["part"], tuple(r["top"])) for r in tops)
    heads = {top: order[i - 1][0] for i, (_, top) in enumerate(order)}
    return _placed(docs, ranges, ["doc_id", "mark", "text"], heads).groupBy("part").applyInArrow(_compare, EDITED)


def op10_fingerprints(spark, sf_dir):
    return compared(table(spark, sf_dir, "documents"))
