"""Removal of repeated substrings: every byte covered by a `length`-byte string that also starts earlier.

Strings are ranked by prefix doubling. Places are ranked by the eight raw bytes that begin there, then by pairs of ranks
at growing offsets (8, 16, 32, ...; the last pair overlaps, so that it is `length` bytes long): pairs are sorted, equal
ones get one rank, and a place whose rank is unique drops out, so it takes no part in the next round. Ranks are exact.

Places that cannot repeat never enter the rounds, and places that can only equal one another are sorted together:

1. Of the K-byte names in each window of `length` bytes the least (leftmost if equal) is the window's anchor. Windows
   with equal bytes have equal anchors at equal places, so each window need only be compared with windows of anchors of
   the same name. An anchor stands for a run of window starts, about 35, and their bytes are its span.
2. Anchors meet by name. Unique names drop out. Of anchors with equal spans (48 bits of the name and a 64-bit hash of
   the bytes), all but the first are repeats, whole. First ones that meet others with a different span go on.
3. Their spans are fetched and dealt by name, and the places in them doubled up to `length`, some names at a time: of
   places of one rank all but the first are repeats. Windows of names that more than `hot` anchors share are sorted by Spark as whole strings
   instead, with partial minima, which needs no group in one place.
4. Covered bytes are removed, in blocks of documents.

Nothing but sizes reaches the driver. Order is by doc_id, then place in the text; rows with one id are ordered by a
hash of the text, and rows equal in both count as one document (each is returned, neither is the other's repeat). A null
id comes first. Null and empty texts and those below `length` bytes keep all bytes. Only doc_id and text are read; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, MULT, U64, mix, release, sliding_min, stored, table, text_buffers, tiles, window_hashes

K = 32
TILE = 1 << 18
_LOW = U64(TILE * 2 - 1)
_POWERS = np.cumprod(np.concatenate([[U64(1)], np.full(TILE * 2, U64(MULT))]))
_INVERSE = np.cumprod(np.concatenate([[U64(1)], np.full(TILE * 2, U64(pow(MULT, -1, 1 << 64)))]))


def anchors(ends: np.ndarray, data: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, ...]:
    """(anchor place, first window start, last window start, name, span hash) of all anchors, in places of `data`."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    width = length - k + 1
    for a, b, n in tiles(len(data), length - 1, TILE):
        part = data[a:b]
        (name,) = window_hashes(part, (k,))
        place = np.arange(len(name), dtype=U64)
        at = (sliding_min((name & ~_LOW) | place, width)[:n] & _LOW).astype(np.int64)
        starts = np.arange(a, a + n)
        limit = ends[np.searchsorted(ends, starts, "right").clip(max=len(ends) - 1)]
        valid = starts + length <= limit
        change = np.ones(n, bool)
        change[1:] = (at[1:] != at[:-1]) | ~valid[:-1] | (limit[1:] != limit[:-1])
        first = np.flatnonzero(change & valid)
        stop = np.ones(n, bool)
        stop[:-1] = change[1:] | ~valid[1:]
        last = np.flatnonzero(stop & valid)
        # a hash of the bytes from first to last + length, by sums of byte values times powers
        sums = np.concatenate([[U64(0)], np.cumsum(_BYTE[part] * _INVERSE[: len(part)])])
        size = last + length - first
        span = mix(
            (sums[last + length] - sums[first]) * _POWERS[first] + mix(
                size.astype(U64) * U64(256) + (at[first] - first).astype(U64)
            )
        )
        for x, y in zip(out, (at[first] + a, first + a, last + a, name[at[first]], span), strict=True):
            x.append(y)
    return tuple(
        np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.int64, U64, U64), strict=True)
    )


def _anchored(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket, docs (ids and marks), entries: key (48 bits of name, 16 of document), span hash, place, reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1 << 13):
                b = whole.slice(lo, 1 << 13)
                ends, data = text_buffers(b.column(2))
                at, first, last, name, span = anchors(ends, data, length)
                if not len(at):
                    continue
                doc = np.searchsorted(ends, first, "right") - 1
                ids, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
                bucket = (name % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                place = (first - ends[doc]).astype(np.uint32)
                reach = (last - first).astype(np.uint8)
                out: list[list] = [[] for _ in range(7)]
                for i in range(buckets):
                    mine = order[cuts[i] : cuts[i + 1]]
                    if not len(mine):
                        continue
                    used, own = np.unique(doc[mine], return_inverse=True)
                    row = (
                        i, ids[used].tobytes(), marks[used].tobytes(), ((name[mine] & ~U64(0xFFFF)) | own.astype(U64)).tobytes(),
                        span[mine].tobytes(), place[mine].tobytes(), reach[mine].tobytes()
                    )
                    for x, y in zip(out, row, strict=True):
                        x.append(y)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])],
                    names=["bucket", "ids", "marks", "key", "span", "place", "reach"]
                )
        release()

    return docs.mapInArrow(run, "bucket int, ids binary, marks binary, key binary, span binary, place binary, reach binary")


def _sorted_out(part: pa.Table) -> pa.Table:
    """Anchors that are repeats whole (sure), and first ones whose name others share with a different span."""
    rows = part.to_pylist()
    get = lambda c, t: [np.frombuffer(r[c], t) for r in rows]
    ids, marks, keys = get("ids", np.int64), get("marks", np.int64), get("key", U64)
    base = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    own = np.concatenate([(k & U64(0xFFFF)).astype(np.int64) + o for k, o in zip(keys, base[:-1], strict=True)])
    all_ids, all_marks = np.concatenate(ids), np.concatenate(marks)
    turn = np.lexsort((all_marks, all_ids))
    new = np.ones(len(turn), bool)
    new[1:] = (all_ids[turn][1:] != all_ids[turn][:-1]) | (all_marks[turn][1:] != all_marks[turn][:-1])
    rank = np.empty(len(turn), np.int64)
    rank[turn] = np.cumsum(new) - 1
    key = np.concatenate(keys) >> U64(16)
    span, place, reach = (np.concatenate(get(c, t)) for c, t in (("span", U64), ("place", np.uint32), ("reach", np.uint8)))
    location = (rank[own] << 32) | place
    order = np.lexsort((location, span, key))
    key, span, location, place, reach, own = (x[order] for x in (key, span, location, place, reach, own))
    fresh_key, fresh_span = np.ones(len(key), bool), np.ones(len(key), bool)
    fresh_key[1:] = key[1:] != key[:-1]
    fresh_span[1:] = fresh_key[1:] | (span[1:] != span[:-1])
    group = np.cumsum(fresh_span) - 1
    first_location = location[fresh_span][group]
    sure = ~fresh_span & (location != first_location)
    names = np.cumsum(fresh_key) - 1
    spans = np.bincount(names, fresh_span)
    asked = fresh_span & (spans[names] > 1)
    keep = np.flatnonzero(sure | asked)
    out = pa.table({
        "doc_id": all_ids[own[keep]], "mark": all_marks[own[keep]], "place": place[keep].astype(np.int64), "reach": reach[keep].astype(np.int32),
        "name": key[keep].view(np.int64), "spans": spans[names[keep]].astype(np.int64), "sure": sure[keep],
    })
    release()
    return out


def _by_document(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row of left, id, mark, rows of right that belong to it) in a block of documents."""
    ids, marks = right.column("doc_id").to_numpy(), right.column("mark").to_numpy()
    order = np.lexsort((marks, ids))
    ids, marks = ids[order], marks[order]
    edge = np.flatnonzero(
        np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
    ) if len(ids) else np.zeros(0, int)
    where = {
        (i, m): order[a:b] for i, m, a,
        b in zip(ids[edge].tolist(), marks[edge].tolist(), edge.tolist(), [*edge.tolist(), len(ids)][1:], strict=True)
    }
    none = order[:0]
    for row, (i, m) in enumerate(zip(left.column("doc_id").to_pylist(), left.column("mark").to_pylist(), strict=True)):
        yield row, i, m, where.get((i, m), none)


def _spans(length: int):
    """Bytes of the asked anchors' spans; a document that stands in several equal rows gives them once."""

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        place, reach, name = (right.column(c).to_numpy() for c in ("place", "reach", "name"))
        rows, spans, done = [], [], set()
        texts = left.column("text").combine_chunks() if isinstance(left.column("text"), pa.ChunkedArray) else left.column("text")
        for row, i, m, own in _by_document(left, right):
            if len(own) and (i, m) not in done:
                done.add((i, m))
                raw = texts[row].as_buffer().to_pybytes()
                for j in own.tolist():
                    rows.append((i, m, j))
                    spans.append(raw[place[j] : place[j] + reach[j] + length])
        at = np.array([r[2] for r in rows], np.int64)
        release()
        return pa.table(
            {
                "name": name[at], "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                "mark": pa.array([r[1] for r in rows], pa.int64()), "place": place[at], "span": pa.array(spans, pa.binary())
            }
        )

    return run


_PIECES = "doc_id long, mark long, start long, stop long"


def _windows(part: pa.RecordBatch | pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the rows' spans, row of each window, its place in its text, its place in the bytes)."""
    ends, data = text_buffers(_as_text(part.column("span")))
    sizes = np.diff(ends)
    many = (sizes - length + 1).clip(0)
    row = np.repeat(np.arange(len(sizes)), many)
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return data, row, part.column("place").to_numpy()[row] + inside, ends[row] + inside


def doubled(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of the `length`-byte string at each start among all of them, -1 where no other start has its like."""
    words = data.astype(U64)
    for k in (1, 2, 4):
        words = (words[:-k] << U64(8 * k)) | words[k:] if len(words) > k else words[:0]
    offsets, size = [], 8  # of the pairs: 8, 16, 32, ..., and the rest
    while size < length:
        offsets.append(min(size, length - size))
        size += offsets[-1]
    wanted = [np.unique(starts)]  # places whose ranks a round needs, from the last round to the first
    for step in reversed(offsets):
        wanted.append(np.unique(np.concatenate([wanted[-1], wanted[-1] + step])))
    rank = np.full(len(data), -1, np.int64)
    at = wanted.pop()
    rank[at] = _reranked(words[at])
    del words
    for step in offsets:
        at = wanted.pop()
        at = at[(rank[at] >= 0) & (rank[at + step] >= 0)]
        got = _reranked((rank[at].astype(U64) << U64(32)) | rank[at + step].astype(U64))
        rank = np.full(len(data), -1, np.int64)
        rank[at] = got
    return rank[starts]


def _reranked(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys by sorting, -1 for unique ones."""
    _, rank, many = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(many[rank] > 1, rank, -1)


def _as_text(column) -> pa.Array:
    """Binary seen as a text column, for its buffers only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    return pa.Array.from_buffers(pa.large_string(), len(column), column.buffers(), offset=column.offset)


def _pieces(ids: np.ndarray, marks: np.ndarray, place: np.ndarray, length: int) -> pa.Table:
    """Repeated window starts, joined to runs, as covered bytes."""
    order = np.lexsort((place, marks, ids))
    ids, marks, place = ids[order], marks[order], place[order]
    new = np.ones(len(place), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (place[1:] > place[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1 if len(first) else first
    return pa.table({"doc_id": ids[first], "mark": marks[first], "start": place[first], "stop": place[last] + length})


def _resolved(length: int, most: int = 4_000):
    """All but the first of equal windows among anchors whose names hash alike.

    Equal windows have equal names, so whole names are ranked about `most` anchors at a time, which bounds the memory.
    """

    def repeated(part: pa.Table) -> pa.Table:
        data, row, place, at = _windows(part, length)
        rank = doubled(data, at, length)
        own = np.flatnonzero(rank >= 0)
        rank, row, place = rank[own], row[own], place[own]
        ids, marks = part.column("doc_id").to_numpy()[row], part.column("mark").to_numpy()[row]
        order = np.lexsort((place, marks, ids, rank))
        first = np.ones(len(order), bool)
        first[1:] = rank[order][1:] != rank[order][:-1]
        repeats = order[~first]
        return _pieces(ids[repeats], marks[repeats], place[repeats], length)

    def run(part: pa.Table) -> pa.Table:
        name = part.column("name").to_numpy()
        order = np.argsort(name, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(name[order])) + 1, len(order))
        out, a = [], 0
        while a < len(order):
            b = int(edges[min(np.searchsorted(edges, a + most), len(edges) - 1)])
            out.append(repeated(part.take(pa.array(order[a:b]))))
            a = b
        release()
        return pa.concat_tables(out)

    return run


def _removed(length: int):
    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        start, stop = right.column("start").to_numpy(), right.column("stop").to_numpy()
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        texts = left.column("text").combine_chunks() if isinstance(left.column("text"), pa.ChunkedArray) else left.column("text")
        shown = left.column("shown").to_pylist()
        for row, _, _, own in _by_document(left, right):
            raw = texts[row].as_buffer().to_pybytes()
            kept, at, spans, gone = hashlib.sha256(), 0, 0, 0
            if len(own):
                order = own[np.argsort(start[own], kind="stable")]
                reach = -1
                for a, b in zip(start[order].tolist(), stop[order].tolist(), strict=True):
                    if a > reach:  # touching runs are one
                        spans += 1
                        kept.update(raw[at:a])
                        gone -= a
                        if spans > 1:
                            gone += reach
                        reach = b
                    reach = max(reach, b)
                    at = reach
                gone += reach
            kept.update(raw[at:])
            for c, v in zip(out, (shown[row], len(raw), gone, spans, kept.hexdigest()), strict=True):
                out[c].append(v)
        return pa.table(
            {
                "doc_id": pa.array(out["doc_id"], pa.int64()),
                **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")},
                "kept_sha256": out["kept_sha256"]
            }
        )

    return run


def without_repeats(docs: DataFrame, length: int = 100, block_bytes: int = 6 << 20, hot: int = 20_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if not K + 8 <= length <= 250:
        raise ValueError("length must lie between 40 and 250 bytes")
    spark = docs.sparkSession
    docs = docs.select(
        F.col("doc_id").cast("long").alias("shown"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text")
    )
    docs = docs.select("shown", "doc_id", F.xxhash64("text").alias("mark"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / 16e6), 1)
    blocks = max(1, int(total // block_bytes))
    met = _anchored(docs.select("doc_id", "mark", "text"), length, buckets).groupBy("bucket").applyInArrow(
        _sorted_out, "doc_id long, mark long, place long, reach int, name long, spans long, sure boolean"
    )
    met = stored(met, "anchors")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    asked = met.filter("NOT sure")
    texts = docs.select(block, "shown", "doc_id", "mark", "text")
    spans = texts.groupBy("block").cogroup(
        asked.select(block, "doc_id", "mark", "place", "reach", "name").groupBy("block")
    ).applyInArrow(_spans(length), "name long, doc_id long, mark long, place long, span binary")
    spans = stored(spans, "spans")
    # how many anchors share a name is known from the meeting: spans
    frequent = asked.filter(F.col("spans") > hot).select("name").distinct()
    usual = spans.join(frequent, "name", "left_anti")
    n = max(1, asked.count() // 30_000)
    found = usual.groupBy(F.pmod(F.xxhash64("name"), F.lit(n)).alias("part")).applyInArrow(_resolved(length), _PIECES)
    pieces = met.filter("sure").select(
        "doc_id", "mark", F.col("place").alias("start"), (F.col("place") + F.col("reach") + length).alias("stop")
    ).unionByName(found)
    if frequent.limit(1).count():

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    few = b.slice(i, 256)
                    data, row, place, at = _windows(few, length)
                    raw = data.tobytes()
                    windows = pa.array([raw[x : x + length] for x in at.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [few.column(k).take(pa.array(row)) for k in (0, 1)] + [pa.array(place), windows],
                        names=["doc_id", "mark", "start", "window"]
                    )

        many = spans.join(frequent, "name", "left_semi").select("doc_id", "mark", "place", "span")
        windows = many.mapInArrow(opened, "doc_id long, mark long, start long, window binary")
        first = windows.groupBy("window").agg(
            F.min(F.struct("doc_id", "mark", "start")).alias("least"), F.count(F.lit(1)).alias("many")
        ).filter("many > 1")
        repeats = windows.join(first, "window").filter(F.struct("doc_id", "mark", "start") != F.col("least"))
        pieces = pieces.unionByName(repeats.select("doc_id", "mark", "start", (F.col("start") + length).alias("stop")))
    cut = pieces.select(block, "doc_id", "mark", "start", "stop").groupBy("block")
    return texts.groupBy("block").cogroup(cut).applyInArrow(
        _removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op4_suffix(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"))
