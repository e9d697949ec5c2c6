"""Jaccard join of word n-gram sets by parity sketches.

The hash range of shingles is cut into S segments, and a document's sketch holds for each segment the exclusive-or of
the hashes of its shingles there. A shingle that only one of two sets has changes one segment, so the number of
differing segments is a lower bound of their symmetric difference. Two sets that reach the similarity differ in at
most D shingles (D follows from their sizes), so with S > D segments one at least is equal in both: documents of a size
band and the next one meet on equal segments. A second sketch, of single parity bits, rules out more pairs by its
Hamming distance, and what is left is verified on the sets themselves.

Equal segments may be empty ones, which say nothing and are no keys. S has room for as many empty segments as are
likely; documents with more also give the sketch of another seed, in which both of such a pair take part, and so on;
after the last seed the empty segments are keys too. So no pair is missed.

Documents with equal sets are one node. Of the nodes that meet on a segment, first every one is compared with the least,
its pivot: as many pairs as nodes. Where all are linked then, nothing is left to do. Where a pivot has met nodes of
several components, these nodes are dealt to blocks, and each pair of blocks goes to a task. There pairs of different
components are ruled out by their distances from the pivot (Jaccard distance is a metric) or by wide parity sketches, of
four bits or more a shingle. Nodes of which a pair is left go to a task for the same pair of blocks again, with their
whole sets, and are compared; a link joins its components at once, so that a task returns a forest of links. Tasks return
nodes, or fewer links than nodes, and never pairs. The components of all links are the result.

Defined results: null and empty texts and texts without words have no shingles, link with nothing and are their own
component. Texts of fewer words than a shingle have the whole sequence as one. Repeated rows are copies of one
another; different texts under one id, or without one, are documents of their own. A null doc_id never is a component's
smallest one unless all are null. Two sets with one 64-bit hash are told apart by a second one. Only doc_id and text are
read, whatever other columns are called; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULT, U64, mix, release, stored, table
from .components import components

SEEDS, BITS, MOST_BITS = 6, 512, 1 << 17
NO_ID = 2**63 - 1  # stands for a null id, after all others
MOST_BROADCAST = 2_000_000  # row hashes (16 MB); beyond it the text is shuffled instead
SALTS = 16


class Sets:
    """Shingle sets of a run of documents: sorted hashes one after another, with ends."""

    def __init__(self, texts: pa.Array, words: int):
        number: dict[bytes, int] = {}
        tokens, sizes = [], []
        for text in texts:
            got = (text.as_py() or "").encode().lower().split()
            sizes.append(len(got))
            get = number.get
            ids = [get(w) for w in got]
            if None in ids:
                ids = [number.setdefault(w, len(number)) if i is None else i for i, w in zip(ids, got, strict=True)]
            tokens.append(np.array(ids, np.int32))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), U64, len(number))
        flat = hashes[np.concatenate(tokens)] if tokens else hashes
        key = flat
        for k in range(1, words):
            key = mix(key[:-1] * U64(MULT) + flat[k:] + U64(k)) if len(key) > 1 else key[:0]
        out, at = [], 0
        for n in sizes:
            if n >= words:
                out.append(np.unique(key[at : at + n - words + 1]))
            elif n:
                h = flat[at : at + 1] + U64(n)
                for k in range(1, n):
                    h = mix(h * U64(MULT) + flat[at + k] + U64(k))
                out.append(mix(h ^ U64(0x5BF03635)))
            else:
                out.append(flat[:0])
            at += n
        self.sets = out
        self.sizes = np.array([len(x) for x in out], np.int64)

    def fingerprints(self, clashing: np.ndarray | None = None, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(node, check): two independent hashes of each set; of nodes that other sets share (clashing), one of both."""
        first = np.array([np.add.reduce(mix(x ^ U64(0x1F83D9AB))) if len(x) else U64(0) for x in self.sets], U64)
        second = np.array([np.bitwise_xor.reduce(mix(x ^ U64(0xBE5466CF))) if len(x) else U64(0) for x in self.sets], U64)
        first, second = first ^ mix(self.sizes.astype(U64)), second + self.sizes.astype(U64)
        first &= U64((1 << bits) - 1)
        if clashing is not None and len(clashing):
            first = np.where(np.isin(first, clashing), mix(first ^ mix(second)), first)
        return first, second

    def parities(self) -> list[bytes]:
        """BITS parity bits of each set."""
        return [parity(x, BITS) for x in self.sets]


def parity(x: np.ndarray, bits: int) -> bytes:
    """Parities of the hashes by their lowest bits."""
    odd = np.bincount((x & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def wide_parity(x: np.ndarray) -> bytes:
    """A power of two of parity bits, at least four a shingle."""
    return parity(x, min(MOST_BITS, max(BITS, 1 << int(4 * len(x) - 1).bit_length())))


def band_edges(percent: int, top: int) -> np.ndarray:
    """Sizes at which bands begin: a set links with sets of its own band, the one before and the one after only."""
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent + 1))
    return np.array([*edges, max(edges[-1] + 1, edges[-1] * 100 // percent + 1)])


def segments_of(band: int, edges: np.ndarray, percent: int) -> tuple[int, int]:
    """(segments, empty segments there is room for) of pairs whose smaller set is in a band."""
    least, most = int(edges[band]), int(edges[band + 1]) - 1
    far = (100 - percent) * (most + most * 100 // percent) // (100 + percent)
    room = 0
    for _ in range(4):
        mean = (far + 1 + room) * math.exp(-least / (far + 1 + room))
        room = math.ceil(mean + 3 * math.sqrt(mean)) if mean > 0.002 else 0
    return far + 1 + room, room


def sketch_keys(hashes: np.ndarray, size: int, edges: np.ndarray, percent: int, plans: dict[int, tuple[int, int]]) -> np.ndarray:
    """Keys of a set (its sorted hashes) in the two bands in which it may meet others."""
    own = int(np.searchsorted(edges, size, "right")) - 1
    out = []
    for band in (own, own - 1):
        if band < 0:
            continue
        if band not in plans:
            plans[band] = segments_of(band, edges, percent)
        segments, room = plans[band]
        for seed in range(SEEDS):
            h = hashes if not seed else np.sort(mix(hashes ^ U64(seed)))
            place = ((h >> U64(32)) * U64(segments)) >> U64(32)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            label = U64(((band * SEEDS + seed) << 32) & (2**64 - 1))
            out.append(mix(np.bitwise_xor.reduceat(mix(h), first) ^ mix(place[first] + label)))
            if segments - len(first) <= room:
                break
            if seed == SEEDS - 1:
                empty = np.setdiff1d(np.arange(segments, dtype=U64), place[first])
                out.append(mix(mix(empty + label)))
    return np.concatenate(out)


def row_hash() -> Column:
    """Tells rows apart by id and text, where ids are null or repeated."""
    return F.xxhash64("doc_id", "text")


def _described(docs: DataFrame, words: int, named: dict) -> DataFrame:
    """doc_id, row, n (set size), node and check (hashes of the set), bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            s = Sets(b.column(1), words)
            node, check = s.fingerprints(**named)
            out = {
                "doc_id": b.column(0), "row": b.column(2), "n": pa.array(s.sizes),
                "node": pa.array(node.view(np.int64), mask=s.sizes == 0), "check": pa.array(check.view(np.int64)),
                "bits": pa.array(s.parities(), pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return docs.select("doc_id", "text", "row").mapInArrow(
        run, "doc_id long, row long, n long, node long, check long, bits binary"
    )


def _small(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most about `most` bytes and 60,000 rows."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False) + 64
        ends, a = np.cumsum(sizes), 0
        while a < len(sizes):
            e = min(len(sizes), a + 60_000, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right"))))
            yield b.slice(a, e - a)
            a = e
    release()


def _keyed(docs: DataFrame, words: int, percent: int, edges: np.ndarray, buckets: int, named: dict) -> DataFrame:
    """bucket, nodes (hashes), entries (48 bits of key, 16 bits of place among the nodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, tuple[int, int]] = {}
        for b in _small(batches, 6 << 20):
            s = Sets(b.column(1), words)
            nodes, _ = s.fingerprints(**named)
            _, first = np.unique(nodes, return_index=True)  # copies in a batch speak once
            keys, owner = [], []
            for k, i in enumerate(i for i in first.tolist() if s.sizes[i]):
                got = sketch_keys(s.sets[i], int(s.sizes[i]), edges, percent, plans)
                keys.append(got)
                owner.append(np.full(len(got), k, U64))
            if not keys:
                continue
            nodes = nodes[[i for i in first.tolist() if s.sizes[i]]]
            key, own = np.concatenate(keys), np.concatenate(owner)
            bucket = (key & U64(0xFFFF)) % U64(buckets) if buckets <= 1 << 12 else (key & U64(0xFFFFFFFF)) % U64(buckets)
            entry = (key & ~U64(0xFFFF)) | own
            turn = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[turn], np.arange(buckets + 1))
            out: list[list] = [[], [], []]
            for i in range(buckets):
                mine = entry[turn[cuts[i] : cuts[i + 1]]]
                if len(mine):
                    used, place = np.unique(mine & U64(0xFFFF), return_inverse=True)
                    out[0].append(i)
                    out[1].append(nodes[used.astype(np.int64)].tobytes())
                    out[2].append(((mine & ~U64(0xFFFF)) | place.astype(U64)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                names=["bucket", "nodes", "entries"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, nodes binary, entries binary")


def _met(part: pa.Table) -> pa.Table:
    """(a, b): the least node of each key, and every other node of the key; each pair once."""
    keys, nodes = [], []
    for n, e in zip(part.column("nodes").to_pylist(), part.column("entries").to_pylist(), strict=True):
        e = np.frombuffer(e, U64)
        keys.append(e >> U64(16))
        nodes.append(np.frombuffer(n, np.int64)[(e & U64(0xFFFF)).astype(np.int64)])
    key, node = np.concatenate(keys), np.concatenate(nodes)
    del keys, nodes
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pivot = np.repeat(np.minimum.reduceat(node, first), np.diff(np.append(first, len(key))))
    del key, order
    other = pivot != node
    pivot, node = pivot[other], node[other]
    order = np.lexsort((node, pivot))
    pivot, node = pivot[order], node[order]
    new = np.ones(len(node), bool)
    new[1:] = (pivot[1:] != pivot[:-1]) | (node[1:] != node[:-1])
    out = pa.table({"a": pivot[new], "b": node[new]})
    del pivot, node, order, other, new
    release()
    return out


def _fetched(docs: DataFrame, wanted: DataFrame, words: int, named: dict) -> DataFrame:
    """wanted(row, node) -> node, shingles array<long>, wide (parity bits), computed from the documents' texts again; only sets of that node count."""
    few = wanted.count() <= MOST_BROADCAST
    rows = docs.select("row", "text").join(F.broadcast(wanted) if few else wanted, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            s = Sets(b.column(1), words)
            same = pa.array(s.fingerprints(**named)[0].view(np.int64) == b.column(2).to_numpy())
            shingles = pa.array([x.view(np.int64) for x in s.sets], pa.list_(pa.int64()))
            wide = pa.array([wide_parity(x) for x in s.sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(2), shingles, wide], names=["node", "shingles", "wide"]).filter(same)

    return rows.select("row", "text", "node").mapInArrow(
        run, "node long, shingles array<long>, wide binary"
    ).dropDuplicates(["node"])


def _compared(pairs: DataFrame, bits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) -> a, b, nb, near (similarity reached), far (Jaccard distance; 1 where parity bits alone rule it out)."""
    left, right = (bits.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    known = pairs.join(left, "a").join(right, "b")

    def hamming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(n, -1) for i in (4, 5))
            least = np.bitwise_count(x ^ y).sum(1).astype(np.int64)  # of the symmetric difference
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            keep = least * (100 + percent) <= (100 - percent) * (na + nb)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(keep)], names=["a", "b", "na", "nb", "likely"])

    known = stored(
        known.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(
            hamming, "a long, b long, na long, nb long, likely boolean"
        ),
        "pairs"
    )
    ends = [sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab"]
    held = known.filter("likely").join(ends[0], "a").join(ends[1], "b")
    held = held.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("both"))
    whole = F.col("na") + F.col("nb") - F.col("both")
    near, far = F.col("both") * 100 >= whole * percent, 1 - F.col("both") / whole
    sure = held.select("a", "b", "nb", near.alias("near"), far.alias("far"))
    return sure.unionByName(
        known.filter("NOT likely").select("a", "b", "nb", F.lit(False).alias("near"), F.lit(1.0).alias("far"))
    )


def _folded(wide: list[bytes]) -> np.ndarray:
    """Parity sketches as rows of 64-bit words, all of the least width: parities of a half add up to those of the whole."""
    least = min(map(len, wide))
    rows = []
    for x in wide:
        y = np.frombuffer(x, np.uint8)
        while len(y) > least:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        rows.append(y)
    return np.array(rows).view(U64)


class Nodes:
    """A pivot's nodes of a block, or of two, with what rules pairs of them out."""

    def __init__(self, part: pa.Table, wide: list[bytes], percent: int):
        self.node, comp, self.far, self.n, block = (part.column(c).to_numpy() for c in ("node", "component", "far", "n", "block"))
        self.comp = comp.copy()
        self.i, self.j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        self.left, self.right = np.flatnonzero(block == self.i), np.flatnonzero(block == self.j)
        self.sketch, self.percent, self.reach = _folded(wide), percent, 1 - percent / 100 + 1e-9

    def left_over(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each node of the first block, with those of the other (the likeliest first) that nothing rules out."""
        n, far, percent = self.n, self.far, self.percent
        for x in self.left.tolist():
            y = self.right[self.right > x] if self.i == self.j else self.right
            y = y[(self.comp[y] != self.comp[x]) & (np.maximum(n[y], n[x]) * percent <= np.minimum(n[y], n[x]) * 100)]
            y = y[(far[y] >= 1) | (far[x] >= 1) | (np.abs(far[y] - far[x]) <= self.reach)]
            if len(y):
                least = np.bitwise_count(self.sketch[y] ^ self.sketch[x]).sum(1).astype(np.int64)
                near = least * (100 + percent) <= (100 - percent) * (n[x] + n[y])
                yield x, y[near][np.argsort(least[near], kind="stable")]


_DEALT = "pivot long, i int, j int, block int, node long, component long, far double, n long"


def _open(percent: int):
    """The nodes of which a pair is left over."""

    def run(part: pa.Table) -> pa.Table:
        some = np.zeros(part.num_rows, bool)
        for x, y in Nodes(part, part.column("wide").to_pylist(), percent).left_over():
            some[x] |= len(y) > 0
            some[y] = True
        return part.drop_columns(["wide"]).filter(pa.array(some))

    return run


def _across(percent: int):
    """A forest of the links that join components.

    Whole sets are compared wherever nothing rules a pair out; a component that a link joins to another has its label
    from then on, so no more links leave than there are nodes, and fewer pairs are left to compare with each.
    """

    def run(part: pa.Table) -> pa.Table:
        lists = part.column("shingles").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]  # sorted
        nodes = Nodes(part, [wide_parity(x) for x in sets], percent)
        comp, out = nodes.comp, []
        for x, y in nodes.left_over():
            for k in y.tolist():
                if comp[k] == comp[x]:  # joined meanwhile
                    continue
                both = (sets[x][np.searchsorted(sets[x], sets[k]).clip(max=len(sets[x]) - 1)] == sets[k]).sum()
                if both * 100 >= (len(sets[x]) + len(sets[k]) - both) * percent:
                    out.append((nodes.node[x], nodes.node[k]))
                    comp[comp == comp[k]] = comp[x]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _dealt(seen: DataFrame, whole: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Nodes of each pivot that has met several components, with their sketches, in pairs of blocks.

    A block has about `block` nodes and 700 shingles a node at most on average. Salts keep a pivot's nodes in many tasks.
    """
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    member = seen.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "far", F.col("nb").alias("n"))
    member = member.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / (700 * block))).cast("int")
    sizes = member.groupBy("pivot").agg(blocks.alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high"))
    sizes = sizes.filter("low <> high").select("pivot", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = member.select("*", salt).join(sizes, ["pivot", "salt"]).join(sets.select("node", "wide"), "node")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return placed.select("pivot", "i", "j", "block", "node", "component", "far", "n", "wide")


def grouped(docs: DataFrame, words: int = 4, percent: int = 85, block: int = 1500) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    return represented(docs, words, percent, block).select("doc_id", "n_shingles", "component_id")


def represented(docs: DataFrame, words: int, percent: int, block: int = 1500, node_bits: int = 64) -> DataFrame:
    """docs(doc_id, text) -> doc_id, row, n_shingles, component_id, kept: whether the row is its component's one.

    That is the row with the smallest doc_id, of several with that the one with the least hash; copies of it are kept too.
    node_bits below 64 makes hashes of sets clash (for tests).
    """
    spark = docs.sparkSession
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    docs = docs.select(ids.alias("doc_id"), F.col("text"), row_hash().alias("row"))
    named: dict = {"bits": node_bits}
    described = stored(_described(docs, words, named), "sets")
    nodes = stored(_nodes(described), "nodes")
    # nodes whose sets differ: about n * n / 2^65 of n
    clashing = [r["node"] for r in nodes.filter("low <> high").select("node").collect()]
    if clashing:
        named["clashing"] = np.array(clashing, np.int64).view(U64)
        described = stored(_described(docs, words, named), "sets")
        nodes = stored(_nodes(described), "nodes")
    top, total = described.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    edges = band_edges(percent, int(top))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 0.4) >> 19, 1)
    met = _keyed(docs, words, percent, edges, buckets, named).groupBy("bucket").applyInArrow(_met, "a long, b long")
    first = stored(met.distinct(), "first")
    labelled = nodes.select("node", "rep")
    if first.limit(1).count():
        wanted = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct()
        wanted = stored(nodes.join(wanted, "node", "left_semi").select("rep.row", "node"), "wanted")
        sets = stored(_fetched(docs, wanted, words, named), "shingles")
        seen = stored(_compared(first, nodes, sets, percent), "compared")
        whole = components(seen.filter("near").select("a", "b"))
        # a pair that met on a key is among the nodes of that key's pivot
        pair = ["pivot", "i", "j"]
        left = stored(_dealt(seen, whole, sets, block).groupBy(*pair).applyInArrow(_open(percent), _DEALT), "open")
        left = left.join(sets.select("node", "shingles"), "node").groupBy(*pair)
        forest = stored(left.applyInArrow(_across(percent), "a long, b long"), "across")
        if forest.limit(1).count():
            ends = [whole.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
            joined = forest.join(ends[0], "a", "left").join(ends[1], "b", "left")
            joined = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
            joined = joined.select(F.col("node").alias("old"), F.col("component").alias("new"))
            links = whole.unionByName(joined.select(F.col("old").alias("node"), F.col("old").alias("component")))
            whole = links.dropDuplicates(["node"]).join(joined, F.col("component") == F.col("old"), "left")
            whole = whole.select("node", F.coalesce("new", "component").alias("component"))
        labelled = labelled.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = labelled.groupBy("component").agg(F.min("rep").alias("rep"))
        labelled = labelled.select("node", "component").join(least, "component")
    mapped = labelled.select("node", F.col("rep.doc_id").alias("component_id"), F.col("rep.row").alias("least_row"))
    out = described.join(mapped, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("row") == F.col("least_row"), F.lit(True))  # without shingles a row is its own component
    shown = [F.nullif(c, F.lit(NO_ID)).alias(c) for c in ("doc_id", "component_id")]
    return out.select(shown[0], "row", F.col("n").alias("n_shingles"), shown[1], kept.alias("kept"))


def _nodes(described: DataFrame) -> DataFrame:
    """One row a set: node, rep (least id, row), low and high check, n, bits."""
    ends = [F.min("check").alias("low"), F.max("check").alias("high")]
    rep = F.min(F.struct("doc_id", "row")).alias("rep")
    return described.filter("node IS NOT NULL").groupBy("node").agg(
        rep, *ends, F.first("n").alias("n"), F.first("bits").alias("bits")
    )


def op9_jaccard(spark, sf_dir):
    return grouped(table(spark, sf_dir, "documents"))
