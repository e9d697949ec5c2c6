"""Near-duplicate vectors by product quantisation.

Index. A coarse quantiser of two levels (k-means on unit vectors to cells of about LISTS_A_CELL lists, and again within
each cell) deals all vectors to inverted lists, and a product quantiser codes each residual by subspace. Both are fitted on a sample of about `sample`
distinct vectors at most, or PER_LIST a list where that is more, chosen by hash; all vectors are indexed, each with its
own quantisation error. The number of lists grows with the square root of the number of vectors, without a ceiling. A
vector length of which there are fewer than LEAST vectors has a single list and no codes.

Search. A vector at cosine c has distance sqrt(2 - 2 c) at most, and so can stand in a list only if the query is that
near to the list's side of the plane between it and the query's own list: those lists are probed, no more and no less,
first among the cells, then within each. In a probed list, table lookups (one table a query and subspace) give the
distance to each code; a vector whose code is farther than the radius and its own error is out; what is left is reranked
by exact cosine in double precision. These bounds hold for every vector, so no link is lost, whatever the sample was.

Distribution. Work is dealt by (label, list, query block, member block) with blocks of at most about `block` rows, so a
label or list of any size is split. Equal vectors are one node with a count. Blocks return link counts and a forest of
their links, never pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link
with nothing. Vectors of different lengths do not link. Repeated rows are vectors equal to one another, and link. A null
vec_id is never a component's smallest unless all are null, and kept where the component has no id. Two vectors with one
64-bit hash are told apart by a second one. Only vec_id, embedding and label are read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .components import components

PARTS, CODES = 8, 64
LEAST, PER_LIST, LISTS_A_CELL = 64, 8, 256


def _described(rows: DataFrame, bits: int, clashing: frozenset[int]) -> DataFrame:
    """vec_id, label, node (hash of label and vector; null: links with nothing), check, vec (doubles)."""
    kept = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, check, vec = [], [], []
            for label, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                v = np.array(x, float) if x and label is not None and None not in x else np.zeros(0)
                if not len(v) or not np.isfinite(v).all() or not v.any():
                    node.append(None), check.append(None), vec.append(None)
                    continue
                h = hashlib.blake2b(f"{label}|".encode() + v.tobytes(), digest_size=24).digest()
                first, second, third = (int.from_bytes(h[i : i + 8], "little", signed=True) for i in (0, 8, 16))
                first = first & kept if bits < 64 else first
                node.append(third if first in clashing else first), check.append(second), vec.append(v.tobytes())
            out = [pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(vec, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out], names=["vec_id", "label", "node", "check", "vec"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {kind}, node long, check long, vec binary")


def _nodes(described: DataFrame) -> DataFrame:
    """One row a label and vector: the least vec_id, how many there are, the vector and its length."""
    sums = [
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("check").alias("low"), F.max("check").alias("high")
    ]
    nodes = described.filter("node IS NOT NULL").groupBy("label", "node").agg(*sums, F.first("vec").alias("vec"))
    return nodes.withColumn("dim", (F.octet_length("vec") / 8).cast("int"))


def unit(raw: list[bytes]) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that squares neither vanish nor overflow."""
    x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, but for the squares of x."""
    return (centres * centres).sum(1) - 2 * x @ centres.T


def _reached(far: np.ndarray, centres: np.ndarray, radius: float) -> np.ndarray:
    """rows x centres: whether a vector within the radius of the row may be nearest to the centre.

    Such a vector lies on the centre's side of the plane between it and the row's own nearest centre.
    """
    own = far.argmin(1)
    here, back = np.unique(own, return_inverse=True)
    apart = np.sqrt(
        ((centres[here][:, None, :] - centres[None, :, :]) ** 2).sum(-1)
    ) if len(here) else np.zeros((0, len(centres)))
    return far - far[np.arange(len(far)), own][:, None] <= 2 * radius * apart[back] + 1e-9


class Index:
    """Coarse centres of two levels and residual codebooks for one vector length, and the search radius.

    Lists are numbered cell by cell: those of cell i begin at first[i], and centres holds all of them.
    """

    def __init__(self, sample: np.ndarray, lists: int, cosine: float, a_cell: int = LISTS_A_CELL):
        self.radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
        self.cells = k_means(sample, -(-lists // a_cell))
        cell = _far(sample, self.cells).argmin(1)
        own = [sample[cell == i] for i in range(len(self.cells))]
        wanted = [max(1, round(lists * len(x) / len(sample))) for x in own]
        parts = [k_means(x, n) if len(x) else c[None] for x, n, c in zip(own, wanted, self.cells, strict=True)]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        self.centres = np.concatenate(parts)
        residual = sample - self.centres[self.assigned(sample)[0]]
        self.cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.books = [k_means(residual[:, a:b], CODES, 6) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def assigned(self, x: np.ndarray, step: int = 512) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's list, and the lists from its own number on that may hold a vector within the radius."""
        own, probes = np.empty(len(x), np.int32), []
        for a in range(0, len(x), step):
            rows = x[a : a + step]
            far = _far(rows, self.cells)
            home, cells = far.argmin(1), _reached(far, self.cells, self.radius)
            found: list[list[np.ndarray]] = [[] for _ in rows]
            for i in np.flatnonzero(cells.any(0)).tolist():
                at = np.flatnonzero(cells[:, i])
                centres = self.centres[self.first[i] : self.first[i + 1]]
                far = _far(rows[at], centres)
                mine = home[at] == i
                own[a + at[mine]] = self.first[i] + far[mine].argmin(1)
                for j, reach in zip(at.tolist(), _reached(far, centres, self.radius), strict=True):
                    found[j].append(self.first[i] + np.flatnonzero(reach))
            for j, lists in enumerate(found):
                got = np.concatenate(lists).astype(np.int32)
                probes.append(got[got >= own[a + j]])
        return own, probes

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the distance of each residual to its code."""
        code = np.empty((len(residual), len(self.books)), np.uint8)
        off = np.zeros(len(residual))
        for i, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            part = residual[:, a:b]
            far = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            code[:, i] = np.argmin(far, axis=1)
            off += ((part - book[code[:, i]]) ** 2).sum(1)
        return code, np.sqrt(off)

    def near(self, queries: np.ndarray, centre: int, code: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Whether each code may stand within the radius of each query."""
        rest = queries - self.centres[centre]
        total = np.zeros((len(queries), len(code)))
        for i, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            part = rest[:, a:b]
            tables = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            total += tables[:, code[:, i]]
        return total <= (self.radius + error + 1e-7) ** 2


def _linked(q: np.ndarray, m: np.ndarray, maybe: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs among the candidates whose exact cosine is reached."""
    i, j = np.nonzero(maybe)
    keep = []
    for a in range(0, len(i), 1 << 15):
        keep.append((q[i[a : a + (1 << 15)]] * m[j[a : a + (1 << 15)]]).sum(1) >= cosine)
    k = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[k], j[k]


def _searched(index_of: Callable[[int], Index], cosine: float):
    def run(part: pa.Table) -> pa.Table:
        role = part.column("role").to_numpy()
        node, weight, own, raw = (part.column(c) for c in ("node", "weight", "own", "vec"))
        node, weight, own, raw = node.to_numpy(), weight.to_numpy(), own.to_numpy(), raw.to_pylist()
        queries, members = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        links: dict[int, int] = {}
        a_out: list[np.ndarray] = []
        b_out: list[np.ndarray] = []
        if len(queries) and len(members):
            which = int(part.column("list")[0].as_py())
            index = index_of(len(raw[0]) // 8)
            q, m = unit([raw[i] for i in queries]), unit([raw[i] for i in members])
            code, error = index.encode(m - index.centres[which])
            pairs_q, pairs_m = [], []
            for a in range(0, len(queries), 256):
                rows = queries[a : a + 256]
                maybe = index.near(q[a : a + 256], which, code, error)
                same = own[rows] == which  # in the query's own list each pair once
                maybe &= ~same[:, None] | (node[rows][:, None] < node[members])
                i, j = _linked(q[a : a + 256], m, maybe, cosine)
                pairs_q.append(rows[i]), pairs_m.append(members[j])
            i, j = np.concatenate(pairs_q), np.concatenate(pairs_m)
            counts = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
            label = node.copy()
            while len(i):  # least label of each connected part of the block
                least = np.minimum(label[i], label[j])
                before = label.copy()
                np.minimum.at(label, i, least)
                np.minimum.at(label, j, least)
                if (before == label).all():
                    break
            at = np.flatnonzero(counts)
            for n, c in zip(node[at].tolist(), counts[at].tolist(), strict=True):
                links[n] = links.get(n, 0) + int(c)
            a_out.append(node[at]), b_out.append(label[at])
        out = {"node": np.array(list(links), np.int64), "links": np.array(list(links.values()), np.int64)}
        first = dict(zip(np.concatenate(a_out).tolist(), np.concatenate(b_out).tolist(), strict=True)) if a_out else {}
        return pa.table({**out, "root": pa.array([first[n] for n in out["node"].tolist()], pa.int64())})

    return run


class Whole(Index):
    """A single list without codes, for lengths with few vectors."""

    def __init__(self, dim: int, cosine: float):
        self.radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
        self.centres, self.cuts, self.books = np.zeros((1, dim)), np.zeros(1, int), []

    def assigned(self, x: np.ndarray, step: int = 512) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.zeros(len(x), np.int32), [np.zeros(1, np.int32)] * len(x)

    def near(self, queries: np.ndarray, centre: int, code: np.ndarray, error: np.ndarray) -> np.ndarray:
        return np.ones((len(queries), len(code)), bool)


def _indexes(nodes: DataFrame, cosine: float, sample: int, lists: int | None) -> dict[int, Index]:
    """An index for each vector length of which there are LEAST vectors at least, fitted on its share of the sample."""
    sizes = nodes.groupBy("dim").count().filter(F.col("count") >= LEAST).collect()
    total = sum(r["count"] for r in sizes)
    out = {}
    for r in sizes:
        k = lists or max(1, math.isqrt(r["count"]) // 4)
        share = max(LEAST, sample * r["count"] // total, PER_LIST * k)
        own = nodes.filter(F.col("dim") == r["dim"])
        every = max(1, r["count"] // share)
        chosen = own.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("vec").orderBy("node").toLocalIterator()
        out[r["dim"]] = Index(unit([x["vec"] for x in chosen]), k, cosine)
    return out


def near_duplicates(
    rows: DataFrame, cosine: float = 0.98, sample: int = 20_000, lists: int | None = None, block: int = 2048, node_bits: int = 64
) -> DataFrame:
    """rows(vec_id, embedding, label) -> vec_id, n_links, component_id, kept. node_bits below 64 makes hashes clash (for tests)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    described = stored(_described(rows, node_bits, frozenset()), "vectors")
    kind = described.schema["label"].dataType.simpleString()
    nodes = stored(_nodes(described), "nodes")
    # hashes that different vectors share: about n * n / 2^65 of n
    clashing = frozenset(
        r["node"] for r in nodes.groupBy("node").agg(
            F.min("low").alias("low"), F.max("high").alias("high")
        ).filter("low <> high").collect()
    )
    if clashing:
        described = stored(_described(rows, node_bits, clashing), "vectors")
        nodes = stored(_nodes(described), "nodes")
    indexes = _indexes(nodes, cosine, sample, lists)

    def index_of(dim: int) -> Index:
        return indexes[dim] if dim in indexes else Whole(dim, cosine)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, own, probes = b.column(3).to_pylist(), np.zeros(b.num_rows, np.int32), [None] * b.num_rows
            sizes = np.array([len(r) // 8 for r in raw], int)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                own[at], found = index_of(dim).assigned(unit([raw[i] for i in at]))
                for i, p in zip(at, found, strict=True):
                    probes[i] = p
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(own), pa.array(probes, pa.list_(pa.int32()))],
                names=["label", "node", "weight", "vec", "own", "probes"]
            )

    placed = stored(
        nodes.select("label", "node", "weight", "vec").mapInArrow(
            assign, f"label {kind}, node long, weight long, vec binary, own int, probes array<int>"
        ),
        "lists"
    )
    size = F.octet_length("vec").alias("bytes")
    members = placed.groupBy("label", F.col("own").alias("list"), size).agg(F.count(F.lit(1)).alias("members"))
    asking = placed.select(
        "label", F.explode("probes").alias("list"), size
    ).groupBy("label", "list", "bytes").agg(F.count(F.lit(1)).alias("asking"))
    cells = members.join(asking, ["label", "list", "bytes"]).select(
        "label", "list", "bytes", F.ceil(F.col("members") / block).cast("int").alias("nm"),
        F.ceil(F.col("asking") / block).cast("int").alias("nq")
    )
    cells = stored(cells, "cells")
    turn = F.xxhash64("node")
    base = placed.select("label", "node", "weight", "vec", "own", "probes", size)
    q = base.select(
        "label", "node", "weight", "vec", "own", "bytes", F.explode("probes").alias("list")
    ).join(cells, ["label", "list", "bytes"])
    q = q.select(
        "label", "list", "bytes", F.pmod(turn, "nq").cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("mb"), F.lit(0).alias("role"), "node", "weight", "own", "vec"
    )
    m = base.withColumn("list", F.col("own")).join(cells, ["label", "list", "bytes"])
    m = m.select(
        "label", "list", "bytes", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"),
        F.pmod(turn, "nm").cast("int").alias("mb"), F.lit(1).alias("role"), "node", "weight", "own", "vec"
    )
    found = q.unionByName(m).groupBy("label", "list", "bytes", "qb", "mb").applyInArrow(
        _searched(index_of, cosine), "node long, links long, root long"
    )
    found = stored(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("others"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = nodes.select("node", "rep", "weight").join(counts, "node", "left").join(joined, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = labelled.groupBy("component").agg(F.min("rep").alias("least"))
    labelled = labelled.join(least, "component").select(
        "node", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least"
    )
    out = described.select("vec_id", "node").join(labelled, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def op2_vectors(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
