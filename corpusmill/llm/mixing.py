"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of all documents are cut into blocks of equal size. The blocks go to the sources by highest quotients
target / (2 * seats + 1), and each source's seats again to its shards by their sizes, so that every shard has an
integer quota. A shard stands in a seeded order of its documents; its quota takes whole rounds of the shard and then
the first blocks of that order. A document at the edge of the last block is taken in part.

Shards hold about `shard_words` words, so a source of any share of the corpus is spread over as many window
partitions as it needs. The driver sees one row per source and per shard, and works on them as arrays: shard_words grows
with the corpus so that there are at most `most_shards` shards besides one per source. Quotas are broadcast up to
MOST_BROADCAST rows and joined by a shuffle beyond.

Defined results: null texts have size 0 and are taken 0 times; a null source is a source of its own, after all
others. Repeated rows, and rows with equal ids or without one, each count; shard and order within it are settled by a
hash of id and text, so rows that share an id only go to all shards.
An empty table gives an empty result. Columns of documents other than doc_id, text and source are carried by `mixed`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
MOST_BROADCAST = 500_000  # rows of a source or shard each
_WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """Shares of the whole by weight; what is above `most` times a source's size is shared again by weight among the rest."""
    size = np.asarray(sizes, float)
    weight = np.resize(np.asarray(weights, float), len(size))
    out, open_, left = np.zeros(len(size)), np.ones(len(size), bool), float(size.sum())
    while open_.any():
        share = weight * (left / weight[open_].sum())
        full = open_ & (share > most * size)
        if not full.any():
            out[open_] = share[open_]
            break
        out[full] = most * size[full]
        left -= out[full].sum()
        open_ &= ~full
    return out.tolist()


def sainte_lague(shares: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients share / (2 k + 1); ties go to the earlier party.

    A party has round(share / d) seats for the divisor d at which the sum is right, so d is searched, and the few seats
    that are left at its edge go one by one.
    """
    shares = np.asarray(shares, float)
    if seats <= 0 or not len(shares) or shares.sum() <= 0:
        return np.zeros(len(shares), np.int64)
    at = lambda d: np.ceil(shares / d - 0.5).clip(0).astype(np.int64)
    low, high = shares.max() / (seats + 2) / 2, 2 * shares.max() + 1
    for _ in range(200):
        d = (low + high) / 2
        low, high = (low, d) if at(d).sum() <= seats else (d, high)
    got = at(high)
    for _ in range(seats - int(got.sum())):  # ties at the divisor
        got[np.argmax(shares / (2 * got + 1))] += 1
    return got


def _hinted(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= MOST_BROADCAST else rows


def taken(
    docs: DataFrame, seed: int = 7, block_words: int = 128, shard_words: int = 1 << 21, most_shards: int = 1_000_000, carry: bool = False
) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, size, source_size, target, taken; with carry, the input row as `_row` too."""
    spark = docs.sparkSession
    own = [F.struct(*(docs[c] for c in docs.columns)).alias("_row")] if carry else []
    turn = F.xxhash64(F.lit(seed), "doc_id", "text").alias("turn")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), turn, F.xxhash64("text").alias("mark"), *own)
    if not carry:
        sized = stored(sized, "sizes")  # else every step below would count the words again
    kind = docs.schema["source"].dataType.simpleString()
    by = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).toLocalIterator()}
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in by)
    sizes = [by[s] for s in names]
    total = sum(sizes)
    want = targets(sizes)
    shard_words = max(shard_words, total // most_shards)
    shards = [max(1, math.ceil(x / shard_words)) for x in sizes]
    plan = spark.createDataFrame(
        list(zip(names, sizes, want, shards, strict=True)), f"source {kind}, source_size long, target double, shards int"
    )
    placed = sized.alias("d").join(_hinted(plan, len(names)).alias("p"), F.expr("d.source <=> p.source")).drop(F.col("p.source"))
    placed = placed.withColumn("shard", F.pmod("turn", F.col("shards")).cast("int"))
    held: dict[str | None, list[tuple[int, int]]] = {}
    for r in placed.groupBy("source", "shard").agg(F.sum("size").alias("words")).toLocalIterator():
        held.setdefault(r["source"], []).append((r["shard"], r["words"]))
    block = max(1, min(block_words, total // (200 * len(names)))) if names else 1
    seats = sainte_lague(np.array(want), round(sum(want) / block)).tolist()
    quotas = []
    for s, limit, n in zip(names, want, seats, strict=True):
        parts = sorted(held[s])
        got = sainte_lague(np.array([words for _, words in parts]), n)
        quotas += [
            (s, shard, words, min(int(g) * block, MOST_REPEATS * words, math.ceil(limit))) for (shard, words),
            g in zip(parts, got, strict=True)
        ]
    rows = spark.createDataFrame(quotas, f"source {kind}, shard int, words long, quota long")
    placed = placed.alias("d").join(_hinted(rows, len(quotas)).alias("q"), F.expr("d.source <=> q.source AND d.shard = q.shard"))
    placed = placed.drop(F.col("q.source"), F.col("q.shard"))
    order = Window.partitionBy("source", "shard").orderBy("turn", "doc_id", "mark")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rounds = F.when(F.col("words") > 0, F.floor(F.col("quota") / F.greatest("words", F.lit(1)))).otherwise(0)
    part = F.greatest(F.lit(0), F.least("size", F.col("quota") - rounds * F.col("words") - F.coalesce(before, F.lit(0))))
    count = (rounds * F.col("size") + part).cast("long").alias("taken")
    return placed.select("doc_id", "size", "source_size", "target", count, *(["_row"] if carry else []))


def head_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + _WORDS), F.lit(0)), F.lit(1), n), "")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, and the part that the last block reaches.

    Columns are those of docs; a part has its own text, and where there is an n_chars column, its own count.
    """
    size = F.greatest("size", F.lit(1))
    whole, rest = F.floor(F.col("taken") / size).cast("int"), (F.col("taken") % size).cast("int")
    parts = F.concat(F.array_repeat(F.lit(0), whole), F.filter(F.array(rest), lambda x: x > 0))
    out = taken(docs, carry=True, **options).select("_row", F.explode(parts).alias("_part"))
    cut, text = F.col("_part") > 0, F.col("_row")["text"]
    changed = {"text": F.when(cut, head_words(text, F.col("_part"))).otherwise(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(
            cut, F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)
        ).otherwise(F.col("_row")["n_chars"])
    return out.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def op8_mixing(spark, sf_dir):
    return taken(table(spark, sf_dir, "documents"))
