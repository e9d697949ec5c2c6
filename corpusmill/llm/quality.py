"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

One scan turns each text into STATISTICS numbers (of the whole text). They are standardised by the training rows'
mean and deviation and mapped to cos(w.x + b) features, which approximate a Gaussian kernel. Each partition sums its
share of the normal equations; the driver adds them up (a matrix of fixed size) and solves for the ridge weights.
Scores of the training rows, summed in `bins` bins, give a rising step function by pooling adjacent violators.

All labelled training rows are used, however many there are. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts are scored as texts of no words. Labels other than 0 and 1 and null labels do
not train; where a document has several labels, each trains. With no training rows, or labels of one class only,
every score is the share of label 1 (0.5 if there are no labels). Repeated rows get a row each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, stored, table

FEATURES, BINS, SEED = 384, 1000, 11
FAN = 64  # arrays of at most 1.4 MB that one task, or the driver, adds up
MOST_BROADCAST = 2_000_000  # ids (16 MB)
STATISTICS = (
    "log_bytes log_words word_bytes upper digit space punct symbol newline nonascii distinct_words repeated_next top_word caps_words end_symbol_words "
    "distinct_lines log_line_bytes sentence_marks words_a_sentence one_letter_words long_words packed letters_entropy first_upper_after_mark bar_hash"
).split()
_KIND = np.zeros(256, np.int64)
for _name, _chars in enumerate(
    (
        range(65, 91), range(97, 123), range(48, 58), (32, 9), (10, 13), b",.;:!?'\"-()", b"#$%&*+/<=>@[\\]^_`{|}~",
        range(128, 256)
    ),
    1
):
    for _c in _chars:
        _KIND[_c] = _name
_MARKS = b".!?"


def statistics(text: str | None) -> list[float]:
    """The numbers of STATISTICS, in that order."""
    raw = (text or "").encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, counts, 9) / max(1, n)
    words = raw.split()
    m = len(words)
    per = max(1, m)
    tally = Counter(words)
    repeats = sum(map(eq, words, islice(words, 1, None)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = int(counts[46] + counts[33] + counts[63])
    p = counts[counts > 0] / max(1, n)
    tails = b"".join(w[-1:] for w in words)
    heads = b"".join(w[:1] for w in words)
    tail_kinds = np.bincount(_KIND[np.frombuffer(tails, np.uint8)], minlength=9) / per
    head_kinds = np.bincount(_KIND[np.frombuffer(heads, np.uint8)], minlength=9) / per
    sizes = np.fromiter(map(len, words), np.int64, m)
    return [
        np.log1p(n), np.log1p(m), n / per, kinds[1], kinds[3], kinds[4], kinds[6], kinds[7], kinds[5], kinds[8], len(tally) / per, repeats / per,
        max(tally.values(), default=0) / per, head_kinds[1], tail_kinds[7], len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), marks / per, np.log1p(m / max(1, marks)),
        float((sizes == 1).sum()) / per, float((sizes > 14).sum()) / per, len(zlib.compress(raw, 1)) / max(1, n), float(-(p * np.log2(p)).sum()) if n else 0.0,
        head_kinds[7], float(counts[124] + counts[35]) / max(1, n),
    ]


def document_statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and `stats` array<double>; a scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = pa.array([statistics(x.as_py()) for x in b.column(len(keep))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], stats], names=[*keep, "stats"])

    return docs.select(*keep, "text").mapInArrow(
        run, T.StructType([*(docs.schema[c] for c in keep), T.StructField("stats", T.ArrayType(T.DoubleType()))])
    )


def fourier(x: np.ndarray, features: int = FEATURES, seed: int = SEED) -> np.ndarray:
    """sqrt(2 / features) cos(w.x + b), besides x itself and 1."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1 / np.sqrt(2.0 * x.shape[1]), (x.shape[1], features))
    return np.hstack([np.cos(x @ w + rng.uniform(0, 2 * np.pi, features)) * np.sqrt(2 / features), 0.1 * x, np.ones((len(x), 1))])


def pooled(means: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to means, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for m, w in zip(means, weights, strict=True):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, n2 = blocks.pop()
            m1, w1, n1 = blocks[-1]
            blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


class Model:
    """mean, deviation, ridge weights, and the calibration's bin values over the clipped raw score in [-0.5, 1.5]."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, weights: np.ndarray | None, steps: np.ndarray):
        self.mean, self.deviation, self.weights, self.steps = mean, deviation, weights, steps

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.deviation).clip(-6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(self.scaled(x)) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, and with a slight slope by the raw score, so that equal steps keep their order."""
        if self.weights is None:
            return np.full(len(x), self.steps[0])
        raw = self.raw(x)
        return (0.998 * self.steps[bin_of(raw)] + 0.002 / (1 + np.exp(-4 * (raw - 0.5)))).clip(0, 1)


def bin_of(raw: np.ndarray) -> np.ndarray:
    return ((raw.clip(-0.5, 1.4999) + 0.5) / 2 * BINS).astype(int)


def _summed(rows: DataFrame, f, size: int) -> np.ndarray:
    """Sum over all rows of f(stats, label): one array of `size` a partition; every FAN of them are added by a task, and
    their sums again, until FAN are left for the driver. Tasks stream through the arrays, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            if b.num_rows:
                out += f(np.array(b.column(0).to_pylist(), float), b.column(1).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            for x in b.column(0):
                out += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["part"])

    parts, many = rows.select("stats", "label").mapInArrow(run, "part binary"), rows.rdd.getNumPartitions()
    while many > FAN:
        many = -(-many // FAN)
        parts = parts.repartition(many).mapInArrow(add, "part binary")
    out = np.zeros(size)
    for r in parts.toLocalIterator():
        out += np.frombuffer(r["part"])
    return out


def fitted(rows: DataFrame, ridge: float = 1e-2) -> Model:
    """rows(stats, label 0/1, fold 0/1): fold 0 gives the weights, fold 1 the calibration."""
    d = len(STATISTICS)
    sums = _summed(rows, lambda x, y: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), y.sum()]]), 2 * d + 2)
    n, ones = sums[-2], sums[-1]
    if not n or ones in (0, n):
        return Model(np.zeros(d), np.ones(d), None, np.array([ones / n if n else 0.5]))
    mean = sums[:d] / n
    deviation = np.sqrt((sums[d : 2 * d] / n - mean**2).clip(0)) + 1e-6
    model = Model(mean, deviation, None, np.array([ones / n]))
    size = FEATURES + d + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(model.scaled(x))
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    fold = [rows.filter(F.col("fold") == k) for k in (0, 1)]
    got = _summed(fold[0], normal, size * size + size)
    gram, right = got[: size * size].reshape(size, size), got[size * size :]
    model.weights = np.linalg.solve(gram + ridge * max(1.0, n / 1000) * np.eye(size), right)
    held = _summed(
        fold[1], lambda x,
        y: np.concatenate([np.bincount(bin_of(model.raw(x)), minlength=BINS), np.bincount(bin_of(model.raw(x)), y, BINS)]),
        2 * BINS
    )
    count, good = held[:BINS], held[BINS:]
    seen = np.flatnonzero(count)
    if len(seen):
        steps = pooled(good[seen] / count[seen], count[seen])
        model.steps = np.interp(np.arange(BINS), seen, steps)
    else:
        model.steps = (np.arange(BINS) / BINS * 2 - 0.5).clip(0, 1)
    return model


def _rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stats(doc_id, stats) with labels of the training rows: stats, label, fold."""
    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("labelled"), F.col("quality").alias("label"))
    fold = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).cast("int").alias("fold")
    return stored(stats.join(known, F.col("doc_id") == F.col("labelled")).select("stats", "label", fold), "labelled")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted; learned from the other rows' labels. One scan of the text."""
    stats = stored(document_statistics(docs, ("doc_id",)), "statistics")
    model = fitted(_rows(stats.filter(~held_out()), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(np.array(b.column(1).to_pylist(), float).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    schema = T.StructType(
        [stats.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
    return stats.mapInArrow(run, schema).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that score `least` or more, all columns as they are; nothing but the labelled statistics moves.

    Statistics of labelled rows only are taken first where the labels' ids can be broadcast, else those of all rows.
    """
    training = docs.filter(~held_out())
    if labels.count() <= MOST_BROADCAST:
        training = training.join(F.broadcast(labels.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fitted(_rows(document_statistics(training, ("doc_id",)), labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = model.score(np.array([statistics(x.as_py()) for x in b.column(at)], float))
                yield b.filter(pa.array(score >= least))
        release()

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
