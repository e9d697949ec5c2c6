"""Character n-grams within words, counted in Arrow batches: a word's n-grams are looked up once, however often it stands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts counted at a time, and words (of this length at most) whose n-grams are remembered.
TEXTS, KNOWN, LONGEST = 512, 100_000, 64
VECTOR = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def grams_of(word: str, low: int = 3, high: int = 5) -> list[str]:
    """n-grams of a word with a space at either end."""
    w = f" {word} "
    return [w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def remembered(number: Callable[[str], int | None]) -> Callable[[str], np.ndarray]:
    """The numbers of a word's n-grams, without those that have none."""
    known: dict[str, np.ndarray] = {}

    def of(word: str) -> np.ndarray:
        found = known.get(word)
        if found is None:
            found = np.array([x for x in map(number, grams_of(word)) if x is not None], np.int64)
            if len(word) <= LONGEST:
                if len(known) >= KNOWN:
                    known.clear()
                known[word] = found
        return found

    return of


def counted(texts: list[str | None], of: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count), by text and n-gram; str.split knows the same white space as text.WHITE."""
    words = [(t or "").split() for t in texts]
    found = [of(w) for own in words for w in own]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    row = np.repeat(np.repeat(np.arange(len(words)), [len(own) for own in words]), [len(x) for x in found])
    key, count = np.unique((row << 32) | np.concatenate(found), return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, TEXTS):
            yield b.slice(i, TEXTS)


def totals(most: int = 300_000):
    """batches(text) -> gram, tf, df: parts that are to be added up; at most about `most` n-grams are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        of = remembered(lambda g: number.setdefault(g, len(number)))
        tf, df = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(number), pa.string()), pa.array(tf), pa.array(df)], names=["gram", "tf", "df"]
            )

        for b in slices(batches):
            _, gram, count = counted(b.column(0).to_pylist(), of)
            more = len(number) - len(tf)
            tf, df = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (tf, df))
            np.add.at(tf, gram, count)
            df += np.bincount(gram, minlength=len(number))
            if len(number) >= most:
                yield flush()
                number = {}
                of = remembered(lambda g, own=number: own.setdefault(g, len(own)))
                tf, df = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if number:
            yield flush()

    return run


class Weigher:
    """Texts as unit vectors of (1 + ln count) * idf over a vocabulary."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray):
        number = {g: i for i, g in enumerate(vocabulary)}
        self.of, self.idf = remembered(number.get), idf

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, n-gram, value); a text that has none of the n-grams has no entries."""
        row, gram, count = counted(texts, self.of)
        value = (1 + np.log(count)) * self.idf[gram]
        size = np.sqrt(np.bincount(row, value * value, len(texts)))[row]
        return row, gram, np.divide(value, size, out=value, where=size > 0)


def vectors(model, width: int):
    """batches(label, weight, text) -> _f, label, weight; _f as Spark's vectors are laid out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(*model.value)
        for b in slices(batches):
            n = b.num_rows
            row, gram, value = weigher(b.column(2).to_pylist())
            ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (gram.astype(np.int32), value)]
            shape = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32))]
            vector = pa.StructArray.from_arrays([*shape, *lists], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([vector, b.column(0), b.column(1)], names=["_f", "label", "weight"])

    return run


def classes(model, names: list[str]):
    """batches(..., text in lower case) -> the same without the last column, with conf and pred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, coefficients, intercepts, labels = model.value
        weigher, called = Weigher(vocabulary, idf), pa.array(labels, pa.string())
        for b in slices(batches):
            n = b.num_rows
            row, gram, value = weigher(b.column(b.num_columns - 1).to_pylist())
            margin = np.stack([np.bincount(row, value * c[gram], n) + i for c, i in zip(coefficients, intercepts, strict=True)], 1)
            p = np.exp(margin - margin.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = [pa.array(p.max(1)), called.take(pa.array(p.argmax(1)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *best], names=names)

    return run
