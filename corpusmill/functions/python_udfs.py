"""What Spark has no expression for, in Arrow batches: canonical composition, blake2b ids, subsequences, n-gram scores."""

from __future__ import annotations

import gzip
import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def blake2b_64(text: pd.Series) -> pd.Series:
    """The 16 hex digits of a document's content id."""
    return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=8).hexdigest())


@F.pandas_udf(T.LongType())
def blake2b_32(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else int(hashlib.blake2b(t.encode(), digest_size=4).hexdigest(), 16))


@F.pandas_udf(T.StringType())
def payload(content: pd.Series) -> pd.Series:
    """A file's bytes as text, unpacked first where they begin as gzip does; null where they cannot be."""

    def text(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):
            return None

    return content.map(text)


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence. A row of the usual table is one whole number, with a bit for each place of
    b where the row does not rise, and is moved on by an addition."""
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    flat = full
    for x in a:
        hits = flat & where.get(x, 0)
        flat = ((flat + hits) | (flat - hits)) & full
    return len(b) - flat.bit_count()


@F.pandas_udf(T.LongType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [0 if x is None or y is None else lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64"
    )


@F.pandas_udf(T.DoubleType())
def weighted_exp(sums: pd.Series, counts: pd.Series) -> float:
    """exp of a mean, from sums and counts of parts: a grouped aggregate."""
    n = counts.sum()
    return float(np.exp(sums.sum() / n)) if n else float("nan")


@F.udtf(returnType="start bigint, words string")
class WordWindows:
    """Windows of `size` words, each `step` after the one before, until the end of the text is reached."""

    def eval(self, text: str, size: int, step: int):
        words = text.split(" ") if text else []
        for start in range(0, len(words), step):
            if not start or start + size - step < len(words):
                yield start, " ".join(words[start : start + size])


MEASURES = "words long, word_len double, terminal double, symbols double, dup_lines double, dup_grams double"


def measures_of(text: str, terminals: str, symbols: str, n: int) -> tuple[int, float, float, float, float, float]:
    """Words and lines of a text are split once for all its measures; str.split knows the same white space as text.WHITE."""
    w, own = text.split(), [x for line in text.split("\n") if (x := line.strip())]
    grams = len(set(zip(*(w[i:] for i in range(n)), strict=False))) if len(w) > n else 0
    return (
        len(w), sum(map(len, w)) / len(w) if w else 0.0, sum(x[-1] in terminals for x in own) / len(own) if own else 0.0,
        sum(map(text.count, symbols)) / len(w) if w else 1.0, 1 - len(set(own)) / len(own) if len(own) > 1 else 0.0,
        1 - grams / (len(w) - n + 1) if len(w) > n else 0.0
    )


def text_measures(terminals: str, symbols: str, n: int):
    """A function of texts to MEASURES; a text that is null has no words, and no repeats that could be measured."""
    none = (None, 0.0, 0.0, 1.0, None, None)

    @F.pandas_udf(MEASURES)
    def run(text: pd.Series) -> pd.DataFrame:
        rows = [none if x is None else measures_of(x, terminals, symbols, n) for x in text]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")])
        return out.astype({"words": "Int64"} | dict.fromkeys(out.columns[1:], "float64"))

    return run


def row_overlaps(orders: tuple[int, ...], unit: str):
    """A function of two texts to matched (clipped), hyp, ref for each order in turn: n-gram counts of that pair."""
    spaces = re.compile(r"\s+", re.ASCII)

    def counts(text: str | None, n: int) -> Counter:
        if text is None:
            return Counter()
        if unit == "char":
            return Counter(text[i : i + n] for i in range(len(text) - n + 1))
        return Counter(zip(*(text[i:] for i in range(n)), strict=False))

    def items(text: str | None):
        return text if text is None else spaces.sub("", text) if unit == "char" else text.split()

    @F.pandas_udf("array<bigint>")
    def run(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
        out = []
        for h, r in zip(map(items, hypothesis), map(items, reference), strict=True):
            row = []
            for n in orders:
                a, b = counts(h, n), counts(r, n)
                row += [sum(min(c, b[g]) for g, c in a.items() if g in b), a.total(), b.total()]
            out.append(row)
        return pd.Series(out)

    return run


@F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("spread", T.DoubleType())]))
def word_spread(text: pd.Series) -> pd.DataFrame:
    """How many words a text has, and the sum of c * log2(c) over the counts c of its different words, equal counts at once."""
    rows = []
    for x in text:
        w = x.split() if x is not None else []
        rows.append((len(w), sum(k * c * math.log2(c) for c, k in sorted(Counter(Counter(w).values()).items()))))
    return pd.DataFrame(rows, columns=["n", "spread"]).astype({"n": "int64", "spread": "float64"})


word_spread = word_spread.asNondeterministic()  # or a filter on it would work it out a second time


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def word_numbers(text: pd.Series) -> pd.Series:
    """A 16-bit number for each word: its characters times 37; null for a null text."""
    return text.map(lambda t: None if t is None else (np.fromiter(map(len, t.split()), np.int64) * 37 % 65536).astype(np.int32))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def token_ids(raw: pd.Series) -> pd.Series:
    """16-bit little-endian bytes as whole numbers; null for null."""
    return raw.map(lambda b: None if b is None else np.frombuffer(b, "<u2", len(b) // 2).astype(np.int32))
