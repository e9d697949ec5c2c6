"""Order-preserving packing of tokenised documents into sequences of at most `width` tokens.

Cuts are chosen by dynamic programming over the ends of documents and sentences (and, in runs longer than `reach`
without such an end, at every `reach` tokens): the best cost of all windows up to boundary j is

    best[j] = min over i with at[j] - at[i] <= width of best[i] + padding(at[j] - at[i]) + penalty[j]

plus a fixed cost of opening a sequence; penalty is 0 at a document's end, `sentence` at a sentence's and `inside` elsewhere. As padding is
width - length, the minimum over i is that of best[i] + at[i], kept in a monotone queue; lengths that are powers of
two need no padding, and every boundary that lies a power of two before is looked up besides.

Documents keep the order of the table's files. Each Spark partition packs its own stream in stretches of about
`stretch` tokens: memory is bounded, nothing is shuffled, and a lost task is redone alone to the same result.

Defined results: a null or empty text is the single id 0, and so one piece. Repeated rows are packed each. Longer
texts than a sequence go on in the next. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WIDTH = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A space before white space, or at the end, is no cut: such texts are encoded whole.
_ODD = [
    f" {c}" for c in map(
        chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    )
]


class SegmentEncoder:
    """ids of byte_bpe_50k.json, as the tokenizers library gives them, from the same vocabulary as ranks.

    A cut before a space that a printing character follows is always a cut of the vocabulary's own pattern, so a text
    splits there and each segment is encoded once and kept, up to `kept` segments. Texts in which one of the file's added
    tokens is written out are left to the tokenizers library itself.
    """

    def __init__(self, ranks_path: str | None = None, json_path: str | None = None, kept: int = 250_000):
        import public_tokenizers
        import tiktoken

        self.json_path, self.whole = json_path or public_tokenizers.path("byte_bpe_50k.json"), None
        with open(self.json_path, encoding="utf-8") as f:
            head = f.read()
        at = head.index("[", head.index('"added_tokens"'))
        added = {t["content"]: t["id"] for t in json.JSONDecoder().raw_decode(head, at)[0]}
        self.added = list(added)

        path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        ordinary = self.encoding._core_bpe.encode_ordinary

        marks = {c: array("I", ordinary(c)).tobytes() for c in ".,;:!?"}

        class Kept(dict):
            def __missing__(self, segment: str) -> bytes:
                if segment[-1:] in marks and segment[-2:-1].isalpha():  # letters and a mark never share an id
                    out = self[segment[:-1]] + marks[segment[-1]]
                else:
                    out = array("I", ordinary(" " + segment)).tobytes()
                if len(self) < kept:
                    self[segment] = out
                return out

        self.segments = Kept()
        self.ends_sentence = np.zeros(max(self.encoding.n_vocab, *added.values(), 0) + 1, bool)
        for raw, i in ranks.items():
            self.ends_sentence[i] = raw.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b"\n") if raw.strip(b"\"')]") else False

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if any(x in text for x in self.added):
            if self.whole is None:  # few texts need it
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if any(x in text for x in _ODD):
            return array("I", self.encoding._core_bpe.encode_ordinary(text)).tobytes()
        head, *rest = text.split(" ")
        first = array("I", self.encoding._core_bpe.encode_ordinary(head)).tobytes()
        return first + b"".join(map(self.segments.__getitem__, rest))


def choose_cuts(at: np.ndarray, penalty: np.ndarray, width: int = WIDTH, opening: float = 32.0) -> list[int]:
    """Indexes into `at` (increasing, at[0] = 0, gaps <= width) of the cheapest cuts, the first and last included.

    Each window costs `opening` too; a window as long as any power of two below width is not padded.
    """
    n = len(at)
    here, there = [], []
    for w in (1 << k for k in range(width.bit_length()) if 1 << k < width):
        i = np.searchsorted(at, at - w)
        met = np.flatnonzero(at[np.minimum(i, n - 1)] == at - w)
        here.append(met), there.append(i[met])
    here, there = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (here, there))
    exact = there[np.argsort(here, kind="stable")].tolist()  # boundaries that lie a power of two before each
    ends = np.cumsum(np.bincount(here, minlength=n)).tolist()
    rows = iter(zip(at.tolist(), (penalty + opening).tolist(), ends, strict=True))
    near = next(rows)[2]
    best, back = [0.0], [0]
    queue, places, values, head = [0], [0], [0.0], 0  # values: best[i] + at[i], rising
    for j, (p, c, end) in enumerate(rows, 1):
        while places[head] < p - width:
            head += 1
        low, frm = values[head] + width - p, queue[head]
        if near < end:
            for k in exact[near:end]:
                if best[k] < low:
                    low, frm = best[k], k
            near = end
        low += c
        best.append(low)
        back.append(frm)
        v = low + p
        while len(queue) > head and values[-1] > v:
            queue.pop(), places.pop(), values.pop()
        queue.append(j), places.append(p), values.append(v)
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def boundaries(
    ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray, width: int, reach: int, sentence: float, inside: float
) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may fall, with penalties."""
    kind = np.zeros(len(ids) + 1, np.uint8)
    kind[1:][ends_sentence[ids]] = 2
    kind[ends] = 3
    kind[0] = 3
    at = np.flatnonzero(kind)
    for g in np.flatnonzero(np.diff(at) > reach):
        kind[at[g] + reach : at[g + 1] : reach] = 1
    at = np.flatnonzero(kind)
    return at, np.array([0.0, inside, sentence, 0.0])[kind[at]]


def pack_stretch(ids: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces as (document index, begin, end, sequence index), all in places of the stretch."""
    edges = np.unique(np.concatenate([cuts, ends]))
    begin, end = edges[:-1], edges[1:]
    return np.searchsorted(ends, begin, "right"), begin, end, np.searchsorted(cuts, begin, "right") - 1


def packed(
    docs: DataFrame, encoder: Callable[[], SegmentEncoder] = SegmentEncoder, width: int = WIDTH, reach: int = 32,
    sentence: float = 4.0, inside: float = 16.0, stretch: int = 1 << 20, with_ids: bool = False
) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _encoder(encoder)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            ends = np.cumsum([len(x) >> 2 for _, x in held])
            starts = np.concatenate([[0], ends[:-1]])
            at, penalty = boundaries(ids, ends, code.ends_sentence, width, reach, sentence, inside)
            cuts = at[choose_cuts(at, penalty, width)]
            doc, begin, end, seq = pack_stretch(ids, ends, cuts)
            raw = memoryview(ids).cast("B") if len(ids) else b""
            out = {
                "doc_id": pa.array([held[i][0] for i in doc.tolist()], pa.int64()), "start": begin - starts[doc], "length": end - begin,
                "ids_crc32": np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.int64),
                "doc_tokens": (ends - starts)[doc], "sequence_id": seq + sequence, "offset": begin - cuts[seq],
            }
            if with_ids:
                out["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in zip(begin, end, strict=True)], pa.list_(pa.int32()))
            sequence += len(cuts) - 1
            return pa.RecordBatch.from_pydict(out)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = code.ids(text.as_py() or "") + b"\0\0\0\0"
                held.append((doc_id, ids))
                size += len(ids) >> 2
                if size >= stretch:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    ).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


_made: dict[object, SegmentEncoder] = {}


def _encoder(make: Callable[[], SegmentEncoder]) -> SegmentEncoder:
    """One encoder a worker process."""
    if make not in _made:
        _made[make] = make()
    return _made[make]


def op3_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))
