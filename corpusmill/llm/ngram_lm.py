"""Language-model scoring with a weighted backoff automaton.

Model. n-gram counts of the training texts, smoothed by a Dirichlet prior at each order:

    p(w | h) = (c(h w) + m * p(w | shorter h)) / (c(h) + m),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

Automaton. A state is a context that occurred in training. It has an arc for each word seen after it, weighted with
log10 p(w | h), and a failure arc to the next shorter context, weighted with log10 m / (c(h) + m). A text is traversed
once from left to right: the state is carried, failure arcs are taken until an arc fits, and weights add up.

Distribution. Texts are cut into chunks of about `chunk_bytes`. A chunk keeps each distinct word once and its tokens as
numbers, and asks for the counts of its own distinct n-grams: it sends sorted 64-bit keys with its own counts to the
buckets of a hash partitioning, where the counts of all chunks are added up and answered in the order asked. With the
answers a chunk builds the part of the automaton that its texts can reach and traverses it, all tokens side by side: the
state before a token is where the arc of the longest known n-gram before it leads. So the model may be of any
size: no vocabulary, count table or automaton is broadcast or collected, and no key is hot, since a chunk asks for each
n-gram once. Words are told apart by 64-bit hashes, longer n-grams by their bucket (of about 2^20 keys) and 40 bits, so that
one in a million may be counted with another, at any size of the corpus.

Defined results: null and empty texts are the end token alone. A null id counts as training text. Repeated rows and
equal ids are scored (and counted) each. Texts of any length are handled whole. Only the id, the text and the training
condition are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULT, U64, mix, stored, table

END, START = b"\n", b"\t"  # no words: words hold no white space
ORDER, PRIOR = 3, 200.0
_CHUNK = "chunk long, ids binary, held binary, ends binary, words binary, tokens binary"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case: runs of bytes other than ASCII white space."""
    return (text or "").encode().lower().split()


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs(doc_id, train, text) -> chunks: document ids, training flags, ends, word hashes, and tokens as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made = 0
        number: dict[bytes, int] = {}
        ids: list[int | None] = []
        train: list[bool] = []
        sizes: list[int] = []
        tokens: list[np.ndarray] = []
        seen = 0

        def number_of(w: bytes) -> int:
            return number.setdefault(w, len(number))

        def flush() -> pa.RecordBatch:
            nonlocal made
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), U64, len(number))
            # frequent words get small numbers, which pack well
            flat = np.concatenate(tokens)
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            nulls = np.array([x is None for x in ids])
            held = np.packbits(np.array([*train, *nulls], bool))
            out = {
                "chunk": [(task << 24) + made], "ids": [np.array([x or 0 for x in ids], np.int64).tobytes()], "held": [held.tobytes()],
                "ends": [np.cumsum(sizes).tobytes()], "words": [hashes[order].tobytes()], "tokens": [_planes(rank[flat])],
            }
            made += 1
            for x in (ids, train, sizes, tokens, number):
                x.clear()
            return pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("chunk", pa.int64()), *((k, pa.binary()) for k in list(out)[1:])])
            )

        for b in batches:
            for i, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = words_of(text.as_py())
                words.append(END)
                ids.append(i)
                train.append(bool(t))
                sizes.append(len(words))
                get = number.get
                got = [get(w) for w in words]
                if None in got:
                    got = [number_of(w) if x is None else x for x, w in zip(got, words, strict=True)]
                tokens.append(np.array(got, np.uint32))
                seen += 8 + text.as_buffer().size if text.is_valid else 8
                if seen >= chunk_bytes:
                    yield flush()
                    seen = 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, _CHUNK)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as their low halves and then their high ones, which are mostly zero and pack well."""
    return (numbers & 0xFFFF).astype(np.uint16).tobytes() + (numbers >> 16).astype(np.uint16).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    low, high = np.frombuffer(planes, np.uint16).reshape(2, -1).astype(np.uint32)
    return low | high << np.uint32(16)


def _counts(numbers: np.ndarray) -> bytes:
    """Counts as planes of bytes, the lowest first, as many as the greatest needs; high ones are mostly zero and pack well."""
    numbers = np.asarray(numbers, "<u8")
    planes = -(-int(numbers.max(initial=0)).bit_length() // 8)
    return numbers.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def _counted(planes: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if planes:
        out[:, : len(planes) // n] = np.frombuffer(planes, np.uint8).reshape(-1, n).T
    return out.view("<u8").reshape(-1).astype(np.int64)


def _packed(keys: np.ndarray, n: int) -> bytes:
    """Sorted keys of n-grams as planes of the steps between their first 40 bits; those of single words whole."""
    if n == 1:
        return keys.tobytes()
    steps = np.diff(keys >> U64(24), prepend=U64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    if n == 1:
        return np.frombuffer(raw, U64)
    steps = np.zeros((len(raw) // 5, 8), np.uint8)
    steps[:, :5] = np.frombuffer(raw, np.uint8).reshape(5, -1).T
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=U64)


class Chunk:
    """A chunk with its n-gram keys: per order k, the key at each token of the n-gram that ends there (0: none)."""

    def __init__(self, row: dict, order: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        flags = np.unpackbits(np.frombuffer(row["held"], np.uint8))[: 2 * n].astype(bool)
        self.train, self.null_ids = flags[:n], flags[n:]
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.words = np.frombuffer(row["words"], U64)
        self.tokens = _numbers(row["tokens"])
        starts = np.concatenate([[0], self.ends[:-1]])
        in_train = np.repeat(self.train, self.ends - starts)
        self.place = np.arange(len(self.tokens)) - np.repeat(starts, self.ends - starts)  # within the text
        own = np.bincount(self.tokens[in_train], minlength=len(self.words))
        self.sets = [(self.words, own)]  # per order: sorted or word-ordered keys, own training counts
        self.at: list[np.ndarray] = [self.tokens]  # per order: index of the n-gram that ends at each token
        begin = U64(xxhash.xxh3_64_intdigest(START))
        key = self.words[self.tokens]
        word = key
        for k in range(2, order + 1):
            past = np.empty_like(key)
            past[1:] = key[:-1]
            # a text is preceded by one start mark only, so the first tokens have no longer n-grams
            past[self.place == 0] = begin
            key = mix(past * U64(MULT) + word + U64(k))
            some = self.place >= k - 2
            unique, index = np.unique(key[some], return_inverse=True)
            at = np.full(len(key), -1, np.int64)
            at[some] = index
            self.sets.append((unique, np.bincount(index[in_train[some]], minlength=len(unique))))
            self.at.append(at)


def _asked(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, chunk, order, keys, own counts), sorted by key within each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row, order)
                out: dict[str, list] = {x: [] for x in ("bucket", "chunk", "n", "keys", "counts")}
                for k, (keys, own) in enumerate(c.sets, 1):
                    place = _bucket(keys, buckets)
                    turn = np.argsort(place, kind="stable")
                    cuts = np.searchsorted(place[turn], np.arange(buckets + 1))
                    for i in range(buckets):
                        mine = turn[cuts[i] : cuts[i + 1]]
                        if len(mine):
                            out["bucket"].append(i)
                            out["chunk"].append(row["chunk"])
                            out["n"].append(k)
                            out["keys"].append(_packed(keys[mine], k))
                            out["counts"].append(_counts(own[mine]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["bucket"], pa.int32()), pa.array(out["chunk"], pa.int64()), pa.array(out["n"], pa.int32()),
                        pa.array(out["keys"], pa.binary()), pa.array(out["counts"], pa.binary())
                    ],
                    names=list(out)
                )

    return chunks.mapInArrow(run, "bucket int, chunk long, n int, keys binary, counts binary")


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys) % U64(buckets)).astype(np.int64)


def _sums(index: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Sum of the counts of each index; whole numbers throughout."""
    out = np.zeros(n, np.int64)
    np.add.at(out, index, counts)
    return out


def _answer(part: pa.Table) -> pa.Table:
    """All chunks' counts of a bucket's keys, in each chunk's own order; and the bucket's sums for the first order."""
    rows = part.to_pylist()
    keys = [_unpacked(r["keys"], r["n"]) for r in rows]
    out: list[bytes] = [b""] * len(rows)
    total = types = 0
    for n in {r["n"] for r in rows}:
        mine = [i for i, r in enumerate(rows) if r["n"] == n]
        unique, index = np.unique(np.concatenate([keys[i] for i in mine]), return_inverse=True)
        sums = _sums(index, np.concatenate([_counted(rows[i]["counts"], len(keys[i])) for i in mine]), len(unique))
        if n == 1:
            total, types = int(sums.sum()), int((sums > 0).sum())
        a = 0
        for i in mine:
            out[i] = _counts(sums[index[a : a + len(keys[i])]])
            a += len(keys[i])
    return pa.table(
        {
            "bucket": part.column("bucket"), "chunk": part.column("chunk"), "n": part.column("n"),
            "counts": pa.array(out, pa.binary()), "total": pa.array([total] + [0] * (len(rows) - 1), pa.int64()),
            "types": pa.array([types] + [0] * (len(rows) - 1), pa.int64())
        }
    )


class Automaton:
    """States, arcs and failure arcs that the texts of one chunk can reach.

    State 0 is the root (no context), 1 + w the context of word w, then the start mark, then longer contexts. From the
    root an arc leads on for every word, known or not, so failing ends there.
    """

    def __init__(self, chunk: Chunk, counts: list[np.ndarray], total: int, types: int, texts: int, prior: float):
        self.chunk, order, words = chunk, len(counts), len(chunk.words)
        self.base = np.log10((counts[0] + 0.1) / (total + 0.1 * (types + 1)))
        self.start = 1 + words if order > 1 else 0
        place, tokens = chunk.place, chunk.tokens.astype(np.int64)
        fail = [np.zeros(1), np.log10(prior / (counts[0] + prior)), [math.log10(prior / (texts + prior))]]
        back = [np.zeros(2 + words, np.int64)]
        weight = [self.base]
        arcs = [tokens]  # per order: the arc of the n-gram that ends at each token, -1 where there is none
        many = words
        into = [np.where(counts[0] > 0, 1 + np.arange(words), 0) if order > 1 else np.zeros(words, np.int64)]
        lower = self.base[tokens]  # log10 p of each token by the context one word shorter
        state = np.where(counts[0][tokens] > 0, 1 + tokens, 0)  # after each token, by the context one word shorter
        seen = np.where(place > 0, np.concatenate([[0], counts[0][tokens[:-1]]]), texts).astype(float)
        before = np.where(place > 0, np.concatenate([[0], state[:-1]]), self.start)
        first_id = 2 + words
        for k in range(2, order + 1):
            at, own = chunk.at[k - 1], counts[k - 1]
            some = at >= 0
            met = np.zeros(len(at), np.int64)
            met[some] = own[at[some]]
            p = np.where(some, np.log10(met + prior * 10**lower) - np.log10(seen + prior), lower)
            known = met > 0
            where = np.flatnonzero(known)
            index, first, inverse = np.unique(at[where], return_index=True, return_inverse=True)
            first = where[first]
            arc = np.full(len(at), -1, np.int64)
            arc[where] = many + inverse
            arcs.append(arc)
            many += len(first)
            weight.append(p[first])
            if k < order:
                states = first_id + index
                into.append(states)
                fail.append(np.full(len(own), 0.0))
                fail[-1][index] = np.log10(prior / (own[index] + prior))
                back.append(np.zeros(len(own), np.int64))
                back[-1][index] = state[first]
            else:
                into.append(state[first])
            lower = p
            if k < order:
                after = np.where(known, first_id + at, state)
                seen = np.concatenate([[0], met[:-1]]).astype(float)
                before = np.concatenate([[0], after[:-1]])
                state = after
                first_id += len(own)
        self.fail, self.weight = np.concatenate(fail), np.concatenate(weight)
        self.back, self.into = np.concatenate(back), np.concatenate(into).astype(np.int64)
        self.arcs = arcs
        # a state's depth is the length of its context
        sizes = [1, 1 + words, *(len(x) for x in fail[3:])]
        self.depth = np.repeat(np.arange(len(sizes), dtype=np.int8), sizes)

    def traverse(self) -> np.ndarray:
        """log10 probability of each text. All tokens go on together: each is tried at the arc that leaves its state, follows
        failure arcs until one fits, and hands the state it leads to on to the next token."""
        n, order = len(self.chunk.tokens), len(self.arcs)
        # the state before a token is where the arc of the longest n-gram that ends at the token before it leads
        longest = self.arcs[0].copy()
        for arc in self.arcs[1:]:
            longest = np.where(arc >= 0, arc, longest)
        state = np.concatenate([[self.start], self.into[longest[:-1]]])[:n]
        state[self.chunk.place == 0] = self.start
        score = np.zeros(n)
        open_ = np.arange(n)
        for depth in range(order - 1, -1, -1):
            mine = self.depth[state[open_]] == depth
            at = open_[mine]
            found = self.arcs[depth][at]
            fits = found >= 0
            score[at[fits]] += self.weight[found[fits]]
            lost = at[~fits]
            score[lost] += self.fail[state[lost]]
            state[lost] = self.back[state[lost]]
            open_ = np.sort(np.concatenate([open_[~mine], lost]))
        starts = np.concatenate([[0], self.chunk.ends[:-1]]).astype(np.int64)
        return np.add.reduceat(score, starts) if len(starts) else score[:0]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(
    docs: DataFrame, held_out: Column, order: int = ORDER, prior: float = PRIOR, chunk_bytes: int = 3 << 20,
    keys_a_bucket: int = 1 << 20
) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    chunks = stored(
        _chunks(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~held_out, F.lit(True)).alias("train"), "text"),
            chunk_bytes
        ),
        "chunks"
    )
    tokens = chunks.agg(F.coalesce(F.sum(F.octet_length("tokens") / 4), F.lit(0.0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens * order / 4 / keys_a_bucket), 1)
    answers = stored(
        _asked(chunks, order, buckets).groupBy("bucket").applyInArrow(
            _answer, "bucket int, chunk long, n int, counts binary, total long, types long"
        ),
        "answers"
    )
    total, types = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()

    def texts_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            got = [int(np.unpackbits(np.frombuffer(h, np.uint8))[: len(i) // 8].sum()) for h, i in both]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["n"])

    texts = chunks.select("held", "ids").mapInArrow(texts_in, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def traversed(_, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        replies: dict[int, list] = {}
        for r in sorted(right.to_pylist(), key=lambda r: (r["n"], r["bucket"])):
            replies.setdefault(r["n"], []).append((r["bucket"], r["counts"]))
        for row in left.to_pylist():
            c = Chunk(row, order)
            counts = []
            for k, (keys, _) in enumerate(c.sets, 1):
                place = _bucket(keys, buckets)
                got = np.zeros(len(keys), np.int64)
                if len(keys):
                    many = np.bincount(place, minlength=buckets).tolist()
                    got[np.argsort(place, kind="stable")] = np.concatenate([_counted(x, many[i]) for i, x in replies[k]])
                counts.append(got)
            machine = Automaton(c, counts, int(total), int(types), int(texts), prior)
            starts = np.concatenate([[0], c.ends[:-1]]).astype(np.int64)
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
            parts.append(
                pa.table({
                    "doc_id": pa.array(c.ids, mask=c.null_ids), "held_out": ~c.train, "n_tokens": c.ends - starts, "n_known": add((counts[0] > 0)[c.tokens].astype(np.int64)),
                    "train_tokens": np.full(len(starts), int(total)), "base_score": add(machine.base[c.tokens]), "score": machine.traverse(),
                })
            )
        return pa.concat_tables(parts)

    return chunks.groupBy("chunk").cogroup(
        answers.select("chunk", "bucket", "n", "counts").groupBy("chunk")
    ).applyInArrow(traversed, SCORES)


def op1_lm(spark, sf_dir):
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return scored(table(spark, sf_dir, "documents"), held)
