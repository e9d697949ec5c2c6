"""Token operators: frequencies, coverage, tokenizer evaluation, windows, prompt masks, decoding transforms, distribution scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.python_udfs import word_spread
from ..session import ship
from ..streaming.jobs import stored

#: Stands between symbols while pairs are merged; no symbol holds it.
SEP = "\x1f"
BYTE_PIECE = "^<0x[0-9A-F]{2}>$"


def batches_of_texts(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, after the last) of runs of texts of about `most` characters."""
    a = size = 0
    for i, x in enumerate(texts):
        if i > a and size + len(x) > most:
            yield a, i
            a, size = i, 0
        size += len(x)
    if a < len(texts):
        yield a, len(texts)


def encoded(docs: DataFrame, model_path: str, eos: int | None = 2, id_col: str = "doc_id") -> DataFrame:
    """id, ids, pieces of a sentencepiece model, loaded once a task; about a million characters at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for f in frames:
            texts = f["text"].fillna("").tolist()
            for a, b in batches_of_texts(texts):
                ids = model.encode(texts[a:b], num_threads=1)
                pieces = [[model.id_to_piece(i) for i in x] for x in ids]
                yield pd.DataFrame(
                    {id_col: f[id_col].iloc[a:b].tolist(), "ids": [x + [eos] if eos is not None else x for x in ids], "pieces": pieces}
                )

    return docs.select(id_col, "text").mapInPandas(
        run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>, pieces array<string>"
    )


def token_numbers(docs: DataFrame, model_path: str, eos: bool = True, name: str = "tokens") -> DataFrame:
    """docs(text, ...) with the number of a sentencepiece model's ids in place of text; the ids themselves are not kept."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            texts, counts = batch.column(len(others)), []
            size = max(1, min(len(texts), (len(texts) << 20) // max(1, texts.nbytes)))
            for i in range(0, len(texts), size):
                part = [x or "" for x in texts.slice(i, size).to_pylist()]
                for a, b in batches_of_texts(part):
                    counts += [len(x) + eos for x in model.encode(part[a:b], num_threads=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*others, name])

    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(name, T.LongType())])
    ship(docs.sparkSession)
    return docs.select(*others, "text").mapInArrow(run, schema)


def numbered(
    rows: DataFrame, order: list[Column | str], name: str, running: dict[str, str] | None = None
) -> tuple[DataFrame, int, dict[str, int]]:
    """rows with their place in a total order, from 1, and running sums of columns; also the number of rows and the sums.

    Rows are sorted by ranges; the driver adds up one count (and sum) a range, and each row's place in its range moves by
    what is before it. No task sees all rows.
    """
    running = running or {}
    ids = F.monotonically_increasing_id()  # the partition's number, then the row's in it
    placed = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", ids)
    ).withColumn("_p", F.shiftright("_m", 33))
    sums = placed.groupBy("_p").agg(
        F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_s_{k}") for k, c in running.items())
    ).orderBy("_p").collect()
    columns, before, at = ["_n", *(f"_s_{k}" for k in running)], [], [0] * (1 + len(running))
    for r in sums:
        before.append((r["_p"], *at))
        at = [x + r[c] for x, c in zip(at, columns, strict=True)]
    starts = rows.sparkSession.createDataFrame(before, "_p long" + "".join(f", {c} long" for c in columns))
    out = placed.join(F.broadcast(starts), "_p")  # a row a range
    own = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    places = [(F.col("_n") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).alias(name)]
    places += [(F.col(f"_s_{k}") + F.sum(c).over(own)).alias(k) for k, c in running.items()]
    return out.select(*rows.columns, *places), at[0], dict(zip(running, at[1:], strict=True))


def token_frequency(tokens: DataFrame, token: str = "token") -> DataFrame:
    """token, count, share, rank, running; equal counts by token. Counts are aggregated first, types are ranked by ranges."""
    counts = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("count"))
    ranked, _, sums = numbered(counts, [F.desc("count"), F.asc(token)], "rank", {"running": "count"})
    return ranked.select(token, "count", (F.col("count") / F.lit(max(1, sums["running"]))).alias("share"), "rank", "running")


def covering(frequency: DataFrame, share: float = 0.95) -> DataFrame:
    """n: how many of the most frequent types make up a share of all tokens."""
    total = frequency.agg(F.max("running")).first()[0] or 0
    return frequency.filter(F.col("running") >= share * total).agg(F.min("rank").cast("long").alias("n"))


def tokenizer_report(encoded_docs: DataFrame, docs: DataFrame, unk: str = "<unk>", id_col: str = "doc_id") -> DataFrame:
    """One row: docs, words, chars, tokens, fertility, compression, unk and byte-fallback percentages."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    joined = encoded_docs.join(
        docs.select(id_col, words.alias("w"), F.length("text").alias("c"), F.octet_length("text").alias("b")), id_col
    )
    fallback = lambda low, high: F.size(
        F.filter("pieces", lambda p: p.rlike(BYTE_PIECE) & F.conv(F.substring(p, 4, 2), 16, 10).cast("int").between(low, high))
    )
    s = joined.agg(
        F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"), F.sum("c").alias("chars"), F.sum("b").alias("bytes"), F.sum(F.size("pieces")).alias("tokens"),
        F.sum(F.size(F.filter("pieces", lambda p: p == unk))).alias("unk"), F.sum(fallback(0, 127)).alias("ascii_fallback"), F.sum(fallback(128, 255)).alias("other_fallback"),
    )
    rate = lambda c: F.round(100 * F.try_divide(F.col(c), F.col("tokens")), 4)
    return s.select(
        "*", F.round(F.try_divide("tokens", "words"), 2).alias("fertility"),
        F.round(F.try_divide("chars", "tokens"), 2).alias("compression"),
        F.round(F.try_divide("bytes", "tokens"), 4).alias("bytes_per_token"), rate("unk").alias("unk_pct"),
        rate("ascii_fallback").alias("ascii_fallback_pct"), rate("other_fallback").alias("other_fallback_pct")
    )


def windows(tokens: DataFrame, context: int, ids: str = "ids", stride: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """id, start, x, y: windows of `context` tokens and the same a token later; only whole windows."""
    last = F.size(ids) - context - 1
    starts = F.when(
        last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride or context))
    ).otherwise(F.array().cast("array<int>"))
    return tokens.select(id_col, ids, F.explode(starts).alias("start")).select(
        id_col, "start", F.slice(ids, F.col("start") + 1, context).alias("x"),
        F.slice(ids, F.col("start") + 2, context).alias("y")
    )


def random_windows(tokens: DataFrame, context: int, n: int, seed: int = 0, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """n windows a row at offsets by hash, the same in every run."""
    room = F.size(ids) - context
    drawn = tokens.filter(room > 0).select(id_col, ids, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).withColumn(
        "start", F.pmod(F.xxhash64(F.lit(seed), id_col, "draw"), F.size(ids) - context).cast("int")
    )
    return drawn.select(
        id_col, "draw", "start", F.slice(ids, F.col("start") + 1, context).alias("x"),
        F.slice(ids, F.col("start") + 2, context).alias("y")
    )


def prompt_masked(rows: DataFrame, max_len: int, pad: int = 0, ignore: int = -100) -> DataFrame:
    """rows(prompt, target: arrays of int) -> input, labels of max_len - 1: only the target counts; longer rows go."""
    whole = F.concat("prompt", "target")
    kept = rows.filter(F.size(whole) <= max_len).withColumn("_w", whole)
    given = F.size("prompt") - 1
    inputs = F.concat(F.slice("_w", 1, F.size("_w") - 1), F.array_repeat(F.lit(pad), F.lit(max_len) - F.size("_w")))
    labels = F.concat(
        F.array_repeat(F.lit(ignore), F.greatest(given, F.lit(0))), F.slice("_w", F.size("prompt") + 1, F.size("target")),
        F.array_repeat(F.lit(ignore), F.lit(max_len) - F.size("_w"))
    )
    return kept.withColumn("input", inputs).withColumn("labels", labels).drop("_w")


def pseudo_perplexity(docs: DataFrame, tokens: str, id_col: str = "doc_id", words: str | None = None) -> DataFrame:
    """docs(id, tokens: array) -> id, ppl: 2^entropy of the tokens, times tokens per word (where words has their number);
    9999 for a single token, nothing for none. Counted in the row, nothing is shuffled."""
    n = F.size(tokens)
    spread = F.aggregate(X.run_lengths(F.col(tokens)), F.lit(0.0), lambda a, c: a + c * F.log2(c.cast("double")))
    scale = n / F.greatest(F.col(words), F.lit(1)) if words else F.lit(1.0)
    ppl = F.when(n <= 1, F.lit(9999.0)).otherwise(F.pow(F.lit(2.0), F.log2(n.cast("double")) - spread / n) * scale)
    return docs.filter(n > 0).select(id_col, ppl.alias("ppl"))


def text_perplexity(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """pseudo_perplexity of the words of a text, which are counted in Arrow batches."""
    ship(docs.sparkSession)
    n, spread = F.col("_w.n"), F.col("_w.spread")
    ppl = F.when(n <= 1, F.lit(9999.0)).otherwise(F.pow(F.lit(2.0), F.log2(n.cast("double")) - spread / n))
    return docs.select(id_col, word_spread(text).alias("_w")).filter(n > 0).select(id_col, ppl.alias("ppl"))


def index_percentiles(scores: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """p, value: the value at place floor(n * p) of the sorted rows; nothing between two rows is made up."""
    ranked, n, _ = numbered(scores.select(value), [value], "r")
    wanted = scores.sparkSession.createDataFrame([(p, min(math.floor(n * p), n - 1) + 1) for p in shares], "p double, r long")
    return ranked.join(F.broadcast(wanted), "r").select("p", value)


def decoded_transform(
    logits: DataFrame, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None, penalty: float = 1.0
) -> DataFrame:
    """logits(step, token, logit, seen) -> step, token, p after repetition penalty, temperature, top-k and top-p.

    The nucleus is the smallest head of the sorted distribution that reaches top_p; the token that crosses it stays.
    """
    x = F.col("logit")
    x = F.when(F.col("seen"), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x) / temperature
    by = Window.partitionBy("step").orderBy(F.desc("x"), "token")
    out = logits.withColumn("x", x).withColumn("r", F.row_number().over(by))
    if top_k:
        out = out.filter(F.col("r") <= top_k)
    step = Window.partitionBy("step")
    out = out.withColumn("e", F.exp(F.col("x") - F.max("x").over(step))).withColumn("p", F.col("e") / F.sum("e").over(step))
    if top_p:
        before = F.sum("p").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("p")
        out = out.withColumn("before", before).filter(F.col("before") < top_p).withColumn("p", F.col("p") / F.sum("p").over(step))
    return out.select("step", "token", "p")


def banned_ngrams(history: Column, n: int) -> Column:
    """Tokens that would repeat an n-gram of the history if they came next."""
    last = F.slice(history, F.greatest(F.size(history) - (n - 2), F.lit(1)), n - 1)
    starts = F.when(
        F.size(history) >= n, F.sequence(F.lit(1), F.greatest(F.size(history) - n + 1, F.lit(1)))
    ).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(
        F.transform(
            F.filter(starts, lambda i: F.slice(history, i, F.lit(n - 1)) == last), lambda i: F.element_at(history, i + n - 1)
        )
    )


def forced_choice(scores: DataFrame) -> DataFrame:
    """scores(item, place, candidate, logprob: one row a token) -> item, chosen; the first candidate wins ties."""
    sums = scores.groupBy("item", "place", "candidate").agg(F.sum("logprob").alias("s"))
    return sums.groupBy("item").agg(F.max_by("candidate", F.struct(F.col("s"), -F.col("place"))).alias("chosen"))


def learning_rate(step: Column, peak: float, warmup: int, total: int, floor: float) -> Column:
    """Linear warm-up, then a half cosine down to the floor."""
    share = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, peak * (step + 1) / warmup).when(step >= total, F.lit(floor)).otherwise(
        floor + (peak - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * share))
    )


def parameters(vocab: Column, width: int, layers: int, d_ff: Column, tied: bool = True) -> Column:
    """Of a decoder with gated feed-forward layers and two norms a layer."""
    layer = 4 * width * width + 3 * width * d_ff + 2 * width
    return vocab * width * (1 if tied else 2) + layers * layer + width


def position_matches(ids: Column, pattern: Column) -> Column:
    """0-based starts of a run of tokens in an array."""
    n = F.size(pattern)
    starts = F.when(
        (n > 0) & (F.size(ids) >= n), F.sequence(F.lit(1), F.greatest(F.size(ids) - n + 1, F.lit(1)))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(starts, lambda i: F.slice(ids, i, n) == pattern), lambda i: i - 1)


def byte_pairs(word_counts: DataFrame, merges: int) -> list[tuple[str, str]]:
    """Merges of byte-pair encoding over words(symbols: array<string>, n), by rounds of one aggregation and one rewrite.

    The driver sees one pair a round. Meant for small vocabularies of words: the table is kept, not the corpus.
    """
    out = []
    words = word_counts
    for k in range(merges):
        pairs = words.select(
            "n",
            F.explode(
                F.expr(
                    "transform(sequence(1, greatest(size(symbols) - 1, 1)), i -> struct(element_at(symbols, i) AS a, try_element_at(symbols, i + 1) AS b))"
                )
            ).alias("p")
        ).filter("p.b IS NOT NULL")
        best = pairs.groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(1).collect()
        if not best:
            break
        a, b = best[0]["p"]
        out.append((a, b))
        joined = F.concat(F.lit(SEP), F.array_join("symbols", SEP + SEP), F.lit(SEP))
        merged = F.regexp_replace(
            joined, F.lit(f"{SEP}\\Q{a}\\E{SEP}{SEP}\\Q{b}\\E{SEP}"),
            F.lit(SEP + (a + b).replace("\\", "\\\\").replace("$", "\\$") + SEP)
        )
        words = words.select("n", F.split(F.regexp_replace(merged, f"^{SEP}|{SEP}$", ""), SEP + SEP).alias("symbols"))
        if k % 20 == 19:
            words = words.checkpoint()
    return out
