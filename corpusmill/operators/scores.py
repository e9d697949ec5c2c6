"""Scores of generated text and of answers: diversity, ROUGE-L, BLEU, chrF, sliced accuracy, shortcut rules, perplexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.python_udfs import lcs, row_overlaps
from ..streaming.jobs import stored


def distinct_n(texts: DataFrame, n: int, text: str = "text") -> DataFrame:
    """value: distinct word n-grams over all of them."""
    grams = texts.select(F.explode(X.ngrams(X.words(F.col(text)), n)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    return grams.agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("total")
    ).select((F.col("kinds") / F.col("total")).alias("value"))


def repetition(texts: DataFrame, n: int = 4, text: str = "text") -> DataFrame:
    """value: mean share of repeated n-grams; texts without n-grams do not count."""
    grams = X.ngrams(X.words(F.col(text)), n)
    return texts.select(F.when(F.size(grams) > 0, X.repeated_fraction(grams)).alias("r")).agg(F.avg("r").alias("value"))


def rouge_l(pairs: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference") -> DataFrame:
    """value: mean F1 of longest common word subsequences, times 100; 0 where either side is empty."""
    h, r = X.words(F.col(hypothesis)), X.words(F.col(reference))
    rows = pairs.select(F.size(h).alias("nh"), F.size(r).alias("nr"), lcs(h, r).alias("l"))
    f1 = F.when((F.col("nh") == 0) | (F.col("nr") == 0), 0.0).otherwise(2 * F.col("l") / (F.col("nh") + F.col("nr")))
    return rows.agg((100 * F.avg(f1)).alias("value"))


def _gram_counts(pairs: DataFrame, key: str, column: str, unit: str, n: int) -> DataFrame:
    c = F.regexp_replace(F.col(column), r"\s+", "") if unit == "char" else F.col(column)
    items = F.filter(F.split(c, ""), lambda x: x != "") if unit == "char" else X.words(c)
    return pairs.select(key, F.explode(X.ngrams(items, n)).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias("c"))


def overlaps(
    pairs: DataFrame, orders: tuple[int, ...], unit: str = "char", key: str = "id", hypothesis: str = "hypothesis",
    reference: str = "reference"
) -> DataFrame:
    """n, matched (clipped), hyp, ref: n-gram counts summed over all pairs.

    A pair whose key no other has is counted in its row, and no n-gram is shuffled; rows that share a key count together.
    """
    rows = pairs.select(F.col(key).alias("id"), F.col(hypothesis).alias("h"), F.col(reference).alias("r"))
    shared = stored(rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("id"))
    rows = stored(rows.join(shared.withColumn("_many", F.lit(True)), "id", "left"))
    alone = rows.filter("_many IS NULL").select(row_overlaps(orders, unit)("h", "r").alias("c"))
    sums = [F.coalesce(F.sum(F.col("c")[i]), F.lit(0)).alias(f"c{i}") for i in range(3 * len(orders))]
    parts = alone.agg(*sums).select(F.explode(F.array(*(
        F.struct(F.lit(n).alias("n"), *(F.col(f"c{3 * k + j}").alias(c) for j, c in enumerate(("matched", "hyp", "ref"))))
        for k, n in enumerate(orders)
    ))).alias("x")).select("x.*")
    if shared.isEmpty():
        return parts
    for n in orders:
        parts = parts.unionByName(_shared_overlaps(rows.filter("_many"), n, unit))
    return parts.groupBy("n").agg(*(F.sum(c).alias(c) for c in ("matched", "hyp", "ref")))


def _shared_overlaps(rows: DataFrame, n: int, unit: str) -> DataFrame:
    h, r = _gram_counts(rows, "id", "h", unit, n), _gram_counts(rows, "id", "r", unit, n)
    both = h.withColumnRenamed("c", "ch").join(r.withColumnRenamed("c", "cr"), ["id", "g"], "full_outer")
    z = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))
    return both.agg(
        F.lit(n).alias("n"), z(F.sum(F.least(z("ch"), z("cr")))).alias("matched"), z(F.sum("ch")).alias("hyp"),
        z(F.sum("cr")).alias("ref")
    )


def bleu(pairs: DataFrame, unit: str = "char", orders: tuple[int, ...] = (1, 2, 3, 4), **names: str) -> DataFrame:
    """value: corpus BLEU with exponential smoothing of empty orders and a brevity penalty, times 100."""
    o = overlaps(pairs, orders, unit, **names)
    empty = F.sum(F.when(F.col("matched") == 0, 1).otherwise(0)).over(
        Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    )
    p = F.when(F.col("matched") == 0, 1 / F.pow(F.lit(2.0), "z") / F.col("hyp")).otherwise(F.col("matched") / F.col("hyp"))
    s = o.withColumn("z", empty).filter("hyp > 0").agg(
        F.avg(F.log(p)).alias("m"), F.max(F.when(F.col("n") == 1, F.col("hyp"))).alias("h"),
        F.max(F.when(F.col("n") == 1, F.col("ref"))).alias("r")
    )
    brevity = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return s.select((100 * brevity * F.exp("m")).alias("value"))


def chrf(pairs: DataFrame, chars: int = 6, words: int = 2, beta: float = 2.0, **names: str) -> DataFrame:
    """value: chrF++ over the corpus: mean of F scores by order, characters and words, times 100."""
    o = overlaps(pairs, tuple(range(1, chars + 1)), "char", **names).unionByName(
        overlaps(pairs, tuple(range(1, words + 1)), "word", **names)
    ).filter("hyp > 0 AND ref > 0")
    p, r = F.col("matched") / F.col("hyp"), F.col("matched") / F.col("ref")
    f = F.when(F.col("matched") == 0, 0.0).otherwise((1 + beta**2) * p * r / (beta**2 * p + r))
    return o.agg((100 * F.avg(f)).alias("value"))


def sliced_accuracy(rows: DataFrame, slices: list[str], right: Column) -> DataFrame:
    """slice, level, n, correct, accuracy: overall and by each column, in one pass with grouping sets."""
    marked = rows.select(*slices, right.cast("int").alias("_right"))
    by = marked.groupingSets([[], *([c] for c in slices)], *slices)
    sums = by.agg(
        *(F.grouping(c).alias(f"_g{i}") for i, c in enumerate(slices)), F.count(F.lit(1)).alias("n"),
        F.sum("_right").alias("correct")
    )
    name = F.coalesce(*(F.when(F.col(f"_g{i}") == 0, c) for i, c in enumerate(slices)), F.lit("overall"))
    level = F.coalesce(*(F.col(c).cast("string") for c in slices), F.lit("all"))
    return sums.select(
        name.alias("slice"), level.alias("level"), "n", "correct", F.round(F.col("correct") / F.col("n"), 4).alias("accuracy")
    )


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_report(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1."""
    c = confusion(rows, gold, predicted)
    g = c.groupBy(F.col(gold).alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit")
    )
    p = c.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("named"))
    both = g.join(p, "class", "left").withColumn(
        "precision", F.coalesce(F.try_divide("hit", "named"), F.lit(0.0))
    ).withColumn("recall", F.col("hit") / F.col("support"))
    return both.select(
        "class", "support", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"),
        F.round(
            F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)),
            4
        ).alias("f1")
    )


def majority(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg((F.max("c") / F.sum("c")).alias("baseline"))


def violations(rates: DataFrame, rules: list[str]) -> DataFrame:
    """rates(category, n, chance, one column a rule) -> category, rule, accuracy, bound above which chance does not reach."""
    long = rates.unpivot(["category", "n", "chance"], rules, "rule", "accuracy")
    bound = F.col("chance") + F.greatest(F.lit(0.05), 3 * F.sqrt(F.col("chance") * (1 - F.col("chance")) / F.col("n")))
    return long.withColumn("bound", bound).filter("accuracy > bound")


def cross_entropy(losses: DataFrame, bytes_per_token: float) -> DataFrame:
    """losses(loss, tokens) -> loss, perplexity (of a loss of 20 at most), bits_per_byte, compression."""
    out = losses.agg((F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")).alias("loss"))
    bits = F.col("loss") / F.log(F.lit(2.0)) / bytes_per_token
    return out.select(
        "loss", F.exp(F.least("loss", F.lit(20.0))).alias("perplexity"), bits.alias("bits_per_byte"),
        (8 / bits).alias("compression")
    )


def attention_heads(weights: DataFrame, least_query: int = 4) -> DataFrame:
    """weights(layer, head, q, k, p) -> layer, head, entropy, distance: means over queries from least_query on."""
    rows = weights.filter(F.col("q") >= least_query).groupBy("layer", "head", "q").agg(
        F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0)).alias("e"),
        F.sum(F.col("p") * (F.col("q") - F.col("k"))).alias("d")
    )
    return rows.groupBy("layer", "head").agg(F.avg("e").alias("entropy"), F.avg("d").alias("distance"))


def head_kinds(heads: DataFrame) -> DataFrame:
    """local or global by the median distance, sharp or broad by the median entropy."""
    middle = heads.agg(F.percentile("distance", F.lit(0.5)).alias("md"), F.percentile("entropy", F.lit(0.5)).alias("me"))
    out = heads.crossJoin(F.broadcast(middle))  # one row
    kind = F.concat_ws(
        "-", F.when(F.col("distance") <= F.col("md"), "local").otherwise("global"),
        F.when(F.col("entropy") <= F.col("me"), "sharp").otherwise("broad")
    )
    return out.select("layer", "head", "entropy", "distance", kind.alias("kind"))
