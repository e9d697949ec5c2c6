"""Queries around models: language identification, schedules, sizes, decoding, attention, loss accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import langid, scores, tokens
from ..registry import query
from ..sources.tables import table as t


@query("langid_report")
def langid_report(spark, d):
    """Precision, recall and F1 by language over all held-out paragraphs; the fit is on at most 20,000 of the others a language."""
    train, test = langid.stratified(langid.paragraphs(t(spark, d, "documents")))
    return scores.class_report(langid.fitted(langid.sampled(train)).predict(test), "lang", "pred")


_STEPS = "SELECT CAST(s AS BIGINT) AS step FROM range(0, 1000, 10) r(s)"


@query(
    "learning_rate_schedule",
    f"SELECT step, round(CASE WHEN step < 100 THEN 3e-4 * (step + 1) / 100 WHEN step >= 900 THEN 3e-5 ELSE 3e-5 + 2.7e-4 * 0.5 * (1 + cos(pi() * (step - 100) / 800.0)) END, 12) AS lr FROM ({_STEPS})"
)
def learning_rate_schedule(spark, d):
    return spark.range(0, 1000, 10).select(
        F.col("id").alias("step"), F.round(tokens.learning_rate(F.col("id"), 3e-4, 100, 900, 3e-5), 12).alias("lr")
    )


@query(
    "parameter_budget",
    "SELECT CAST(v AS BIGINT) AS vocab, min_by(f, struct_pack(a := abs(v * 512 + 8 * (4 * 512 * 512 + 3 * 512 * f + 1024) + 512 - 25000000), f := f)) AS d_ff FROM (VALUES (5000), (8000), (10000)) x(v), (SELECT CAST(f AS BIGINT) AS f FROM range(512, 4096, 64) r(f)) GROUP BY v"
)
def parameter_budget(spark, d):
    """For each vocabulary the feed-forward width that comes nearest to a parameter budget."""
    grid = spark.createDataFrame([(5000,), (8000,), (10000,)], "vocab long").withColumn(
        "f", F.explode(F.sequence(F.lit(512).cast("long"), F.lit(4095).cast("long"), F.lit(64).cast("long")))
    )
    off = F.abs(tokens.parameters(F.col("vocab"), 512, 8, F.col("f")) - 25_000_000)
    return grid.groupBy("vocab").agg(F.min_by("f", F.struct(off, F.col("f"))).alias("d_ff"))


#: Scores of events by hour stand in for a model's logits: a step an hour, a token an event type.
_LOGITS = "SELECT epoch(date_trunc('hour', ts))::BIGINT AS step, event_type AS token, round(sum(value) / 100, 6) AS logit FROM events GROUP BY ALL"


@query(
    "decoding_top_p",
    f"WITH l AS ({_LOGITS}), r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY logit DESC, token) AS r, exp(logit - max(logit) OVER (PARTITION BY step)) AS e FROM l), k AS (SELECT *, e / sum(e) OVER (PARTITION BY step) AS p FROM r WHERE r <= 4), c AS (SELECT *, sum(p) OVER (PARTITION BY step ORDER BY r) - p AS before FROM k) SELECT step, token, round(p / sum(p) OVER (PARTITION BY step), 6) AS p FROM c WHERE before < 0.9",
)
def decoding_top_p(spark, d):
    x = t(spark, d, "events").groupBy(
        F.unix_timestamp(F.date_trunc("hour", "ts")).alias("step"), F.col("event_type").alias("token")
    ).agg(F.round(F.sum("value") / 100, 6).alias("logit"))
    return tokens.decoded_transform(
        x.withColumn("seen", F.lit(False)), top_k=4, top_p=0.9
    ).select("step", "token", F.round("p", 6).alias("p"))


_LOSS = "SELECT round(sum(loss * n) / sum(n), 6) AS loss, round(exp(least(sum(loss * n) / sum(n), 20)), 4) AS perplexity, round(sum(loss * n) / sum(n) / ln(2) / 4, 6) AS bits_per_byte FROM (SELECT l_discount * 40 AS loss, l_quantity AS n FROM lineitem)"


@query("loss_account", _LOSS)
def loss_account(spark, d):
    rows = t(spark, d, "lineitem").select((F.col("l_discount") * 40).alias("loss"), F.col("l_quantity").alias("tokens"))
    return scores.cross_entropy(rows, 4.0).select(
        F.round("loss", 6).alias("loss"), F.round("perplexity", 4).alias("perplexity"),
        F.round("bits_per_byte", 6).alias("bits_per_byte")
    )


@query(
    "attention_heads",
    "WITH w AS (SELECT l_linenumber AS layer, 0 AS head, l_orderkey % 50 AS q, l_partkey % 50 AS k, sum(l_quantity) AS x FROM lineitem WHERE l_partkey % 50 <= l_orderkey % 50 GROUP BY ALL), p AS (SELECT layer, head, q, k, x / sum(x) OVER (PARTITION BY layer, head, q) AS p FROM w), r AS (SELECT layer, head, q, sum(-p * log2(p)) AS e, sum(p * (q - k)) AS d FROM p WHERE q >= 4 GROUP BY ALL) SELECT layer, head, round(avg(e), 6) AS entropy, round(avg(d), 6) AS distance FROM r GROUP BY ALL",
)
def attention_heads(spark, d):
    """Weights made of quantities: a query's share by key."""
    from pyspark.sql import Window

    x = t(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("layer"), F.lit(0).alias("head"), (F.col("l_orderkey") % 50).alias("q"),
        (F.col("l_partkey") % 50).alias("k"), "l_quantity"
    ).filter("k <= q")
    w = x.groupBy("layer", "head", "q", "k").agg(F.sum("l_quantity").alias("x"))
    w = w.withColumn("p", F.col("x") / F.sum("x").over(Window.partitionBy("layer", "head", "q")))
    return scores.attention_heads(w).select(
        "layer", "head", F.round("entropy", 6).alias("entropy"), F.round("distance", 6).alias("distance")
    )
