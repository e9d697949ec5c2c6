"""Language identification: character n-grams within words, sublinear TF-IDF, balanced multinomial regression."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gram_vectors as G
from ..functions import text as X
from ..session import ship
from ..streaming.jobs import folder, stored

MAX_CHARS = 5_000


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams of each word with a space at either end; a padded word shorter than n gives itself once."""

    def of(w: Column) -> Column:
        def grams(ch: Column) -> Column:
            def sized(n: int) -> Column:
                own = F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size(ch) - (n - 1), F.lit(1))),
                    lambda i: F.array_join(F.slice(ch, i, F.lit(n)), "")
                )
                return own if n == low else F.when(F.size(ch) >= n, own).otherwise(F.array().cast("array<string>"))

            return F.flatten(F.array(*(sized(n) for n in range(low, high + 1))))

        return X.let(F.filter(F.split(F.concat(F.lit(" "), w, F.lit(" ")), ""), lambda x: x != ""), grams)

    return F.flatten(F.transform(X.words(F.lower(F.substring(c, 1, MAX_CHARS))), of))


def _lowered(c: Column) -> Column:
    return F.lower(F.substring(c, 1, MAX_CHARS))


class Classifier:
    """vocabulary, idf and regression; `predict` adds `conf` and `pred`, in Arrow batches."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, coefficients: np.ndarray, intercepts: np.ndarray, labels: list[str]):
        self.model = (vocabulary, idf, coefficients, intercepts, labels)

    def predict(self, docs: DataFrame) -> DataFrame:
        names = [*docs.columns, "conf", "pred"]
        schema = T.StructType([*docs.schema, T.StructField("conf", T.DoubleType()), T.StructField("pred", T.StringType())])
        model = docs.sparkSession.sparkContext.broadcast(self.model)  # of fixed size
        return docs.select("*", _lowered(F.col("text")).alias("_low")).mapInArrow(G.classes(model, names), schema)


def paragraphs(docs: DataFrame, low: int = 200, high: int = 2000) -> DataFrame:
    """lang, text: all paragraphs of a fit length."""
    return docs.select("lang", F.explode(F.split("text", r"\n\n")).alias("text")).filter(F.length("text").between(low, high))


def sampled(rows: DataFrame, per_class: int = 20_000) -> DataFrame:
    """The first per_class different texts of each language by hash, written once. Only about as many are ranked."""
    turn = F.xxhash64("text")
    place = F.shiftrightunsigned(turn, 11)
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(turn, 0.02).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(1.25 * per_class) / F.col("_n"))
    near = rows.join(F.broadcast(sizes), "lang").filter(place / float(1 << 53) <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "text"))
    return stored(near.select("lang", "text").distinct().withColumn("_r", rank).filter(F.col("_r") <= per_class).drop("_r"))


def stratified(rows: DataFrame, test: float = 0.1, seed: int = 1337) -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash, the same share of every class in expectation and the same rows in every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), "lang", "text"), F.lit(10_000)) / 10_000
    return rows.filter(u >= test), rows.filter(u < test)


def fitted(rows: DataFrame, features: int = 200_000, c: float = 4.0) -> Classifier:
    """rows(lang, text) -> classifier with idf ln((1 + n) / (1 + df)), unit length and balanced class weights.

    The vocabulary holds the most frequent n-grams of those in two rows at least; equal counts by n-gram.
    """
    spark = rows.sparkSession
    ship(spark)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    labels, n = sorted(counts), sum(counts.values())
    code = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("lang")).cast("double") - 1
    weight = F.create_map(*(F.lit(x) for k in labels for x in (k, n / (len(labels) * counts[k]))))[F.col("lang")]
    tasks = max(1, min(spark.sparkContext.defaultParallelism, n // 500))  # each sends a whole gradient a round
    dealt = rows.repartition(tasks)
    low = _lowered(F.col("text")).alias("_low")
    grams = dealt.select(low).mapInArrow(G.totals(), "gram string, tf long, df long").groupBy("gram").agg(
        F.sum("tf").alias("tf"), F.sum("df").alias("df")
    ).filter("df >= 2").orderBy(F.desc("tf"), "gram").limit(features).toArrow()
    vocabulary = grams.column("gram").to_pylist()
    idf = np.log((n + 1) / (grams.column("df").to_numpy() + 1))
    model = spark.sparkContext.broadcast((vocabulary, idf))
    path = folder(spark)
    dealt.select(code.alias("label"), weight.alias("weight"), low).mapInArrow(
        G.vectors(model, len(vocabulary)), f"_f {G.VECTOR}, label double, weight double"
    ).write.parquet(path)
    numbers = [T.StructField(k, T.DoubleType()) for k in ("label", "weight")]
    ready = spark.read.schema(T.StructType([T.StructField("_f", VectorUDT()), *numbers])).parquet(path).coalesce(tasks)
    made = LogisticRegression(
        featuresCol="_f", labelCol="label", weightCol="weight", family="multinomial", regParam=1 / (c * n), maxIter=30
    ).fit(ready)
    return Classifier(vocabulary, idf, made.coefficientMatrix.toArray(), made.interceptVector.toArray(), labels)


def accepted(predicted: DataFrame, target: Column, least: float = 0.90) -> Column:
    """Whether a document's predicted language is its own, surely enough."""
    return (F.col("pred") == target) & (F.col("conf") >= least)


def contamination(predicted: DataFrame, target: str) -> DataFrame:
    """source, total, contamination: share of a source's documents that another language is predicted for."""
    return predicted.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.round(1 - F.avg((F.col("pred") == target).cast("int")), 4).alias("contamination")
    )
