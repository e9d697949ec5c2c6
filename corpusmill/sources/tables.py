"""Readers and writers: Parquet tables, JSON-lines shards, text manifests, CSV and JSON reports."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.python_udfs import blake2b_64, token_ids
from ..session import ship

DOCUMENT = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("source_type", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("fetched_at", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("flags", T.MapType(T.StringType(), T.StringType())),
])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_shards(spark: SparkSession, path: str | list[str], tolerant: bool = False) -> DataFrame:
    """JSON-lines shards (plain, gzip or zstd) below a folder, or of listed files; tolerant skips what cannot be read."""
    reader = spark.read.schema(DOCUMENT).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl*")
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("mode", "DROPMALFORMED")
    return reader.json(path)


def write_shards(docs: DataFrame, path: str, shard_docs: int = 50_000, mode: str = "append", parquet: bool = True) -> None:
    """Shards of at most shard_docs rows; a further run adds shards. Parquet with zstd, or JSON lines with gzip."""
    writer = docs.write.mode(mode).option("maxRecordsPerFile", shard_docs)
    writer.option("compression", "zstd").parquet(path) if parquet else writer.option("compression", "gzip").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, one a line, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("doc_id")).filter("doc_id <> ''").distinct()


def write_manifests(splits: DataFrame, path: str) -> None:
    """splits(split, doc_id): a folder of ids for each split."""
    splits.select(
        "split", F.col("doc_id").cast("string").alias("value")
    ).repartition("split").write.mode("overwrite").partitionBy("split").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def _files(spark: SparkSession, path: str) -> bool:
    """Whether a folder that any of Spark's file systems reads holds something besides marks."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and any(x.getPath().getName()[0] not in "._" for x in fs.listStatus(at))


def first_with_files(spark: SparkSession, paths: list[str]) -> str:
    """The first of several folders that holds files, the last where none does."""
    return next((p for p in paths if _files(spark, p)), paths[-1])


def report_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON-lines report; no rows where it is missing, nulls for what cannot be read."""
    return spark.read.schema(schema).json(path) if _files(spark, path) else spark.createDataFrame([], schema)


def config(path: str) -> dict:
    """Settings of a JSON file, or of a YAML one where its library is there."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError:
                raise ValueError("a YAML file needs the yaml library; JSON does not") from None
            return yaml.safe_load(f) or {}
        return json.load(f)


def thresholds(settings: dict) -> X.Thresholds:
    """Filter thresholds with the given ones in place of the usual; a name that is none fails."""
    return dataclasses.replace(X.Thresholds(), **settings)


def finalised(docs: DataFrame) -> DataFrame:
    """docs with content ids where doc_id is missing; fails when it is run at a source type that is none."""
    wrong = F.raise_error(F.concat(F.lit("unknown source type: "), F.coalesce("source_type", F.lit("none"))))
    kind = F.when(F.col("source_type").isin("manual", "downloaded"), F.col("source_type")).otherwise(wrong.cast("string"))
    return docs.withColumn("doc_id", F.coalesce("doc_id", blake2b_64("text"))).withColumn("source_type", kind)


def write_sample(docs: DataFrame, path: str, least: int = 10, most: int | None = None) -> None:
    """Sentences of at least `least` characters as lines of text; what is there already is left."""
    lines = docs.select(F.explode(X.sentences(F.col("text"), ".?!")).alias("value")).filter(F.length("value") >= least)
    lines = lines.select(F.regexp_replace("value", r"\n", " ").alias("value"))
    (lines.limit(most) if most else lines).write.mode("ignore").text(path)


def write_sorted(docs: DataFrame, path: str, order: list[str]) -> None:
    """Shards that are ranges of an order, sorted within."""
    docs.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_quarantine(docs: DataFrame, kept_path: str, rejected_path: str, accepted: str = "accepted") -> None:
    """Kept and rejected rows to two places; docs should be a stored table, as it is read twice."""
    docs.filter(F.col(accepted)).drop(accepted).write.mode("append").parquet(kept_path)
    docs.filter(~F.coalesce(F.col(accepted), F.lit(False))).drop(accepted).write.mode("append").parquet(rejected_path)


def write_tokens(tokens: DataFrame, path: str, ids: str = "ids") -> None:
    """Token arrays as 16-bit little-endian bytes, in a binary column (vocabularies of up to 65,536 ids)."""
    ship(tokens.sparkSession)
    at = tokens.columns.index(ids)
    schema = T.StructType([T.StructField(ids, T.BinaryType()) if k == at else f for k, f in enumerate(tokens.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [None if x is None else x.drop_null().to_numpy().astype("<u2").tobytes() for x in (v.values for v in b.column(at))]
            columns = [pa.array(rows, pa.binary()) if k == at else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    tokens.mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: str = "ids") -> DataFrame:
    """What write_tokens wrote, as arrays of int again."""
    ship(spark)
    return spark.read.parquet(path).withColumn(ids, token_ids(ids))


def prompts(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines -> prompt, candidates (after a bar, parted by commas); blank lines and notes (#) are left out."""
    kept = lines.filter((F.trim(value) != "") & ~F.trim(value).startswith("#"))
    names = F.filter(F.transform(F.split(F.split_part(value, F.lit("|"), F.lit(2)), ","), lambda x: F.trim(x)), lambda x: x != "")
    return kept.select(F.trim(F.split_part(value, F.lit("|"), F.lit(1))).alias("prompt"), names.alias("candidates"))


def ingest(
    docs: DataFrame, source: str, lang: str, text_key: str = "text", url_key: str | None = None, min_chars: int = 200,
    max_docs: int | None = None
) -> DataFrame:
    """A public dataset's rows as documents: long enough texts, at most max_docs of them, marked as downloaded."""
    out = docs.select(
        F.col(text_key).alias("text"), F.lit(lang).alias("lang"), F.lit(source).alias("source"),
        F.lit("downloaded").alias("source_type"), (F.col(url_key) if url_key else F.lit(None).cast("string")).alias("url")
    )
    out = out.filter(F.length("text") >= min_chars).withColumn("doc_id", F.substring(F.md5("text"), 1, 16))
    return out.limit(max_docs) if max_docs else out
