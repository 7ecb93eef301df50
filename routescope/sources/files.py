"""Corpus files, manifest, configuration, results and materialised representations."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.functions.vectors import finite

MANIFEST = "kind string, ordinal int, text_id string, filename string"


def read_corpus(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus.jsonl, queries.jsonl and qrels/{split}.tsv -> corpus, queries that occur in the split, judgements."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{root}/corpus.jsonl").withColumnRenamed("_id", "doc_id")
    queries = spark.read.schema("_id string, text string").json(f"{root}/queries.jsonl").withColumnRenamed("_id", "query_id")
    qrels = spark.read.csv(f"{root}/qrels/{split}.tsv", sep="\t", header=True, schema="query_id string, doc_id string, rel int")
    return corpus, queries.join(qrels, "query_id", "left_semi"), qrels


def write_manifest(records: DataFrame, folder: str) -> None:
    records.select("kind", "ordinal", "text_id", "filename").write.mode("overwrite").csv(folder, header=True)


def read_manifest(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    df = spark.read.csv(folder, header=True, schema=MANIFEST)
    return df if kind is None else df.where(F.col("kind") == kind)


def pass_rows(manifest: DataFrame, root: str, pass_name: str, kind: str) -> DataFrame:
    """The manifest's rows of a kind with the path of their output in a pass."""
    return manifest.where(F.col("kind") == kind).withColumn("path", F.concat_ws("/", F.lit(f"{root}/embeddings/{pass_name}"), "filename"))


def write_json(path: str, value: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True))


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def write_results(df: DataFrame, folder: str) -> None:
    """The results table as one CSV file; one row per method and pass."""
    df.coalesce(1).write.mode("overwrite").csv(folder, header=True)


def write_report(df: DataFrame, column: str, folder: str) -> None:
    """A text report: one line per row."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(folder)


def representation_key(settings: dict, data: dict) -> str:
    """Name of a materialised representation: the settings that made it and a fingerprint of the rows it was made from."""
    return hashlib.sha1(json.dumps({"settings": settings, "data": data}, sort_keys=True).encode()).hexdigest()[:16]


def materialised(spark: SparkSession, root: str, key: str, build, rebuild: bool = False) -> DataFrame:
    """Read-through store: the representation under ``key``, built and written if it is missing or to be rebuilt. Every
    vector that comes out of the store is checked: a null, NaN or infinity in one is an error."""
    path = f"{root}/representations/{key}"
    if rebuild or not _committed(spark, path):
        build().write.mode("overwrite").parquet(path)
        spark.range(1).write.mode("overwrite").parquet(f"{path}.done")
    found = spark.read.parquet(path)
    vectors = [c for c, t in found.dtypes if t in ("array<double>", "array<float>")]
    wrong = F.raise_error(F.lit(f"non-finite values in the stored representation {key}"))
    return found.select(*[F.when(finite(F.col(c)), F.col(c)).otherwise(wrong).alias(c) if c in vectors else c for c in found.columns])


def _committed(spark: SparkSession, path: str) -> bool:
    """Whether the table beside this mark is whole: the mark is written after it. Any file system Spark reads from."""
    try:
        return not spark.read.parquet(f"{path}.done").isEmpty()
    except AnalysisException:
        return False


def write_text(path: str, lines: list[str]) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
