"""Readers of the signal tables and the rule for which delivery of a row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PASS_ALL = "rerouted"
PASS_PAPER = "paper_rerouted"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` columns (nulls last).

    Rows with a null key are dropped: they name nothing. Ties on every order column (redelivered rows)
    are broken by a hash of the whole row, so any engine run keeps the same one. The rank filter plans as a
    group limit before the shuffle, so a key holding a large share of all rows sends one row per task.
    """
    tie = F.xxhash64(*[df[c] for c in df.columns])
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order], tie)
    df = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def payload_rows(spark: SparkSession, folder: str, pass_name: str | None, columns: Sequence[str]) -> DataFrame:
    """Payload rows of one pass (all passes if None) with only the columns asked for; every attempt."""
    df = table(spark, folder, "payloads")
    if pass_name is not None:
        df = df.where(F.col("pass_name") == pass_name)
    keys = [] if pass_name is not None else ["pass_name"]
    return df.select(*keys, "text_id", "written_at", "loaded_at", *columns)


def current(df: DataFrame) -> DataFrame:
    """The latest written attempt per text (and pass, if that column is there)."""
    keys = [c for c in ("pass_name", "text_id") if c in df.columns]
    return latest(df, keys, ["written_at", "loaded_at"])
