"""Incremental extraction as a stream: newly delivered records become work for every pass, each once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from routescope.operators.records import prompt
from routescope.sources.tables import latest

RECORD = "kind string, ordinal int, text_id string, text string, filename string, created_at timestamp_ntz, loaded_at timestamp_ntz"


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records as they are delivered to ``folder`` (Parquet)."""
    return spark.readStream.schema(RECORD).parquet(folder)


def plan_rows(records: DataFrame, passes: tuple[str, ...]) -> DataFrame:
    """One row of work per record and pass: text_id, pass_name, path, prompt."""
    work = records.withColumn("pass_name", F.explode(F.array(*[F.lit(p) for p in passes])))
    return work.select("text_id", "pass_name", F.concat_ws("/", F.lit("embeddings"), "pass_name", "filename").alias("path"), prompt(F.col("kind"), F.col("text")).alias("prompt"))


def run_available(records: DataFrame, passes: tuple[str, ...], out: str, checkpoint: str) -> StreamingQuery:
    """Plan what has been delivered so far and stop; the next call goes on from there.

    A text is planned once, with the first delivery that has a text, however late it comes: a null text waits, and what
    the written plan already holds is left out. Each batch replaces its own directory, so a batch that is run again
    after a failure leaves no second copy.
    """

    def plan(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch.where("text is not null"), ["text_id"], ["loaded_at"])
        try:
            known = spark.read.parquet(out).where(F.col("batch") < number).select("text_id").distinct()
            fresh = fresh.join(known, "text_id", "left_anti")
        except AnalysisException:
            pass  # nothing planned yet
        plan_rows(fresh, passes).write.mode("overwrite").partitionBy("pass_name").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
