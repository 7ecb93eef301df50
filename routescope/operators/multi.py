"""Builders of several vectors per text: pass_name, text_id, vec_no, vec."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routescope.session import cut_lineage

TEXT = ["pass_name", "text_id"]


def pool_vectors(pool: DataFrame, chosen: Sequence[int], min_count: int, dim: int) -> DataFrame:
    """The pool vectors with at least ``min_count`` tokens; a text without any takes those with one token or more;
    a text without those gets one zero vector."""
    some = pool.where(F.col("layer").isin(*chosen)).withColumn("most", F.max("count").over(Window.partitionBy(*TEXT)))
    kept = some.where(F.col("count") >= F.when(F.col("most") >= min_count, min_count).otherwise(1))
    number = F.row_number().over(Window.partitionBy(*TEXT).orderBy("layer", "slot")) - 1
    kept = kept.withColumn("vec_no", number).select(*TEXT, "vec_no", "vec")
    none = pool.select(*TEXT).distinct().join(kept.select(*TEXT).distinct(), TEXT, "left_anti")
    return kept.unionByName(none.select(*TEXT, F.lit(0).alias("vec_no"), F.array_repeat(F.lit(0.0), dim).alias("vec")))


def offsets(multi: DataFrame) -> DataFrame:
    """Number of vectors of each text and where they start when texts are laid end to end in the order of their id.

    The prefix sum is taken in two levels - within ranges of texts and over the ranges - so no single task orders all texts.
    """
    counts = multi.groupBy(*TEXT).agg(F.count("*").alias("vectors"))
    spread = counts.repartitionByRange("pass_name", "text_id").withColumn("part", F.spark_partition_id())
    inner = F.sum("vectors").over(Window.partitionBy("pass_name", "part").orderBy("text_id")) - F.col("vectors")
    # Read twice below: the range borders are sampled, so the numbering is written down once.
    spread = cut_lineage(spread.withColumn("inner", inner))
    parts = spread.groupBy("pass_name", "part").agg(F.sum("vectors").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("pass_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread.join(parts.withColumn("base", base), ["pass_name", "part"]).select(*TEXT, F.col("vectors").cast("bigint").alias("vectors"), (F.col("base") + F.col("inner")).cast("bigint").alias("start"))
