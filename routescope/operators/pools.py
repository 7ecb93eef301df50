"""Aggregations over token signals: per-expert pools and means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routescope.functions.vectors import bind, mean_vector

KEYS = ["pass_name", "text_id", "layer"]


def scale(v: Column, by: Column) -> Column:
    return bind(by, lambda s: F.transform(v, lambda x: x * s))


def own_output(h: Column, expert: Column, experts: int) -> Column:
    return scale(h, 1.0 + expert / F.lit(float(experts)))


def combined_output(routing: DataFrame, top_k: int, experts: int) -> DataFrame:
    """Per token: the sum over its routed experts of weight x own output."""
    routed = routing.where(F.col("slot") < top_k)
    factor = F.sum(F.col("weight") * (1.0 + F.col("expert") / F.lit(float(experts)))).alias("f")
    per = routed.groupBy(*KEYS, "tok").agg(factor, F.first("h").alias("h"))
    return per.select(*KEYS, "tok", scale(F.col("h"), F.col("f")).alias("vec"))


def expert_pool(routing: DataFrame, values: DataFrame, shared: DataFrame, top_k: int, last: int, dim: int) -> DataFrame:
    """For each expert of the last token (slot): the mean of ``values`` over the tokens routed to it, and the count.

    ``values``: KEYS, tok, expert (or none: the same vector whatever the expert), vec; ``shared``: KEYS, tok, vec, pooled
    over all tokens into slot ``top_k``. A slot nothing was routed to has count 0 and a zero vector of ``dim``.
    """
    routed = routing.where(F.col("slot") < top_k)
    slots = routed.where(F.col("tok") == last).select(*KEYS, "slot", "expert")
    hits = slots.join(routed.select(*KEYS, "expert", "tok"), [*KEYS, "expert"])
    on = [*KEYS, "tok", "expert"] if "expert" in values.columns else [*KEYS, "tok"]
    pooled = mean_vector(hits.join(values, on), [*KEYS, "slot"], "vec")
    pooled = slots.select(*KEYS, "slot").join(pooled, [*KEYS, "slot"], "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)))
    whole = mean_vector(shared, KEYS, "vec").select(*KEYS, F.lit(top_k).alias("slot"), "vec", "count")
    return pooled.select(*KEYS, "slot", "vec", "count").unionByName(whole)
