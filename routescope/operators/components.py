"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routescope.session import cut_lineage


def _rewire(edges: DataFrame, nearest_only: bool) -> DataFrame:
    """edges: u, v. large-star links each larger neighbour, small-star each smaller one, to the least around u."""
    if nearest_only:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # min is combined map-side; a node with very many edges meets one row here and is split by the skew join.
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = near.join(least, "u")
    if nearest_only:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """edges (u, v), undirected -> (id, label) for every node with an edge; label is the component's least id.

    Loops and rows with a null end are ignored, repeated edges count once; no edges give no rows. Each step is
    written to the shared checkpoint folder; only a row count and a checksum come to the driver.
    """
    state = cut_lineage(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    before = None
    for _ in range(max_steps):
        state = cut_lineage(_rewire(_rewire(state, False), True))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return state.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(state.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {max_steps} steps")
