"""Choice of layers by intrinsic dimension (two nearest neighbours)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_AT_ONCE = 64


def _two_nearest(group: pa.Table) -> pa.Table:
    """Distances to the two nearest other vectors of one layer, at least 1e-10; k is how many there are."""
    group = group.combine_chunks()
    n = group.num_rows
    x = group.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    near = np.full((n, 2), np.nan)
    k = min(2, n - 1)
    for at in range(0, n if k else 0, ROWS_AT_ONCE):
        part = x[at : at + ROWS_AT_ONCE]
        d = np.sqrt(((part[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        d[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
        near[at : at + len(part), :k] = np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)
    near = np.maximum(near, 1e-10)
    names = ["layer", "a", "r1", "r2", "k"]
    return pa.table([group.column("layer").cast(pa.int32()), group.column("text_id"), pa.array(near[:, 0]), pa.array(near[:, 1]), pa.array(np.full(n, k), pa.int32())], names=names)

def two_nn(features: DataFrame) -> DataFrame:
    """layer, text_id, vec -> layer, dimension, points: the slope through the origin of -ln(1 - rank / (n + 1)) on
    ln(second / first nearest distance). NaN below three usable points.

    The estimate is defined on a bounded sample of texts (the caller's), so a layer's vectors are one group of bounded
    size; its nearest distances are taken in one matrix pass over it.
    """
    two = features.select("layer", "text_id", "vec").groupBy("layer").applyInArrow(_two_nearest, f"layer int, a {dict(features.dtypes)['text_id']}, r1 double, r2 double, k int")
    mu = two.where("k = 2").withColumn("mu", F.col("r2") / F.col("r1")).where((F.col("mu") > 1 + 1e-6) & (F.col("mu") < float("inf")))
    by = Window.partitionBy("layer")
    placed = mu.withColumn("rank", F.row_number().over(by.orderBy("mu", "a"))).withColumn("n", F.count("*").over(by))
    x, y = F.log("mu"), -F.log(1 - F.col("rank") / (F.col("n") + 1))
    fit = placed.groupBy("layer").agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.count("*").alias("points"))
    slope = F.when((F.col("points") >= 3) & (F.col("xx") > 0), F.round(F.col("xy") / F.col("xx"), 6)).otherwise(float("nan"))
    all_layers = features.select("layer").distinct()
    return all_layers.join(fit.select("layer", slope.alias("dimension"), "points"), "layer", "left").select("layer", F.coalesce("dimension", F.lit(float("nan"))).alias("dimension"), F.coalesce("points", F.lit(0)).alias("points"))


@dataclass(frozen=True)
class Selection:
    global_layers: tuple[int, ...]
    attention_layers: tuple[int, ...]
    min_layer: int | None
    strategy: str


def select_layers(dimension: dict[int, float], attention: list[int], count: int) -> Selection:
    """The window of layers from the one of least dimension beyond the first fifth, and its attention layers.

    Works on one number per layer. Ties take the earlier layer. The window holds max(1, layers // 10) layers after the
    first. Without an attention layer in it, the best-scoring candidate attention layer and the next one are taken.
    """
    score = lambda i: dimension.get(i, math.nan)
    finite = [i for i in range(count) if math.isfinite(score(i))]
    candidates = [i for i in finite if i >= int(0.2 * count)] or finite
    if not candidates:
        return fallback_layers(attention, count, "no finite score")
    least = min(candidates, key=lambda i: (score(i), i))
    chosen = [i for i in range(least, min(count - 1, least + max(1, count // 10)) + 1)]
    kept = [i for i in chosen if i in attention]
    if not kept:
        pool = [i for i in candidates if i in attention] or list(attention)
        if not pool:
            return Selection(tuple(chosen), (), least, "min dimension window")
        first = min(pool, key=lambda i: (score(i) if math.isfinite(score(i)) else math.inf, i))
        later = [i for i in pool if i > first]
        kept = [first, *later[:1]]
    return Selection(tuple(chosen), tuple(kept), least, "min dimension window")


def fallback_layers(attention: list[int], count: int, reason: str) -> Selection:
    """The second half of the attention layers, or the last one."""
    kept = attention[len(attention) // 2 :] or attention[-1:]
    return Selection(tuple(kept), tuple(kept), None, f"fallback: {reason}")
