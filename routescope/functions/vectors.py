"""Vector kernels on array columns, all inside the JVM.

A scalar used inside a lambda is bound once per row through a one-element array; written inline, the optimiser
would copy the expression into the lambda and evaluate it for every element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-10


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), use)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """v over its length, or over EPS where it is shorter: a zero vector stays zero."""
    return bind(F.greatest(norm(v), F.lit(EPS)), lambda n: F.transform(v, lambda x: x / n))


def softmax(v: Column) -> Column:
    return bind(F.array_max(v), lambda m: bind(F.transform(v, lambda x: F.exp(x - m)), lambda e: bind(total(e), lambda s: F.transform(e, lambda x: x / s))))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def finite(v: Column) -> Column:
    """Whether a float array is there and holds no null, NaN or infinity."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def collect_vector(df: DataFrame, keys: Sequence[str], dim: str, value: str, name: str, *more: Column) -> DataFrame:
    """Rows (keys, dim, value) -> one array per key in the order of dim; a vector's length bounds the group."""
    items = F.array_sort(F.collect_list(F.struct(F.col(dim).alias("d"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(items, lambda s: s["v"]).alias(name), *more)


def mean_vector(df: DataFrame, keys: Sequence[str], vec: str, name: str = "vec", weight: Column | None = None) -> DataFrame:
    """Element-wise (weighted) mean per key, and the number of rows. Partial sums are formed before the shuffle,
    so a key with very many rows sends one row per task and dimension."""
    w = F.lit(1.0) if weight is None else weight
    long = df.select(*keys, w.alias("__w"), F.posexplode(vec).alias("__d", "__x"))
    means = long.groupBy(*keys, "__d").agg(F.sum(F.col("__w") * F.col("__x")).alias("__s"), F.sum("__w").alias("__t"), F.count("*").alias("count"))
    means = means.withColumn("__m", F.col("__s") / F.greatest(F.col("__t"), F.lit(EPS)))
    return collect_vector(means, keys, "__d", "__m", name, F.max("count").alias("count"))


def long_form(df: DataFrame, keys: Sequence[str], vec: str = "vec", digits: int = 6) -> DataFrame:
    """One row per dimension, rounded; what the SQL checks compare."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "__x")).withColumn("value", F.round("__x", digits) + 0.0).drop("__x")
