"""Records, prompts and the planning of incremental extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routescope.functions.text import strip
from routescope.session import cut_lineage


def numbered(df: DataFrame, order: Sequence[Column], name: str, within: Sequence[str] = ()) -> DataFrame:
    """Rows with their place (from 1) in the order given, per ``within`` - without sorting a group in one task.

    Rows are range-partitioned by the order; each range numbers its own rows, and the ranges' counts, one row per
    range, give the offsets. Written down once, since range borders come from a sample.
    """
    cols = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    names = [*within, *[f"__o{i}" for i in range(len(order))]]
    placed = df.select("*", *cols).repartitionByRange(*names).withColumn("__part", F.spark_partition_id())
    w = Window.partitionBy(*within, "__part").orderBy(*[F.col(n).asc_nulls_last() for n in names[len(within) :]])
    placed = cut_lineage(placed.withColumn("__at", F.row_number().over(w)))
    sizes = placed.groupBy(*within, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    out = placed.join(offsets, [*within, "__part"])
    return out.withColumn(name, (F.col("__base") + F.col("__at")).cast("int")).drop("__part", "__at", "__base", *names[len(within) :])


def document_text(title: Column, body: Column) -> Column:
    """strip(strip(title) + ". " + strip(body)); a missing part is empty."""
    part = lambda c: strip(F.coalesce(c, F.lit("")))
    return strip(F.concat(part(title), F.lit(". "), part(body)))


def filename(kind: Column, ordinal: Column) -> Column:
    """doc_0000001.npz, query_000001.npz; any other kind is an error."""
    return F.when(kind == "doc", F.format_string("doc_%07d.npz", ordinal)).when(kind == "query", F.format_string("query_%06d.npz", ordinal)).otherwise(F.raise_error(F.concat(F.lit("unknown record kind: "), F.coalesce(kind, F.lit("null")))))


def limited(records: DataFrame, docs: int | None, queries: int | None) -> DataFrame:
    """The first so many records per kind by their ordinals; None keeps all, 0 none, a negative number all but the last."""

    def keep(kind: str, limit: int | None) -> Column:
        mine = F.col("kind") == kind
        if limit is None:
            return mine
        if limit >= 0:
            return mine & (F.col("ordinal") <= limit)
        return mine & (F.col("ordinal") <= F.col(f"__{kind}") + limit)

    if any(x is not None and x < 0 for x in (docs, queries)):
        top = records.agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("ordinal"))), F.lit(0)).alias(f"__{k}") for k in ("doc", "query")]).withColumn("__one", F.lit(1))
        records = records.withColumn("__one", F.lit(1)).join(F.broadcast(top), "__one").drop("__one")
    return records.where(keep("doc", docs) | keep("query", queries)).drop("__doc", "__query")


def prompt(kind: Column, text: Column) -> Column:
    label = F.when(kind == "doc", "Context").otherwise("Query")
    return F.concat(label, F.lit(": "), text, F.lit("\nCompress the "), label, F.lit(" in one word:"))


def batch_status(records: DataFrame, done: DataFrame, passes: int) -> DataFrame:
    """skip where every pass has an output, reset where some have, new where none has; and each record's place among all,
    documents first. done: text_id, pass_name."""
    records = numbered(records, [F.when(F.col("kind") == "doc", 0).otherwise(1), F.col("ordinal")], "position")
    have = done.select("text_id", "pass_name").distinct().groupBy("text_id").agg(F.count("*").alias("outputs"))
    met = records.join(have, "text_id", "left").withColumn("outputs", F.coalesce("outputs", F.lit(0)))
    return met.withColumn("status", F.when(F.col("outputs") >= passes, "skip").when(F.col("outputs") > 0, "reset").otherwise("new"))


def partial_outputs(status: DataFrame, done: DataFrame) -> DataFrame:
    """The outputs of records to be reset, to be deleted before these are processed again."""
    return done.join(status.where("status = 'reset'").select("text_id"), "text_id", "left_semi")


def query_batches(pending: DataFrame, size: int) -> DataFrame:
    """pending: kind, ordinal, ... -> batch: documents alone, queries in batches of ``size`` in the order of their ordinals."""
    at = numbered(pending, [F.col("ordinal")], "place", within=["kind"])
    group = F.when(F.col("kind") == "query", F.floor((F.col("place") - 1) / max(size, 1))).otherwise(F.col("place") - 1)
    return at.withColumn("batch", group.cast("int")).drop("place")
