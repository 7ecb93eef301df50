"""Ranking metrics with the textbook definitions: linear gain, log2 discount, ideal over all judged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, judged: DataFrame, cuts: tuple[int, ...] = (10, 100)) -> DataFrame:
    """nDCG and recall at the cuts for every judged query that has results.

    ranked: groups (method, pass_name where there), query_id, doc_id, rank; judged: query_id, doc_id, rel. Unjudged
    documents and judgements of 0 or less gain nothing; a query without a positive judgement is left out.
    """
    groups = [c for c in ("method", "pass_name") if c in ranked.columns]
    good = judged.where("rel > 0").select("query_id", "doc_id", "rel")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))
    best = good.withColumn("at", order)
    gain = lambda r, at: r / F.log2(at + 1)
    ideal = best.groupBy("query_id").agg(F.count("*").alias("relevant"), *[F.sum(F.when(F.col("at") <= k, gain(F.col("rel"), F.col("at"))).otherwise(0.0)).alias(f"ideal_{k}") for k in cuts])
    hit = ranked.join(good, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    sums = [F.sum(F.when(F.col("rank") <= k, gain(F.col("rel"), F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}") for k in cuts]
    found = [F.sum(F.when((F.col("rank") <= k) & (F.col("rel") > 0), 1).otherwise(0)).alias(f"hits_{k}") for k in cuts]
    precise = F.sum(F.when(F.col("rel") > 0, 1.0 / F.col("rank") * F.col("so_far")).otherwise(0.0)).alias("precisions")
    running = F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).over(Window.partitionBy(*groups, "query_id").orderBy("rank"))
    per = hit.withColumn("so_far", running).groupBy(*groups, "query_id").agg(*sums, *found, precise)
    met = per.join(ideal, "query_id")
    out = [(F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).alias(f"ndcg_{k}") for k in cuts] + [(F.col(f"hits_{k}") / F.col("relevant")).alias(f"recall_{k}") for k in cuts] + [(F.col(f"hits_{k}") / F.lit(k)).alias(f"precision_{k}") for k in cuts]
    return met.select(*groups, "query_id", *out, (F.col("precisions") / F.col("relevant")).alias("average_precision"))


def per_query_binary(ranked: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """nDCG and recall where documents are relevant or not. ranked: query_id, rank, rel (0 or 1) and relevant, the number of
    relevant documents there are, so no list of judgements is needed; queries without one are left out."""
    discount = lambda at: 1.0 / F.log2(at + 1)
    found = [F.sum(F.when((F.col("rank") <= k) & (F.col("rel") > 0), discount(F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}") for k in cuts]
    hits = [F.sum(F.when((F.col("rank") <= k) & (F.col("rel") > 0), 1).otherwise(0)).alias(f"hits_{k}") for k in cuts]
    per = ranked.where("relevant > 0").groupBy("query_id", "relevant").agg(*found, *hits)
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + discount(i))
    return per.select("query_id", *[(F.col(f"dcg_{k}") / ideal(k)).alias(f"ndcg_{k}") for k in cuts], *[(F.col(f"hits_{k}") / F.col("relevant")).alias(f"recall_{k}") for k in cuts])


def summary(queries: DataFrame, names: list[str]) -> DataFrame:
    """Means over the queries, rounded."""
    groups = [c for c in ("method", "pass_name") if c in queries.columns]
    return queries.groupBy(*groups).agg(F.count("*").alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names])
