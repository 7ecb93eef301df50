"""Queries over the captured payloads: representations, retrieval quality and the comparison of the two passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.functions.vectors import doubles, finite, long_form, norm, unit
from routescope.operators import dense as D
from routescope.operators import layers as L
from routescope.operators import metrics as E
from routescope.operators import routing as A
from routescope.operators import scoring as S
from routescope.plans.records import current_judgements, current_records
from routescope.session import cut_lineage
from routescope.sources.tables import PASS_ALL, PASS_PAPER, current, payload_rows, table

TEXT = ["pass_name", "text_id"]
EXPERTS, SLOTS = 128, 8
TOP = 100


def _usable(df: DataFrame) -> DataFrame:
    """Rows whose vector is there and finite; the others are listed by finite_violations."""
    return df.where(finite(F.col("vec")) & (F.size("vec") > 0))


def _last_layer(field: str) -> Callable[[SparkSession, str], DataFrame]:
    def make(spark: SparkSession, folder: str) -> DataFrame:
        rows = current(payload_rows(spark, folder, None, [F.try_element_at(field, F.lit(-1)).alias("vec")]))
        return _usable(rows).select(*TEXT, doubles(F.col("vec")).alias("vec"))

    return make


_last, _mean = _last_layer("hs_last_token"), _last_layer("hs_mean")


def _moee(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(payload_rows(spark, folder, None, [F.flatten("routing_full_last").alias("vec")]))
    return _usable(rows).select(*TEXT, doubles(F.col("vec")).alias("vec"))


def _sparse(spark: SparkSession, folder: str) -> DataFrame:
    return A.last_token_weights(current(payload_rows(spark, folder, None, ["routing_indices", "routing_weights"])), EXPERTS, SLOTS)


DENSE = {"KV-Embedding": lambda s, f: D.hybrid(_last(s, f), _mean(s, f)), "LastToken-HS": _last, "MeanPool-HS": _mean, "MoEE": _moee}


#: Methods whose vectors travel together, each a weighted sum of columns of one scan.
FAMILIES = [{"KV-Embedding": {"last": 0.5, "mean": 0.5}, "LastToken-HS": {"last": 1.0}, "MeanPool-HS": {"mean": 1.0}}, {"MoEE": {"moee": 1.0}}]


def _normal(df: DataFrame) -> DataFrame:
    return df.withColumn("vec", unit(F.col("vec")))


def _dense_query(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: long_form(_normal(DENSE[method](spark, folder)), TEXT)


def sparse_moee(spark: SparkSession, folder: str) -> DataFrame:
    rows = _sparse(spark, folder)
    length = rows.groupBy(*TEXT).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    return rows.join(length, TEXT).select(*TEXT, "dim", (F.round(F.col("w") / F.greatest("n", F.lit(1e-10)), 6) + 0.0).alias("value"))


def _side(df: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    return df.join(records.where(F.col("kind") == kind).select("text_id"), "text_id", "left_semi")


def eval_dense(spark: SparkSession, folder: str) -> DataFrame:
    """nDCG and recall of four single-vector methods in both passes, queries against all documents, on the judgements."""
    judged = current_judgements(spark, folder)
    wanted = judged.where("rel > 0").groupBy(F.col("query_id").alias("text_id")).agg(F.collect_list("doc_id").alias("wanted"))
    kinds = current_records(spark, folder).select("text_id", "kind").join(wanted, "text_id", "left")
    # a query without a positive judgement has no metrics
    kinds = cut_lineage(kinds.where("kind = 'doc' or kind = 'query' and wanted is not null").select("text_id", F.when(F.col("kind") == "query", F.col("wanted")).alias("wanted")))
    passes = sorted(r["pass_name"] for r in payload_rows(spark, folder, None, []).select("pass_name").where("pass_name is not null").distinct().collect())  # one row per pass
    cols = [F.try_element_at("hs_last_token", F.lit(-1)).alias("last"), F.try_element_at("hs_mean", F.lit(-1)).alias("mean"), F.flatten("routing_full_last").alias("moee")]
    rows = current(payload_rows(spark, folder, None, cols)).select(*TEXT, "last", "mean", "moee")
    # joined on the keys of the latest attempts, so the vectors are not shuffled again
    each = kinds.withColumn("pass_name", F.explode(F.array(*[F.lit(p) for p in passes]).cast("array<string>")))
    ranked = S.judged_ranks(rows.join(each, TEXT), passes, FAMILIES, kinds.where("wanted is not null").count(), TOP)
    return E.summary(E.per_query(cut_lineage(ranked), judged), ["ndcg_10", "ndcg_100", "recall_10", "recall_100"])


def map_precision(spark: SparkSession, folder: str) -> DataFrame:
    """Average precision and precision of MeanPool-HS per query."""
    rep = cut_lineage(_normal(_mean(spark, folder)))
    kinds = current_records(spark, folder).select("text_id", "kind")
    ranked = cut_lineage(S.best(S.dense_scores(_side(rep, kinds, "query"), _side(rep, kinds, "doc"), TOP), TOP))
    per = E.per_query(ranked, current_judgements(spark, folder))
    return per.select("pass_name", "query_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("average_precision", "precision_10", "precision_100")])


# routing of the two passes ---------------------------------------------------------------------------------------

def _compared(spark: SparkSession, folder: str) -> DataFrame:
    first, second = (current(payload_rows(spark, folder, p, ["routing_indices", "routing_weights", "routing_full_last"])) for p in (PASS_ALL, PASS_PAPER))
    return A.compare_passes(first, second, EXPERTS, SLOTS)


def kl_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return A.tokens_of(_compared(spark, folder), "kl").select("text_id", "layer", "tok", (F.round("kl", 6) + 0.0).alias("kl"))


def kl_layers(spark: SparkSession, folder: str) -> DataFrame:
    return A.layer_means(_compared(spark, folder), "kl").select("layer", (F.round("kl", 6) + 0.0).alias("kl"), "texts")


def top1_changed(spark: SparkSession, folder: str) -> DataFrame:
    return A.layer_means(_compared(spark, folder), "top1").select("layer", F.round("top1", 6).alias("top1"), "texts")


def topk_changed(spark: SparkSession, folder: str) -> DataFrame:
    return A.layer_means(_compared(spark, folder), "topk").select("layer", F.round("topk", 6).alias("topk"), "texts")


def layerwise_table(spark: SparkSession, folder: str) -> DataFrame:
    """The plotted table: per layer its type, mean divergence and shares of changed experts."""
    c = cut_lineage(_compared(spark, folder))
    out = table(spark, folder, "layers").select("layer", "layer_type")
    for value in ("kl", "top1", "topk"):
        out = out.join(A.layer_means(c, value).select("layer", value), "layer")
    return out.select("layer", "layer_type", *[(F.round(x, 6) + 0.0).alias(x) for x in ("kl", "top1", "topk")])


def _active(spark: SparkSession, folder: str) -> DataFrame:
    rows = current(payload_rows(spark, folder, PASS_PAPER, [F.transform("routing_indices", lambda t: F.array_distinct(F.flatten(F.transform(t, lambda x: F.slice(x, 1, SLOTS))))).alias("active")]))
    layers = rows.select("text_id", F.posexplode("active").alias("layer", "e")).select("text_id", "layer", F.explode("e").alias("expert"))
    return layers.where(f"expert between 0 and {EXPERTS - 1}").select("text_id", "layer", F.col("expert").cast("int").alias("expert")).distinct()


def active_experts(spark: SparkSession, folder: str) -> DataFrame:
    return _active(spark, folder)


def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return A.jaccard_pairs(_active(spark, folder), digits=6)  # rounded in the kernel: in the JVM it would go by decimals


def jaccard_relevance(spark: SparkSession, folder: str) -> DataFrame:
    docs = current_records(spark, folder).where("kind = 'doc'").select("text_id")
    active = _active(spark, folder).join(docs, "text_id", "left_semi")
    judged = table(spark, folder, "qrels").select("query_id", "doc_id").where("query_id is not null and doc_id is not null")
    return A.relevance_split(active, judged)


def coactivation_report(spark: SparkSession, folder: str) -> DataFrame:
    """The text report of co-activation: line, value."""
    return A.coactivation_lines(jaccard_relevance(spark, folder))


def delta_report(spark: SparkSession, folder: str) -> DataFrame:
    """The text report of divergent tokens: line, value; ids stand for tokens, as no tokenizer belongs to the data."""
    return A.example_lines(kl_examples(spark, folder))


def kl_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the greatest divergence of ten sampled texts, with five tokens on either side."""
    per = cut_lineage(A.tokens_of(_compared(spark, folder), "kl"))
    both = per.select("text_id").distinct()
    rows = current(payload_rows(spark, folder, PASS_ALL, ["token_ids"])).join(both, "text_id", "left_semi")
    tokens = rows.select("text_id", F.posexplode("token_ids").alias("tok", "token_id"))
    return A.divergence_examples(per, cut_lineage(tokens))


# layers ----------------------------------------------------------------------------------------------------------

def _features(spark: SparkSession, folder: str, sample: int = 1000) -> DataFrame:
    """layer, text_id, vec of the first ``sample`` documents in the order of the records (a stated bound of the method)."""
    first = current_records(spark, folder).where(F.col("ordinal") <= sample)
    docs = first.where("kind = 'doc'").select("text_id")
    if docs.isEmpty():  # then the first records of any kind, which are queries
        docs = first.select("text_id")
        if docs.isEmpty():
            raise ValueError("no records to sample layers from")
    rows = current(payload_rows(spark, folder, PASS_ALL, ["hs_last_token"])).join(docs, "text_id", "left_semi")
    layers = rows.select("text_id", F.posexplode("hs_last_token").alias("layer", "vec"))
    return _usable(layers).select("layer", "text_id", doubles(F.col("vec")).alias("vec"))


def twonn_by_layer(spark: SparkSession, folder: str) -> DataFrame:
    return L.two_nn(cut_lineage(_features(spark, folder))).withColumn("points", F.col("points").cast("bigint"))


def _selection_frame(spark: SparkSession, s: L.Selection) -> DataFrame:
    rows = [(i, i in s.global_layers, i in s.attention_layers, s.strategy) for i in sorted({*s.global_layers, *s.attention_layers})]
    return spark.createDataFrame(rows, "layer int, in_window boolean, selected boolean, strategy string")


def _attention_layers(spark: SparkSession, folder: str) -> tuple[list[int], int]:
    rows = table(spark, folder, "layers").orderBy("layer").collect()  # one row per layer of the model
    return [r["layer"] for r in rows if r["layer_type"] == "full_attention"], len(rows)


def layer_selection(spark: SparkSession, folder: str) -> DataFrame:
    attention, count = _attention_layers(spark, folder)
    dimension = {r["layer"]: r["dimension"] for r in twonn_by_layer(spark, folder).collect()}  # one row per layer
    return _selection_frame(spark, L.select_layers(dimension, attention, count))


def layer_fallback(spark: SparkSession, folder: str) -> DataFrame:
    attention, count = _attention_layers(spark, folder)
    return _selection_frame(spark, L.fallback_layers(attention, count, "too few samples"))


def embedding_search(spark: SparkSession, folder: str) -> DataFrame:
    """Top 10 by cosine for every vector whose id is divisible by 50, against all others, with each query's nDCG@10 and
    Recall@10 where vectors of the same label are relevant."""
    e = table(spark, folder, "embeddings").select("vec_id", F.col("label"), doubles(F.col("embedding")).alias("vec")).where("vec_id is not null")
    e = _usable(e).where(norm(F.col("vec")) > 0)
    rep = cut_lineage(_normal(e).select(F.lit("all").alias("pass_name"), F.col("vec_id").alias("text_id"), "vec", "label"))
    q = rep.where("text_id % 50 = 0")
    scores = S.dense_scores(q.select("pass_name", "text_id", "vec"), rep.select("pass_name", "text_id", "vec"), 11).where("query_id <> doc_id")
    ranked = cut_lineage(S.best(scores, 10))
    # One count per label instead of a row per query and relevant vector; labels are compared at the ranked rows.
    of_label = rep.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    relevant = q.join(of_label, "label").select(F.col("text_id").alias("query_id"), "relevant", F.col("label").alias("mine"))
    found = rep.select(F.col("text_id").alias("doc_id"), "label")
    graded = ranked.join(relevant, "query_id").join(found, "doc_id").withColumn("rel", (F.col("label") == F.col("mine")).cast("int"))
    per = E.per_query_binary(graded, (10,)).select("query_id", (F.round("ndcg_10", 6) + 0.0).alias("ndcg_10"), (F.round("recall_10", 6) + 0.0).alias("recall_10"))
    return ranked.select("query_id", "doc_id", "rank", (F.round("score", 6) + 0.0).alias("score")).join(per, "query_id")


QUERIES = {f.__name__: f for f in (sparse_moee, eval_dense, map_precision, kl_tokens, kl_layers, top1_changed, topk_changed, layerwise_table, active_experts, jaccard_pairs, jaccard_relevance, coactivation_report, delta_report, kl_examples, twonn_by_layer, layer_selection, layer_fallback, embedding_search)}
QUERIES |= {n: _dense_query(m) for n, m in (("dense_last", "LastToken-HS"), ("dense_mean", "MeanPool-HS"), ("dense_hybrid", "KV-Embedding"), ("dense_moee", "MoEE"))}

# SQL -----------------------------------------------------------------------------------------------------------

_CUR = """with cur as (select * exclude (rk) from (select *, row_number() over (partition by pass_name, text_id order by written_at desc, loaded_at desc) as rk from payloads where text_id is not null and pass_name is not null) where rk = 1),
rec as (select * exclude (rk) from (select *, row_number() over (partition by text_id order by loaded_at desc) as rk from records where text_id is not null) where rk = 1),
jud as (select query_id, doc_id, rel from (select *, row_number() over (partition by query_id, doc_id order by judged_at desc nulls last, loaded_at desc nulls last, rel desc) as rk
  from qrels where rel is not null and query_id is not null and doc_id is not null) where rk = 1),
raw as (select 'LastToken-HS' as method, pass_name, text_id, cast(hs_last_token[-1] as double[]) as v from cur where hs_last_token is not null union all
  select 'MeanPool-HS', pass_name, text_id, cast(hs_mean[-1] as double[]) from cur where hs_mean is not null union all
  select 'MoEE', pass_name, text_id, cast(flatten(routing_full_last) as double[]) from cur where routing_full_last is not null),
okv as (select * from raw where len(v) > 0 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0),
hyb as (select 'KV-Embedding' as method, a.pass_name, a.text_id, list_transform(range(1, len(a.v) + 1), lambda i: 0.5 * (a.v[i] + b.v[i])) as v from okv a join okv b using (pass_name, text_id) where a.method = 'LastToken-HS' and b.method = 'MeanPool-HS'),
rep as (select * from okv union all select * from hyb),
nr as (select *, greatest(sqrt(list_dot_product(v, v)), 1e-10) as n from rep),
sl as (select pass_name, text_id, layer, unnest(ix) as ix, unnest(wt) as wt, generate_subscripts(ix, 1) - 1 as tok from (select pass_name, text_id, unnest(routing_indices) as ix, unnest(routing_weights) as wt, generate_subscripts(routing_indices, 1) - 1 as layer from cur where routing_indices is not null and routing_weights is not null)),
slots as (select * from (select pass_name, text_id, layer, tok, unnest(ix) as expert, unnest(wt)::double as weight, generate_subscripts(ix, 1) - 1 as slot from sl) where slot < 8 and expert between 0 and 127 and weight > 0 and not isnan(weight)),
lastp as (select pass_name, text_id, max(tok) as tok from slots group by all),
fl as (select pass_name, text_id, layer, tok, unnest(r)::double as p, generate_subscripts(r, 1) - 1 as expert from (select cur.pass_name, cur.text_id, unnest(routing_full_last) as r, generate_subscripts(routing_full_last, 1) - 1 as layer from cur where routing_full_last is not null) join lastp using (pass_name, text_id)
  where len(list_filter(r, lambda x: x is null or isnan(x) or isinf(x))) = 0),
dist as (select pass_name, text_id, layer, tok, expert, sum(weight) as p from slots where (pass_name, text_id, tok) not in (select (pass_name, text_id, tok) from fl) group by all
  union all select pass_name, text_id, layer, tok, expert, p from fl),
kl as (select p.text_id, p.layer, p.tok, sum(p.p * (ln(p.p + 1e-10) - ln(coalesce(q.p, 0) + 1e-10))) as kl from dist p left join dist q on q.pass_name = 'paper_rerouted' and p.text_id = q.text_id and p.layer = q.layer and p.tok = q.tok and p.expert = q.expert
  where p.pass_name = 'rerouted' and p.text_id in (select text_id from dist where pass_name = 'paper_rerouted') group by all),
chg as (select a.text_id, a.layer, a.tok, cast(a.top is distinct from b.top as int)::double as top1, cast(a.s <> b.s as int)::double as topk from
  (select pass_name, text_id, layer, tok, min(expert) filter (slot = 0) as top, list_sort(list(distinct expert)) as s from slots group by all) a join
  (select pass_name, text_id, layer, tok, min(expert) filter (slot = 0) as top, list_sort(list(distinct expert)) as s from slots group by all) b
  on a.pass_name = 'rerouted' and b.pass_name = 'paper_rerouted' and a.text_id = b.text_id and a.layer = b.layer and a.tok = b.tok),
act as (select distinct text_id, cast(layer as int) as layer, cast(e as int) as expert from (select text_id, layer, unnest(ix[1:8]) as e from (select text_id, layer, unnest(ix) as ix from (select text_id, unnest(routing_indices) as ix, generate_subscripts(routing_indices, 1) - 1 as layer from cur where pass_name = 'paper_rerouted'))) where e between 0 and 127),
"""
_END = "fin as (select 1) "
_RANKED = """sc as (select q.method, q.pass_name, q.text_id as query_id, d.text_id as doc_id, list_dot_product(q.v, d.v) / (q.n * d.n) as score from nr q join nr d using (method, pass_name)
  where q.text_id in (select text_id from rec where kind = 'query') and d.text_id in (select text_id from rec where kind = 'doc')),
rk as (select *, row_number() over (partition by method, pass_name, query_id order by round(score, 6) desc, doc_id) as rank from sc qualify rank <= 100),
good as (select *, row_number() over (partition by query_id order by rel desc, doc_id) as pos from jud where rel > 0),
idl as (select query_id, count(*) as n, sum(case when pos <= 10 then rel * ln(2) / ln(pos + 1) else 0 end) as i10, sum(case when pos <= 100 then rel * ln(2) / ln(pos + 1) else 0 end) as i100 from good group by 1),
hit as (select rk.*, coalesce(g.rel, 0) as rel, sum(case when g.rel > 0 then 1 else 0 end) over (partition by method, pass_name, rk.query_id order by rank) as so_far from rk left join good g on rk.query_id = g.query_id and rk.doc_id = g.doc_id),
per as (select method, pass_name, query_id, sum(case when rank <= 10 then rel * ln(2) / ln(rank + 1) else 0 end) as d10, sum(rel * ln(2) / ln(rank + 1)) as d100, count(*) filter (rank <= 10 and rel > 0) as h10, count(*) filter (rel > 0) as h100,
  sum(case when rel > 0 then so_far / rank::double else 0 end) as ap from hit group by all),
qm as (select method, pass_name, query_id, d10 / i10 as ndcg_10, d100 / i100 as ndcg_100, h10::double / n as recall_10, h100::double / n as recall_100, h10 / 10.0::double as precision_10, h100 / 100.0::double as precision_100, ap / n as average_precision from per join idl using (query_id)),
"""
_PAIR = """sz as (select text_id, count(*) as n from act group by 1),
jp as (select x.text_id as a, y.text_id as b, count(*) as c from act x join act y using (layer, expert) where x.text_id < y.text_id group by all),
jac as (select a, b, c / (p.n + q.n - c)::double as jaccard from jp join sz p on p.text_id = a join sz q on q.text_id = b),
"""


def _mean_sql(name: str, frm: str) -> str:
    return f"select layer, round(avg(v), 6) + 0 as {name}, count(*) as texts from (select text_id, cast(layer as int) as layer, avg({name}) as v from {frm} group by all) group by layer"


ORACLE = {n: _CUR + _END + f"select pass_name, text_id, cast(generate_subscripts(v, 1) - 1 as int) as dim, round(unnest(v) / n, 6) + 0 as value from nr where method = '{m}'" for n, m in (("dense_last", "LastToken-HS"), ("dense_mean", "MeanPool-HS"), ("dense_hybrid", "KV-Embedding"), ("dense_moee", "MoEE"))}
ORACLE |= {
    "sparse_moee": _CUR + """w as (select pass_name, text_id, cast(layer * 128 + expert as int) as dim, sum(weight) as w from slots join lastp using (pass_name, text_id, tok) group by all)
select pass_name, text_id, dim, round(w / greatest(sqrt(sum(w * w) over (partition by pass_name, text_id)), 1e-10), 6) + 0 as value from w""",
    "eval_dense": _CUR + _RANKED + _END + "select method, pass_name, count(*) as queries, round(avg(ndcg_10), 6) as ndcg_10, round(avg(ndcg_100), 6) as ndcg_100, round(avg(recall_10), 6) as recall_10, round(avg(recall_100), 6) as recall_100 from qm group by all",
    "map_precision": _CUR + _RANKED + _END + "select pass_name, query_id, round(average_precision, 6) as average_precision, round(precision_10, 6) as precision_10, round(precision_100, 6) as precision_100 from qm where method = 'MeanPool-HS'",
    "kl_tokens": _CUR + _END + "select text_id, cast(layer as int) as layer, cast(tok as int) as tok, round(kl, 6) + 0 as kl from kl",
    "kl_layers": _CUR + _END + _mean_sql("kl", "kl"),
    "top1_changed": _CUR + _END + _mean_sql("top1", "chg"),
    "topk_changed": _CUR + _END + _mean_sql("topk", "chg"),
    "layerwise_table": _CUR + f"""a as ({_mean_sql("kl", "kl")}), b as ({_mean_sql("top1", "chg")}), c as ({_mean_sql("topk", "chg")}) select a.layer, layer_type, kl, top1, topk from a join b using (layer) join c using (layer) join layers using (layer)""",
    "active_experts": _CUR + _END + "select * from act",
    "jaccard_pairs": _CUR + _PAIR + _END + "select p.text_id as a, q.text_id as b, round(coalesce(jaccard, 0), 6) as jaccard from sz p join sz q on p.text_id < q.text_id left join jac on jac.a = p.text_id and jac.b = q.text_id",
    "jaccard_relevance": _CUR.replace("act as (select distinct", "act as (select * from (select distinct").replace("where e between 0 and 127),\n", "where e between 0 and 127) where text_id in (select text_id from rec where kind = 'doc')),\n") + _PAIR + """rl as (select distinct x.doc_id as a, y.doc_id as b from qrels x join qrels y using (query_id) where x.doc_id < y.doc_id and x.doc_id in (select text_id from sz) and y.doc_id in (select text_id from sz)),
k as (select (select count(*) from sz) as n, (select count(*) from rl) as r, (select coalesce(sum(jaccard), 0) from jac where (a, b) in (select (a, b) from rl)) as i, (select coalesce(sum(jaccard), 0) from jac where (a, b) not in (select (a, b) from rl)) as o)
select case when r > 0 then round(i / r, 6) else 'nan'::double end as relevant_mean, case when n * (n - 1) // 2 - r > 0 then round(o / (n * (n - 1) // 2 - r), 6) else 'nan'::double end as other_mean, r as relevant_pairs, cast(n * (n - 1) // 2 - r as bigint) as other_pairs from k""",
    "kl_examples": _CUR + """tk as (select text_id, unnest(token_ids) as token_id, generate_subscripts(token_ids, 1) - 1 as tok from cur where pass_name = 'rerouted' and text_id in (select text_id from kl)),
ch as (select text_id from (select distinct text_id from tk) order by md5('7' || text_id), text_id limit 10),
mk as (select text_id, tok, round(avg(kl), 6) as kl from kl where text_id in (select text_id from ch) group by all),
cx as (select *, array_to_string(list(token_id) over (partition by text_id order by tok rows between 5 preceding and 5 following), ' ') as context from tk where text_id in (select text_id from ch)),
pl as (select *, row_number() over (partition by text_id order by kl desc, tok) as place from mk)
select text_id, cast(place as int) as place, cast(tok as int) as tok, token_id, kl, context from pl join cx using (text_id, tok) where place <= 10""",
    "twonn_by_layer": _CUR + """ft as (select text_id, cast(layer as int) as layer, cast(v as double[]) as v from (select text_id, unnest(hs_last_token) as v, generate_subscripts(hs_last_token, 1) - 1 as layer from cur where pass_name = 'rerouted' and text_id in (select text_id from rec where kind = 'doc' and ordinal <= 1000))
  where len(v) > 0 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0),
dd as (select a.layer, a.text_id as a, b.text_id as b, greatest(list_distance(a.v, b.v), 1e-10) as d from ft a join ft b on a.layer = b.layer and a.text_id <> b.text_id),
tw as (select layer, a, min(d) as r1, max(d) as r2 from (select *, row_number() over (partition by layer, a order by d, b) as r from dd) where r <= 2 group by all having count(*) = 2),
mu as (select layer, a, r2 / r1 as mu from tw where r2 / r1 > 1 + 1e-6 and not isinf(r2 / r1)),
pt as (select *, row_number() over (partition by layer order by mu, a) as k, count(*) over (partition by layer) as n from mu),
ls as (select layer, count(*) as points, sum(ln(mu) * -ln(1 - k / (n + 1)::double)) as xy, sum(ln(mu) * ln(mu)) as xx from pt group by 1)
select layer, case when points >= 3 and xx > 0 then round(xy / xx, 6) else 'nan'::double end as dimension, points from ls""",
    "layer_fallback": """with a as (select layer, row_number() over (order by layer) - 1 as i, count(*) over () as n from layers where layer_type = 'full_attention')
select layer, true as in_window, true as selected, 'fallback: too few samples' as strategy from a where i >= n // 2""",
    "embedding_search": """
with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), u as (select *, sqrt(list_dot_product(v, v)) as n from e),
s as (select q.vec_id as query_id, d.vec_id as doc_id, q.label = d.label as same, list_dot_product(q.v, d.v) / (q.n * d.n) as score from u q join u d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as int) as rank from s),
n as (select query_id, count(*) filter (same) as n from s group by 1),
p as (select r.query_id, round(sum(case when same then ln(2) / ln(rank + 1) else 0 end) / list_sum(list_transform(range(1, least(any_value(n), 10) + 1), lambda i: ln(2) / ln(i + 1))), 6) as ndcg_10, round(count(*) filter (same) / any_value(n)::double, 6) as recall_10 from r join n on n.query_id = r.query_id where rank <= 10 and n > 0 group by 1)
select r.query_id, doc_id, rank, round(score, 6) + 0 as score, ndcg_10, recall_10 from r join p on p.query_id = r.query_id where rank <= 10""",
}
ORACLE["coactivation_report"] = "with j as (" + ORACLE["jaccard_relevance"] + """)
select 1 as line, 'Relevant-pair mean Jaccard similarity: ' || case when isnan(relevant_mean) then 'nan' else printf('%.6f', relevant_mean) end as value from j
union all select 2, 'Non-relevant-pair mean Jaccard similarity: ' || case when isnan(other_mean) then 'nan' else printf('%.6f', other_mean) end from j
union all select 3, 'Relevant pair count: ' || relevant_pairs from j union all select 4, 'Non-relevant pair count: ' || other_pairs from j"""
ORACLE["delta_report"] = "with x as (" + ORACLE["kl_examples"] + """), t as (select text_id, row_number() over (order by text_id) as n from (select distinct text_id from x))
select cast((n - 1) * 12 + 1 as int) as line, 'Document ' || text_id as value from t
union all select cast((n - 1) * 12 + 1 + place as int), printf('  token_idx=%03d kl=%.6f token=%d context=%s', tok, kl, token_id, chr(39) || context || chr(39)) from x join t using (text_id)
union all select cast(n * 12 as int), '' from t"""
ORACLE["layer_selection"] = ORACLE["twonn_by_layer"].rsplit("select layer, case", 1)[0].rstrip().rstrip(",") + """,
idd as (select layer, xy / xx as dimension from ls where points >= 3 and xx > 0), cnt as (select count(*) as c from layers),
best as (select arg_min(layer, (dimension, layer)) as m from idd, cnt where layer >= cast(floor(0.2 * c) as int)),
win as (select l.layer, l.layer_type from layers l, best, cnt where l.layer between m and least(c - 1, m + greatest(1, c // 10))),
hit as (select layer from win where layer_type = 'full_attention'),
pool as (select idd.layer, dimension from idd join layers using (layer), cnt where layer_type = 'full_attention' and idd.layer >= cast(floor(0.2 * c) as int)),
b2 as (select arg_min(layer, (dimension, layer)) as f from pool),
sel as (select layer from hit union all select f from b2 where not exists (select * from hit) union all select min(layer) from pool, b2 where layer > f and not exists (select * from hit) having min(layer) is not null),
al as (select layer from win union select layer from sel)
select layer, layer in (select layer from win) as in_window, layer in (select layer from sel) as selected, 'min dimension window' as strategy from al"""
