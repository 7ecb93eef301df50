"""Queries over the stand-in model: aggregates, representations, scores and the table of all methods, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.functions.vectors import collect_vector, long_form, mean_vector, sigmoid, unit
from routescope.operators import metrics as E
from routescope.operators import multi as M
from routescope.operators import pools as P
from routescope.operators import scoring as S
from routescope.operators.evaluation import DENSE, FUSION, MULTI, TOP, evaluate
from routescope.session import cut_lineage
from routescope.sources import standin
from routescope.sources.standin import ARCH

TEXT = ["pass_name", "text_id"]
ATTENTION = ARCH.attention


def _whole(df: DataFrame, *keys: str) -> DataFrame:
    return long_form(df, [*keys])


# token signals -------------------------------------------------------------------------------------------------

def seq_len(spark: SparkSession, folder: str) -> DataFrame:
    t = standin.tokens(spark, folder)
    return t.groupBy("text_id").agg(F.count("*").alias("seq_len"), F.max("tok").alias("last_position"))


def last_token_state(spark: SparkSession, folder: str) -> DataFrame:
    h = standin.hidden(spark, folder)
    last = h.groupBy("text_id", "layer").agg(F.max_by("h", "tok").alias("vec"))
    return _whole(last, "text_id", "layer")


def mean_state(spark: SparkSession, folder: str) -> DataFrame:
    return _whole(mean_vector(standin.hidden(spark, folder), ["text_id", "layer"], "h"), "text_id", "layer")


def final_tokens(spark: SparkSession, folder: str) -> DataFrame:
    h = standin.hidden(spark, folder).where(f"layer = {ARCH.layers - 1}").withColumnRenamed("h", "vec")
    return _whole(h, "text_id", "tok")


def attn_weights(spark: SparkSession, folder: str) -> DataFrame:
    a = standin.attention(spark, folder)
    return a.select(*TEXT, "off", "head", (F.round("reroute", 6) + 0.0).alias("reroute"), F.posexplode("w").alias("tok", "x")).withColumn("w", F.round("x", 6) + 0.0).drop("x")


def routing_topk(spark: SparkSession, folder: str) -> DataFrame:
    return standin.routing(spark, folder).select(*TEXT, "layer", "tok", "slot", "expert", (F.round("weight", 6) + 0.0).alias("weight"))


@standin.shared
def _pool(spark: SparkSession, folder: str, family: str) -> DataFrame:
    r = standin.routing(spark, folder)
    routed = r.where(F.col("slot") < ARCH.top_k)
    every = r.where(F.col("slot") == ARCH.top_k)
    keys = [*P.KEYS, "tok"]
    half = P.scale(F.col("h"), F.lit(0.5))
    gated = P.scale(F.col("h"), 0.5 * sigmoid(F.col("h")[0]))
    if family == "out":
        return P.expert_pool(r, P.combined_output(r, ARCH.top_k, ARCH.experts), every.select(*keys, gated.alias("vec")), ARCH.top_k, ARCH.last, ARCH.hidden)
    if family == "va":
        on = F.col("layer").isin(*ATTENTION)
        value = every.where(on).select(*keys, F.col("h").alias("vec"))
        return P.expert_pool(r.where(on), value, value, ARCH.top_k, ARCH.last, ARCH.hidden)
    own = P.own_output(F.col("h"), F.col("expert"), ARCH.experts)
    if family == "ffn":
        return P.expert_pool(r, routed.select(*keys, "expert", own.alias("vec")), every.select(*keys, half.alias("vec")), ARCH.top_k, ARCH.last, ARCH.hidden)
    weighted = P.scale(own, F.col("weight"))
    return P.expert_pool(r, routed.select(*keys, "expert", weighted.alias("vec")), every.select(*keys, gated.alias("vec")), ARCH.top_k, ARCH.last, ARCH.hidden)


def _pool_query(family: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _whole(_pool(spark, folder, family), *P.KEYS, "slot", "count")

    return query


def _values(spark: SparkSession, folder: str) -> DataFrame:
    h = standin.hidden(spark, folder).where(F.col("layer").isin(*ATTENTION))
    off = F.array_position(F.array(*[F.lit(x) for x in ATTENTION]), F.col("layer")).cast("int") - 1
    return h.select("text_id", off.alias("off"), "tok", F.col("h").alias("vec"), F.explode(F.array(F.lit("rerouted"), F.lit("paper_rerouted"))).alias("pass_name"))


@standin.shared
def _value_means(spark: SparkSession, folder: str) -> DataFrame:
    return mean_vector(_values(spark, folder), [*TEXT, "off"], "vec").select(*TEXT, "off", "vec")


def va_mean(spark: SparkSession, folder: str) -> DataFrame:
    return _whole(_value_means(spark, folder), *TEXT, "off")


# representations -----------------------------------------------------------------------------------------------

def _both(df: DataFrame) -> DataFrame:
    return df.withColumn("pass_name", F.explode(F.array(F.lit("rerouted"), F.lit("paper_rerouted"))))


class StandIn:
    """The stand-in model's signals."""

    arch = ARCH

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _final(self) -> DataFrame:
        return standin.hidden(self.spark, self.folder).where(f"layer = {ARCH.layers - 1}")

    def last(self) -> DataFrame:
        return _both(self._final().where(f"tok = {ARCH.last}").select("text_id", F.col("h").alias("vec"))).select(*TEXT, "vec")

    def mean(self) -> DataFrame:
        return _both(mean_vector(self._final(), ["text_id"], "h")).select(*TEXT, "vec")

    def router(self) -> DataFrame:
        r = standin.router(self.spark, self.folder).where(f"tok = {ARCH.last}").select(*TEXT, "layer", F.posexplode("prob").alias("e", "p"))
        return collect_vector(r.withColumn("dim", F.col("layer") * ARCH.experts + F.col("e")), TEXT, "dim", "p", "vec")

    def routed(self) -> DataFrame:
        r = standin.routing(self.spark, self.folder).where(f"tok = {ARCH.last} and slot < {ARCH.top_k}")
        return r.select(*TEXT, (F.col("layer") * ARCH.experts + F.col("expert")).alias("dim"), F.col("weight").alias("w"))

    def value_means(self) -> DataFrame:
        return _value_means(self.spark, self.folder)

    def attention(self) -> DataFrame:
        return standin.attention(self.spark, self.folder)

    def values(self) -> DataFrame:
        return _values(self.spark, self.folder)

    def pool(self, family: str) -> DataFrame:
        return _pool(self.spark, self.folder, family)

    def states(self) -> DataFrame:
        return _both(self._final().select("text_id", F.col("tok").alias("vec_no"), F.col("h").alias("vec"))).select(*TEXT, "vec_no", "vec")


def _normal(df: DataFrame) -> DataFrame:
    return df.withColumn("vec", unit(F.col("vec")))


def _dense_query(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: _whole(_normal(DENSE[method](StandIn(spark, folder))), *TEXT)


def _multi_query(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: _whole(_normal(MULTI[method](StandIn(spark, folder))), *TEXT, "vec_no")


def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    return _whole(e.select("vec_id", unit(F.col("embedding").cast("array<double>")).alias("vec")), "vec_id")


def multi_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return M.offsets(MULTI["ExpertPool-Value-attn"](StandIn(spark, folder)))


# scores --------------------------------------------------------------------------------------------------------

def _side(df: DataFrame, spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return df.join(standin.texts(spark, folder).where(F.col("kind") == kind).select("text_id"), "text_id", "left_semi")


def _scores(spark: SparkSession, folder: str, method: str, k: int | None = None) -> DataFrame:
    rep = _normal(DENSE[method](StandIn(spark, folder)))
    return S.dense_scores(_side(rep, spark, folder, "query"), _side(rep, spark, folder, "doc"), k)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6) + 0.0)


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """A document is relevant to a query of the same label."""
    t = standin.texts(spark, folder)
    q = t.where("kind = 'query'").select(F.col("text_id").alias("query_id"), "label")
    return q.join(t.where("kind = 'doc'").select(F.col("text_id").alias("doc_id"), "label"), "label").select("query_id", "doc_id", F.lit(1).alias("rel"))


def cosine_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_scores(spark, folder, "KV-Embedding"))


def sparse_cosine(spark: SparkSession, folder: str) -> DataFrame:
    rows = StandIn(spark, folder).routed()
    out = S.sparse_scores(_side(rows, spark, folder, "query"), _side(rows, spark, folder, "doc"))
    return _rounded(out)


def _max_sim(spark: SparkSession, folder: str, method: str) -> DataFrame:
    rep = cut_lineage(_normal(MULTI[method](StandIn(spark, folder))))  # read for its size, as queries and as documents
    return S.max_sim(_side(rep, spark, folder, "query"), _side(rep, spark, folder, "doc"))


def maxsim_arrow(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair, through the block kernel."""
    return _rounded(_max_sim(spark, folder, "ExpertPool-Value-attn"))


def fusion(spark: SparkSession, folder: str) -> DataFrame:
    a, b, w = FUSION["MoEE+VA-0.3"]
    return _rounded(S.fuse(_scores(spark, folder, a), _scores(spark, folder, b), w))


def topk(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.best(_scores(spark, folder, "LastToken-HS", 10), 10))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return S.best(_scores(spark, folder, "MoEE", TOP), TOP).select("pass_name", "query_id", "doc_id", "rank")


def _reranked(spark: SparkSession, folder: str, method: str) -> DataFrame:
    rep = cut_lineage(_normal(MULTI[method](StandIn(spark, folder))))
    scored = S.rerank(candidates(spark, folder), _side(rep, spark, folder, "query"), _side(rep, spark, folder, "doc"))
    return S.best(scored, TOP)


def rerank(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_reranked(spark, folder, "ExpertPool-Value-attn"))


def eval_rerank(spark: SparkSession, folder: str) -> DataFrame:
    return E.summary(E.per_query(rerank(spark, folder), _judged(spark, folder)), ["ndcg_10", "ndcg_100", "recall_10", "recall_100"])


def results_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per method and pass: nDCG and recall, average vectors a document, their dimension and the index's bytes."""
    kinds = standin.texts(spark, folder).select("text_id", "kind")
    with standin.sharing():
        return evaluate(StandIn(spark, folder), kinds, cut_lineage(_judged(spark, folder)), k=TOP)


DENSE_NAMES = {"va_second_half": "VA", "va_all": "VA-all-attn", "va_last": "VA-last-attn", "aligned_wva": "AlignedWVA", "expert_out_all": "ExpertOut-mean", "expert_out_attn": "ExpertOut-mean-attn-only", "expert_out_delta": "ExpertOut-mean-delta-only"}
MULTI_NAMES = {"va_second_half": "ExpertPool-Value-attn", "va_all": "ExpertPool-Value-attn-all", "expert_out_all": "ExpertPool-ExpertOut-all", "expert_out_attn": "ExpertPool-ExpertOut-attn", "expert_out_delta": "ExpertPool-ExpertOut-delta", "tokens": "TokenLevel-HS-final"}

QUERIES = {f.__name__: f for f in (seq_len, last_token_state, mean_state, final_tokens, attn_weights, routing_topk, va_mean, l2_normalize, multi_offsets, cosine_scores, sparse_cosine, maxsim_arrow, fusion, topk, candidates, rerank, eval_rerank, results_table)}
QUERIES |= {f"pool_{n}": _pool_query(f) for n, f in (("expert_out", "out"), ("expert_ffn", "ffn"), ("expert_contrib", "contrib"), ("va", "va"))}
QUERIES |= {f"dense_{n}": _dense_query(m) for n, m in DENSE_NAMES.items()} | {f"multi_{n}": _multi_query(m) for n, m in MULTI_NAMES.items()}

# SQL -----------------------------------------------------------------------------------------------------------

_BASE = """with
tok as (select cast(vec_id // 5 as int) as text_id, cast(vec_id % 5 as int) as tok, cast(embedding as double[]) as x, label from embeddings),
hid as (select text_id, l.layer, tok, x[l.layer * 16 + 1 : l.layer * 16 + 16] as h from tok, (select cast(unnest(range(4)) as int) as layer) l),
lst as (select text_id, layer, h as z from hid where tok = 4),
lg as (select 'rerouted' as pass_name, *, h as lo from hid union all
  select 'paper_rerouted', hid.*, case when hid.layer >= 2 then list_transform(range(1, 17), lambda i: 0.75 * h[i] + 0.25 * z[i]) else h end from hid join lst on hid.text_id = lst.text_id and hid.layer = lst.layer),
ex as (select *, list_transform(lo, lambda v: exp(v - list_max(lo))) as e from lg),
pb as (select pass_name, text_id, layer, tok, h, lo, list_transform(e, lambda v: v / list_sum(e)) as prob from ex),
un as (select pass_name, text_id, layer, tok, h, cast(unnest(range(16)) as int) as expert, unnest(lo) as lo, unnest(prob) as p from pb),
rt as (select pass_name, text_id, layer, tok, slot, expert, p as weight, h from (select *, cast(row_number() over (partition by pass_name, text_id, layer, tok order by lo desc, expert) - 1 as int) as slot from un) where slot < 4
  union all select pass_name, text_id, layer, tok, 4, 16, 1 / (1 + exp(-h[1])), h from pb),
txt as (select text_id, case when text_id % 10 = 0 then 'query' else 'doc' end as kind, label from tok where tok = 4),
passes as (select unnest(['rerouted', 'paper_rerouted']) as pass_name),
hd as (select text_id, layer, tok, head, h[head * 8 + 1 : head * 8 + 8] as v from hid, (select unnest(range(2)) as head) where layer in (1, 3)),
al as (select a.text_id, a.layer, a.head, a.tok, list_dot_product(q.v, a.v) / sqrt(8.0::double) as s from hd a join hd q on q.tok = 4 and a.text_id = q.text_id and a.layer = q.layer and a.head = q.head),
ar as (select pass_name, al.*, exp(s) as e from al, passes),
ac as (select pass_name, text_id, layer, head, sum(e) + max(case when tok = 4 and (pass_name = 'rerouted' or layer >= 2) then exp(s + 1.0) else 0 end) as total,
  max(case when tok = 4 and (pass_name = 'rerouted' or layer >= 2) then exp(s + 1.0) else 0 end) as copy from ar group by all),
att as (select ar.pass_name, ar.text_id, cast((ar.layer - 1) // 2 as int) as off, cast(ar.head as int) as head, ar.tok, e / total as w, copy / total as reroute from ar join ac using (pass_name, text_id, layer, head)),
val as (select pass_name, text_id, cast((layer - 1) // 2 as int) as off, tok, h from hid, passes where layer in (1, 3)),
sl as (select pass_name, text_id, layer, slot, expert from rt where tok = 4 and slot < 4),
hits as (select sl.pass_name, sl.text_id, sl.layer, sl.slot, sl.expert, rt.tok, rt.weight, rt.h from sl join rt on rt.slot < 4 and sl.pass_name = rt.pass_name and sl.text_id = rt.text_id and sl.layer = rt.layer and sl.expert = rt.expert),
cmb as (select pass_name, text_id, layer, tok, sum(weight * (1 + expert / 16.0::double)) as f from rt where slot < 4 group by all),
sh as (select pass_name, text_id, layer, 4 as slot, tok, h, weight as g from rt where slot = 4),
d16 as (select cast(unnest(range(16)) as int) as dim),
po as (select hits.pass_name, hits.text_id, hits.layer, slot, dim, avg(f * h[dim + 1]) as v, count(*) as n from hits join cmb using (pass_name, text_id, layer, tok), d16 group by all
  union all select pass_name, text_id, layer, slot, dim, avg(0.5 * g * h[dim + 1]), count(*) from sh, d16 group by all),
pf as (select pass_name, text_id, layer, slot, dim, avg((1 + expert / 16.0::double) * h[dim + 1]) as v, count(*) as n from hits, d16 group by all
  union all select pass_name, text_id, layer, slot, dim, avg(0.5 * h[dim + 1]), count(*) from sh, d16 group by all),
pc as (select pass_name, text_id, layer, slot, dim, avg(weight * (1 + expert / 16.0::double) * h[dim + 1]) as v, count(*) as n from hits, d16 group by all
  union all select pass_name, text_id, layer, slot, dim, avg(0.5 * g * h[dim + 1]), count(*) from sh, d16 group by all),
pv as (select pass_name, text_id, layer, slot, dim, avg(h[dim + 1]) as v, count(*) as n from hits, d16 where layer in (1, 3) group by all
  union all select pass_name, text_id, layer, slot, dim, avg(h[dim + 1]), count(*) from sh, d16 where layer in (1, 3) group by all),
vm as (select pass_name, text_id, off, dim, avg(h[dim + 1]) as v from val, d16 group by all),
ws as (select *, w / greatest(sum(w) over (partition by pass_name, text_id, off, head), 1e-10) as share from att),
wl as (select ws.pass_name, ws.text_id, ws.off, dim, sum(share * h[dim + 1]) as v from ws join val using (pass_name, text_id, off, tok), d16 where dim // 8 = head and ws.off = 1 group by all),
eo as (select pass_name, text_id, layer, dim, sum(n * v) / sum(n) as v from po group by all),
rep as (
  select 'LastToken-HS' as method, pass_name, text_id, dim, h[dim + 1] as v from hid, passes, d16 where layer = 3 and tok = 4
  union all select 'MeanPool-HS', pass_name, text_id, dim, avg(h[dim + 1]) from hid, passes, d16 where layer = 3 group by all
  union all select 'KV-Embedding', pass_name, text_id, dim, 0.5 * (avg(h[dim + 1]) + max(case when tok = 4 then h[dim + 1] end)) from hid, passes, d16 where layer = 3 group by all
  union all select 'MoEE', pass_name, text_id, layer * 16 + expert, p from un where tok = 4
  union all select 'MoEE-sparse', u.pass_name, u.text_id, u.layer * 16 + u.expert, coalesce(r.weight, 0) from un u left join rt r on r.slot < 4 and r.tok = 4 and u.pass_name = r.pass_name and u.text_id = r.text_id and u.layer = r.layer and u.expert = r.expert where u.tok = 4
  union all select 'VA', pass_name, text_id, dim, v from vm where off = 1
  union all select 'VA-last-attn', pass_name, text_id, dim, v from vm where off = 1
  union all select 'VA-all-attn', pass_name, text_id, dim, avg(v) from vm group by all
  union all select 'AlignedWVA', pass_name, text_id, dim, avg(v) from wl group by all
  union all select 'ExpertOut-mean', pass_name, text_id, dim, avg(v) from eo group by all
  union all select 'ExpertOut-mean-attn-only', pass_name, text_id, dim, avg(v) from eo where layer in (1, 3) group by all
  union all select 'ExpertOut-mean-delta-only', pass_name, text_id, dim, avg(v) from eo where layer in (0, 2) group by all),
nrm as (select method, pass_name, text_id, dim, v / greatest(sqrt(sum(v * v) over (partition by method, pass_name, text_id)), 1e-10) as v from rep),
vecs as (select method, pass_name, text_id, array_agg(v order by dim) as vec from nrm group by all),
pvk as (select *, max(n) over (partition by pass_name, text_id) as m3 from pv where layer = 3), pvk2 as (select *, max(n) over (partition by pass_name, text_id) as m from pv),
mul as (
  select 'ExpertPool-Value-attn' as method, pass_name, text_id, layer, slot, dim, v from pvk where n >= case when m3 >= 2 then 2 else 1 end
  union all select 'ExpertPool-Value-attn-all', pass_name, text_id, layer, slot, dim, v from pvk2 where n >= case when m >= 2 then 2 else 1 end
  union all select 'ExpertPool-ExpertOut-all', pass_name, text_id, layer, slot, dim, v from po where n >= 1
  union all select 'ExpertPool-ExpertOut-attn', pass_name, text_id, layer, slot, dim, v from po where n >= 1 and layer in (1, 3)
  union all select 'ExpertPool-ExpertOut-delta', pass_name, text_id, layer, slot, dim, v from po where n >= 1 and layer in (0, 2)
  union all select 'TokenLevel-HS-final', pass_name, text_id, 0, tok, dim, h[dim + 1] from hid, passes, d16 where layer = 3),
mnr as (select method, pass_name, text_id, layer, slot, dim, v / greatest(sqrt(sum(v * v) over (partition by method, pass_name, text_id, layer, slot)), 1e-10) as v from mul),
mvec as (select *, cast(row_number() over (partition by method, pass_name, text_id order by layer, slot) - 1 as int) as vec_no from (select method, pass_name, text_id, layer, slot, array_agg(v order by dim) as vec from mnr group by all)),
sc as (select q.method, q.pass_name, q.text_id as query_id, d.text_id as doc_id, list_dot_product(q.vec, d.vec) as score from vecs q join vecs d using (method, pass_name)
  where q.text_id % 10 = 0 and d.text_id % 10 <> 0),
ms as (select method, pass_name, query_id, doc_id, sum(near) as score from (select q.method, q.pass_name, q.text_id as query_id, q.vec_no, d.text_id as doc_id, max(list_dot_product(q.vec, d.vec)) as near
  from mvec q join mvec d using (method, pass_name) where q.text_id % 10 = 0 and d.text_id % 10 <> 0 group by all) group by all),
cand as (select pass_name, query_id, doc_id, cast(row_number() over (partition by pass_name, query_id order by round(score, 6) desc, doc_id) as int) as rank from sc where method = 'MoEE' qualify rank <= 100),
judged as (select q.text_id as query_id, d.text_id as doc_id from txt q join txt d on q.label = d.label and q.kind = 'query' and d.kind = 'doc'),
fus as (select a.pass_name, a.query_id, a.doc_id, a.score as x, b.score as y, c.score as z from sc a join sc b using (pass_name, query_id, doc_id) join sc c using (pass_name, query_id, doc_id)
  where a.method = 'MoEE' and b.method = 'VA' and c.method = 'ExpertOut-mean'),
alls as (select * from sc union all select * from ms
  union all select 'MoEE+VA-0.3', pass_name, query_id, doc_id, 0.3 * x + 0.7 * y from fus union all select 'MoEE+VA-0.5', pass_name, query_id, doc_id, 0.5 * x + 0.5 * y from fus
  union all select 'MoEE+VA-0.7', pass_name, query_id, doc_id, 0.7 * x + (1 - 0.7::double) * y from fus union all select 'MoEE+ExpertOut-0.5', pass_name, query_id, doc_id, 0.5 * x + 0.5 * z from fus
  union all select r.new, ms.pass_name, ms.query_id, ms.doc_id, ms.score from ms join (values ('RouteSig-then-ExpertPool-Value', 'ExpertPool-Value-attn'), ('RouteSig-then-ExpertPool-ExpertOut', 'ExpertPool-ExpertOut-all'),
    ('RouteSig-then-TokenLevel-HS', 'TokenLevel-HS-final')) r(new, old) on r.old = ms.method join cand on cand.pass_name = ms.pass_name and cand.query_id = ms.query_id and cand.doc_id = ms.doc_id),
rk as (select *, row_number() over (partition by method, pass_name, query_id order by round(score, 6) desc, doc_id) as rank from alls qualify rank <= 100),
idl as (select query_id, count(*) as n from judged group by 1),
per as (select rk.method, rk.pass_name, rk.query_id, sum(case when j.doc_id is not null and rank <= 10 then ln(2) / ln(rank + 1) else 0 end) as d10, sum(case when j.doc_id is not null then ln(2) / ln(rank + 1) else 0 end) as d100,
  count(j.doc_id) filter (rank <= 10) as h10, count(j.doc_id) as h100 from rk left join judged j on rk.query_id = j.query_id and rk.doc_id = j.doc_id group by all),
qm as (select method, pass_name, d10 / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: ln(2) / ln(i + 1))) as ndcg_10, d100 / list_sum(list_transform(range(1, least(n, 100) + 1), lambda i: ln(2) / ln(i + 1))) as ndcg_100,
  cast(h10 as double) / n as recall_10, cast(h100 as double) / n as recall_100 from per join idl using (query_id)),
res as (select method, pass_name, count(*) as queries, round(avg(ndcg_10), 6) as ndcg_10, round(avg(ndcg_100), 6) as ndcg_100, round(avg(recall_10), 6) as recall_10, round(avg(recall_100), 6) as recall_100 from qm group by all)
"""

_POOL_SQL = "select pass_name, text_id, layer, slot, n as count, dim, round(v, 6) + 0 as value from "
ORACLE = {
    "seq_len": _BASE + "select text_id, count(*) as seq_len, max(tok) as last_position from tok group by 1",
    "last_token_state": _BASE + "select text_id, layer, dim, round(h[dim + 1], 6) + 0 as value from hid, d16 where tok = 4",
    "mean_state": _BASE + "select text_id, layer, dim, round(avg(h[dim + 1]), 6) + 0 as value from hid, d16 group by all",
    "final_tokens": _BASE + "select text_id, tok, dim, round(h[dim + 1], 6) + 0 as value from hid, d16 where layer = 3",
    "attn_weights": _BASE + "select pass_name, text_id, off, head, tok, round(w, 6) + 0 as w, round(reroute, 6) + 0 as reroute from att",
    "routing_topk": _BASE + "select pass_name, text_id, layer, tok, slot, expert, round(weight, 6) + 0 as weight from rt",
    "va_mean": _BASE + "select pass_name, text_id, off, dim, round(v, 6) + 0 as value from vm",
    "l2_normalize": """with e as (select vec_id, cast(embedding as double[]) as x from embeddings), u as (select vec_id, unnest(x) as v, cast(unnest(range(len(x))) as int) as dim from e)
select vec_id, dim, round(v / greatest(sqrt(sum(v * v) over (partition by vec_id)), 1e-10), 6) + 0 as value from u""",
    "multi_offsets": _BASE + """, c as (select pass_name, text_id, count(*) as vectors from mvec where method = 'ExpertPool-Value-attn' group by all)
select pass_name, text_id, vectors, cast(sum(vectors) over (partition by pass_name order by text_id) - vectors as bigint) as start from c""",
    "cosine_scores": _BASE + "select pass_name, query_id, doc_id, round(score, 6) + 0 as score from sc where method = 'KV-Embedding'",
    "sparse_cosine": _BASE + """select a.pass_name, a.text_id as query_id, b.text_id as doc_id, round(sum(a.v * b.v), 6) + 0 as score from nrm a join nrm b using (method, pass_name, dim)
where method = 'MoEE-sparse' and a.text_id % 10 = 0 and b.text_id % 10 <> 0 group by all""",
    "maxsim_arrow": _BASE + "select pass_name, query_id, doc_id, round(score, 6) + 0 as score from ms where method = 'ExpertPool-Value-attn'",
    "fusion": _BASE + "select pass_name, query_id, doc_id, round(score, 6) + 0 as score from alls where method = 'MoEE+VA-0.3'",
    "topk": _BASE + "select pass_name, query_id, doc_id, round(score, 6) + 0 as score, cast(rank as int) as rank from rk where method = 'LastToken-HS' and rank <= 10",
    "candidates": _BASE + "select * from cand",
    "rerank": _BASE + "select pass_name, query_id, doc_id, round(score, 6) + 0 as score, cast(rank as int) as rank from rk where method = 'RouteSig-then-ExpertPool-Value'",
    "eval_rerank": _BASE + "select * exclude (method) from res where method = 'RouteSig-then-ExpertPool-Value'",
    "results_table": _BASE + """, own as (select method, pass_name, 1.0::double as nv, max(dim) + 1 as vd, 4 * count(*) as bytes from rep where text_id % 10 <> 0 group by all
  union all select method, pass_name, count(*)::double / count(distinct text_id), 16, 4 * 16 * count(*) from mvec where text_id % 10 <> 0 group by all),
size as (select * from own
  union all select f.name, pass_name, 1.0::double, max(vd), sum(bytes) from own join (values ('MoEE+VA-0.3', 'VA'), ('MoEE+VA-0.5', 'VA'), ('MoEE+VA-0.7', 'VA'), ('MoEE+ExpertOut-0.5', 'ExpertOut-mean')) f(name, other) on method in ('MoEE', other) group by all
  union all select r.name, pass_name, nv, vd, 0 from own join (values ('RouteSig-then-ExpertPool-Value', 'ExpertPool-Value-attn'), ('RouteSig-then-ExpertPool-ExpertOut', 'ExpertPool-ExpertOut-all'), ('RouteSig-then-TokenLevel-HS', 'TokenLevel-HS-final')) r(name, base) on method = base)
select method, pass_name, ndcg_10, ndcg_100, recall_10, recall_100, round(nv, 6) as num_vectors, cast(vd as int) as vec_dim, cast(bytes as bigint) as index_bytes, case when method = 'MoEE-sparse' then 16.0::double end as avg_nonzero from res join size using (method, pass_name)""",
    "pool_expert_out": _BASE + _POOL_SQL + "po",
    "pool_expert_ffn": _BASE + _POOL_SQL + "pf",
    "pool_expert_contrib": _BASE + _POOL_SQL + "pc",
    "pool_va": _BASE + _POOL_SQL + "pv",
}
ORACLE |= {f"dense_{n}": _BASE + f"select pass_name, text_id, cast(dim as int) as dim, round(v, 6) + 0 as value from nrm where method = '{m}'" for n, m in DENSE_NAMES.items()}
ORACLE |= {f"multi_{n}": _BASE + f"select pass_name, text_id, vec_no, cast(unnest(range(len(vec))) as int) as dim, round(unnest(vec), 6) + 0 as value from mvec where method = '{m}'" for n, m in MULTI_NAMES.items()}
