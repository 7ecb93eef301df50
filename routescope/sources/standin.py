"""A stand-in signal model on the ``embeddings`` table, for the signals the payload table does not carry.

A text is five consecutive vectors (its tokens); each of four layers sees sixteen of a token's elements, which are
its hidden state and the router's logits of sixteen experts, four of them routed. Layers 1 and 3 have attention.
The signals exercise the operators; their metric values say nothing about retrieval.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.functions.vectors import bind, dot, doubles, sigmoid, softmax
from routescope.session import cut_lineage
from routescope.sources.tables import PASS_ALL, PASS_PAPER, table

_SHARED: ContextVar[dict | None] = ContextVar("shared", default=None)


@contextmanager
def sharing() -> Iterator[None]:
    """Within this block every shared table is computed once and written to the checkpoint folder."""
    token = _SHARED.set({})
    try:
        yield
    finally:
        _SHARED.reset(token)


def shared(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(make)
    def get(spark: SparkSession, folder: str, *more) -> DataFrame:
        kept = _SHARED.get()
        if kept is None:
            return make(spark, folder, *more)
        key = (make.__name__, folder, *more)
        if key not in kept:
            kept[key] = cut_lineage(make(spark, folder, *more))
        return kept[key]

    return get


@dataclass(frozen=True)
class Architecture:
    layers: int = 4
    experts: int = 16
    top_k: int = 4
    tokens: int = 5
    hidden: int = 16
    heads: int = 2
    attention: tuple[int, ...] = (1, 3)
    paper_from: int = 2
    reroute_bias: float = 1.0

    @property
    def last(self) -> int:
        return self.tokens - 1

    @property
    def value_dim(self) -> int:
        return self.hidden

    @property
    def head_dim(self) -> int:
        return self.hidden // self.heads


ARCH = Architecture()


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select(F.expr(f"cast(vec_id div {ARCH.tokens} as int)").alias("text_id"), (F.col("vec_id") % ARCH.tokens).cast("int").alias("tok"), doubles(F.col("embedding")).alias("x"), "label")


@shared
def texts(spark: SparkSession, folder: str) -> DataFrame:
    """text_id, kind, label (of the last token)."""
    last = tokens(spark, folder).where(f"tok = {ARCH.last}")
    return last.select("text_id", F.when(F.col("text_id") % 10 == 0, "query").otherwise("doc").alias("kind"), "label")


@shared
def hidden(spark: SparkSession, folder: str) -> DataFrame:
    """text_id, layer, tok, h."""
    layer = F.explode(F.sequence(F.lit(0), F.lit(ARCH.layers - 1))).alias("layer")
    return tokens(spark, folder).select("text_id", "tok", "x", layer).select("text_id", "layer", "tok", F.slice("x", F.col("layer") * ARCH.hidden + 1, ARCH.hidden).alias("h"))


@shared
def router(spark: SparkSession, folder: str) -> DataFrame:
    """pass_name, text_id, layer, tok, h, logit, prob; the second pass mixes the last token's logits into later layers."""
    h = hidden(spark, folder)
    last = h.where(f"tok = {ARCH.last}").select("text_id", "layer", F.col("h").alias("z"))
    mixed = F.when(F.col("layer") >= ARCH.paper_from, F.zip_with("h", "z", lambda a, b: 0.75 * a + 0.25 * b)).otherwise(F.col("h"))
    both = h.join(last, ["text_id", "layer"]).select("text_id", "layer", "tok", "h", F.explode(F.array(F.struct(F.lit(PASS_ALL).alias("pass_name"), F.col("h").alias("logit")), F.struct(F.lit(PASS_PAPER).alias("pass_name"), mixed.alias("logit")))).alias("p"))
    return both.select("p.pass_name", "text_id", "layer", "tok", "h", F.col("p.logit").alias("logit"), softmax(F.col("p.logit")).alias("prob"))


@shared
def routing(spark: SparkSession, folder: str) -> DataFrame:
    """pass_name, text_id, layer, tok, slot, expert, weight, h: the routed experts by falling logit, then the shared one."""
    r = router(spark, folder)
    ranked = F.slice(F.array_sort(F.transform("logit", lambda x, i: F.struct((-x).alias("neg"), i.alias("expert")))), 1, ARCH.top_k)
    routed = r.select("pass_name", "text_id", "layer", "tok", "h", "prob", F.posexplode(ranked).alias("slot", "e"))
    routed = routed.select("pass_name", "text_id", "layer", "tok", "slot", F.col("e.expert").alias("expert"), F.get("prob", F.col("e.expert")).alias("weight"), "h")
    shared = r.select("pass_name", "text_id", "layer", "tok", F.lit(ARCH.top_k).alias("slot"), F.lit(ARCH.experts).alias("expert"), sigmoid(F.col("h")[0]).alias("weight"), "h")
    return routed.unionByName(shared)


@shared
def attention(spark: SparkSession, folder: str) -> DataFrame:
    """pass_name, text_id, off, head, w (per token), reroute: the last token's weights; the mass of the prepended copy
    of the last token is split off and the rest is not renormalised. A layer the pass does not reroute has none."""
    h = hidden(spark, folder).where(F.col("layer").isin(*ARCH.attention)).select("text_id", "layer", "tok", "h", F.explode(F.sequence(F.lit(0), F.lit(ARCH.heads - 1))).alias("head"))
    part = h.select("text_id", "layer", "tok", "head", F.slice("h", F.col("head") * ARCH.head_dim + 1, ARCH.head_dim).alias("v"))
    q = part.where(f"tok = {ARCH.last}").select("text_id", "layer", "head", F.col("v").alias("q"))
    logit = part.join(q, ["text_id", "layer", "head"]).select("text_id", "layer", "head", "tok", (dot(F.col("q"), F.col("v")) / F.sqrt(F.lit(float(ARCH.head_dim)))).alias("s"))
    row = logit.groupBy("text_id", "layer", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok", "s"))), lambda t: t["s"]).alias("s"))
    both = row.select("*", F.explode(F.array(F.lit(PASS_ALL), F.lit(PASS_PAPER))).alias("pass_name"))
    rerouted = (F.col("pass_name") == PASS_ALL) | (F.col("layer") >= ARCH.paper_from)
    full = F.when(rerouted, bind(F.col("s"), lambda s: F.concat(F.array(F.element_at(s, -1) + ARCH.reroute_bias), s))).otherwise(F.col("s"))
    w = both.withColumn("full", softmax(full)).withColumn("rerouted", rerouted)
    off = F.array_position(F.array(*[F.lit(x) for x in ARCH.attention]), F.col("layer")).cast("int") - 1
    return w.select("pass_name", "text_id", off.alias("off"), "head", F.when(F.col("rerouted"), F.slice("full", 2, ARCH.tokens)).otherwise(F.col("full")).alias("w"), F.when(F.col("rerouted"), F.col("full")[0]).otherwise(0.0).alias("reroute"))
