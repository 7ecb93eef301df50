"""All retrieval methods over any source of signals: representations, scores, fusion, reranking and the results table.

``Signals`` is what a source has to offer, each as a table keyed by pass_name and text_id; the stand-in model and the
payload archives are two such sources. Single-vector methods are multiplied in one block join: a pair of blocks gives
the scores of every method, the weighted sums of the fusions are formed from them on the spot, and only each query's
best documents by method leave the task. No full score matrix is ever a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routescope.functions.vectors import finite, unit
from routescope.operators import dense as D
from routescope.operators import metrics as E
from routescope.operators import multi as M
from routescope.operators import scoring as S
from routescope.session import cut_lineage

TEXT = ["pass_name", "text_id"]
TOP = 100
METRICS = ["ndcg_10", "ndcg_100", "recall_10", "recall_100"]


class Shape(Protocol):
    layers: int
    experts: int
    top_k: int
    hidden: int
    value_dim: int
    head_dim: int
    attention: tuple[int, ...]


class Signals(Protocol):
    """Each method returns rows of pass_name, text_id and the columns named."""

    arch: Shape

    def last(self) -> DataFrame: ...  # vec: the last token's state in the last layer
    def mean(self) -> DataFrame: ...  # vec: the mean state of the last layer
    def router(self) -> DataFrame: ...  # vec: the last token's router rows laid end to end
    def routed(self) -> DataFrame: ...  # dim, w: the last token's routed weights
    def value_means(self) -> DataFrame: ...  # off, vec
    def attention(self) -> DataFrame: ...  # off, head, w (by token)
    def values(self) -> DataFrame: ...  # off, tok, vec
    def pool(self, family: str) -> DataFrame: ...  # layer, slot, count, vec; family: out or va
    def states(self) -> DataFrame: ...  # vec_no, vec: the last layer's token states


def _scattered(s: Signals) -> DataFrame:
    """The routed weights scattered into a full vector."""
    row = s.routed().groupBy(*TEXT).agg(F.map_from_entries(F.collect_list(F.struct("dim", "w"))).alias("m"))
    dims = F.sequence(F.lit(0), F.lit(s.arch.layers * s.arch.experts - 1))
    return row.select(*TEXT, F.transform(dims, lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("vec"))


def _linear(s: Signals) -> tuple[int, ...]:
    return tuple(x for x in range(s.arch.layers) if x not in s.arch.attention)


def _va(select: str) -> Callable[[Signals], DataFrame]:
    return lambda s: D.mean_over(s.value_means(), "off", D.attention_offsets(len(s.arch.attention), select))


def _late(s: Signals) -> tuple[int, ...]:
    return s.arch.attention[len(s.arch.attention) // 2 :]


DENSE: dict[str, Callable[[Signals], DataFrame]] = {
    "KV-Embedding": lambda s: D.hybrid(s.last(), s.mean()),
    "LastToken-HS": lambda s: s.last(),
    "MeanPool-HS": lambda s: s.mean(),
    "MoEE": lambda s: s.router(),
    "VA": _va("second_half"),
    "VA-all-attn": _va("all"),
    "VA-last-attn": _va("last"),
    "AlignedWVA": lambda s: D.aligned_values(s.attention(), s.values(), D.attention_offsets(len(s.arch.attention), "second_half"), s.arch.head_dim),
    "ExpertOut-mean": lambda s: D.pool_mean(s.pool("out"), tuple(range(s.arch.layers)), s.arch.hidden),
    "ExpertOut-mean-attn-only": lambda s: D.pool_mean(s.pool("out"), s.arch.attention, s.arch.hidden),
    "ExpertOut-mean-delta-only": lambda s: D.pool_mean(s.pool("out"), _linear(s), s.arch.hidden),
    "MoEE-sparse": _scattered,
}
MULTI: dict[str, Callable[[Signals], DataFrame]] = {
    "ExpertPool-Value-attn": lambda s: M.pool_vectors(s.pool("va"), _late(s), 2, s.arch.value_dim),
    "ExpertPool-Value-attn-all": lambda s: M.pool_vectors(s.pool("va"), s.arch.attention, 2, s.arch.value_dim),
    "ExpertPool-ExpertOut-all": lambda s: M.pool_vectors(s.pool("out"), tuple(range(s.arch.layers)), 1, s.arch.hidden),
    "ExpertPool-ExpertOut-attn": lambda s: M.pool_vectors(s.pool("out"), s.arch.attention, 1, s.arch.hidden),
    "ExpertPool-ExpertOut-delta": lambda s: M.pool_vectors(s.pool("out"), _linear(s), 1, s.arch.hidden),
    "TokenLevel-HS-final": lambda s: s.states(),
}
FUSION = {"MoEE+VA-0.3": ("MoEE", "VA", 0.3), "MoEE+VA-0.5": ("MoEE", "VA", 0.5), "MoEE+VA-0.7": ("MoEE", "VA", 0.7), "MoEE+ExpertOut-0.5": ("MoEE", "ExpertOut-mean", 0.5)}
RERANK = {"RouteSig-then-ExpertPool-Value": "ExpertPool-Value-attn", "RouteSig-then-ExpertPool-ExpertOut": "ExpertPool-ExpertOut-all", "RouteSig-then-TokenLevel-HS": "TokenLevel-HS-final"}


def normalised(df: DataFrame) -> DataFrame:
    """Unit vectors; a vector with a null, NaN or infinity is an error that names its text."""
    named = F.concat(F.lit("non-finite vector of text "), F.col("text_id").cast("string"))
    return df.withColumn("vec", F.when(finite(F.col("vec")), unit(F.col("vec"))).otherwise(F.raise_error(named)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), parts)


def represent(signals: Signals, methods: dict[str, Callable[[Signals], DataFrame]]) -> DataFrame:
    """method, pass_name, text_id, (vec_no,) vec: the normalised vectors of all the methods."""
    made = {m: build(signals) for m, build in methods.items()}
    return normalised(_union([df.select(F.lit(m).alias("method"), *TEXT, *[c for c in ("vec_no",) if c in df.columns], "vec") for m, df in made.items()]))


def _score_blocks(methods: list[str], fusions: list[tuple[int, int, float]], k: int):
    def matrices(side: pa.StructArray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each method: the rows that have a vector, and their vectors."""
        inner, n = side.field("vecs").flatten(), len(methods)
        out = []
        for m in range(n):
            mine = inner.take(pa.array(np.arange(m, len(inner), n)))
            there = np.flatnonzero(mine.is_valid().to_numpy(zero_copy_only=False))
            held = mine.take(pa.array(there))
            out.append((there, held.flatten().to_numpy(zero_copy_only=False).reshape(len(there), -1) if len(there) else np.empty((0, 0))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, d = batch.column("q")[i].values, batch.column("d")[i].values
                scores = []
                for (qi, x), (di, y) in zip(matrices(q), matrices(d), strict=True):
                    full = np.full((len(q), len(d)), -np.inf)
                    if len(qi) and len(di):
                        full[np.ix_(qi, di)] = x @ y.T
                    scores.append(full)
                scores += [w * scores[a] + (1 - w) * scores[b] for a, b, w in fusions]
                for m, s in enumerate(scores):
                    bar = s if k >= len(d) else -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] - 10.0**-S.DIGITS
                    row, col = np.nonzero((s >= bar) & (s > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), m, np.int32)), pa.array(np.full(len(row), batch.column("pass_name")[i].as_py())), q.field("id").take(pa.array(row)), d.field("id").take(pa.array(col)), pa.array(s[row, col])], names=["m", "pass_name", "query_id", "doc_id", "score"])

    return run


def best_of_all(queries: DataFrame, docs: DataFrame, fusions: dict[str, tuple[str, str, float]], k: int = TOP, query_block: int = 256, doc_block: int = 2048) -> DataFrame:
    """Each query's k best documents by every method of ``queries`` and ``docs`` (method, pass_name, text_id, vec) and by
    every weighted sum of two methods' scores: method, pass_name, query_id, doc_id, score, rank. A pair without a vector
    on either side has no score; blocks are bounded by their rows."""
    methods = [r["method"] for r in docs.select("method").distinct().orderBy("method").collect()]  # one row per method
    names = F.array(*[F.lit(m) for m in methods]) if methods else F.array().cast("array<string>")

    def blocks(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
        texts = df.groupBy(*TEXT).agg(F.map_from_entries(F.collect_list(F.struct("method", "vec"))).alias("m"))
        texts = cut_lineage(texts.select(*TEXT, F.transform(names, lambda m: F.try_element_at("m", m)).alias("vecs")))
        count = max(1, -(-texts.count() // rows))
        block = F.pmod(F.xxhash64("text_id"), F.lit(count)).cast("int")
        return texts.groupBy("pass_name", block.alias(name)).agg(F.collect_list(F.struct(F.col("text_id").alias("id"), "vecs")).alias(name[0])), count

    q, _ = blocks(queries, query_block, "q_block")
    d, many = blocks(docs, doc_block, "d_block")
    met = q.select("pass_name", "q", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("d_block")).join(d, ["pass_name", "d_block"])
    sums = {f: x for f, x in fusions.items() if x[0] in methods and x[1] in methods}
    dtype = dict(docs.dtypes)["text_id"]
    scores = met.select("pass_name", "q", "d").mapInArrow(_score_blocks(methods, [(methods.index(a), methods.index(b), w) for a, b, w in sums.values()], k), f"m int, pass_name string, query_id {dtype}, doc_id {dtype}, score double")
    label = F.get(F.array(*[F.lit(x) for x in [*methods, *sums, ""]]), F.col("m"))
    return S.best(scores.select(label.alias("method"), "pass_name", "query_id", "doc_id", "score"), k)


def _grouped(df: DataFrame) -> DataFrame:
    """Method and pass in one column, as the block operators group by pass_name only."""
    return df.withColumn("pass_name", F.concat_ws("|", "method", "pass_name")).drop("method")


def _ungrouped(df: DataFrame) -> DataFrame:
    part = F.split("pass_name", r"\|")
    return df.select(part[0].alias("method"), part[1].alias("pass_name"), "query_id", "doc_id", "score")


def index_sizes(single: DataFrame, several: DataFrame, arch: Shape) -> DataFrame:
    """method, pass_name, num_vectors (average a document), vec_dim, index_bytes (of float32), avg_nonzero; for documents.

    A fusion keeps both indexes: the sum of their bytes and the greater dimension. A reranking reports the vectors and
    the dimension of the method it reranks by, and no index of its own."""
    cells = F.sum(F.size("vec").cast("bigint"))
    many = [F.countDistinct("text_id").alias("texts"), F.count("*").alias("vectors"), F.max(F.size("vec")).alias("vec_dim"), (4 * cells).alias("index_bytes")]
    own = cut_lineage(single.select("method", *TEXT, "vec").unionByName(several.select("method", *TEXT, "vec")).groupBy("method", "pass_name").agg(*many).select("method", "pass_name", (F.col("vectors") / F.col("texts")).alias("num_vectors"), "vec_dim", "index_bytes"))
    more = []
    for name, (a, b, _) in FUSION.items():
        both = own.where(F.col("method").isin(a, b)).groupBy("pass_name")
        more.append(both.agg(F.max("num_vectors").alias("num_vectors"), F.max("vec_dim").alias("vec_dim"), F.sum("index_bytes").alias("index_bytes")).select(F.lit(name).alias("method"), "pass_name", "num_vectors", "vec_dim", "index_bytes"))
    for name, base in RERANK.items():
        more.append(own.where(F.col("method") == base).select(F.lit(name).alias("method"), "pass_name", "num_vectors", "vec_dim", F.lit(0).cast("bigint").alias("index_bytes")))
    dims = F.when(F.col("method") == "MoEE-sparse", float(arch.layers * arch.top_k))
    return _union([own, *more]).select("method", "pass_name", F.round("num_vectors", 6).alias("num_vectors"), F.col("vec_dim").cast("int").alias("vec_dim"), F.col("index_bytes").cast("bigint").alias("index_bytes"), dims.alias("avg_nonzero"))


def evaluate(signals: Signals, kinds: DataFrame, judged: DataFrame, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None, k: int = TOP) -> DataFrame:
    """One row per method and pass: nDCG and recall at 10 and 100 and the size of the documents' index.

    ``kinds``: text_id, kind (doc or query); ``judged``: query_id, doc_id, rel. ``keep`` materialises a table under a
    name (for instance :func:`routescope.sources.files.materialised` with a key of the settings); without it tables go
    to the checkpoint folder. Every vector must be finite. Methods without any vector have no row.
    """
    store = keep or (lambda _, build: cut_lineage(build()))
    single = store("dense", lambda: represent(signals, DENSE))
    several = store("multi", lambda: represent(signals, MULTI))
    side = lambda df, kind: df.join(kinds.where(F.col("kind") == kind).select("text_id"), "text_id", "left_semi")
    first = cut_lineage(best_of_all(side(single, "query"), side(single, "doc"), FUSION, k))
    mq, md = (_grouped(side(several, kind)) for kind in ("query", "doc"))
    asked = first.where("method = 'MoEE'").select(F.explode(F.array(*[F.lit(b) for b in RERANK.values()])).alias("method"), "pass_name", "query_id", "doc_id")
    new = F.create_map(*[F.lit(x) for m, base in RERANK.items() for x in (base, m)])
    again = _ungrouped(S.rerank(_grouped(asked), mq, md)).withColumn("method", F.element_at(new, F.col("method")))
    ranked = first.unionByName(S.best(_ungrouped(S.max_sim(mq, md, k)).unionByName(again), k))
    table = E.summary(E.per_query(ranked, judged), METRICS)
    return table.join(index_sizes(side(single, "doc"), side(several, "doc"), signals.arch), ["method", "pass_name"]).drop("queries")


def stats_lines(results: DataFrame, build_seconds: dict[str, float], bytes_text: Callable) -> DataFrame:
    """The text report of the run: one line per method and pass."""
    seconds = F.create_map(*[F.lit(x) for m, s in build_seconds.items() for x in (m, float(s))]) if build_seconds else F.create_map().cast("map<string,double>")
    took = F.format_string("%.3f", F.coalesce(F.try_element_at(seconds, F.col("method")), F.lit(0.0)))
    line = F.concat(F.col("method"), F.lit("-"), F.col("pass_name"), F.lit(": build_time="), took, F.lit("s, index_size="), bytes_text(F.col("index_bytes")), F.lit(", avg_vectors="), F.format_string("%.3f", "num_vectors"), F.when(F.col("avg_nonzero").isNotNull(), F.concat(F.lit(", avg_nonzero_dims="), F.format_string("%.3f", "avg_nonzero"))).otherwise(""))
    return results.select(line.alias("line"))
