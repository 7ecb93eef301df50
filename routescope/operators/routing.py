"""Comparison of two passes' routing: divergence, changed experts, active sets and their similarity."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routescope.functions.nested import as_array, beside, walk
from routescope.functions.vectors import EPS
from routescope.session import cut_lineage

COMPARED = "text_id string, layer int, kl array<double>, top1 array<double>, topk array<double>"
SLICE_ROWS = 256
PAIR_ROWS, PAIR_TASKS = 1 << 17, 10_000


class _Pass:
    """One pass of a slice of texts as dense arrays [text, layer, token, expert]."""

    def __init__(self, ix: pa.Array, wt: pa.Array, last: pa.Array, experts: int, slots: int):
        value, index, ok = walk(ix, 3)
        w, other, wok = walk(wt, 3)
        w, wok = beside(index, other, w, wok)
        row, layer, tok, slot = index
        value = value.astype(np.int64)
        use = ok & wok & (w > 0) & (slot < slots) & (value >= 0) & (value < experts)
        self.row, self.layer, self.tok, self.slot, self.expert, self.weight = row[use], layer[use], tok[use], slot[use], value[use], w[use].astype(np.float64)
        p, (frow, flayer, fexpert), fok = walk(last, 2)
        good = fok & np.isfinite(p)
        bad = set(zip(frow[~good].tolist(), flayer[~good].tolist()))
        keep = np.array([k not in bad for k in zip(frow.tolist(), flayer.tolist())], bool) & (fexpert < experts) if bad else fexpert < experts
        self.full = frow[keep], flayer[keep], fexpert[keep], p[keep].astype(np.float64)

    def shape(self) -> tuple[int, int]:
        return int(max(self.layer.max(initial=-1), self.full[1].max(initial=-1))) + 1, int(self.tok.max(initial=-1)) + 1

    def fill(self, n: int, layers: int, toks: int, experts: int) -> None:
        self.used = np.zeros((n, layers, toks, experts), bool)
        self.used[self.row, self.layer, self.tok, self.expert] = True
        self.top = np.full((n, layers, toks), -1, np.int64)
        first = self.slot == 0
        self.top[self.row[first], self.layer[first], self.tok[first]] = self.expert[first]
        self.p = np.zeros((n, layers, toks, experts))
        np.add.at(self.p, (self.row, self.layer, self.tok, self.expert), self.weight)
        self.there = self.used.copy()
        end = np.full(n, -1)
        np.maximum.at(end, self.row, self.tok)
        row, layer, expert, p = self.full
        known = end[row] >= 0
        row, layer, expert, p = row[known], layer[known], expert[known], p[known]
        some = np.unique(row)
        self.p[some, :, end[some]] = 0  # at the last token the whole router row stands in for the routed experts
        self.there[some, :, end[some]] = False
        self.p[row, layer, end[row], expert] = p
        self.there[row, layer, end[row], expert] = True


def _compare_batches(experts: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                a, b = (_Pass(*[as_array(part.column(f"{c}_{side}")) for c in ("ix", "wt", "full")], experts, slots) for side in "ab")
                (la, ta), (lb, tb) = a.shape(), b.shape()
                layers, toks = max(la, lb), max(ta, tb)
                if not layers or not toks:
                    continue
                for x in (a, b):
                    x.fill(part.num_rows, layers, toks, experts)
                kl = (a.p * (np.log(a.p + EPS) - np.log(b.p + EPS)))
                kl = np.where(a.there, kl, 0).sum(axis=3)
                known = a.there.any(axis=3) & b.there.any(axis=(1, 2, 3))[:, None, None]
                both = a.used.any(axis=3) & b.used.any(axis=3)
                top1, topk = (a.top != b.top).astype(float), (a.used != b.used).any(axis=3).astype(float)
                row, layer = np.nonzero((known | both).any(axis=2))

                def lay(x, mask, row=row, layer=layer):
                    v, m = x[row, layer], mask[row, layer]
                    flat = pa.array(v.reshape(-1), pa.float64(), mask=~m.reshape(-1))
                    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), flat)

                if len(row):
                    yield pa.RecordBatch.from_arrays([part.column("text_id").take(pa.array(row)), pa.array(layer, pa.int32()), lay(kl, known), lay(top1, both), lay(topk, both)], names=["text_id", "layer", "kl", "top1", "topk"])

    return run


def compare_passes(first: DataFrame, second: DataFrame, experts: int = 128, slots: int = 8) -> DataFrame:
    """Per text and layer, by token (null where not compared): the divergence sum p (ln(p + eps) - ln(q + eps)), whether
    the top expert differs, and whether the set of routed experts differs.

    Both sides: text_id (once), routing_indices, routing_weights, routing_full_last. p and q are the routed weights, at the
    last token the whole router row; an expert missing from the second pass has q = 0. Slots without an expert in range or
    a positive weight are not in use. The passes meet in one join on the text with their arrays still packed: no token or
    slot ever becomes a row of a shuffle.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("text_id", F.col("routing_indices").alias(f"ix_{name}"), F.col("routing_weights").alias(f"wt_{name}"), F.col("routing_full_last").alias(f"full_{name}"))

    return side(first, "a").join(side(second, "b"), "text_id").mapInArrow(_compare_batches(experts, slots), COMPARED)


def layer_means(compared: DataFrame, value: str) -> DataFrame:
    """Mean over tokens per text, then the plain mean over texts."""
    known = F.filter(value, lambda x: x.isNotNull())
    per_text = compared.withColumn("x", known).where("size(x) > 0").select("layer", (F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")).alias("m"))
    return per_text.groupBy("layer").agg(F.avg("m").alias(value), F.count("*").alias("texts"))


def tokens_of(compared: DataFrame, value: str) -> DataFrame:
    return compared.select("text_id", "layer", F.posexplode(value).alias("tok", value)).where(F.col(value).isNotNull())


def _last_slots(experts: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            none = pa.nulls(batch.num_rows, pa.list_(pa.list_(pa.float32())))
            p = _Pass(as_array(batch.column("routing_indices")), as_array(batch.column("routing_weights")), none, experts, slots)
            end = np.full(batch.num_rows, -1)
            np.maximum.at(end, p.row, p.tok)
            keep = p.tok == end[p.row]
            key, at = np.unique(p.row[keep] << 32 | (p.layer[keep] * experts + p.expert[keep]), return_inverse=True)
            w = np.bincount(at, weights=p.weight[keep], minlength=len(key))
            take = pa.array(key >> 32)
            yield pa.RecordBatch.from_arrays([batch.column("pass_name").take(take), batch.column("text_id").take(take), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(w)], names=["pass_name", "text_id", "dim", "w"])

    return run


def last_token_weights(payloads: DataFrame, experts: int = 128, slots: int = 8) -> DataFrame:
    """pass_name, text_id, dim = layer x experts + expert, w: the last token's routed weights; repeated experts add up."""
    return payloads.select("pass_name", "text_id", "routing_indices", "routing_weights").mapInArrow(_last_slots(experts, slots), "pass_name string, text_id string, dim int, w double")


def _bits(rows: pa.Array) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(rows.to_pylist()), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)


def _pack_active(layers: int, experts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, (row, _), _ = walk(batch.column("active"), 1)
            bits = np.zeros((batch.num_rows, layers * experts), bool)
            bits[row, value] = True
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), batch.column("queries"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["text_id", "queries", "bits"])

    return run


def _co_judged(p: pa.Array, q: pa.Array) -> np.ndarray:
    """Whether two texts share a judging query, as a matrix; only queries of both sides take a column."""

    def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        value, (row, _), _ = walk(col, 1)
        return np.asarray(value, dtype=object).astype(str), row

    (pv, pr), (qv, qr) = flat(p), flat(q)
    common = np.intersect1d(pv, qv)
    a, b = np.zeros((len(p), len(common)), np.float32), np.zeros((len(q), len(common)), np.float32)
    for value, row, into in ((pv, pr, a), (qv, qr, b)):
        keep = np.isin(value, common)
        into[row[keep], np.searchsorted(common, value[keep])] = 1
    return (a @ b.T) > 0


def rounded_shares(width: int, digits: int) -> np.ndarray:
    """[c, t]: c / t to ``digits`` places, halves up, for c and t up to ``width``; 0 where t is 0. In whole numbers, so exact."""
    c, t, one = np.arange(width + 1)[:, None], np.maximum(np.arange(width + 1), 1)[None, :], 10**digits
    return (2 * one * c + t) // (2 * t) / one


def _pair_rows(digits: int | None):
    """Pairs of two blocks, a < b, in runs of one a: from texts in the order of their ids, so that order is a matter of place."""
    shares: dict[int, np.ndarray] = {}

    def sorted_side(side: pa.StructArray) -> tuple[list[str], pa.Array, np.ndarray]:
        ids = side.field("text_id").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)  # by code point, as the engine's binary order
        take = pa.array(order, pa.int64())
        return [ids[i] for i in order], side.field("text_id").take(take), _bits(side.field("bits").take(take))

    def rows(left: pa.Array, right: pa.Array, common: np.ndarray, n: np.ndarray, m: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of every row of ``left`` the pairs with ``right`` from place ``first`` on."""
        many = common.shape[1] - first
        step = np.cumsum(many) // PAIR_ROWS
        bounds = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1], [True]))) if len(step) else []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            k = many[lo:hi]
            r = np.repeat(np.arange(lo, hi), k)
            c = np.arange(len(r)) - np.repeat(np.cumsum(k) - k, k) + first[r]
            both = common[r, c].astype(np.int64)
            total = n[r] + m[c] - both
            if digits is None:
                similarity = both / np.maximum(total, 1)
            else:
                similarity = shares[digits][both, total]
            if len(r):
                yield pa.RecordBatch.from_arrays([left.take(pa.array(r)), right.take(pa.array(c)), pa.array(similarity)], names=["a", "b", "jaccard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("same")[i].as_py()
                (names, p, x), (others, q, y) = (sorted_side(batch.column(c)[i].values) for c in "pq")
                if digits is not None and digits not in shares:
                    shares[digits] = rounded_shares(x.shape[1], digits)
                common, n, m = x @ y.T, *(z.sum(axis=1).astype(np.int64) for z in (x, y))
                yield from rows(p, q, common, n, m, np.array([bisect_right(others, a) for a in names], np.int64))
                if not same:
                    yield from rows(q, p, common.T, m, n, np.array([bisect_right(names, a) for a in others], np.int64))

    return run


def _split_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            p, q = batch.column("p")[i].values, batch.column("q")[i].values
            x, y = _bits(p.field("bits")), _bits(q.field("bits"))
            common = x @ y.T
            total = x.sum(1)[:, None] + y.sum(1)[None, :] - common
            similarity = common.astype(np.float64) / np.maximum(total, 1)
            left, right = (np.array(z.field("text_id").to_pylist(), dtype=object) for z in (p, q))
            once = left[:, None] < right[None, :] if batch.column("same")[i].as_py() else np.ones(common.shape, bool)
            rel = _co_judged(p.field("queries"), q.field("queries"))
            yield pa.RecordBatch.from_arrays([pa.array([float(similarity[once & rel].sum())]), pa.array([int((once & rel).sum())]), pa.array([float(similarity[once & ~rel].sum())]), pa.array([int((once & ~rel).sum())])], names=["rel_sum", "rel_n", "other_sum", "other_n"])


def _block_pairs(active: DataFrame, judged: DataFrame | None, block: int, layers: int, experts: int) -> tuple[DataFrame, int]:
    """Texts packed into blocks of bit rows, and every pair of blocks once, by an equi-join on the block number; the
    number of pairs."""
    rows = active.groupBy("text_id").agg(F.collect_set((F.col("layer") * experts + F.col("expert")).cast("int")).alias("active"))
    if judged is None:
        rows = rows.withColumn("queries", F.array().cast("array<string>"))
    else:
        asked = judged.groupBy(F.col("doc_id").alias("text_id")).agg(F.collect_set("query_id").alias("queries"))
        rows = rows.join(asked, "text_id", "left").withColumn("queries", F.coalesce("queries", F.array().cast("array<string>")))
    packed = cut_lineage(rows.select("text_id", "queries", "active").mapInArrow(_pack_active(layers, experts), "text_id string, queries array<string>, bits binary"))
    count = max(1, -(-packed.count() // block))
    blocks = packed.groupBy(F.pmod(F.xxhash64("text_id"), F.lit(count)).cast("int").alias("i")).agg(F.collect_list(F.struct("text_id", "queries", "bits")).alias("p"))
    left = blocks.select("i", "p", F.explode(F.sequence(F.col("i"), F.lit(count - 1))).alias("j"))
    met = left.join(blocks.select(F.col("i").alias("j"), F.col("p").alias("q")), "j")
    return met.select("p", "q", (F.col("i") == F.col("j")).alias("same"), (F.expr("j * (j + 1L) div 2") + F.col("i")).alias("pair")), count * (count + 1) // 2


def jaccard_pairs(active: DataFrame, block: int = 2048, layers: int = 4, experts: int = 128, digits: int | None = None) -> DataFrame:
    """a < b, jaccard of every pair of texts, 0 where nothing is common: a full matrix, in blocks; rounded if ``digits``.

    For large sets use the similarity join of the data pipeline, which returns only pairs above a threshold."""
    met, pairs = _block_pairs(active, None, block, layers, experts)
    spread = met.repartitionById(min(pairs, PAIR_TASKS), F.pmod("pair", F.lit(min(pairs, PAIR_TASKS))).cast("int"))  # blocks are small, their pairs are not
    return spread.mapInArrow(_pair_rows(digits), "a string, b string, jaccard double")


def relevance_split(active: DataFrame, judged: DataFrame, block: int = 2048, layers: int = 4, experts: int = 128) -> DataFrame:
    """Mean similarity of pairs judged for one query, whatever the grade, and of all others; NaN where there is no pair.

    Similarities and shared judgements are both matrices of a pair of blocks and only their sums leave the task, so
    neither the pairs of texts nor the pairs judged for one query - however many it has - are ever rows."""
    met, _ = _block_pairs(active, judged, block, layers, experts)
    sums = met.mapInArrow(_split_sums, "rel_sum double, rel_n bigint, other_sum double, other_n bigint")
    whole = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rel_sum", "rel_n", "other_sum", "other_n")])
    mean = lambda s, c: F.when(F.col(c) > 0, F.round(F.col(s) / F.col(c), 6)).otherwise(float("nan"))
    return whole.select(mean("rel_sum", "rel_n").alias("relevant_mean"), mean("other_sum", "other_n").alias("other_mean"), F.col("rel_n").cast("bigint").alias("relevant_pairs"), F.col("other_n").cast("bigint").alias("other_pairs"))


def divergence_examples(per_token: DataFrame, tokens: DataFrame, texts: int = 10, top: int = 10, around: int = 5, seed: str = "7") -> DataFrame:
    """For a seeded sample of texts: the tokens of the greatest layer-mean divergence with their neighbours.

    tokens: text_id, tok, token_id. The sample takes the texts of the least hash of (seed, id): same on every run."""
    chosen = tokens.select("text_id").distinct().orderBy(F.md5(F.concat(F.lit(seed), F.col("text_id").cast("string"))), "text_id").limit(texts)
    mean = per_token.join(chosen, "text_id", "left_semi").groupBy("text_id", "tok").agg(F.round(F.avg("kl"), 6).alias("kl"))
    near = Window.partitionBy("text_id").orderBy("tok").rowsBetween(-around, around)
    context = tokens.join(chosen, "text_id", "left_semi").withColumn("context", F.concat_ws(" ", F.collect_list(F.col("token_id").cast("string")).over(near)))
    w = Window.partitionBy("text_id").orderBy(F.desc("kl"), "tok")
    return mean.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).join(context, ["text_id", "tok"]).select("text_id", "place", "tok", "token_id", F.col("kl"), "context")


def coactivation_lines(split: DataFrame) -> DataFrame:
    """The four lines of the co-activation report from :func:`relevance_split`: line, value."""
    mean = lambda c: F.when(F.isnan(c), "nan").otherwise(F.format_string("%.6f", c))
    lines = [("Relevant-pair mean Jaccard similarity: ", mean("relevant_mean")), ("Non-relevant-pair mean Jaccard similarity: ", mean("other_mean")), ("Relevant pair count: ", F.col("relevant_pairs").cast("string")), ("Non-relevant pair count: ", F.col("other_pairs").cast("string"))]
    return split.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("line"), F.concat(F.lit(t), v).alias("value")) for i, (t, v) in enumerate(lines)])).alias("x")).select("x.line", "x.value")


def example_lines(examples: DataFrame, top: int = 10) -> DataFrame:
    """The lines of the examples' report: per text (ten of them at most) a heading, its tokens and an empty line."""
    place = F.row_number().over(Window.orderBy("text_id")) - 1
    texts = examples.select("text_id").distinct().withColumn("at", place * (top + 2))
    head = texts.select((F.col("at") + 1).alias("line"), F.concat(F.lit("Document "), "text_id").alias("value"))
    rows = examples.join(F.broadcast(texts), "text_id").select((F.col("at") + 1 + F.col("place")).alias("line"), F.format_string("  token_idx=%03d kl=%.6f token=%d context='%s'", "tok", "kl", "token_id", "context").alias("value"))
    return head.unionByName(rows).unionByName(texts.select((F.col("at") + top + 2).alias("line"), F.lit("").alias("value")))
