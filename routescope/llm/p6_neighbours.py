"""Problem 6: the k most similar vectors of every vector.

Vantage-point trees per shard. A small tree over a bounded sample (``sample_rows``) cuts the space into cells
of about ``cell_rows`` vectors; every vector goes to the cell it falls in, and each cell (a large one: each of
its sub-shards) gets its own vantage-point tree. A query visits the cells and branches that the triangle
inequality cannot rule out: with a vantage point at distance d from the query and a split radius m, the far
side is skipped when ``factor * |d - m|`` exceeds the distance of the k-th neighbour so far. ``factor`` 1 is
exact; a larger one skips more. With ``min_similarity`` the search starts from that radius, in one pass;
without it a query first searches its own cell and then the cells its k-th distance still reaches.

Skew: exact copies are merged before the search and get their neighbours from their class, so a class holding
a third of all rows is one vector; cell borders are sample quantiles, a cell above ``cell_rows`` is split into
sub-shards by a hash, and a cell with many queries is replicated. No task holds more than a shard's vectors;
queries stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routescope.functions.nested import as_array, walk
from routescope.session import cut_lineage
from routescope.sources.tables import PASS_ALL, current, payload_rows

K = 5
FACTOR = 1.5
CELL_ROWS = 8192
SAMPLE_ROWS = 16384
QUERY_ROWS = 65536
LEAF = 96
SLACK = 1e-4
ROUNDING = 5e-6
SLICE_QUERIES = 512
EXACT_ROWS = 100_000


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """A vantage-point tree over unit vectors; distances are Euclidean."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 1):
        self.points = points.astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)), leaf)

    def _build(self, at: np.ndarray, leaf: int):
        if len(at) <= leaf:
            return at
        trial = at[self.rng.integers(0, len(at), 6)]
        probe = at[self.rng.integers(0, len(at), 64)]
        spread = [np.var(distance(self.points[probe], self.points[[t]])) for t in trial]
        vantage = int(trial[int(np.argmax(spread))])
        d = distance(self.points[at], self.points[[vantage]])[:, 0]
        m = float(np.median(d))
        near = d <= m
        if near.all():
            m = float(np.nextafter(np.float32(d.max()), np.float32(0)))
            near = d <= m
            if near.all() or not near.any():
                return at
        return vantage, m, self._build(at[near], leaf), self._build(at[~near], leaf)

    def within(self, queries: np.ndarray, own: np.ndarray, k: int, radius: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of the k nearest other points up to radius, and of any tied with the k-th within rounding."""
        found_q, found_p, found_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        least = 1 - (radius + SLACK) ** 2 / 2
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if isinstance(node, np.ndarray):
                s = queries[q] @ self.points[node].T
                near = (s >= least) & (own[q][:, None] != node[None, :])
                if len(node) > k + 1 and np.count_nonzero(near) > 4 * k * len(q):  # dense: only a leaf's k best can count
                    s = np.where(near, s, np.float32(-2))
                    near &= s >= np.partition(s, -k, axis=1)[:, [-k]] - np.float32(ROUNDING)
                i, j = np.nonzero(near)
                found_q.append(q[i])
                found_p.append(node[j])
                found_s.append(s[i, j])
                continue
            vantage, m, inside, outside = node
            gap = distance(queries[q], self.points[[vantage]])[:, 0] - m
            stack.append((inside, q[factor * gap <= radius + SLACK]))
            stack.append((outside, q[factor * -gap <= radius + SLACK]))
        q, p, s = np.concatenate(found_q), np.concatenate(found_p), np.concatenate(found_s)
        order = np.lexsort((-s, q))
        q, p, s = q[order], p[order], s[order]
        last = np.arange(len(q)) - np.searchsorted(q, q) == k - 1
        kth = np.full(len(queries), -np.inf, np.float32)
        kth[q[last]] = s[last]
        keep = s >= kth[q] - np.float32(ROUNDING)
        return q[keep], p[keep]

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int, tau: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest points of each query but its own; places not filled hold -1. own: -1 or the query's point."""
        best_d = np.full((len(queries), k), np.inf, np.float32)
        best_p = np.full((len(queries), k), -1, np.int64)
        tau = tau.astype(np.float32) + np.float32(SLACK)

        def visit(node, q):
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                d = distance(queries[q], self.points[node])
                d[own[q][:, None] == node[None, :]] = np.inf
                all_d = np.concatenate((best_d[q], d), axis=1)
                all_p = np.concatenate((best_p[q], np.broadcast_to(node, d.shape)), axis=1)
                top = np.argpartition(all_d, k - 1, axis=1)[:, :k]
                best_d[q], best_p[q] = np.take_along_axis(all_d, top, 1), np.take_along_axis(all_p, top, 1)
                tau[q] = np.minimum(tau[q], best_d[q].max(axis=1) + np.float32(SLACK))
                return
            vantage, m, inside, outside = node
            gap = distance(queries[q], self.points[[vantage]])[:, 0] - m
            near_in = gap <= 0
            visit(inside, q[near_in])
            visit(outside, q[~near_in])
            reach = factor * np.abs(gap) <= tau[q]
            visit(outside, q[near_in & reach])
            visit(inside, q[~near_in & reach])

        visit(self.root, np.arange(len(queries)))
        best_p[~np.isfinite(best_d)] = -1
        return best_d, best_p


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Cells:
    """The tree that names a vector's cell and the cells a query may have to visit."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 3):
        self.points, self.count = [], 0
        rng = np.random.default_rng(seed)
        sample = sample.astype(np.float32)

        def build(at: np.ndarray, want: int):
            if want <= 1 or len(at) < 4:
                self.count += 1
                return self.count - 1
            trial = at[rng.integers(0, len(at), 6)]
            probe = at[rng.integers(0, len(at), 128)]
            vantage = int(trial[int(np.argmax([np.var(distance(sample[probe], sample[[t]])) for t in trial]))])
            d = distance(sample[at], sample[[vantage]])[:, 0]
            low = want // 2
            m = float(np.quantile(d, low / want))
            near = d <= m
            if near.all() or not near.any():
                self.count += 1
                return self.count - 1
            self.points.append(sample[vantage])
            me = len(self.points) - 1
            return me, m, build(at[near], low), build(at[~near], want - low)

        self.root = build(np.arange(len(sample)), cells) if len(sample) else self._single()
        self.points = np.array(self.points, np.float32) if self.points else np.empty((0, 1), np.float32)

    def _single(self) -> int:
        self.count = 1
        return 0

    def home(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, int):
                out[at] = node
            elif len(at):
                v, m, inside, outside = node
                near = distance(x[at], self.points[[v]])[:, 0] <= m
                stack += [(inside, at[near]), (outside, at[~near])]
        return out

    def reach(self, x: np.ndarray, tau: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) for every cell not ruled out."""
        q_out, c_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, int):
                q_out.append(at)
                c_out.append(np.full(len(at), node))
            elif len(at):
                v, m, inside, outside = node
                gap = distance(x[at], self.points[[v]])[:, 0] - m
                stack += [(inside, at[factor * gap <= tau[at] + SLACK]), (outside, at[factor * -gap <= tau[at] + SLACK])]
        return np.concatenate(q_out), np.concatenate(c_out)


def _matrix(col: pa.Array) -> np.ndarray:
    col = as_array(col)
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), -1)


def _clean(fields: list[str], dim: int | None):
    """Raw vector columns -> one row per usable vector: field, text_id, vec (bytes of float32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, name in enumerate(fields):
                value, (row, _), ok = walk(batch.column(name), 1)
                n = np.bincount(row, minlength=batch.num_rows)
                bad = np.bincount(row[~(ok & np.isfinite(value))], minlength=batch.num_rows) > 0
                size = np.bincount(row, weights=np.where(ok, np.abs(np.nan_to_num(value, posinf=1, neginf=1)), 0), minlength=batch.num_rows)
                use = (n > 0) & ~bad & (size > 0) & ((n == dim) if dim else True)
                starts = np.cumsum(n) - n
                flat = (value.astype(np.float32) + np.float32(0)).tobytes()
                rows = np.flatnonzero(use)
                vec = [flat[4 * starts[r] : 4 * (starts[r] + n[r])] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), f), pa.int32()), batch.column("text_id").take(pa.array(rows)), pa.array(vec, pa.binary())], names=["field", "text_id", "vec"])

    return run


_PROBE = "field int, cell bigint, sub int, flag int, id string, vec binary, ids array<string>, is_query boolean, tau double, home bigint"


def _locate(cells: dict[int, Cells]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            field, out = batch.column("field").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for f in np.unique(field):
                at = np.flatnonzero(field == f)
                out[at] = cells[int(f)].home(unit(_matrix(batch.column("vec").take(pa.array(at)))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("field", "id", "vec", "ids", "is_query")], pa.array(out)], names=["field", "id", "vec", "ids", "is_query", "cell"])

    return run


def _route(cells: dict[int, Cells], factor: float, skip_home: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            field, tau, home = batch.column("field").to_numpy(), batch.column("tau").to_numpy(), batch.column("home").to_numpy()
            for f in np.unique(field):
                at = np.flatnonzero(field == f)
                q, c = cells[int(f)].reach(unit(_matrix(batch.column("vec").take(pa.array(at)))).astype(np.float32), tau[at], factor)
                if skip_home:
                    keep = c != home[at][q]
                    q, c = q[keep], c[keep]
                rows = batch.take(pa.array(at[q]))
                yield pa.RecordBatch.from_arrays([rows.column("field"), pa.array(c, pa.int64()), rows.column("id"), rows.column("vec"), rows.column("tau"), rows.column("home")], names=["field", "cell", "id", "vec", "tau", "home"])

    return run


_HIT_NAMES = ["field", "id", "other", "similarity", "other_ids"]
_HIT = "field int, id string, other string, similarity double, other_ids array<string>"


def _search(k: int, factor: float, radius: float | None):
    """Rows arrive sorted by (field, cell, sub, replica, flag): a shard's vectors, then the queries that visit it."""

    def answer(tree: Tree, data: pa.Table, x: np.ndarray, queries: pa.RecordBatch, places: dict[str, int]):
        raw = unit(_matrix(queries.column("vec")))
        q = raw.astype(np.float32)
        ids = queries.column("id").to_pylist()
        own = np.array([places.get(x, -1) for x in ids])
        if radius is not None:
            i, j = tree.within(q, own, k, radius, factor)
        else:
            _, p = tree.nearest(q, own, k, queries.column("tau").to_numpy(), factor)
            i, c = np.nonzero(p >= 0)
            j = p[i, c]
        sim = np.empty(len(i))
        for a in range(0, len(i), EXACT_ROWS):  # a dense ball of near copies gives many pairs
            b = slice(a, a + EXACT_ROWS)
            sim[b] = np.einsum("ij,ij->i", raw[i[b]], x[j[b]])
        if len(i):  # the k best of each query in this shard
            order = np.lexsort((j, -sim, i))
            i, j, sim = i[order], j[order], sim[order]
            start = np.searchsorted(i, i)
            # ties at the k-th place stay: the merge decides them by id
            place = np.arange(len(i)) - start
            kth = np.full(len(queries), -np.inf)
            last = place == k - 1
            kth[i[last]] = sim[last]
            keep = sim >= kth[i]
            i, j, sim = i[keep], j[keep], sim[keep]
        take = pa.array(j, pa.int64())
        return pa.RecordBatch.from_arrays([as_array(queries.column("field").take(pa.array(i, pa.int64()))), as_array(queries.column("id").take(pa.array(i, pa.int64()))), as_array(data.column("id").take(take)), pa.array(sim, pa.float64()), as_array(data.column("ids").take(take))], names=_HIT_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        data = x = places = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("field", "cell", "sub", "replica", "flag")], axis=1)
            cuts = np.flatnonzero((np.diff(shard, axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                part, me, flag = batch.slice(a, b - a), tuple(shard[a, :4]), shard[a, 4]
                if me != key:
                    key, held, tree = me, [], None
                if flag == 0:
                    held.append(part.select(["id", "vec", "ids"]))
                elif held:
                    if tree is None:
                        data = pa.Table.from_batches(held).combine_chunks()
                        x = unit(_matrix(data.column("vec")))
                        tree, places = Tree(x), {i: n for n, i in enumerate(data.column("id").to_pylist())}
                    for at in range(0, len(part), SLICE_QUERIES):
                        yield answer(tree, data, x, part.slice(at, SLICE_QUERIES), places)

    return run


def _probe(data: DataFrame, routed: DataFrame, k: int, factor: float, radius: float | None) -> DataFrame:
    """data: field, cell, sub, id, vec, ids; routed: field, cell, id, vec, tau -> hits."""
    # One row per sub-shard: its number grows with the data only through rows / cell_rows, far below any row count.
    shards = data.select("field", "cell", "sub").distinct()
    load = routed.groupBy("field", "cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("replicas"))
    shape = shards.join(load, ["field", "cell"])
    each = routed.join(shape, ["field", "cell"]).withColumn("replica", F.pmod(F.xxhash64("id"), F.col("replicas")).cast("int"))
    visits = each.select("field", "cell", "sub", "replica", F.lit(1).alias("flag"), "id", "vec", F.lit(None).cast("array<string>").alias("ids"), "tau")
    copies = data.join(load, ["field", "cell"]).withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("replicas") - 1)))
    held = copies.select("field", "cell", "sub", "replica", F.lit(0).alias("flag"), "id", "vec", "ids", F.lit(0.0).alias("tau"))
    keys = ["field", "cell", "sub", "replica"]
    rows = held.unionByName(visits).repartition(*keys).sortWithinPartitions(*keys, "flag", "id")
    return rows.mapInArrow(_search(k, factor, radius), _HIT)


def nearest(df: DataFrame, fields: list[str], k: int = K, factor: float = FACTOR, min_similarity: float | None = None, query: str = "true", dim: int | None = None, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The k most similar other texts of every text, by cosine, in each of the vector columns ``fields``.

    ``df``: text_id and the array columns. ``query`` is a SQL condition on text_id that names the texts to find
    neighbours for; all texts are searched. ``min_similarity`` leaves out neighbours below it (they still do
    not push others out: the k best at or above it are returned). Returns field, text_id, neighbour, similarity.

    Null arrays, arrays holding a null, NaN or infinity, empty and all-zero arrays, and (with ``dim``) arrays of
    another length are no vectors. Equal similarities are ordered by the neighbour's id. Repeated text ids must
    have been removed; null ids are dropped; extra columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    vectors = df.where("text_id is not null").select("text_id", *fields).mapInArrow(_clean(fields, dim), "field int, text_id string, vec binary")
    # The k + 1 least ids stand for a class of copies; the group limit before the shuffle bounds what a hot class sends.
    least = Window.partitionBy("field", "vec").orderBy("text_id")
    vectors = cut_lineage(vectors.withColumn("wanted", F.expr(query)))  # read three times
    first = vectors.withColumn("r", F.row_number().over(least)).where(f"r <= {k + 1}")
    ids = first.groupBy("field", "vec").agg(F.array_sort(F.collect_list("text_id")).alias("ids"))
    sizes = vectors.groupBy("field", "vec").agg(F.count("*").alias("n"), F.max("wanted").alias("is_query"))
    reps = cut_lineage(ids.join(sizes, ["field", "vec"]).withColumn("id", F.col("ids")[0]))

    counts = {r["field"]: r["n"] for r in reps.groupBy("field").agg(F.count("*").alias("n")).collect()}  # one row per field
    cells: dict[int, Cells] = {}
    for f, n in counts.items():
        want = -(-n // cell_rows)
        # A bounded sample fitted on the driver: sample_rows vectors whatever the size of the table.
        picked = reps.where(F.col("field") == f).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vec").collect() if want > 1 else []
        sample = np.frombuffer(b"".join(bytes(r["vec"]) for r in picked), np.float32).reshape(len(picked), -1) if picked else np.empty((0, 1), np.float32)
        cells[f] = Cells(unit(sample) if len(sample) else sample, want)

    located = reps.select("field", "id", "vec", "ids", "is_query").mapInArrow(_locate(cells), "field int, id string, vec binary, ids array<string>, is_query boolean, cell bigint")
    filled = located.groupBy("field", "cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("subs"))
    data = located.join(filled, ["field", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))
    radius = float(np.sqrt(max(2 - 2 * min_similarity, 0))) if min_similarity is not None else None
    asked = data.where("is_query").select("field", "cell", "id", "vec", F.lit(radius if radius is not None else 2.0).alias("tau"), F.col("cell").alias("home"))
    routed_type = "field int, cell bigint, id string, vec binary, tau double, home bigint"
    if radius is not None:
        hits = _probe(data, asked.mapInArrow(_route(cells, factor, False), routed_type), k, factor, radius)
    else:
        near = cut_lineage(_probe(data, asked, k, factor, None))
        kth = near.groupBy("field", "id").agg(F.count("*").alias("got"), F.min("similarity").alias("worst"))
        bound = asked.drop("tau").join(kth, ["field", "id"], "left").withColumn("tau", F.when(F.col("got") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("worst")))).otherwise(2.0))
        far = _probe(data, bound.select("field", "cell", "id", "vec", "tau", "home").mapInArrow(_route(cells, factor, True), routed_type), k, factor, None)
        hits = near.unionByName(far)
    if min_similarity is not None:
        hits = hits.where(F.col("similarity") >= min_similarity)
    best = Window.partitionBy("field", "id").orderBy(F.desc("similarity"), "other")
    hits = hits.withColumn("r", F.row_number().over(best)).where(f"r <= {k}").select("field", "id", "similarity", "other_ids")

    # Members of a class: its own other ids at similarity 1, then the ids of the neighbouring classes.
    mine = reps.where("is_query").select("field", "id", F.explode("ids").alias("text_id"))
    own = reps.where("is_query and n > 1").select("field", "id", F.lit(1.0).alias("similarity"), F.col("ids").alias("other_ids"))
    offered = hits.unionByName(own).withColumn("neighbour", F.explode("other_ids")).drop("other_ids")
    pairs = mine.join(offered, ["field", "id"]).where("text_id <> neighbour")
    rest = first_rest(vectors, reps, k)
    top = Window.partitionBy("field", "text_id").orderBy(F.desc("similarity"), "neighbour")
    out = pairs.select("field", "text_id", "neighbour", "similarity").where(query).unionByName(rest.where(query))
    out = out.withColumn("r", F.row_number().over(top)).where(f"r <= {k}")
    name = F.element_at(F.array(*[F.lit(x) for x in fields]), F.col("field") + 1)
    return out.select(name.alias("field"), "text_id", "neighbour", "similarity")


def first_rest(vectors: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Members of classes of more than k + 1 copies beyond those k + 1: the k least ids are their neighbours."""
    large = reps.where(f"n > {k + 1}").select("field", "vec", "ids")
    beyond = vectors.join(large, ["field", "vec"]).where(~F.array_contains("ids", F.col("text_id")))
    return beyond.select("field", "text_id", F.explode(F.slice("ids", 1, k)).alias("neighbour"), F.lit(1.0).alias("similarity"))


def _last_layers(spark: SparkSession, folder: str) -> DataFrame:
    last = [F.try_element_at(c, F.lit(-1)).alias(c) for c in ("hs_last_token", "hs_mean")]
    return current(payload_rows(spark, folder, PASS_ALL, last))


def p6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar texts of every text whose number is divisible by 50, against all texts."""
    number = "try_cast(regexp_extract(text_id, '([0-9]+)$', 1) as decimal(38,0)) % 50 = 0"
    out = nearest(_last_layers(spark, folder), ["hs_last_token", "hs_mean"], query=number)
    return out.withColumn("similarity", F.round("similarity", 6))


def p6_found(spark: SparkSession, folder: str, least: float = 0.98) -> DataFrame:
    """Pairs of texts with a cosine of at least 0.98 of which one is among the other's 5 most similar; exact."""
    out = nearest(_last_layers(spark, folder), ["hs_last_token", "hs_mean"], factor=1.0, min_similarity=least)
    return out.select("field", F.least("text_id", "neighbour").alias("text_id_a"), F.greatest("text_id", "neighbour").alias("text_id_b")).distinct()


QUERIES = {"p6_neighbours": p6_neighbours, "p6_found": p6_found}

_SQL = """
with cur as (
  select text_id, hs_last_token[-1] as h1, hs_mean[-1] as h2 from (
    select *, row_number() over (partition by text_id order by written_at desc, loaded_at desc) as rk
    from payloads where pass_name = 'rerouted' and text_id is not null) where rk = 1),
v as (select 'hs_last_token' as field, text_id, cast(h1 as double[]) as v from cur where h1 is not null
  union all select 'hs_mean', text_id, cast(h2 as double[]) from cur where h2 is not null),
u as (select field, text_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from v
  where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0),
w as (select * from u where n > 0),
s as (select a.field, a.text_id as x, b.text_id as y, list_dot_product(a.v, b.v) / (a.n * b.n) as c
  from w a join w b on a.field = b.field and a.text_id <> b.text_id),
r as (select *, row_number() over (partition by field, x order by c desc, y) as rk from s)
"""
ORACLE = {
    "p6_neighbours": _SQL + "select field, x as text_id, y as neighbour, round(c, 6) as similarity from r where rk <= 5 and try_cast(regexp_extract(x, '([0-9]+)$', 1) as decimal(38,0)) % 50 = 0",
    "p6_found": _SQL + "select distinct field, least(x, y) as text_id_a, greatest(x, y) as text_id_b from r where rk <= 5 and c >= 0.98",
}
