"""Scores of a stated query set against all documents: cosine, sparse cosine, late interaction, fusion, reranking.

Dense scores are computed block by block: queries and documents are packed into blocks of a bounded number of
vectors, each query block meets each document block through an equi-join on the block number, and one matrix
product per pair of blocks gives the scores, of which only each query's best go on to the merge.

Where only the judged documents among each query's best count, :func:`judged_ranks` holds a group of queries in a task
and lets all documents stream past it: no candidate ever leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routescope.functions.nested import as_array
from routescope.functions.vectors import EPS, dot
from routescope.session import cut_lineage

QUERY_BLOCK, DOC_BLOCK = 1024, 4096
DIGITS = 6
SEARCH_ROWS = 8192
CHUNK_ROWS = 1024
SCORE_BITS, PLACE_BITS = 21, 42


def _stack(col: pa.ListScalar | pa.Array) -> np.ndarray:
    flat = col.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _multiply(k: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, d = batch.column("q")[i].values, batch.column("d")[i].values
                if not len(q) or not len(d):
                    continue
                scores = _stack(q.field("vec")) @ _stack(d.field("vec")).T
                names = d.field("id")
                row, col = _chosen(scores, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), batch.column("pass_name")[i].as_py())), q.field("id").take(pa.array(row)), names.take(pa.array(col)), pa.array(scores[row, col])], names=["pass_name", "query_id", "doc_id", "score"])

    return run


def _blocks(df: DataFrame, rows: int, total: int, name: str) -> DataFrame:
    count = max(1, -(-total // rows))
    block = F.pmod(F.xxhash64("text_id"), F.lit(count)).cast("int")
    return df.groupBy("pass_name", block.alias(name)).agg(F.collect_list(F.struct(F.col("text_id").alias("id"), "vec")).alias(name[0]))


def dense_scores(queries: DataFrame, docs: DataFrame, k: int | None, query_block: int = QUERY_BLOCK, doc_block: int = DOC_BLOCK) -> DataFrame:
    """Dot products of normalised vectors; with ``k`` only each query's k best (by rounded score, then document id).

    ``queries``, ``docs``: pass_name, text_id, vec. Returns pass_name, query_id, doc_id, score. A block's size is bounded
    by ``*_block`` times the spread of the hash, whatever the number of rows; no side is broadcast.
    """
    dtype = dict(docs.dtypes)["text_id"]
    nq = queries.count()
    nd = docs.count()
    q = _blocks(queries.select("pass_name", "text_id", "vec"), query_block, nq, "q_block")
    d = _blocks(docs.select("pass_name", "text_id", "vec"), doc_block, nd, "d_block")
    reach = F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-nd // doc_block)) - 1))).alias("d_block")
    met = q.select("pass_name", "q", reach).join(d, ["pass_name", "d_block"])
    scores = met.select("pass_name", "q", "d").mapInArrow(_multiply(k), f"pass_name string, query_id {dtype}, doc_id {dtype}, score double")
    return scores if k is None else best(scores, k).drop("rank")


def best(scores: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query with their rank: falling rounded score, then document id."""
    w = Window.partitionBy(*[c for c in ("method", "pass_name") if c in scores.columns], "query_id").orderBy(F.desc(F.round("score", DIGITS)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Best:
    """The k best of documents that come in the order of their ids, for n queries: falling rounded cosine, then id.

    A candidate is one number: its query, its rounded score from above and its document's place, so that sorted numbers
    are ranked candidates. Once a query has k documents, a later one must have a greater rounded score to count.
    """

    def __init__(self, n: int, k: int):
        self.k, self.n, self.seen = k, n, 0
        self.doc_bits = PLACE_BITS - max(n - 1, 1).bit_length()
        self.held, self.late = np.empty(0, np.int64), []
        self.bar = np.full((n, 1), -np.inf)

    def add(self, queries: np.ndarray, rows: np.ndarray, docs: np.ndarray, places: np.ndarray) -> None:
        """Unit vectors of the queries ``rows`` and of the documents at ``places``."""
        if len(places) and places[-1] >> self.doc_bits:
            raise OverflowError(f"more than {1 << self.doc_bits} documents for a group of {self.n} queries")
        lo = 0
        while lo < len(docs):
            hi = lo + min(max(self.seen, 128), CHUNK_ROWS)  # the first chunks are small: they have no bar yet
            scores = queries @ docs[lo:hi].T
            row, col = np.nonzero(scores >= self.bar[rows])
            x = scores[row, col]
            rounded = (np.sign(x) * np.floor(np.abs(x) * 10.0**DIGITS + 0.5)).astype(np.int64)
            self.late.append((rows[row] << SCORE_BITS | ((1 << SCORE_BITS - 1) - rounded)) << self.doc_bits | places[lo:hi][col])
            self.seen += scores.shape[1]
            lo = hi
            if 2 * sum(map(len, self.late)) > len(self.held):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, rank and document's place of the best so far."""
        keys = np.sort(np.concatenate([self.held, *self.late]))
        row = keys >> SCORE_BITS + self.doc_bits
        rank = np.arange(1, len(keys) + 1) - np.searchsorted(row, np.arange(self.n))[row]
        best = rank <= self.k
        self.held, self.late, row, rank = keys[best], [], row[best], rank[best]
        last = rank == self.k
        kth = (1 << SCORE_BITS - 1) - (self.held[last] >> self.doc_bits & (1 << SCORE_BITS) - 1)
        self.bar[row[last], 0] = (kth + 0.4) / 10.0**DIGITS
        return row, rank, self.held & (1 << self.doc_bits) - 1


def _mixed(columns: list[pa.Array], weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose vectors of a weight are all there and finite, and the unit vectors of their weighted sums."""
    whole, total = np.ones(len(columns[0]), bool), None
    for col, w in zip(columns, weights, strict=True):
        if w:
            n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            flat, row = col.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
            good = (n > 0) & (np.bincount(row[~np.isfinite(flat)], minlength=len(n)) == 0)
            dims = np.unique(n[good])
            if len(dims) > 1:
                raise ValueError(f"vectors of {dims[0]} and {dims[-1]} dimensions")
            whole &= good
            if not whole.any():
                return np.empty(0, np.int64), np.empty((0, 0))
            full = np.zeros((len(n), dims[0]))
            full[good] = w * flat[good[row]].reshape(-1, dims[0]).astype(np.float64)
            total = full if total is None else total + full
    rows = np.flatnonzero(whole)
    vecs = total[rows]
    return rows, vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), EPS)


class _Group:
    """The queries of one slot, all methods of its family, and the documents that stream past."""

    def __init__(self, pass_name: str, methods: dict[str, list[float]], k: int):
        self.pass_name, self.methods, self.k = pass_name, methods, k
        self.queries, self.docs, self.made, self.places = [], [], None, 0

    def start(self) -> None:
        if self.made is None and self.queries:
            table = pa.Table.from_batches(self.queries).combine_chunks()
            self.ids, self.wanted = as_array(table.column("text_id")), as_array(table.column("wanted"))
            columns = [as_array(table.column(c)) for c in table.column_names if c[0] == "v" and c[1:].isdigit()]
            self.made = {m: (*_mixed(columns[: len(w)], w), _Best(len(self.ids), self.k)) for m, w in self.methods.items()}

    def add(self, part: pa.RecordBatch) -> None:
        if part.column("wanted")[0].is_valid:
            self.queries.append(part)
            return
        self.start()
        if self.made is None:
            return
        columns = [part.column(c) for c in part.schema.names if c[0] == "v" and c[1:].isdigit()]
        for m, w in self.methods.items():
            rows, vecs = _mixed(columns[: len(w)], w)
            mine, queries, best = self.made[m]
            if len(rows) and len(mine):
                best.add(queries, mine, vecs, self.places + rows)
        self.docs.append(part.column("text_id").take(pa.array(np.arange(part.num_rows))))  # a copy: a slice would keep the batch
        self.places += part.num_rows

    def ranks(self) -> Iterator[pa.RecordBatch]:
        if self.made is None or not self.docs:
            return
        names = pa.concat_arrays(self.docs)
        at = pc.index_in(self.wanted.flatten(), value_set=names).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(self.ids)), pc.list_value_length(self.wanted).to_numpy(zero_copy_only=False))
        there = ~np.isnan(at)
        judged = row[there] << 32 | at[there].astype(np.int64)
        for m, (_, _, best) in self.made.items():
            row, rank, place = best.settle()
            keep = np.isin(row << 32 | place, judged) | (rank == 1)
            row, rank, place = row[keep], rank[keep], place[keep]
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(row), pa.string()), pa.array([self.pass_name] * len(row), pa.string()), self.ids.take(pa.array(row)), names.take(pa.array(place)), pa.array(rank, pa.int32())], names=["method", "pass_name", "query_id", "doc_id", "rank"])


def _stream(families: list[dict[str, list[float]]], k: int):
    """Rows arrive sorted by (slot, queries first, text_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, group = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            slots = batch.column("slot").to_numpy()
            doc = batch.column("wanted").is_null().to_numpy(zero_copy_only=False)
            turns = np.flatnonzero(np.concatenate(([True], (slots[1:] != slots[:-1]) | (doc[1:] != doc[:-1]))))
            for lo, hi in zip(turns, [*turns[1:], batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if slots[lo] != slot:
                    if group is not None:
                        yield from group.ranks()
                    slot, group = slots[lo], _Group(part.column("pass_name")[0].as_py(), families[part.column("family")[0].as_py()], k)
                group.add(part)
        if group is not None:
            yield from group.ranks()

    return run


def judged_ranks(texts: DataFrame, passes: list[str], families: list[dict[str, dict[str, float]]], queries: int, k: int, group_rows: int = SEARCH_ROWS) -> DataFrame:
    """method, pass_name, query_id, doc_id, rank: of each query's k best documents by cosine (rounded, then by id) the
    first and those the query asks about.

    ``texts``: pass_name, text_id, wanted - the documents a query asks about, null for a document - and array columns;
    ``families``: sets of methods, each a weighted sum of array columns, whose arrays travel together; ``queries``: about
    how many queries a pass has. A text without a finite vector of a method has no rank by it. Of each pass and family
    about ``group_rows`` queries are held by a task and the documents stream past in the order of their ids, so the
    documents travel once a group and nothing but the result leaves it; a task holds the queries' vectors and k numbers
    a query and method.
    """
    parts, dtype = max(1, -(-queries // group_rows)), dict(texts.dtypes)["text_id"]
    columns = [sorted({c for m in f.values() for c in m}) for f in families]
    width = max(map(len, columns))
    kind = dict(texts.dtypes)[columns[0][0]]
    laid = [F.struct(F.lit(i).alias("family"), *[(F.col(own[j]) if j < len(own) else F.lit(None).cast(kind)).alias(f"v{j}") for j in range(width)]) for i, own in enumerate(columns)]
    part = F.when(F.col("wanted").isNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64("text_id"), F.lit(parts)).cast("int")))
    at = F.array_position(F.array(*[F.lit(p) for p in passes]).cast("array<string>"), F.col("pass_name")).cast("int") - 1
    spread = texts.withColumn("part", F.explode(part)).select("pass_name", "text_id", "wanted", "part", F.explode(F.array(*laid)).alias("f")).select("pass_name", "text_id", "wanted", "part", "f.*")
    slots = spread.withColumn("slot", (at * len(families) + F.col("family")) * parts + F.col("part"))
    ordered = slots.repartitionById(max(1, len(passes) * len(families) * parts), F.col("slot")).sortWithinPartitions("slot", F.col("wanted").isNull(), "text_id")
    weights = [{m: [w.get(c, 0.0) for c in own] for m, w in f.items()} for f, own in zip(families, columns, strict=True)]
    return ordered.drop("part").mapInArrow(_stream(weights, k), f"method string, pass_name string, query_id {dtype}, doc_id {dtype}, rank int")


def _sparse_blocks(k: int | None):
    def spread(side: pa.StructArray, dims: np.ndarray) -> np.ndarray:
        rows = side.field("row")
        n = np.diff(rows.offsets.to_numpy())
        flat = rows.flatten()
        out = np.zeros((len(side), len(dims)))
        np.add.at(out, (np.repeat(np.arange(len(side)), n), np.searchsorted(dims, flat.field("dim").to_numpy(zero_copy_only=False))), flat.field("w").to_numpy(zero_copy_only=False))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, d = batch.column("q")[i].values, batch.column("d")[i].values
                dims = np.unique(np.concatenate([x.field("row").flatten().field("dim").to_numpy(zero_copy_only=False) for x in (q, d)]))
                scores = spread(q, dims) @ spread(d, dims).T
                row, col = _chosen(scores, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), batch.column("pass_name")[i].as_py())), q.field("id").take(pa.array(row)), d.field("id").take(pa.array(col)), pa.array(scores[row, col])], names=["pass_name", "query_id", "doc_id", "score"])

    return run


def sparse_scores(queries: DataFrame, docs: DataFrame, k: int | None = None, query_block: int = QUERY_BLOCK, doc_block: int = DOC_BLOCK) -> DataFrame:
    """Cosine of sparse rows (pass_name, text_id, dim, w) of every query and document that has one; pairs without a common
    dimension score 0. Blocks of texts meet as in :func:`dense_scores`, so a dimension that most texts have is no key."""
    dtype = dict(docs.dtypes)["text_id"]

    def blocks(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
        texts = cut_lineage(df.groupBy("pass_name", "text_id").agg(F.collect_list(F.struct(F.col("dim").cast("bigint").alias("dim"), F.col("w").cast("double").alias("w"))).alias("row")))
        count = max(1, -(-texts.count() // rows))
        block = F.pmod(F.xxhash64("text_id"), F.lit(count)).cast("int")
        return texts.groupBy("pass_name", block.alias(name)).agg(F.collect_list(F.struct(F.col("text_id").alias("id"), "row")).alias(name[0])), count

    q, _ = blocks(queries, query_block, "q_block")
    d, many = blocks(docs, doc_block, "d_block")
    met = q.select("pass_name", "q", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("d_block")).join(d, ["pass_name", "d_block"])
    return met.select("pass_name", "q", "d").mapInArrow(_sparse_blocks(k), f"pass_name string, query_id {dtype}, doc_id {dtype}, score double")


def _chosen(scores: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """All places of a score matrix, or those whose rounded score reaches the row's k-th: the merge settles ties by id."""
    if k is None or k >= scores.shape[1]:
        return np.divmod(np.arange(scores.size), scores.shape[1])
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    return np.nonzero(scores >= kth - 10.0**-DIGITS)


def _max_sim(k: int | None):
    def lay(side: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        vecs = side.field("vecs")
        return _stack(vecs.flatten()), np.concatenate(([0], np.cumsum(np.diff(vecs.offsets.to_numpy()))[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, d = batch.column("q")[i].values, batch.column("d")[i].values
                if not len(q) or not len(d):
                    continue
                (qv, qs), (dv, ds) = lay(q), lay(d)
                scores = np.add.reduceat(np.maximum.reduceat(qv @ dv.T, ds, axis=1), qs, axis=0)
                row, col = _chosen(scores, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), batch.column("pass_name")[i].as_py())), q.field("id").take(pa.array(row)), d.field("id").take(pa.array(col)), pa.array(scores[row, col])], names=["pass_name", "query_id", "doc_id", "score"])

    return run


def packed(multi: DataFrame) -> DataFrame:
    """pass_name, text_id, vecs: a text's vectors in one array; bounded by the vectors of one text."""
    return multi.groupBy("pass_name", "text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_no", "vec"))), lambda s: s["vec"]).alias("vecs"))


def max_sim(queries: DataFrame, docs: DataFrame, k: int | None = None, query_block: int = 64, doc_block: int = 512) -> DataFrame:
    """Late interaction: the sum over the query's vectors of the greatest dot product with any of the document's.

    Maxima may be negative. With ``k`` a pair of blocks passes on only each query's k best. Same block scheme as :func:`dense_scores`, over texts packed with all their vectors.
    """
    dtype = dict(docs.dtypes)["text_id"]

    def blocks(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
        texts = packed(df)
        count = max(1, -(-df.select("pass_name", "text_id").distinct().count() // rows))
        block = F.pmod(F.xxhash64("text_id"), F.lit(count)).cast("int")
        return texts.groupBy("pass_name", block.alias(name)).agg(F.collect_list(F.struct(F.col("text_id").alias("id"), "vecs")).alias(name[0])), count

    q, _ = blocks(queries, query_block, "q_block")
    d, many = blocks(docs, doc_block, "d_block")
    met = q.select("pass_name", "q", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("d_block")).join(d, ["pass_name", "d_block"])
    return met.select("pass_name", "q", "d").mapInArrow(_max_sim(k), f"pass_name string, query_id {dtype}, doc_id {dtype}, score double")


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Late interaction for given candidates (pass_name, query_id, doc_id) only; equi-joins, expression kernels."""
    q = queries.select("pass_name", F.col("text_id").alias("query_id"), F.col("vec_no").alias("q_no"), F.col("vec").alias("qv"))
    d = packed(docs).select("pass_name", F.col("text_id").alias("doc_id"), "vecs")
    met = candidates.select("pass_name", "query_id", "doc_id").join(d, ["pass_name", "doc_id"]).join(q, ["pass_name", "query_id"])
    near = met.select("pass_name", "query_id", "doc_id", F.array_max(F.transform("vecs", lambda v: dot(v, F.col("qv")))).alias("near"))
    return near.groupBy("pass_name", "query_id", "doc_id").agg(F.sum("near").alias("score"))


def fuse(a: DataFrame, b: DataFrame, weight: float, other: Column | None = None) -> DataFrame:
    """weight x a + (1 - weight) x b on raw scores of the full matrix."""
    keys = ["pass_name", "query_id", "doc_id"]
    both = a.select(*keys, F.col("score").alias("x")).join(b.select(*keys, F.col("score").alias("y")), keys)
    return both.select(*keys, (weight * F.col("x") + (1 - weight) * F.col("y")).alias("score"))
