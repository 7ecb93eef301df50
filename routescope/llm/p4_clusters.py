"""Problem 4: clusters of mutually similar records, with their sizes and most typical members.

Parallel pivot clustering. Records similar in both of two vectors are linked. In a first round every record
falls into the buckets of a few hash tables; in each bucket the record that comes first in hash
order is a pivot and absorbs the records similar to it, then the first one left is the next pivot, until none
is left. This round only makes the cores of the groups: a record may be absorbed by a pivot it is not linked
to, or hang on a member that is no pivot. So further rounds compare, in the buckets of the planned tables, all
pairs of records of different groups, pivots or not: one over a quarter of the tables that takes the few most
alike pairs of two groups, one over all tables that takes every pair. Candidate links are tested on bit
sketches inside the bucket, then on vectors of a byte an element, and where these leave it open (their error is
known) verified with the exact cosines of both vectors; verified links join the
records' groups (by connected components). Finally each member goes to the closest pivot of its group and each
group gets its medoid.

Recall: a table hashes a vector by the nearest of the 2 m corners of a cross-polytope under a random projection, as
often as its bits ask for. The chance that two vectors of a given cosine share a bucket depends on that cosine alone
and is measured once by a seeded simulation. The number of tables grows with the bits so that two records that only
just reach both thresholds miss each other in all tables with probability ``miss`` at most, at every table size.
The bits leave about 32 unlike records in a bucket: comparing them is cheap. Tables for 3,000 / 30,000 / 300,000 /
4 million / 1,000 million records: 32 / 44 / 80
/ 188 / 920.

Skew: exact copies are merged first. In the first round a bucket above ``bucket_rows`` is split by a hash of
bucket and record, so a group with a third of all rows forms one star per split and the stars join. In the
further rounds such a bucket becomes cells of at most twice ``bucket_rows`` in which every two records of
different groups still meet: the records of its largest group are spread, the others are sent to each of the
cells, and the others' blocks meet each other in cells of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routescope.functions.nested import as_array, walk
from routescope.operators.components import components
from routescope.session import cut_lineage
from routescope.sources.tables import PASS_PAPER, current, payload_rows

MIN_A, MIN_B = 0.75, 0.8
MISS = 1e-3
SKETCH_BITS = 128
SIGMAS = 4.5
BUCKET_ROWS = 20000
TYPICAL = 3
MIN_SIZE = 3
FEW = 4
PIVOTS_AT_ONCE = 256
PAIRS_AT_ONCE = 1 << 20
BROADCAST_IDS = 500_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _planes(seed: int, dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, count)).astype(np.float32)


def _matrix(col: pa.Array) -> np.ndarray:
    col = as_array(col)
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), -1)


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _coarse(x: np.ndarray) -> np.ndarray:
    """Unit vectors in steps of a 127th of their largest element: [n, 8 + dim] bytes, the step and the error first."""
    x = _unit(x)
    step = np.abs(x).max(axis=1, keepdims=True) / 127
    q = np.rint(np.divide(x, step, out=np.zeros_like(x), where=step > 0))
    error = np.linalg.norm(x - q * step, axis=1, keepdims=True)
    head = np.concatenate((step, error * (1 + 1e-5) + 1e-6), axis=1).astype(np.float32)
    return np.concatenate((head.view(np.uint8), q.astype(np.int8).view(np.uint8)), axis=1)


def _coarse_cosine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of coarse vectors and how far off they can be."""
    (sx, ex), (sy, ey) = (np.ascontiguousarray(z[:, :8]).view(np.float32).astype(np.float64).T for z in (x, y))
    dot = np.einsum("ij,ij->i", *(z[:, 8:].view(np.int8).astype(np.float32) for z in (x, y)))
    return sx * sy * dot, ex * (1 + ey) + ey


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b vectors -> two 128-bit sketches laid end to end, and both vectors in a byte an element."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [(_unit(_matrix(batch.column(c))).astype(np.float32) @ _planes(s, len(batch.column(c)[0].as_py()) // 4, SKETCH_BITS)) > 0 for c, s in (("a", 101), ("b", 202))]
        words = np.concatenate([_words(x) for x in parts], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("a"), batch.column("b"), pa.array([x.tobytes() for x in words], pa.binary()), *[pa.array([x.tobytes() for x in _coarse(_matrix(batch.column(c)))], pa.binary()) for c in "ab"]], names=["id", "a", "b", "sketch", "ca", "cb"])


def corners(x: np.ndarray, seed: int, hashes: int, m: int) -> np.ndarray:
    """Bucket of each row: the nearest corner of a cross-polytope in each of ``hashes`` random m-dimensional projections."""
    y = (x @ _planes(seed, x.shape[1], hashes * m)).reshape(len(x), hashes, m)
    at = np.abs(y).argmax(axis=2)
    corner = 2 * at + (np.take_along_axis(y, at[:, :, None], 2)[:, :, 0] > 0)
    return corner @ (np.int64(2 * m) ** np.arange(hashes, dtype=np.int64))


@lru_cache(maxsize=256)
def share_corner(cosine: float, m: int) -> float:
    """The probability that vectors of this cosine share a corner, three standard errors below a seeded simulation."""
    rng, n, same = np.random.default_rng(9), 100_000, 0
    for _ in range(10):
        x = rng.standard_normal((n // 10, m), np.float32)
        y = cosine * x + math.sqrt(1 - cosine**2) * rng.standard_normal((n // 10, m), np.float32)
        i, j, r = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1), np.arange(len(x))
        same += int(((i == j) & (x[r, i] * y[r, j] > 0)).sum())
    p = same / n
    return p - 3 * math.sqrt(p * (1 - p) / n)


def _bucket(tables: range, hashes: int, m: int):
    """id, label, sketch, a, b -> the bucket of every table; of four tables one hashes a, the others b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = {c: _unit(_matrix(batch.column(c))).astype(np.float32) for c in ("a", "b")}
            keys = np.empty((batch.num_rows, len(tables)), np.int64)
            for i, t in enumerate(tables):
                keys[:, i] = (corners(vec["a" if t % 4 == 3 else "b"], 1000 + t, hashes, m) if hashes else 0) + (t << 40)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("sketch"), pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), len(tables)).cast(pa.list_(pa.int64()))], names=["id", "label", "sketch", "buckets"])

    return run


def _least_equal(cosine: float) -> float:
    """Fewest equal sketch bits accepted for a cosine; SIGMAS standard deviations below the expected number."""
    p = 1 - math.acos(cosine) / math.pi
    return SKETCH_BITS * p - SIGMAS * math.sqrt(SKETCH_BITS * p * (1 - p))


def _absorb(min_a: float, min_b: float):
    """Rows arrive sorted by (bucket, sub, order): pivots absorb similar rows in rounds; yields candidate links."""
    need_a, need_b = _least_equal(min_a), _least_equal(min_b)

    def links(key: np.ndarray, words: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(key)
        start = np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))
        run = np.cumsum(start) - 1
        size = np.bincount(run)
        free = np.ones(n, bool)
        pivot = np.zeros(n, bool)
        x_out, p_out = [], []
        live = np.flatnonzero(size[run] > 1)
        pivot[size[run] == 1] = True
        while len(live):
            here = live[free[live]]
            if not len(here):
                break
            first = here[np.unique(run[here], return_index=True)[1]]  # the first row left of each bucket
            free[first] = False
            pivot[first] = True
            of_run = np.full(len(size), -1)
            of_run[run[first]] = first
            rows = live[(of_run[run[live]] >= 0) & (live > of_run[run[live]])]
            p = of_run[run[rows]]
            if len(rows):
                same = SKETCH_BITS - np.bitwise_count(words[rows] ^ words[p]).reshape(len(rows), 2, -1).sum(axis=2, dtype=np.int64)
                near = (same[:, 0] >= need_a) & (same[:, 1] >= need_b)
                rows, p = rows[near], p[near]
                free[rows] = False
                apart = label[rows] != label[p]
                x_out.append(rows[apart])
                p_out.append(p[apart])
            done = np.zeros(len(size), bool)
            done[run[here]] = True
            live = live[done[run[live]]]
        cat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return cat(x_out), cat(p_out), pivot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            key = np.stack([whole.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "sub")], axis=1)
            words = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), np.uint64).reshape(whole.num_rows, -1)
            label = whole.column("label").to_numpy(zero_copy_only=False)
            x, p, pivot = links(key, words, label)
            ids = whole.column("id")
            yield pa.RecordBatch.from_arrays([as_array(ids.take(pa.array(x))), as_array(ids.take(pa.array(p)))], names=["x", "p"])
            # A bucket may go on in the next batch: its pivots, which are similar to none of each other, go along.
            last = (key == key[-1]).all(axis=1) & pivot
            held = whole.take(pa.array(np.flatnonzero(last)))

    return run


def _best(score: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` highest scores of every (left, right)."""
    order = np.lexsort((-score, right, left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))[: len(order)])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < most]


def _across(min_a: float, min_b: float, most: int | None):
    """Rows arrive sorted by (bucket, sub, label): candidate links among all pairs of different labels of a bucket,
    or only the ``most`` most alike pairs of any two labels of it."""
    need_a, need_b = _least_equal(min_a), _least_equal(min_b)

    def links(key: np.ndarray, words: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(key)
        fresh = np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))
        start = np.flatnonzero(fresh)
        run_end = np.append(start[1:], n)[np.cumsum(fresh) - 1]
        turn = fresh | np.concatenate(([True], label[1:] != label[:-1]))
        start = np.flatnonzero(turn)
        part = np.cumsum(turn) - 1
        part_end = np.append(start[1:], n)[part]
        count = run_end - part_end  # a row meets the rows of its bucket behind its own label
        step = np.cumsum(count) // PAIRS_AT_ONCE
        bounds = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1], [True])))
        w = [np.ascontiguousarray(words[:, i]) for i in range(words.shape[1])]
        half = len(w) // 2
        found = [np.empty((3, 0), np.int64)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            c = count[lo:hi]
            i = np.repeat(np.arange(lo, hi), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + part_end[i]
            same_b = SKETCH_BITS - sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in w[half:])
            near = same_b >= need_b
            i, j, same_b = i[near], j[near], same_b[near]
            same_a = SKETCH_BITS - sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in w[:half])
            near = same_a >= need_a
            pairs = np.stack([i[near], j[near], same_a[near] + same_b[near]])
            found.append(pairs if most is None else pairs[:, _best(pairs[2], part[pairs[0]], part[pairs[1]], most)])
        pairs = np.concatenate(found, axis=1)
        if most is not None:
            pairs = pairs[:, _best(pairs[2], part[pairs[0]], part[pairs[1]], most)]
        return pairs[0], pairs[1]

    def compare(whole: pa.RecordBatch, key: np.ndarray) -> pa.RecordBatch:
        words = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), np.uint64).reshape(whole.num_rows, -1)
        x, p = links(key, words, whole.column("label").dictionary_encode().indices.to_numpy())
        ids = whole.column("id")
        return pa.RecordBatch.from_arrays([as_array(ids.take(pa.array(x))), as_array(ids.take(pa.array(p)))], names=["x", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            key = np.stack([whole.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "sub")], axis=1)
            # The last bucket may go on in the next batch and waits for it whole.
            ready = int(np.flatnonzero((key == key[-1]).all(axis=1))[0])
            if ready:
                yield compare(whole.slice(0, ready), key[:ready])
            held = whole.slice(ready)
        if held is not None:
            yield compare(held, np.zeros((held.num_rows, 2), np.int64))

    return run


def _rough(min_a: float, min_b: float):
    """Candidate links that the coarse vectors do not rule out; ``sure`` if they prove the link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("ax", "ap", "bx", "bp")}
            (a, off_a), (b, off_b) = _coarse_cosine(raw["ax"], raw["ap"]), _coarse_cosine(raw["bx"], raw["bp"])
            keep = np.flatnonzero((a + off_a >= min_a) & (b + off_b >= min_b))
            sure = (a - off_a >= min_a) & (b - off_b >= min_b)
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays([as_array(batch.column("x").take(take)), as_array(batch.column("p").take(take)), pa.array((a + b)[keep]), pa.array(sure[keep])], names=["x", "p", "closeness", "sure"])

    return run


def _verify(min_a: float, min_b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cos = [np.einsum("ij,ij->i", _unit(_matrix(batch.column(f"{c}x"))), _unit(_matrix(batch.column(f"{c}p")))) for c in "ab"]
            keep = np.flatnonzero((cos[0] >= min_a) & (cos[1] >= min_b))
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays([as_array(batch.column("x").take(take)), as_array(batch.column("p").take(take)), pa.array(cos[0][keep] + cos[1][keep])], names=["x", "p", "closeness"])

    return run


def _cells(spread: DataFrame, bucket_rows: int) -> DataFrame:
    """id, label, bucket and others -> with the cells ``sub`` of the bucket; two rows of different labels share one.

    A bucket of up to ``bucket_rows`` is one cell. In a larger one the rows of the most frequent label form ``tops``
    blocks, the rest ``rests``; every block of the rest meets every block of both kinds. Rows of a bucket with one
    label only have nothing to meet and are left out.
    """
    large = spread.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket")
    sizes = spread.join(large, "bucket").groupBy("bucket", "label").count()
    most = F.max(F.struct("count", "label"))
    blocks = lambda rows: F.ceil(rows / bucket_rows).cast("int")
    plan = sizes.groupBy("bucket").agg(F.sum("count").alias("n"), most.alias("top")).select("bucket", F.col("top.label").alias("top"), blocks(F.col("top.count")).alias("tops"), blocks(F.col("n") - F.col("top.count")).alias("rests"))
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tops, rests = F.col("tops"), F.col("rests")
    block = F.pmod(F.xxhash64("bucket", "id"), F.when(F.col("label") == F.col("top"), tops).otherwise(rests)).cast("int")
    of_top = F.transform(every(rests), lambda j: F.col("block") * rests + j)
    of_rest = F.concat(
        F.transform(every(tops), lambda i: i * rests + F.col("block")),
        F.transform(every(rests), lambda j: tops * rests + F.least(j, F.col("block")) * rests + F.greatest(j, F.col("block"))),
    )
    subs = F.when(tops.isNull(), F.array(F.lit(0))).when(F.col("label") == F.col("top"), of_top).otherwise(of_rest)
    return spread.join(plan, "bucket", "left").withColumn("block", block).withColumn("sub", F.explode(subs)).drop("top", "tops", "rests", "block")


def _round(rows: DataFrame, labels: DataFrame | None, tables: range, hashes: int, m: int, min_a: float, min_b: float, bucket_rows: int, most: int | None) -> DataFrame:
    """Verified links (x, p, closeness) between different groups; without labels, links to pivots."""
    known = rows.withColumn("label", F.col("id")) if labels is None else rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    placed = known.select("id", "label", "sketch", "a", "b").mapInArrow(_bucket(tables, hashes, m), "id string, label string, sketch binary, buckets array<bigint>")
    spread = placed.select("id", "label", "sketch", F.explode("buckets").alias("bucket"))
    if labels is None:
        large = spread.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket", F.ceil(F.col("count") / bucket_rows).cast("int").alias("subs"))
        split = spread.join(large, "bucket", "left").withColumn("sub", F.pmod(F.xxhash64("bucket", "id"), F.coalesce("subs", F.lit(1))).cast("int")).drop("subs")
        ordered = split.withColumn("order", F.xxhash64(F.lit(1), "bucket", "id")).repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "order", "id")
        kernel = _absorb(min_a, min_b)
    else:
        ordered = _cells(spread, bucket_rows).repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "label")
        kernel = _across(min_a, min_b, most)
    met = ordered.mapInArrow(kernel, "x string, p string").distinct()

    def with_vectors(pairs: DataFrame, held: DataFrame, a: str, b: str) -> DataFrame:
        left = held.select(F.col("id").alias("x"), F.col(a).alias("ax"), F.col(b).alias("bx"))
        right = held.select(F.col("id").alias("p"), F.col(a).alias("ap"), F.col(b).alias("bp"))
        return pairs.select("x", "p").join(left, "x").join(right, "p")

    rough = cut_lineage(with_vectors(met, rows, "ca", "cb").mapInArrow(_rough(min_a, min_b), "x string, p string, closeness double, sure boolean"))
    links, open_ = rough.where("sure").drop("sure"), rough.where("not sure")
    # Only the vectors of records in open links travel whole: their ids are broadcast while they are few.
    ends = open_.select(F.explode(F.array("x", "p")).alias("id")).distinct()
    few = ends.count()
    if not few:
        return links
    held = rows.join(F.broadcast(ends), "id", "left_semi") if few <= BROADCAST_IDS else rows
    return links.unionByName(with_vectors(open_, held, "a", "b").mapInArrow(_verify(min_a, min_b), "x string, p string, closeness double"))


def plan_tables(n: int, min_a: float, min_b: float, miss: float) -> tuple[int, int, int]:
    """(hashes, m, tables) for n rows; three of four tables hash the second vector, the fourth the first."""
    if miss <= 0:
        return 0, 0, 1
    bits = max(8, math.ceil(math.log2(max(n, 2))) - 5)
    hashes = math.ceil(bits / 7)  # of at most 7 bits each: 64 dimensions
    m = 1 << math.ceil(bits / hashes) - 1
    a, b = (-math.log1p(-(share_corner(c, m) ** hashes)) for c in (min_a, min_b))
    return hashes, m, 4 * math.ceil(math.log(1 / miss) / (3 * b + a))


def link_groups(df: DataFrame, min_a: float = MIN_A, min_b: float = MIN_B, miss: float = MISS, bucket_rows: int = BUCKET_ROWS, planned: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of records joined by links, directly or through others.

    ``df``: id, a, b (bytes of float32 vectors, one length each). Returns (groups: id, group_id - every record,
    a lone one is its own group; links: x, p, closeness, pivot - the verified links and whether p is a pivot; rows: id, a, b, sketch of
    one record per class of copies). Null ids or vectors must have been removed; a zero or non-finite vector is
    similar to nothing but its copies. An empty table gives no rows. The tables are planned for ``planned`` rows if
    that is more than there are. With ``miss`` 0 every two records of different groups are compared, in blocks, which
    is quadratic: for audits of small tables.
    """
    spark = df.sparkSession
    keyed = df.select("id", "a", "b", F.md5(F.concat("a", F.lit(b"|"), "b")).alias("same"))
    # One row per class of copies; the group limit before the shuffle bounds what a hot class sends.
    w = Window.partitionBy("same").orderBy("id")
    reps = keyed.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "a", "b", "same")
    rows = cut_lineage(reps.select("id", "a", "b").mapInArrow(_sketch, "id string, a binary, b binary, sketch binary, ca binary, cb binary"))
    hashes, m, tables = plan_tables(max(rows.count(), planned), min_a, min_b, miss)
    # The pivots of four tables of their own make the cores; then the planned tables, every pair of different groups.
    rounds = [(range(tables, tables + 4), None), (range(math.ceil(tables / 4)), FEW), (range(tables), None)]
    labels, kept = None, None
    for span, most in rounds:
        links = cut_lineage(_round(rows, labels, span, hashes, m, min_a, min_b, bucket_rows, most))
        links = links.withColumn("pivot", F.lit(labels is None))
        kept = links if kept is None else kept.unionByName(links)
        if labels is None:
            ends = links.select(F.col("x").alias("u"), F.col("p").alias("v"))
            labels = cut_lineage(components(ends))
        elif not links.isEmpty():
            ends = links.join(labels.select(F.col("id").alias("x"), F.col("label").alias("u")), "x", "left").join(labels.select(F.col("id").alias("p"), F.col("label").alias("v")), "p", "left")
            merged = components(ends.select(F.coalesce("u", "x").alias("u"), F.coalesce("v", "p").alias("v"))).select(F.col("id").alias("label"), F.col("label").alias("joined"))
            singles = merged.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("id"), "label")
            labels = cut_lineage(labels.unionByName(singles).join(merged, "label", "left").select("id", F.coalesce("joined", "label").alias("label")))
    found = rows.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("group_id"))
    classes = keyed.groupBy("same").agg(F.min("id").alias("rep"))
    members = keyed.select("id", "same").join(classes, "same").select(F.col("id").alias("member"), "rep")
    groups = members.join(found.withColumnRenamed("id", "rep"), "rep").select(F.col("member").alias("id"), "group_id")
    return groups, kept, rows


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hs_mean (last layer) and routing_full_last (flattened) -> bytes, null where a vector is not usable."""
    for batch in batches:
        cols = []
        for name, strict in (("hs", True), ("rf", False)):
            col = as_array(batch.column(name))
            value, (row, _), ok = walk(col, 1)
            n = np.bincount(row, minlength=batch.num_rows)
            good = ok & np.isfinite(value)
            bad = np.bincount(row[~good], minlength=batch.num_rows) > 0
            size = np.bincount(row, weights=np.where(good, np.abs(np.where(good, value, 0)), 0), minlength=batch.num_rows)
            use = (n > 0) & ~bad & ((size > 0) | (not strict))
            starts = np.cumsum(n) - n
            flat = (value.astype(np.float32) + np.float32(0)).tobytes()
            cols.append(pa.array([flat[4 * s : 4 * (s + k)] if u else None for s, k, u in zip(starts, n, use, strict=True)], pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], names=["text_id", "written_at", "loaded_at", "a", "b"])


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    raw = payload_rows(spark, folder, PASS_PAPER, [F.try_element_at("hs_mean", F.lit(-1)).alias("hs"), F.flatten("routing_full_last").alias("rf")])
    coded = raw.select("text_id", "written_at", "loaded_at", "hs", "rf").mapInArrow(_clean, "text_id string, written_at timestamp_ntz, loaded_at timestamp_ntz, a binary, b binary")
    return current(coded).where("a is not null and b is not null").select(F.col("text_id").alias("id"), "a", "b")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per Arrow batch and group: the sum of the unit vectors, laid end to end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.concatenate([_unit(_matrix(batch.column(c))) for c in "ab"], axis=1)
        name, at = np.unique(batch.column("group_id").to_numpy(zero_copy_only=False), return_inverse=True)
        total = np.zeros((len(name), x.shape[1]))
        np.add.at(total, at, x)
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array([t.tobytes() for t in total], pa.binary())], names=["group_id", "total"])


def _merge_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums sorted by group -> one sum per group."""
    name, total = None, None
    for batch in batches:
        out = []
        for g, raw in zip(batch.column("group_id").to_pylist(), batch.column("total").to_pylist(), strict=True):
            x = np.frombuffer(raw)
            if g == name:
                total = total + x
            else:
                if name is not None:
                    out.append((name, total.tobytes()))
                name, total = g, x
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.binary())], names=["group_id", "total"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([total.tobytes()], pa.binary())], names=["group_id", "total"])


class _Cell:
    """The members of a part of a group: their closest pivot so far, ties to the pivot met first."""

    def __init__(self):
        self.ids, self.units, self.total, self.names = [], [], None, []

    def meet(self, names: list[str], pivots: np.ndarray) -> None:
        if not self.names:
            self.x = np.concatenate(self.units) if self.units else np.empty((0, pivots.shape[1]))
            self.score, self.who, self.units = np.full(len(self.x), -np.inf), np.zeros(len(self.x), np.int64), []
        for lo in range(0, len(pivots), PIVOTS_AT_ONCE):
            cos = np.round(self.x @ pivots[lo : lo + PIVOTS_AT_ONCE].T, 6)
            best = cos.argmax(axis=1)
            top = cos[np.arange(len(cos)), best]
            closer = top > self.score
            self.score[closer], self.who[closer] = top[closer], best[closer] + lo + len(self.names)
        self.names += names

    def rows(self, group: str) -> list[tuple[str, str, str, float]]:
        return [(group, i, self.names[k], t) for i, k, t in zip(self.ids, self.who.tolist(), (self.x @ self.total).tolist(), strict=True)] if self.ids else []


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (group, part, kind, id), the group's sum (kind 0), a part's members (1), then all pivots of the group
    (2) -> each member's closest pivot and its typicality. The members are held and the pivots stream past."""

    def made(out: list[tuple[str, str, str, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], names=["group_id", "id", "pivot", "typical"])

    at, cell = None, _Cell()
    for batch in batches:
        if not batch.num_rows:
            continue
        key = list(zip(*(batch.column(c).to_pylist() for c in ("group_id", "part", "kind")), strict=True))
        ids = batch.column("id").to_pylist()
        there = batch.column("kind").to_numpy() > 0
        held = batch.filter(pa.array(there))
        x = np.concatenate([_unit(_matrix(held.column(c))) for c in "ab"], axis=1) if held.num_rows else None
        place = np.cumsum(there) - there
        starts = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]]
        out = []
        for lo, hi in zip(starts, [*starts[1:], len(key)], strict=True):
            group, part, kind = key[lo]
            if (group, part) != at:
                out += cell.rows(at[0]) if at else []
                at, cell = (group, part), _Cell()
            if kind == 0:
                cell.total = np.frombuffer(batch.column("total")[lo].as_py())
            elif kind == 1:
                cell.ids, cell.units = cell.ids + ids[lo:hi], [*cell.units, x[place[lo] : place[lo] + hi - lo]]
            else:
                cell.meet(ids[lo:hi], x[place[lo] : place[lo] + hi - lo])
        if out:
            yield made(out)
    if at and (out := cell.rows(at[0])):
        yield made(out)


def sums_of(members: DataFrame) -> DataFrame:
    """group_id, id, a, b -> group_id and the sum of its members' unit vectors, pre-aggregated by Arrow batch."""
    parts = members.select("group_id", "a", "b").mapInArrow(_sums, "group_id string, total binary")
    return parts.repartition("group_id").sortWithinPartitions("group_id").mapInArrow(_merge_sums, "group_id string, total binary")


def closest_pivots(members: DataFrame, links: DataFrame, sizes: DataFrame, part_rows: int = BUCKET_ROWS) -> DataFrame:
    """(group_id, id, pivot, typical): each member's closest pivot among those of its group, ties to the smaller id,
    and its similarity to all members of the group, the dot product with the sum of their unit vectors.

    A group's pivots are all records that absorbed others in the first round; a group that only later rounds joined has
    its least record. Groups above ``part_rows`` go in parts, each with all pivots: a task holds a part's members, and
    the pivots, however many, stream past in the order of their ids.
    """
    named = members.select("group_id", "id").join(links.where("pivot").select(F.col("p").alias("id")).distinct(), "id").select("group_id", "id")
    least = members.join(named.select("group_id").distinct(), "group_id", "left_anti").groupBy("group_id").agg(F.min("id").alias("id"))
    parts = sizes.select("group_id", F.ceil(F.col("size") / part_rows).cast("int").alias("parts"))
    every, none = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.lit(None).cast("binary")
    sums = sums_of(members).join(parts, "group_id").select("group_id", every.alias("part"), F.lit(0).alias("kind"), F.lit("").alias("id"), none.alias("a"), none.alias("b"), "total")
    rest = members.join(parts, "group_id").select("group_id", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "id", "a", "b", none.alias("total"))
    chosen = members.join(named.unionByName(least), ["group_id", "id"], "left_semi").join(parts, "group_id")
    heads = chosen.select("group_id", every.alias("part"), F.lit(2).alias("kind"), "id", "a", "b", none.alias("total"))
    placed = sums.unionByName(rest).unionByName(heads).repartition("group_id", "part").sortWithinPartitions("group_id", "part", "kind", "id")
    return placed.mapInArrow(_assign, "group_id string, id string, pivot string, typical double")


def _assigned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of MIN_SIZE and more: their sizes, their members with vectors, and the members' closest pivots."""
    vectors = cut_lineage(_vectors(spark, folder))
    groups, links, _ = link_groups(vectors)
    groups = cut_lineage(groups)
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size")).where(f"size >= {MIN_SIZE}")
    members = cut_lineage(groups.join(sizes.select("group_id"), "group_id", "left_semi").join(vectors, "id").select("group_id", "id", "a", "b"))
    return sizes, members, cut_lineage(closest_pivots(members, links, sizes))


def p4_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every member of a group of 3 or more texts with its group, its cluster - the members that share their closest
    pivot -, that cluster's size, and its medoid: the member most similar to all of the cluster, recomputed after the
    reassignment. Ties go to the smaller text id."""
    _, members, closest = _assigned(spark, folder)
    own = cut_lineage(members.join(closest.select("id", "pivot"), "id").select(F.col("pivot").alias("group_id"), "id", "a", "b"))
    sizes = own.groupBy("group_id").agg(F.count("*").alias("size"))
    # each cluster with one pivot: the pass that assigned the members now only measures them against the new sums
    again = closest_pivots(own, own.select(F.col("id").alias("x"), F.col("group_id").alias("p"), F.lit(False).alias("pivot")), sizes)
    w = Window.partitionBy("group_id").orderBy(F.desc(F.round("typical", 6)), "id")
    medoid = again.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("group_id").alias("pivot"), F.col("id").alias("medoid"))
    out = closest.join(sizes.select(F.col("group_id").alias("pivot"), "size"), "pivot").join(medoid, "pivot")
    return out.select(F.col("id").alias("text_id"), "group_id", "pivot", F.col("size").alias("cluster_size"), "medoid")


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each group of 3 or more texts: its size, its pivots' number and its most typical texts.

    A text's typicality is its mean similarity to all members (the dot product with the group's sum of unit
    vectors), so the first typical text is the group's medoid. Every member is assigned to the closest of its
    group's pivots; ``pivots`` counts the pivots that keep a member. Ties go to the smaller text id.
    """
    sizes, _, closest = _assigned(spark, folder)
    w = Window.partitionBy("group_id").orderBy(F.desc(F.round("typical", 6)), "id")
    top = closest.withColumn("r", F.row_number().over(w)).where(f"r <= {TYPICAL}").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t"))
    pivots = closest.groupBy("group_id").agg(F.countDistinct("pivot").alias("pivots"))
    return sizes.join(top, "group_id").join(pivots, "group_id").select("group_id", "size", "pivots", F.concat_ws(",", F.col("t.id")).alias("typical"))


def p4_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Each group of 3 or more texts with its size."""
    return p4_found(spark, folder).groupBy("group_id").agg(F.count("*").alias("size"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    groups, _, _ = link_groups(cut_lineage(_vectors(spark, folder)))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size")).where(f"size >= {MIN_SIZE}")
    return groups.join(sizes, "group_id").select(F.col("id").alias("text_id"), "group_id")


QUERIES = {"p4_clusters": p4_clusters, "p4_members": p4_members, "p4_sizes": p4_sizes, "p4_found": p4_found}

_SQL = """
with recursive cur as (
  select text_id, hs_mean[-1] as h, flatten(routing_full_last) as f from (
    select *, row_number() over (partition by text_id order by written_at desc, loaded_at desc) as rk
    from payloads where pass_name = 'paper_rerouted' and text_id is not null) where rk = 1),
v as (select text_id, cast(h as double[]) as h, cast(f as double[]) as f from cur where h is not null and f is not null
  and len(list_filter(h, lambda x: x is null or isnan(x) or isinf(x))) = 0),
n as (select text_id, h, f, sqrt(list_dot_product(h, h)) as nh, sqrt(list_dot_product(f, f)) as nf from v),
u as (select * from n where nh > 0),
e as (select a.text_id as x, b.text_id as y from u a join u b on a.text_id <> b.text_id
  where a.nf > 0 and b.nf > 0 and list_dot_product(a.h, b.h) / (a.nh * b.nh) >= 0.75 and list_dot_product(a.f, b.f) / (a.nf * b.nf) >= 0.8),
r(x, y) as (select text_id, text_id from u union select r.x, e.y from r join e on r.y = e.x),
g as (select x as text_id, min(y) as group_id from r group by 1)
"""
ORACLE = {
    "p4_found": _SQL + "select text_id, group_id from g where group_id in (select group_id from g group by 1 having count(*) >= 3)",
    "p4_sizes": _SQL + "select group_id, count(*) as size from g group by 1 having count(*) >= 3",
}
