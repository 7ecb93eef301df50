"""Problem 3: all pairs of records whose value sets overlap above a threshold.

Minwise signatures are cut into bands; records that share a band bucket are candidates and every candidate is
verified with its exact similarity. Identical sets are merged into one representative first, so copies never
meet in a bucket. A set over a small universe travels as a bit field inside its band rows and is verified
inside the bucket join, so unverified candidates are never shuffled; sets over an open universe are verified
after the candidate pairs are made distinct.

Recall: with ``rows`` hashes a band and ``bands`` bands a pair of similarity s is missed with probability
(1 - s**rows)**bands; the defaults give 0.0022 at 0.6, 0.00005 at 0.65 and less above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.functions.nested import as_array, walk
from routescope.llm.slices import slices
from routescope.sources.tables import PASS_PAPER, current, payload_rows

THRESHOLD = 0.6
ROWS, BANDS = 6, 128
LAYERS, EXPERTS, ROUTED_SLOTS = 4, 128, 8
BITFIELD_UNIVERSE = 4096
SLICE_ROWS = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and xor-shift."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def band_keys(values: np.ndarray, starts: np.ndarray, rows: int, bands: int, universe: int | None, seed: int = 7) -> np.ndarray:
    """Band keys [len(starts), bands] of non-empty sets laid end to end in ``values``."""
    out = np.zeros((len(starts), bands), np.uint64)
    names = np.arange(universe, dtype=np.uint64) if universe else None
    with np.errstate(over="ignore"):
        for i in range(rows * bands):
            salt = _mix(np.array([seed * 1_000_003 + i], np.uint64))
            hashed = (_mix(names ^ salt) >> np.uint64(32)).astype(np.uint32)[values] if universe else (_mix(values.astype(np.uint64) ^ salt) >> np.uint64(32)).astype(np.uint32)
            least = np.minimum.reduceat(hashed, starts).astype(np.uint64)
            band = i // rows
            out[:, band] = _mix(out[:, band] * np.uint64(0x100000001B3) + least + np.uint64(band + 1))
    return out


def _words(bits: np.ndarray) -> np.ndarray:
    """Boolean [n, universe] -> int64 [n, universe / 64]."""
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def _sketch_bits(rows: int, bands: int, universe: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_ROWS):
            n = batch.num_rows
            raw = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(n, -1)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(bool)
            record, value = np.nonzero(bits)
            starts = np.searchsorted(record, np.arange(n))
            keys = band_keys(value, starts, rows, bands, universe).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("side"), pa.FixedSizeListArray.from_arrays(pa.array(_words(bits).reshape(-1)), universe // 64).cast(pa.list_(pa.int64())), pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), bands).cast(pa.list_(pa.int64()))], names=["id", "side", "words", "bands"])

    return run


def _sketch_open(rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            value, (record, _), _ = walk(batch.column("items"), 1)
            starts = np.searchsorted(record, np.arange(batch.num_rows))
            keys = band_keys(value.astype(np.int64).view(np.uint64), starts, rows, bands, None).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("side"), batch.column("items"), pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), bands).cast(pa.list_(pa.int64()))], names=["id", "side", "items", "bands"])

    return run


def _pack(universe: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, (record, _), _ = walk(batch.column("items"), 1)
            bits = np.zeros((batch.num_rows, universe), bool)
            bits[record, value.astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("side"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1, bitorder="little")], pa.binary())], names=["id", "side", "bits"])

    return run


def classes(df: DataFrame, by: str) -> DataFrame:
    """id, side, and the representative (least id) and size of the record's class of identical sets on its side."""
    # The grouped side has one row per class, so a class with a third of all rows is pre-aggregated map-side;
    # the join back streams its members past that one row.
    rep = df.groupBy("side", by).agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return df.join(rep, ["side", by])


def similar_classes(df: DataFrame, threshold: float, rows: int = ROWS, bands: int = BANDS, universe: int | None = None, across: bool = False) -> tuple[DataFrame, DataFrame]:
    """Similar pairs between classes of identical sets, and the membership of every record.

    ``df``: id, side (0 or 1), items array<bigint> (distinct). With ``across`` only pairs between side 0 and
    side 1 are returned, else all pairs. ``universe``: values lie in [0, universe), a multiple of 64 up to
    4,096; else None. Returns (pairs: id_a, id_b, similarity - representatives of different classes) and
    (members: id, side, class_id, class_size). Records with a null id, or a null or empty set, are similar to
    nothing and left out of both. Nulls inside a set are ignored, repeated values count once, and repeated ids
    must have been removed. Extra columns are ignored.
    """
    df = df.select("id", F.col("side").cast("int").alias("side"), F.array_distinct(F.array_compact("items")).cast("array<bigint>").alias("items")).where("id is not null and size(items) > 0")
    if universe:
        if universe % 64 or universe > BITFIELD_UNIVERSE:
            raise ValueError("universe must be a multiple of 64 up to 4096")
        packed = df.mapInArrow(_pack(universe), "id string, side int, bits binary")
        return _from_packed(packed, threshold, rows, bands, universe, across)
    df = df.withColumn("items", F.array_sort("items"))
    members = classes(df, "items")
    reps = members.where("id = class_id").select("id", "side", "items")
    sketched = reps.mapInArrow(_sketch_open(rows, bands), "id string, side int, items array<bigint>, bands array<bigint>")
    a, b = _sides(sketched.select("id", "side", F.explode("bands").alias("band")))
    met = a.join(b, _meet(across)).select(F.col("a.id").alias("id_a"), F.col("a.side").alias("side_a"), F.col("b.id").alias("id_b"), F.col("b.side").alias("side_b")).distinct()
    left = reps.select(F.col("id").alias("id_a"), F.col("side").alias("side_a"), F.col("items").alias("items_a"))
    right = reps.select(F.col("id").alias("id_b"), F.col("side").alias("side_b"), F.col("items").alias("items_b"))
    full = met.join(left, ["id_a", "side_a"]).join(right, ["id_b", "side_b"])
    shared = F.size(F.array_intersect("items_a", "items_b"))
    full = full.withColumn("similarity", shared / (F.size("items_a") + F.size("items_b") - shared))
    pairs = full.where(F.col("similarity") >= threshold).select("id_a", "id_b", "similarity")
    return pairs, members.select("id", "side", "class_id", "class_size")


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.alias("a"), df.alias("b")


def _meet(across: bool) -> Column:
    order = (F.col("a.side") == 0) & (F.col("b.side") == 1) if across else F.col("a.id") < F.col("b.id")
    return (F.col("a.band") == F.col("b.band")) & order


def _from_packed(packed: DataFrame, threshold: float, rows: int, bands: int, universe: int, across: bool) -> tuple[DataFrame, DataFrame]:
    members = classes(packed, "bits")
    reps = members.where("id = class_id").select("id", "side", "bits")
    sketched = reps.mapInArrow(_sketch_bits(rows, bands, universe), "id string, side int, words array<bigint>, bands array<bigint>")
    count = universe // 64
    words = [F.col("words")[i].alias(f"w{i}") for i in range(count)]
    flat = sketched.select("id", "side", "bands", *words).withColumn("n", sum((F.bit_count(f"w{i}") for i in range(count)), F.lit(0)))
    banded = flat.select("id", "side", "n", *[f"w{i}" for i in range(count)], F.explode("bands").alias("band"))
    a, b = _sides(banded)
    shared = sum((F.bit_count(F.col(f"a.w{i}").bitwiseAND(F.col(f"b.w{i}"))) for i in range(count)), F.lit(0))
    joined = F.col("a.n") + F.col("b.n") - shared
    # shared / joined >= threshold without a division, so the bound holds exactly at the threshold
    pairs = a.join(b, _meet(across) & (shared >= F.lit(threshold) * joined)).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), (shared / joined).alias("similarity")).distinct()
    return pairs, members.select("id", "side", "class_id", "class_size")


def _active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """routing_indices -> bit field of active (layer, expert)."""
    for batch in slices(batches, SLICE_ROWS):
        col = as_array(batch.column("routing_indices"))
        value, (row, layer, _, slot), ok = walk(col, 3)
        ok &= (slot < ROUTED_SLOTS) & (value >= 0) & (value < EXPERTS) & (layer < LAYERS)
        bits = np.zeros((batch.num_rows, LAYERS * EXPERTS), bool)
        bits[row[ok], layer[ok] * EXPERTS + value[ok].astype(np.int64)] = True
        packed = np.packbits(bits, axis=1, bitorder="little")
        some = bits.any(axis=1)
        out = pa.array([x.tobytes() if s else None for x, s in zip(packed, some, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), out], names=["text_id", "written_at", "loaded_at", "bits"])


def active_sets(rows: DataFrame) -> DataFrame:
    """Current payload rows -> id, side 0, bits: the set of (layer, expert) over the routed slots, whatever the weight."""
    coded = rows.select("text_id", "written_at", "loaded_at", "routing_indices").mapInArrow(_active, "text_id string, written_at timestamp_ntz, loaded_at timestamp_ntz, bits binary")
    return current(coded).where("bits is not null").select(F.col("text_id").alias("id"), F.lit(0).alias("side"), "bits")


def _routing(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sets = active_sets(payload_rows(spark, folder, PASS_PAPER, ["routing_indices"]))
    return _from_packed(sets, THRESHOLD, ROWS, BANDS, LAYERS * EXPERTS, False)


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text: its class of identical sets, the class size and its number of links to other texts."""
    pairs, members = _routing(spark, folder)
    sizes = members.where("id = class_id").select("class_id", "class_size")
    both = pairs.select(F.col("id_a").alias("mine"), F.col("id_b").alias("class_id")).unionByName(pairs.select(F.col("id_b").alias("mine"), F.col("id_a").alias("class_id")))
    links = both.join(sizes, "class_id").groupBy(F.col("mine").alias("class_id")).agg(F.sum("class_size").alias("others"))
    out = members.join(links, "class_id", "left")
    return out.select(F.col("id").alias("text_id"), "class_id", "class_size", (F.col("class_size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every similar pair of texts, copies included (the form TESTDATA.md fixes for this query)."""
    pairs, members = _routing(spark, folder)
    m = members.select(F.col("id").alias("text_id"), "class_id", "class_size")
    one = m.select(F.col("text_id").alias("x"), F.col("class_id").alias("id_a"))
    two = m.select(F.col("text_id").alias("y"), F.col("class_id").alias("id_b"))
    across = pairs.join(one, "id_a").join(two, "id_b").select(F.least("x", "y").alias("text_id_a"), F.greatest("x", "y").alias("text_id_b"))
    copies = m.where("class_size > 1")
    within = copies.alias("p").join(copies.alias("q"), (F.col("p.class_id") == F.col("q.class_id")) & (F.col("p.text_id") < F.col("q.text_id"))).select(F.col("p.text_id").alias("text_id_a"), F.col("q.text_id").alias("text_id_b"))
    return across.unionByName(within)


QUERIES = {"p3_links": p3_links, "p3_found": p3_found}

_SQL = """
with cur as (
  select text_id, routing_indices as ix from (
    select *, row_number() over (partition by text_id order by written_at desc, loaded_at desc) as rk
    from payloads where pass_name = 'paper_rerouted' and text_id is not null) where rk = 1),
l as (select text_id, generate_subscripts(ix, 1) - 1 as layer, unnest(ix) as ix from cur),
t as (select text_id, layer, unnest(ix) as ix from l),
e as (select distinct text_id, layer, x as expert from (select text_id, layer, unnest(ix[1:8]) as x from t) where x between 0 and 127),
n as (select text_id, count(*) as n from e group by 1),
s as (select a.text_id as a, b.text_id as b, count(*) as k from e a join e b on a.layer = b.layer and a.expert = b.expert and a.text_id < b.text_id group by all),
pairs as (select a as text_id_a, b as text_id_b, k, p.n as na, q.n as nb from s join n p on p.text_id = a join n q on q.text_id = b
  where k / (p.n + q.n - k) >= 0.6)
"""
ORACLE = {
    "p3_found": _SQL + "select text_id_a, text_id_b from pairs",
    "p3_links": _SQL + """, pair2 as (select text_id_a as t, text_id_b as o, k = na and k = nb as same from pairs union all select text_id_b, text_id_a, k = na and k = nb from pairs)
select n.text_id, coalesce(min(o) filter (same and o < n.text_id), n.text_id) as class_id,
  1 + count(o) filter (same) as class_size, count(o) as links from n left join pair2 on t = n.text_id group by n.text_id""",
}
