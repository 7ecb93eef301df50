"""Problem 5: items that appear together more often than chance.

Basket collapsing: identical baskets are merged into one with a weight, first per Arrow batch, then over the
whole input; pairs are enumerated once per distinct basket and their weights summed. A basket that holds a
large share of the input therefore reaches the shuffle once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.functions.nested import as_array, walk
from routescope.llm.slices import slices
from routescope.session import cut_lineage
from routescope.sources.tables import PASS_ALL, current, payload_rows

ROUTED_SLOTS = 8
ROUTED_EXPERTS = 128
EMPTY = 0xFFFF
SLICE_ROWS = 1024


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """routing arrays -> per row, the fixed-width baskets of all layers and tokens as bytes, layer first."""
    for batch in slices(batches, SLICE_ROWS):
        ix, w = as_array(batch.column("routing_indices")), as_array(batch.column("routing_weights"))
        out: list[bytes] = [b""] * batch.num_rows
        values, (row, layer, token, slot), ok = walk(ix, 3)
        weight, (wrow, wlayer, wtoken, wslot), wok = walk(w, 3)
        if len(values) != len(weight) or not (np.array_equal(row, wrow) and np.array_equal(layer, wlayer) and np.array_equal(token, wtoken) and np.array_equal(slot, wslot)):
            # Shapes differ in some row: match the slots by position, slots without a weight drop out.
            def name(r, a, t, s):
                return ((r << 12 | a) << 20 | t) << 10 | s

            mine, theirs = name(row, layer, token, slot), name(wrow, wlayer, wtoken, wslot)
            at = np.minimum(np.searchsorted(theirs, mine), max(len(theirs) - 1, 0))
            there = (theirs[at] == mine) if len(theirs) else np.zeros(len(mine), bool)
            weight = np.where(there, weight[at] if len(theirs) else 0.0, 0.0)
            wok = np.where(there, wok[at] if len(theirs) else False, False)
        values = values.astype(np.int64)
        keep = ok & wok & (weight > 0) & (slot < ROUTED_SLOTS) & (values >= 0) & (values < ROUTED_EXPERTS)
        row, layer, token, values = row[keep], layer[keep], token[keep], values[keep]
        if len(row):
            order = np.lexsort((values, token, layer, row))
            row, layer, token, values = row[order], layer[order], token[order], values[order]
            fresh = np.concatenate(([True], (np.diff(row) != 0) | (np.diff(layer) != 0) | (np.diff(token) != 0)))
            fresh_value = fresh | np.concatenate(([True], np.diff(values) != 0))
            row, layer, values, fresh = row[fresh_value], layer[fresh_value], values[fresh_value], fresh[fresh_value]
            starts = np.flatnonzero(fresh)
            basket = np.cumsum(fresh) - 1
            table = np.full((len(starts), ROUTED_SLOTS + 1), EMPTY, np.uint16)
            table[:, 0] = layer[starts]
            table[basket, np.arange(len(values)) - starts[basket] + 1] = values
            of_row = row[starts]
            bounds = np.searchsorted(of_row, np.arange(batch.num_rows + 1))
            raw, width = table.tobytes(), 2 * (ROUTED_SLOTS + 1)
            out = [raw[a * width : b * width] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        keep_cols = [batch.column(i) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*keep_cols, pa.array(out, pa.binary())], names=["text_id", "written_at", "loaded_at", "baskets"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4 * SLICE_ROWS):
        raw = b"".join(x for x in batch.column("baskets").to_pylist() if x)
        if not raw:
            continue
        table = np.frombuffer(raw, np.dtype((np.void, 2 * (ROUTED_SLOTS + 1))))
        distinct, n = np.unique(table, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in distinct], pa.binary()), pa.array(n, pa.int64())], names=["basket", "weight"])


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted pair and item counts of distinct baskets, summed per Arrow batch; an item is the pair (a, a)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.frombuffer(b"".join(batch.column("basket").to_pylist()), np.uint16).reshape(-1, ROUTED_SLOTS + 1)
        layer, items, weight = table[:, 0].astype(np.int64), table[:, 1:].astype(np.int64), batch.column("weight").to_numpy(zero_copy_only=False)
        keys, sums = [layer << 32 | EMPTY << 16 | EMPTY], [weight]
        for i in range(ROUTED_SLOTS):
            for j in range(i, ROUTED_SLOTS):
                ok = items[:, j] != EMPTY  # baskets are sorted with the empty places last
                keys.append((layer << 32 | items[:, i] << 16 | items[:, j])[ok])
                sums.append(weight[ok])
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, np.concatenate(sums))
        yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array(((key >> 16) & EMPTY).astype(np.int32)), pa.array((key & EMPTY).astype(np.int32)), pa.array(total)], names=["layer", "a", "b", "n"])


def distinct_baskets(rows: DataFrame) -> DataFrame:
    """rows: text_id, written_at, loaded_at, routing_indices, routing_weights -> basket, weight."""
    coded = rows.select("text_id", "written_at", "loaded_at", "routing_indices", "routing_weights").mapInArrow(_encode, "text_id string, written_at timestamp_ntz, loaded_at timestamp_ntz, baskets binary")
    parts = current(coded).select("baskets").mapInArrow(_collapse, "basket binary, weight bigint")
    return parts.groupBy("basket").agg(F.sum("weight").alias("weight"))


def basket_pairs(df: DataFrame) -> DataFrame:
    """Pairs of items that share a basket, for baskets of any size and items of any name.

    ``df``: scope, items (an array). Null items drop out, repeated items count once, a null array or a basket without
    items counts nowhere; a null scope is a scope like any other; other columns are ignored; an empty table gives no
    rows. Returns scope, item_a < item_b (as strings), n_ab, n_a, n_b, baskets, lift and conviction as
    :func:`co_occurrence`. Identical baskets of a scope are merged into one with a weight before pairs are formed.
    """
    item = F.array_sort(F.array_distinct(F.array_compact(F.col("items").cast("array<string>"))))
    merged = df.select("scope", item.alias("items")).where("size(items) > 0").groupBy("scope", "items").agg(F.count("*").alias("weight"))
    # An item's own count is the pair (a, a); the basket's the pair without items.
    own = F.transform("items", lambda x: F.struct(x.alias("a"), x.alias("b")))
    two = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    counts = cut_lineage(merged.select("scope", "weight", F.explode(F.concat(own, two, nothing)).alias("p")).groupBy("scope", "p.a", "p.b").agg(F.sum("weight").alias("n")))
    single, total = counts.where("a = b"), counts.where("a is null").select(F.col("scope").alias("s"), F.col("n").alias("baskets"))
    na = single.select(F.col("scope").alias("sa"), F.col("a").alias("ka"), F.col("n").alias("n_a"))
    nb = single.select(F.col("scope").alias("sb"), F.col("a").alias("kb"), F.col("n").alias("n_b"))
    pairs = counts.where("a < b")
    out = pairs.join(na, F.col("scope").eqNullSafe(F.col("sa")) & (F.col("a") == F.col("ka"))).join(nb, F.col("scope").eqNullSafe(F.col("sb")) & (F.col("b") == F.col("kb"))).join(total, F.col("scope").eqNullSafe(F.col("s")))
    return _scored(out.select("scope", F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.col("n").alias("n_ab"), "n_a", "n_b", "baskets"))


def _scored(df: DataFrame) -> DataFrame:
    lift = F.col("n_ab").cast("double") * F.col("baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    conviction = F.try_divide(1.0 - F.col("n_b") / F.col("baskets"), 1.0 - F.col("n_ab") / F.col("n_a"))
    return df.withColumn("lift", F.round(lift, 6)).withColumn("conviction", F.round(conviction, 6))


def co_occurrence(rows: DataFrame) -> DataFrame:
    """Pairs of experts routed for the same token in the same layer, with joint count and lift.

    Input columns as in :func:`distinct_baskets`; other columns are ignored. A basket is the set of distinct
    experts of one token in one layer over the routed slots, with an index in range and a weight above 0; null,
    NaN, zero and negative weights and null indices drop the slot, a null array or an empty basket counts
    nowhere. Returns layer, expert_a < expert_b, n_ab, n_a, n_b, baskets, lift = n_ab * baskets / (n_a * n_b)
    and conviction = (1 - n_b / baskets) / (1 - n_ab / n_a), null where a is never without b. Repeated rows of a
    text count once; an empty table gives no rows.
    """
    # Written down once: pairs, both singles and totals read it.
    counts = cut_lineage(distinct_baskets(rows).mapInArrow(_enumerate, "layer int, a int, b int, n bigint").groupBy("layer", "a", "b").agg(F.sum("n").alias("n")))
    # At most layers x 128 rows of singles and layers rows of totals: bounded by the model, not by the data.
    single = counts.where(f"a = b and a < {EMPTY}")
    total = counts.where(f"a = {EMPTY}").select("layer", F.col("n").alias("baskets"))
    na = single.select("layer", F.col("a").alias("expert_a"), F.col("n").alias("n_a"))
    nb = single.select("layer", F.col("b").alias("expert_b"), F.col("n").alias("n_b"))
    pairs = counts.where("a < b").select("layer", F.col("a").alias("expert_a"), F.col("b").alias("expert_b"), F.col("n").alias("n_ab"))
    out = pairs.join(F.broadcast(na), ["layer", "expert_a"]).join(F.broadcast(nb), ["layer", "expert_b"]).join(F.broadcast(total), "layer")
    return _scored(out.select("layer", "expert_a", "expert_b", "n_ab", "n_a", "n_b", "baskets"))


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of experts with its joint count, lift and conviction."""
    return co_occurrence(payload_rows(spark, folder, PASS_ALL, ["routing_indices", "routing_weights"]))


def p5_found(spark: SparkSession, folder: str, support: float = 0.01, lift: int = 4) -> DataFrame:
    enough = F.col("n_ab") >= F.lit(support) * F.col("baskets")
    often = F.col("n_ab").cast("decimal(38,0)") * F.col("baskets") >= F.lit(lift) * F.col("n_a").cast("decimal(19,0)") * F.col("n_b").cast("decimal(18,0)")
    return p5_pairs(spark, folder).where(enough & often).select("layer", "expert_a", "expert_b")


QUERIES = {"p5_pairs": p5_pairs, "p5_found": p5_found}

_SQL = """
with cur as (
  select text_id, routing_indices as ix, routing_weights as wt from (
    select *, row_number() over (partition by text_id order by written_at desc, loaded_at desc) as rk
    from payloads where pass_name = 'rerouted' and text_id is not null) where rk = 1),
l as (select text_id, generate_subscripts(ix, 1) - 1 as layer, unnest(ix) as ix, unnest(wt) as wt from cur where ix is not null and wt is not null),
t as (select text_id, layer, generate_subscripts(ix, 1) as tok, unnest(ix) as ix, unnest(wt) as wt from l),
s as (select text_id, layer, tok, generate_subscripts(ix, 1) - 1 as slot, unnest(ix) as e, unnest(wt) as w from t),
b as (select distinct text_id, layer, tok, e from s where slot < 8 and e between 0 and 127 and w > 0 and not isnan(w)),
n as (select layer, count(*) as baskets from (select distinct text_id, layer, tok from b) group by 1),
one as (select layer, e, count(*) as n from b group by all),
two as (select x.layer, x.e as expert_a, y.e as expert_b, count(*) as n_ab from b x join b y
  on x.text_id = y.text_id and x.layer = y.layer and x.tok = y.tok and x.e < y.e group by all),
m as (select cast(two.layer as int) as layer, cast(expert_a as int) as expert_a, cast(expert_b as int) as expert_b, n_ab,
  p.n as n_a, q.n as n_b, baskets from two join one p on p.layer = two.layer and p.e = expert_a
  join one q on q.layer = two.layer and q.e = expert_b join n on n.layer = two.layer)
"""
ORACLE = {
    "p5_pairs": _SQL + """select *, round(cast(n_ab as double) * baskets / (cast(n_a as double) * n_b), 6) as lift,
  case when n_ab = n_a then null else round((1.0 - cast(n_b as double) / baskets) / (1.0 - cast(n_ab as double) / n_a), 6) end as conviction from m""",
    "p5_found": _SQL + "select layer, expert_a, expert_b from m where n_ab >= 0.01 * baskets and n_ab * baskets >= 4 * n_a * n_b",
}
