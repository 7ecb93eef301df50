"""Problem 1: how often every distinct term occurs, in how many records, and whether that makes it useful.

Vertical layout. Each record gets a number; for each term a compressed bitmap of the records it occurs in is
built per block of 65,536 record numbers, with an occurrence counter beside it. Bitmaps of the same term and
block are merged by union; the number of records of a term is the sum of its blocks' cardinalities.

Scale: a record's terms never leave the task that numbered it except as bitmaps, so a term held by every
record sends one bitmap per block and Arrow batch, and its blocks are spread over all tasks by (term, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routescope.functions.nested import as_array, walk
from routescope.llm import bitmaps
from routescope.llm.slices import slices
from routescope.sources.tables import PASS_ALL, current, payload_rows

BLOCK_BITS = 16
SLICE_ROWS = 4096
RARE_TEXTS = 2
COMMON_SHARE = 0.4

_PARTS = pa.schema([("field", pa.int32()), ("layer", pa.int32()), ("term", pa.int64()), ("block", pa.int64()), ("bits", pa.binary()), ("occurrences", pa.int64())])
_PARTS_DDL = "field int, layer int, term bigint, block bigint, bits binary, occurrences bigint"


def _columns(code_field: np.ndarray, layer: np.ndarray, term: np.ndarray, block: np.ndarray, bits: list[bytes | None], n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code_field, pa.int32()), pa.array(layer, pa.int32()), pa.array(term, pa.int64()), pa.array(block, pa.int64()), pa.array(bits, pa.binary()), pa.array(n, pa.int64())], schema=_PARTS)


def _build(depths: list[int]):
    """Number the records of a partition and build the bitmaps of each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base, seen = (task.partitionId() if task else 0) << 32, 0
        for batch in slices(batches, SLICE_ROWS):
            for f, depth in enumerate(depths):
                col = as_array(batch.column(f))
                present = len(col) - col.null_count
                # The number of records that have the field travels as a row with a null bitmap, keyed by the partition.
                yield _columns(np.array([f]), np.array([-2]), np.array([0]), np.array([base >> 32]), [None], np.array([present]))
                values, index, ok = walk(col, depth)
                values = values.astype(np.int64)
                ok &= values >= 0
                record = index[0][ok] + seen
                layer = index[1][ok] if depth == 2 else np.full(len(record), -1, np.int64)
                term = values[ok]
                order = np.lexsort((record, term, layer, record >> BLOCK_BITS))
                record, layer, term = record[order], layer[order], term[order]
                block = record >> BLOCK_BITS
                if not len(record):
                    continue
                fresh_term = np.concatenate(([True], (np.diff(term) != 0) | (np.diff(layer) != 0) | (np.diff(block) != 0)))
                fresh_record = fresh_term | np.concatenate(([True], np.diff(record) != 0))
                starts = np.flatnonzero(fresh_term)
                counts = np.diff(np.concatenate((starts, [len(term)])))
                low = (record[fresh_record] & 0xFFFF).astype(np.uint16)
                of_term = np.flatnonzero(fresh_term[fresh_record])
                bits = [bitmaps.encode(x) for x in np.split(low, of_term[1:])]
                yield _columns(np.full(len(starts), f), layer[starts], term[starts], base + block[starts], bits, counts)
            seen += batch.num_rows

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the bitmaps of each (term, block); rows arrive sorted by that key."""
    key, held, count = None, [], 0
    for batch in batches:
        names = [batch.column(i).to_pylist() for i in range(6)]
        out: list[tuple] = []
        for *k, raw, n in zip(*names, strict=True):
            if k != key:
                if key is not None:
                    out.append((*key, bitmaps.cardinality(bitmaps.union(held)) if held else 0, count))
                key, held, count = k, [], 0
            if raw is not None:
                held.append(raw)
            count += n
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["field", "layer", "term", "block", "records", "occurrences"]).cast(_MERGED)
    if key is not None:
        row = (*key, bitmaps.cardinality(bitmaps.union(held)) if held else 0, count)
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in row], names=["field", "layer", "term", "block", "records", "occurrences"]).cast(_MERGED)


_MERGED = pa.schema([("field", pa.int32()), ("layer", pa.int32()), ("term", pa.int64()), ("block", pa.int64()), ("records", pa.int64()), ("occurrences", pa.int64())])


def term_frequency(df: DataFrame, fields: dict[str, str], rare: int = RARE_TEXTS, common: float = COMMON_SHARE) -> DataFrame:
    """Occurrences and record counts of every term of the fields.

    ``df`` has one row per record. ``fields`` maps a field's name to its column: an array of integers, or an
    array (by layer) of arrays of integers. Returns field, layer (-1 for flat arrays), term, occurrences,
    records, records_with_field, mark.

    A null array is a missing field and counts nowhere; an empty one counts as a record with the field. Null
    and negative values are no terms. A term repeated in a record counts once for ``records``. ``mark`` is
    rare up to ``rare`` records, else common above the share ``common`` of the records with the field, else
    useful. An empty table gives no rows. Other columns of ``df``, whatever their names, play no part.
    """
    types = dict(df.dtypes)
    depths = [2 if types[c].startswith("array<array<") else 1 for c in fields.values()]
    cast = [F.col(c).cast("array<array<bigint>>" if d == 2 else "array<bigint>").alias(f"f{i}") if not types[c].endswith(("<int>", "<smallint>", "<int>>", "<smallint>>")) else F.col(c).alias(f"f{i}") for i, (c, d) in enumerate(zip(fields.values(), depths, strict=True))]
    parts = df.select(*cast).mapInArrow(_build(depths), _PARTS_DDL)
    keys = ["field", "layer", "term", "block"]
    merged = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge, "field int, layer int, term bigint, block bigint, records bigint, occurrences bigint")
    counted = merged.groupBy("field", "layer", "term").agg(F.sum("records").alias("records"), F.sum("occurrences").alias("occurrences"))
    # One row per field, a number fixed by the call: always small enough to broadcast.
    totals = counted.where("layer = -2").select("field", F.col("occurrences").alias("records_with_field"))
    name = F.element_at(F.create_map(*[x for i, n in enumerate(fields) for x in (F.lit(i), F.lit(n))]), F.col("field"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(float(common)) * F.col("records_with_field"), "common").otherwise("useful")
    return counted.where("layer > -2").join(F.broadcast(totals), "field").select(name.alias("field"), "layer", F.col("term").cast("int").alias("term"), "occurrences", "records", "records_with_field", mark.alias("mark"))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = payload_rows(spark, folder, PASS_ALL, ["token_ids", F.transform("routing_indices", lambda t: F.flatten(t)).alias("routing_indices")])
    return current(rows)


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of the current rows of the first pass with its counts and mark."""
    return term_frequency(_rows(spark, folder), {"token_ids": "token_ids", "routing_indices": "routing_indices"})


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_terms(spark, folder).where("mark <> 'useful'").select("field", "layer", "term", "mark")


QUERIES = {"p1_terms": p1_terms, "p1_found": p1_found}

_SQL = """
with cur as (
  select text_id, token_ids, routing_indices from (
    select *, row_number() over (partition by text_id order by written_at desc, loaded_at desc) as rk
    from payloads where pass_name = 'rerouted' and text_id is not null) where rk = 1),
hits as (
  select 'token_ids' as field, -1 as layer, text_id, unnest(token_ids) as term from cur
  union all
  select 'routing_indices', layer, text_id, unnest(flatten(layer_rows)) from (
    select text_id, generate_subscripts(routing_indices, 1) - 1 as layer, unnest(routing_indices) as layer_rows from cur)),
n as (select 'token_ids' as field, count(token_ids) as records_with_field from cur
      union all select 'routing_indices', count(routing_indices) from cur),
c as (select field, layer, term, count(*) as occurrences, count(distinct text_id) as records from hits where term >= 0 group by all),
m as (select c.field, cast(layer as int) as layer, cast(term as int) as term, cast(occurrences as bigint) as occurrences,
  cast(records as bigint) as records, cast(records_with_field as bigint) as records_with_field,
  case when records <= 2 then 'rare' when records > 0.4 * records_with_field then 'common' else 'useful' end as mark
  from c join n on c.field = n.field)
"""
ORACLE = {
    "p1_terms": _SQL + "select * from m",
    "p1_found": _SQL + "select field, layer, term, mark from m where mark <> 'useful'",
}
