"""Ingest of per-text signal archives (.npz), the payload table they become, and the signals read from that table."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The arrays of an archive with the column types they are kept in.
_VECTORS = "array<array<float>>"
_POOL, _MASK, _COUNTS = "array<array<array<float>>>", "array<array<boolean>>", "array<array<smallint>>"
FIELDS: dict[str, str] = {
    "token_ids": "array<int>",
    "seq_len": "int",
    "text_id": "string",
    "hs_last_token": _VECTORS,
    "hs_mean": _VECTORS,
    "hs_final_all_tokens": _VECTORS,
    "routing_indices": "array<array<array<smallint>>>",
    "routing_weights": "array<array<array<float>>>",
    "routing_full_last": _VECTORS,
    "va_mean": _VECTORS,
    "va_all_tokens": "array<array<array<float>>>",
    **{f"{family}_{part}": kind for family in ("va_expert", "expert_out", "expert_ffn", "expert_contrib") for part, kind in (("pool", _POOL), ("mask", _MASK), ("counts", _COUNTS))},
    "attn_weights_last": "array<array<array<float>>>",
    "attn_weights_reroute": _VECTORS,
    "shared_expert_index": "smallint",
    "value_dim": "int",
    "hidden_size": "int",
}
FLOATS = tuple(f for f, t in FIELDS.items() if "float" in t)
_LEAF = {"int": (pa.int32(), np.int32), "float": (pa.float32(), np.float32), "smallint": (pa.int16(), np.int16), "boolean": (pa.bool_(), np.bool_), "string": (pa.string(), np.str_)}


def _arrow_type(name: str) -> pa.DataType:
    return pa.list_(_arrow_type(name[6:-1])) if name.startswith("array<") else _LEAF[name][0]


def _leaf(name: str) -> type:
    return _LEAF[name.replace("array<", "").rstrip(">")][1]


def _open(fields: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one archive at a time bounds the memory
                out = {}
                with np.load(io.BytesIO(batch.column("content")[at].as_py()), allow_pickle=False) as z:
                    for f in fields:  # members are read one by one: fields not asked for are never unpacked
                        out[f] = z[f].astype(_leaf(FIELDS[f])).tolist() if f in z.files else None
                yield pa.RecordBatch.from_arrays([batch.column("path").slice(at, 1), *[pa.array([out[f]], _arrow_type(FIELDS[f])) for f in fields]], names=["path", *fields])

    return run


def read_payload_archives(spark: SparkSession, root: str, fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """``root``/embeddings/{pass}/{filename}.npz -> pass_name, kind (from the name: doc or query), filename and the fields;
    a field missing in an archive is null. Half floats become floats; a field not asked for is not unpacked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(f"{root}/embeddings")
    ddl = "path string, " + ", ".join(f"{f} {FIELDS[f]}" for f in fields)
    rows = files.select("path", "content").mapInArrow(_open(fields), ddl)
    part = F.split("path", "/")
    name = F.element_at(part, -1)
    return rows.select(F.element_at(part, -2).alias("pass_name"), F.split(name, "_")[0].alias("kind"), name.alias("filename"), *fields)


def write_payloads(df: DataFrame, folder: str) -> None:
    """The payload table, a directory per pass and kind. Only the directories that ``df`` has rows for are replaced, each
    visible once the whole write has succeeded."""
    keys = [c for c in ("pass_name", "kind") if c in df.columns]
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(folder)


@dataclass(frozen=True)
class ModelShape:
    """The dimensions of the model that made the archives; ``from_architecture`` reads them from its JSON description."""

    layers: int
    experts: int
    top_k: int
    hidden: int
    value_dim: int
    head_dim: int
    attention: tuple[int, ...]

    @classmethod
    def from_architecture(cls, a: dict) -> ModelShape:
        return cls(a["num_layers"], a["num_experts"], a["num_experts_per_tok"], a["hidden_size"], a["value_dim"], a["head_dim"], tuple(a["attn_layer_indices"]))


class ArchiveSignals:
    """The signals of all methods from a table with the archive's columns, pass_name and text_id; one row per pass and text.

    Null arrays give no rows. A pool's slot nothing was routed to keeps its zero vector and count 0.
    """

    def __init__(self, payloads: DataFrame, arch: ModelShape):
        self.rows, self.arch = payloads.where("pass_name is not null and text_id is not null"), arch

    def _one(self, vec: Column) -> DataFrame:
        return self.rows.select("pass_name", "text_id", vec.cast("array<double>").alias("vec")).where("vec is not null")

    def _levels(self, column: str | Column, *names: str) -> DataFrame:
        """pass_name, text_id, one position per level, and the value below them."""
        df = self.rows.select("pass_name", "text_id", F.col(column).alias("v") if isinstance(column, str) else column.alias("v"))
        for i, n in enumerate(names):
            df = df.select("pass_name", "text_id", *names[:i], F.posexplode("v").alias(n, "v"))
        return df

    def last(self) -> DataFrame:
        return self._one(F.try_element_at("hs_last_token", F.lit(-1)))

    def mean(self) -> DataFrame:
        return self._one(F.try_element_at("hs_mean", F.lit(-1)))

    def router(self) -> DataFrame:
        return self._one(F.flatten("routing_full_last"))

    def routed(self) -> DataFrame:
        slots = self._levels(F.transform(F.arrays_zip("routing_indices", "routing_weights"), lambda t: F.arrays_zip(F.try_element_at(t["routing_indices"], F.lit(-1)).alias("e"), F.try_element_at(t["routing_weights"], F.lit(-1)).alias("w"))), "layer", "slot")
        good = slots.where((F.col("slot") < self.arch.top_k) & F.col("v.e").between(0, self.arch.experts - 1) & (F.col("v.w") > 0) & ~F.isnan("v.w"))
        return good.groupBy("pass_name", "text_id", (F.col("layer") * self.arch.experts + F.col("v.e")).cast("int").alias("dim")).agg(F.sum(F.col("v.w").cast("double")).alias("w"))

    def value_means(self) -> DataFrame:
        return self._levels("va_mean", "off").withColumn("vec", F.col("v").cast("array<double>")).drop("v")

    def attention(self) -> DataFrame:
        return self._levels("attn_weights_last", "off", "head").withColumn("w", F.col("v").cast("array<double>")).drop("v")

    def values(self) -> DataFrame:
        return self._levels("va_all_tokens", "off", "tok").withColumn("vec", F.col("v").cast("array<double>")).drop("v")

    def pool(self, family: str) -> DataFrame:
        """family: va, out, ffn or contrib; the va pools are kept by attention layer and come out by model layer."""
        name = "va_expert" if family == "va" else f"expert_{family}"
        both = F.transform(F.arrays_zip(f"{name}_pool", f"{name}_counts"), lambda t: F.arrays_zip(t[f"{name}_pool"].alias("p"), t[f"{name}_counts"].alias("c")))
        slots = self._levels(both, "at", "slot").select("pass_name", "text_id", "at", "slot", F.col("v.c").cast("bigint").alias("count"), F.col("v.p").cast("array<double>").alias("vec"))
        layer = F.get(F.array(*[F.lit(x) for x in self.arch.attention]), F.col("at")) if family == "va" else F.col("at")
        return slots.select("pass_name", "text_id", layer.alias("layer"), "slot", "count", "vec")

    def states(self) -> DataFrame:
        return self._levels("hs_final_all_tokens", "vec_no").withColumn("vec", F.col("v").cast("array<double>")).drop("v")
