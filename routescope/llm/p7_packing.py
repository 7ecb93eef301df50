"""Problem 7: filling containers of fixed capacity with items of varying length.

Hierarchical packing over a histogram. Sizes are whole numbers up to the capacity, so the whole collection is
described by one count per size - at most ``capacity`` numbers, whatever the number of documents. The plan is
made on that histogram. Items are routed to the smallest context-size tier that holds them. The tiers are packed
from the longest to the shortest, each into windows of its own length: a window begins with the longest item left
of its tier, and its gap is filled from its own and then from shorter tiers, always with the longest item that
fits. Windows of a shorter tier must be filled to ``least_fill``; items that do not make such a window wait and are
packed into whole containers at the end. Windows of one tier tile a container (each tier divides the next), what is
left over of the tiers shares containers. A step of the plan is a pattern of sizes with the number of containers
that take it; the number of patterns depends on the capacity and not on the data. Containers are numbered by
falling attention cost (sum of squared lengths) and dealt to step groups back and forth, so the groups of one
training step cost about the same.

Items then find their place by their rank among the items of their size. Ranks are counted per (size, salt)
and offset by a prefix sum, so one size with a third of all rows is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routescope.sources.tables import table

CAPACITY = 4096
TIERS = (512, 1024, 2048, 4096)
GROUP = 8
LEAST_FILL = 0.99
SALT_ROWS = 500_000


Pattern = list[tuple[int, int]]  # (size, how often)


def _greedy(sizes: list[int], left: dict[int, int], room: int, lead: int) -> Pattern:
    """From ``lead`` on, always as many as fit of the longest size left that fits."""
    used: dict[int, int] = {}
    gap = room
    at = bisect_right(sizes, lead) - 1
    while gap > 0:
        while at >= 0 and left[sizes[at]] <= used.get(sizes[at], 0):
            at -= 1
        if at < 0:
            break
        s = sizes[at]
        take = min(gap // s, left[s] - used.get(s, 0))
        used[s] = used.get(s, 0) + take
        gap -= take * s
        at = bisect_right(sizes, gap) - 1
    return sorted(used.items(), reverse=True)


def _windows(left: dict[int, int], room: int, over: int, least_fill: float) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Windows of ``room`` led by the items above ``over``, taken from ``left``; and the items that fill none."""
    sizes = sorted(left)
    made, late = [], {}
    while sizes and (lead := sizes[min(bisect_right(sizes, room), len(sizes)) - 1]) > over:
        pattern = _greedy(sizes, left, room, lead)
        if sum(s * k for s, k in pattern) < least_fill * room:
            late[lead] = left.pop(lead)
            sizes.remove(lead)
            continue
        times = min(left[s] // k for s, k in pattern)
        made.append((pattern, times))
        for s, k in pattern:
            left[s] -= k * times
            if not left[s]:
                del left[s]
                sizes.remove(s)
    return made, late


Placed = tuple[int, int, Pattern]  # tier, where the window begins in its container, its items


def plan(histogram: dict[int, int], capacity: int, tiers: tuple[int, ...], least_fill: float = LEAST_FILL) -> list[tuple[list[Placed], int]]:
    """Containers as lists of windows with the number of containers that take them, by falling cost."""
    left = {s: n for s, n in histogram.items() if n > 0}
    ordered = sorted(tiers)
    made: list[tuple[list[Placed], int]] = []
    waiting: dict[int, int] = {}
    rest: list[tuple[int, Pattern]] = []
    for i in range(len(ordered) - 1, -1, -1):
        tier, over = ordered[i], ordered[i - 1] if i else 0
        found, late = _windows(left, tier, over, least_fill if tier < capacity else 0.0)
        waiting |= late
        tiles = capacity // tier
        for pattern, times in found:
            if times >= tiles:
                made.append(([(tier, j * tier, pattern) for j in range(tiles)], times // tiles))
            rest += [(tier, pattern)] * (times % tiles)
    shared: list[Placed] = []
    start = 0
    for tier, pattern in rest:  # from the longest tier, so that each window begins at a multiple of its length
        if start + tier > capacity:
            made.append((shared, 1))
            shared, start = [], 0
        shared.append((tier, start, pattern))
        start += tier
    if shared:
        gap = capacity - start
        if gap and waiting:
            sizes = sorted(waiting)
            filler = _greedy(sizes, waiting, gap, gap)
            if filler:
                shared.append((capacity, start, filler))
                waiting = {s: n - dict(filler).get(s, 0) for s, n in waiting.items()}
        made.append((shared, 1))
    last, _ = _windows({s: n for s, n in waiting.items() if n}, capacity, 0, 0.0)
    made += [([(capacity, 0, pattern)], times) for pattern, times in last]
    made.sort(key=lambda c: -sum(k * s * s for _, _, pattern in c[0] for s, k in pattern))
    return made


def _assign(starts: np.ndarray, per: np.ndarray, base: np.ndarray, tier: np.ndarray, begin: np.ndarray, containers: int, group: int):
    """starts: ascending size << 44 | rank where a window's share of a size begins."""
    steps = max(1, -(-containers // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size, rank = batch.column("tokens").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(starts, (size << 44) | rank, side="right") - 1
            container = base[at] + (rank - (starts[at] & ((1 << 44) - 1))) // per[at]
            row, col = container // steps, container % steps
            step = np.where(row % 2 == 0, col, steps - 1 - col)
            names = ["id", "piece", "start_token", "tokens"]
            found = [pa.array(container), pa.array(begin[at], pa.int32()), pa.array(tier[at], pa.int32()), pa.array(step)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *found], names=[*names, "container", "window_start", "tier", "step_group"])

    return run


def pack(df: DataFrame, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, group: int = GROUP, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Assign every item to a container of ``capacity``.

    ``df``: id (bigint), tokens (bigint). Items above the capacity are cut into pieces of ``capacity`` and a
    rest; no other item is cut. Returns id, piece (from 0), start_token, tokens, container (from 0), window_start
    (where the item's window begins in the container), tier (that window's length) and step_group. Each tier must
    divide the next one and the longest be the capacity. Null or non-positive sizes are no items; a null id is packed
    like any other; repeated rows are items of their own; an empty table gives no rows; extra columns are ignored.
    """
    ordered = sorted(tiers)
    if ordered[-1] != capacity or any(b % a for a, b in zip(ordered[:-1], ordered[1:], strict=True)):
        raise ValueError("the longest tier must equal the capacity, and each divide the next")
    cap = F.lit(capacity).cast("bigint")
    items = df.select(F.col("id").cast("bigint").alias("id"), F.col("tokens").cast("bigint").alias("total")).where("total > 0")
    last = F.expr(f"(total - 1) div {capacity}")
    pieces = items.select("id", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select("id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * cap).alias("start_token"), F.least(cap, F.col("total") - F.col("piece") * cap).alias("tokens"))
    counted = pieces.groupBy("tokens").count().collect()  # at most ``capacity`` rows
    histogram = {r["tokens"]: r["count"] for r in counted}
    salts = max(1, -(-max(histogram.values(), default=0) // salt_rows))

    spread = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = spread.groupBy("tokens", "salt").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = Window.partitionBy("tokens", "salt").orderBy("id", "piece")
    # capacity x salts rows, fixed by the number of rows over salt_rows
    ranked = spread.withColumn("r", F.row_number().over(place)).join(offset, ["tokens", "salt"]).withColumn("rank", (F.col("offset") + F.col("r") - 1).cast("bigint"))

    starts, per, base, tier, begin, seen, containers = [], [], [], [], [], dict.fromkeys(histogram, 0), 0
    for windows, times in plan(histogram, capacity, tiers):
        for t, at, pattern in windows:
            for s, k in pattern:
                starts.append(s << 44 | seen[s])
                per.append(k)
                base.append(containers)
                tier.append(t)
                begin.append(at)
                seen[s] += k * times
        containers += times
    order = np.argsort(np.array(starts, np.int64), kind="stable")
    arrays = [np.array(x, np.int64)[order] for x in (starts, per, base, tier, begin)]
    return ranked.select("id", "piece", "start_token", "tokens", "rank").mapInArrow(_assign(*arrays, containers, group), "id bigint, piece int, start_token bigint, tokens bigint, container bigint, window_start int, tier int, step_group bigint")


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    """ByT5 tokens: one per UTF-8 byte and one end mark."""
    return table(spark, folder, "documents").where("text is not null").select(F.col("doc_id").alias("id"), (F.octet_length("text") + 1).alias("tokens"))


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document (or piece of one above the capacity) with its container, window, tier and step group."""
    return pack(_sized(spark, folder)).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Windows, tokens and share of the space used, by the windows' tier."""
    per = p7_packing(spark, folder).groupBy("tier").agg(F.countDistinct("container", "window_start").alias("windows"), F.sum("tokens").alias("tokens"))
    return per.withColumn("fill", F.round(F.col("tokens") / (F.col("windows") * F.col("tier")), 6))


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What was placed: documents, pieces, tokens, containers above the capacity, and places of a document's tokens
    that are empty or taken twice."""
    placed = p7_packing(spark, folder)
    per = placed.groupBy("container").agg(F.sum("tokens").alias("used"))
    over = per.agg(F.count(F.when(F.col("used") > CAPACITY, 1)).alias("overfull"))
    docs = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max(F.col("start_token") + F.col("tokens")).alias("end"), F.sum((F.col("start_token") / CAPACITY).cast("bigint")).alias("order"))
    wrong = (F.col("tokens") != F.col("end")) | (F.col("order") != F.expr("pieces * (pieces - 1) div 2"))
    total = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("pieces"), F.lit(0)).cast("bigint").alias("pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"), F.count(F.when(wrong, 1)).alias("misplaced"))
    return total.crossJoin(over)  # one row each


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose pieces lie in several containers. Only whole-container and further pieces can be such."""
    cut = p7_packing(spark, folder).where(f"piece > 0 or tokens = {CAPACITY}").groupBy("doc_id").agg(F.max("piece").alias("piece"), F.min("container").alias("a"), F.max("container").alias("b"))
    return cut.where("piece > 0 and a <> b").select("doc_id")


QUERIES = {"p7_packing": p7_packing, "p7_fill": p7_fill, "p7_totals": p7_totals, "p7_found": p7_found}

_SIZES = "with t as (select doc_id, strlen(text) + 1 as n from documents where text is not null) "
ORACLE = {
    "p7_found": _SIZES + "select doc_id from t where n > 4096",
    "p7_totals": _SIZES + "select count(*) as documents, cast(coalesce(sum((n + 4095) // 4096), 0) as bigint) as pieces, cast(coalesce(sum(n), 0) as bigint) as tokens, cast(0 as bigint) as misplaced, cast(0 as bigint) as overfull from t",
}
