import math

import pytest
from pyspark.sql import functions as F

from routescope.config import ProjectFolders, Timings
from routescope.functions.text import human_bytes, human_duration, sort_key, strip
from routescope.functions.vectors import finite, softmax, unit
from routescope.operators.components import components
from routescope.operators.layers import fallback_layers, select_layers
from routescope.operators.metrics import per_query, per_query_binary
from routescope.operators.pools import expert_pool
from routescope.operators.records import batch_status, document_text, filename, limited, numbered, partial_outputs, prompt, query_batches
from routescope.plans.payloads import _features


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_strip_like_python(spark):
    texts = ["  a ", "　b ", "\x1cc\n", "", " \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_document_text_of_missing_parts(spark):
    df = spark.createDataFrame([("", "b"), ("t", ""), (None, " b "), ("t", None), (" t ", "b")], "title string, body string")
    assert [r[0] for r in df.select(document_text(F.col("title"), F.col("body"))).collect()] == [". b", "t.", ". b", "t.", "t. b"]


def test_ids_sort_by_number_then_text(spark):
    df = spark.createDataFrame([("10",), ("9",), ("a",), ("007",), ("7",), (None,)], "id string")
    got = numbered(df, sort_key(F.col("id")), "n").orderBy("n").collect()
    assert [r["id"] for r in got if r["id"] is not None] == ["007", "7", "9", "10", "a"]


def test_numbering_is_dense_over_many_ranges(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g")).repartition(7)
    got = numbered(df, [-F.col("id")], "n", within=["g"])
    for g in range(3):
        part = sorted(rows(got.where(f"g = {g}").select("id", "n")), reverse=True)
        assert [n for _, n in part] == list(range(1, len(part) + 1))


def test_filename_is_not_truncated(spark):
    df = spark.createDataFrame([("doc", 12345678), ("query", 7)], "k string, n int")
    assert [r[0] for r in df.select(filename(F.col("k"), F.col("n"))).collect()] == ["doc_12345678.npz", "query_000007.npz"]


def test_printed_sizes_and_durations(spark):
    df = spark.createDataFrame([(59.94,), (119.7,), (7260.0,), (0.0,)], "s double")
    assert [r[0] for r in df.select(human_duration(F.col("s"))).collect()] == ["59.9s", "1m 60s", "2h 1m", "0.0s"]
    df = spark.createDataFrame([(0,), (1023,), (1024,), (6272,), (1024**5,)], "n bigint")
    assert [r[0] for r in df.select(human_bytes(F.col("n"))).collect()] == ["0.00 B", "1023.00 B", "1.00 KB", "6.12 KB", "1024.00 TB"]


def test_limits(spark):
    df = spark.createDataFrame([("doc", i) for i in range(1, 5)] + [("query", i) for i in range(1, 4)], "kind string, ordinal int")
    count = lambda d, q: sorted(rows(limited(df, d, q).groupBy("kind").count()))
    assert count(2, 1) == [("doc", 2), ("query", 1)]
    assert count(0, None) == [("query", 3)]
    assert count(-1, 0) == [("doc", 3)]
    assert count(None, None) == [("doc", 4), ("query", 3)]


def test_prompt(spark):
    df = spark.createDataFrame([("doc", "x"), ("query", "y")], "k string, t string")
    assert [r[0] for r in df.select(prompt(F.col("k"), F.col("t"))).collect()] == ["Context: x\nCompress the Context in one word:", "Query: y\nCompress the Query in one word:"]


def test_batches(spark):
    records = spark.createDataFrame([("a", "doc", 1), ("b", "doc", 2), ("c", "query", 1), ("d", "query", 2), ("e", "query", 3)], "text_id string, kind string, ordinal int")
    done = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p"), ("b", "p")], "text_id string, pass_name string")
    status = batch_status(records, done, 2)
    assert {r["text_id"]: r["status"] for r in status.collect()} == {"a": "skip", "b": "reset", "c": "new", "d": "new", "e": "new"}
    planned = query_batches(status.where("status <> 'skip'"), 2)
    assert {r["text_id"]: r["batch"] for r in planned.collect()} == {"b": 0, "c": 0, "d": 0, "e": 1}


def test_vector_kernels(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), (None,), ([1.0, None],)], "v array<double>")
    got = df.select(unit(F.col("v")).alias("u"), finite(F.col("v")).alias("f")).collect()
    assert got[0]["u"] == [0.6, 0.8] and got[1]["u"] == [0.0, 0.0]
    assert [r["f"] for r in got] == [True, True, False, False, False]
    p = df.limit(1).select(softmax(F.array(F.lit(0.0), F.lit(math.log(3.0))))).first()[0]
    assert abs(p[1] - 0.75) < 1e-12


def test_components_against_union_find(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (9, 9), (None, 3), (7, 8), (8, 7), *[(100 + i, 101 + i) for i in range(40)], *[(200, 201 + i) for i in range(50)]]
    got = dict(rows(components(spark.createDataFrame(edges, "u int, v int"))))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7, **{100 + i: 100 for i in range(41)}, **{200 + i: 200 for i in range(51)}}
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("p", "q", "a", 1), ("p", "q", "b", 2), ("p", "q", "c", 3)], "pass_name string, query_id string, doc_id string, rank int")
    judged = spark.createDataFrame([("q", "a", 1), ("q", "c", 2), ("q", "x", 1), ("q", "b", 0), ("z", "a", 1)], "query_id string, doc_id string, rel int")
    got = per_query(ranked, judged, (2, 3)).collect()
    assert len(got) == 1
    ideal = 2 + 1 / math.log2(3) + 1 / 2
    assert abs(got[0]["ndcg_3"] - (1 + 2 / 2) / ideal) < 1e-12
    assert got[0]["recall_2"] == 1 / 3 and got[0]["precision_3"] == 2 / 3
    assert abs(got[0]["average_precision"] - (1 + 2 / 3) / 3) < 1e-12


def test_layer_selection():
    s = select_layers({0: 1.0, 1: 5.0, 2: 3.0, 3: 4.0}, [1, 3], 4)
    assert s.global_layers == (0, 1) and s.attention_layers == (1,)
    far = select_layers({i: 9.0 + i for i in range(20)} | {5: 1.0}, [3, 9, 15], 20)
    assert far.global_layers == (5, 6, 7) and far.attention_layers == (9, 15)
    assert select_layers({0: math.nan}, [1, 3], 4) == fallback_layers([1, 3], 4, "no finite score")
    assert fallback_layers([1, 3, 5], 6, "x").attention_layers == (3, 5)


def test_a_slot_nothing_was_routed_to_is_zero(spark):
    key = "pass_name string, text_id string, layer int, tok int, "
    routing = spark.createDataFrame([("p", "t", 0, 1, 0, 3), ("p", "t", 0, 1, 1, 5), ("p", "t", 0, 1, 2, 9), ("p", "t", 0, 0, 0, 3)], key + "slot int, expert int")
    values = spark.createDataFrame([("p", "t", 0, 1, 3, [1.0, 2.0]), ("p", "t", 0, 0, 3, [3.0, 6.0])], key + "expert int, vec array<double>")
    shared = spark.createDataFrame([("p", "t", 0, 1, [4.0, 4.0])], key + "vec array<double>")
    got = {r["slot"]: (r["count"], r["vec"]) for r in expert_pool(routing, values, shared, 2, 1, 2).collect()}
    assert got == {0: (2, [2.0, 4.0]), 1: (0, [0.0, 0.0]), 2: (1, [4.0, 4.0])}


def test_layers_are_sampled_from_queries_where_there_are_no_documents(spark, tmp_path):
    records = [("query", i, f"q{i}", "x", f"query_{i:06d}.npz") for i in range(1, 6)]
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    spark.createDataFrame(records, "kind string, ordinal int, text_id string, text string, filename string").withColumn("loaded_at", at).write.parquet(str(tmp_path / "records.parquet"))
    rows = [("rerouted", f"q{i}", [[float(i), 1.0]]) for i in range(1, 6)]
    spark.createDataFrame(rows, "pass_name string, text_id string, hs_last_token array<array<float>>").withColumn("written_at", at).withColumn("loaded_at", at).write.parquet(str(tmp_path / "payloads.parquet"))
    assert sorted(r["text_id"] for r in _features(spark, str(tmp_path), 3).collect()) == ["q1", "q2", "q3"]
    spark.createDataFrame([], "kind string, ordinal int, text_id string, loaded_at timestamp_ntz").write.mode("overwrite").parquet(str(tmp_path / "records.parquet"))
    with pytest.raises(ValueError):
        _features(spark, str(tmp_path), 3)


def test_positions_and_partial_outputs(spark):
    records = spark.createDataFrame([("q1", "query", 1), ("d2", "doc", 2), ("d1", "doc", 1)], "text_id string, kind string, ordinal int")
    done = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("q1", "a")], "text_id string, pass_name string")
    status = batch_status(records, done, 2)
    assert {r["text_id"]: (r["position"], r["status"]) for r in status.collect()} == {"d1": (1, "skip"), "d2": (2, "new"), "q1": (3, "reset")}
    assert [tuple(r) for r in partial_outputs(status, done).select("text_id", "pass_name").collect()] == [("q1", "a")]


def test_binary_metric_equals_the_graded_one(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "a", 1)], "query_id string, doc_id string, rank int")
    judged = spark.createDataFrame([("q", "a", 1), ("q", "c", 1), ("q", "x", 1)], "query_id string, doc_id string, rel int")
    graded = ranked.withColumn("rel", F.col("doc_id").isin("a", "c").cast("int")).withColumn("relevant", F.when(F.col("query_id") == "q", 3).otherwise(0))
    a, b = per_query(ranked, judged, (2,)).collect(), per_query_binary(graded, (2,)).collect()
    assert [(r["query_id"], round(r["ndcg_2"], 9), round(r["recall_2"], 9)) for r in a] == [(r["query_id"], round(r["ndcg_2"], 9), round(r["recall_2"], 9)) for r in b]


def test_settings_and_timings(tmp_path):
    folders = ProjectFolders(str(tmp_path / "x")).made()
    assert (tmp_path / "x" / "embeddings" / "paper_rerouted").is_dir() and folders.of_pass("rerouted").endswith("embeddings/rerouted")
    with pytest.raises(ValueError):
        folders.of_pass("other")
    t = Timings(peak_bytes=2 * 1024**3)
    t.add("rerouted", 100.0, 40)
    t.add("rerouted", 19.7, 10)
    assert t.lines() == ["rerouted: total 1m 60s", "rerouted: mean 2.3940s a text over 50 texts", "peak memory: 2.00 GB", "end to end: 1m 60s"]
