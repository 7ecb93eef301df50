import numpy as np
import pytest
from pyspark.sql import functions as F

from routescope.operators import dense, multi, routing, scoring
from routescope.operators.layers import two_nn

DDL = "pass_name string, text_id string, vec array<double>"


def _vectors(spark, n, seed, prefix, dim=8):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([("p", f"{prefix}{i:03d}", v.tolist()) for i, v in enumerate(x)], DDL)


def test_block_scores_equal_the_full_product(spark):
    q, dq = _vectors(spark, 13, 1, "q")
    d, dd = _vectors(spark, 57, 2, "d")
    got = scoring.dense_scores(dq, dd, None, query_block=5, doc_block=10).collect()
    assert len(got) == 13 * 57
    for r in got:
        assert abs(r["score"] - q[int(r["query_id"][1:])] @ d[int(r["doc_id"][1:])]) < 1e-9
    top = scoring.best(scoring.dense_scores(dq, dd, 4, query_block=5, doc_block=10), 4).collect()
    for r in top:
        order = np.argsort(-np.round(q[int(r["query_id"][1:])] @ d.T, 6), kind="stable")
        assert int(r["doc_id"][1:]) == order[r["rank"] - 1]


def test_no_queries_give_no_scores(spark):
    _, dd = _vectors(spark, 5, 2, "d")
    assert scoring.dense_scores(spark.createDataFrame([], DDL), dd, 3).count() == 0


def test_late_interaction(spark):
    rows = [("p", "q", 0, [1.0, 0.0]), ("p", "q", 1, [0.0, 1.0])]
    docs = [("p", "a", 0, [-1.0, 0.0]), ("p", "b", 0, [1.0, 0.0]), ("p", "b", 1, [0.0, -1.0])]
    ddl = "pass_name string, text_id string, vec_no int, vec array<double>"
    q, d = spark.createDataFrame(rows, ddl), spark.createDataFrame(docs, ddl)
    want = {"a": -1.0, "b": 1.0}
    assert {r["doc_id"]: r["score"] for r in scoring.max_sim(q, d).collect()} == want
    pairs = spark.createDataFrame([("p", "q", "a"), ("p", "q", "b")], "pass_name string, query_id string, doc_id string")
    assert {r["doc_id"]: r["score"] for r in scoring.rerank(pairs, q, d).collect()} == want


def test_one_vector_each_is_cosine(spark):
    q, dq = _vectors(spark, 4, 5, "q")
    d, dd = _vectors(spark, 6, 6, "d")
    one = lambda df: df.withColumn("vec_no", F.lit(0))
    a = {(r["query_id"], r["doc_id"]): r["score"] for r in scoring.max_sim(one(dq), one(dd)).collect()}
    b = {(r["query_id"], r["doc_id"]): r["score"] for r in scoring.dense_scores(dq, dd, None).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_fusion_with_weight_one_is_the_first_score(spark):
    ddl = "pass_name string, query_id string, doc_id string, score double"
    a = spark.createDataFrame([("p", "q", "d", 0.25)], ddl)
    b = spark.createDataFrame([("p", "q", "d", 0.75)], ddl)
    assert scoring.fuse(a, b, 1.0).first()["score"] == 0.25 and scoring.fuse(a, b, 0.0).first()["score"] == 0.75


def test_pools_fall_back_per_text(spark):
    ddl = "pass_name string, text_id string, layer int, slot int, vec array<double>, count bigint"
    pool = spark.createDataFrame([("p", "a", 0, 0, [1.0], 1), ("p", "a", 1, 0, [2.0], 1), ("p", "b", 0, 0, [3.0], 1), ("p", "b", 1, 0, [4.0], 2), ("p", "c", 0, 0, None, 0)], ddl)
    got = sorted((r["text_id"], r["vec_no"], r["vec"][0]) for r in multi.pool_vectors(pool, (0, 1), 2, 1).collect())
    assert got == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 4.0), ("c", 0, 0.0)]
    off = {r["text_id"]: r["start"] for r in multi.offsets(multi.pool_vectors(pool, (0, 1), 2, 1)).collect()}
    assert off == {"a": 0, "b": 2, "c": 3}
    means = {r["text_id"]: r["vec"] for r in dense.pool_mean(pool, (0, 1), 1).collect()}
    assert means == {"a": [1.5], "b": [3.5], "c": [0.0]}


def test_attention_selection():
    assert dense.attention_offsets(5, "second_half") == [2, 3, 4]
    assert dense.attention_offsets(5, "last") == [4]
    with pytest.raises(ValueError):
        dense.attention_offsets(5, "first")


PASS = "text_id string, routing_indices array<array<array<smallint>>>, routing_weights array<array<array<float>>>, routing_full_last array<array<float>>"


def test_divergence_of_a_pass_with_itself_is_zero(spark):
    rows = [("t", [[[1, 2], [3, 4]]], [[[0.5, 0.25], [0.5, 0.25]]], [[0.1] * 8]), ("null", None, None, None)]
    one = spark.createDataFrame(rows, PASS)
    got = routing.compare_passes(one, one, experts=8, slots=2).collect()
    assert [r["text_id"] for r in got] == ["t"]
    assert max(abs(x) for x in got[0]["kl"]) < 1e-12 and got[0]["top1"] == [0.0, 0.0] == got[0]["topk"]


def test_passes_compared_by_hand(spark):
    a = spark.createDataFrame([("t", [[[1, 2], [3, 4]]], [[[0.5, 0.25], [0.5, 0.0]]], [[0.5, 0.5, 0.0, 0.0, 0.0]])], PASS)
    b = spark.createDataFrame([("t", [[[2, 1], [3, -1]]], [[[0.25, 0.5], [0.5, 1.0]]], [[0.25, 0.75, 0.0, 0.0, 0.0]])], PASS)
    r = routing.compare_passes(a, b, experts=5, slots=2).first()
    want = 0.5 * np.log(0.5 / 0.25) + 0.5 * np.log(0.5 / 0.75)
    assert abs(r["kl"][0]) < 1e-9 and abs(r["kl"][1] - want) < 1e-6
    assert r["top1"] == [1.0, 0.0] and r["topk"] == [0.0, 0.0]
    bad = spark.createDataFrame([("t", [[[2, 1], [3]]], [[[0.25], [0.5]]], [[0.25, float("nan"), 0.0, 0.0, 0.0]])], PASS)
    r = routing.compare_passes(a, bad, experts=5, slots=2).first()
    assert r["top1"] == [1.0, 0.0] and r["topk"] == [1.0, 0.0]


def test_similarity_split_counts_disjoint_pairs(spark):
    active = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 0, 1), ("b", 0, 2), ("c", 1, 5), ("d", 0, 1)], "text_id string, layer int, expert int")
    judged = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a"), ("r", "b"), ("q", "zz")], "query_id string, doc_id string")
    for block in (2, 100):
        r = routing.relevance_split(active, judged, block=block).first()
        assert (r["relevant_mean"], r["relevant_pairs"], r["other_pairs"]) == (1.0, 1, 5)
        assert abs(r["other_mean"] - round((0.5 + 0.5) / 5, 6)) < 1e-9
        pairs = {(x["a"], x["b"]): x["jaccard"] for x in routing.jaccard_pairs(active, block=block).collect()}
        assert pairs == {("a", "b"): 1.0, ("a", "d"): 0.5, ("b", "d"): 0.5, ("a", "c"): 0.0, ("b", "c"): 0.0, ("c", "d"): 0.0}


def test_two_nearest_neighbours(spark):
    x = np.random.default_rng(0).uniform(size=(60, 2))
    rows = [(0, i, v.tolist()) for i, v in enumerate(x)] + [(1, 0, [0.0]), (1, 1, [1.0])] + [(2, i, [float(i // 2)]) for i in range(8)]
    got = {r["layer"]: r for r in two_nn(spark.createDataFrame(rows, "layer int, text_id int, vec array<double>")).collect()}
    d = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)[:, 1:3]
    mu = np.sort(d[:, 1] / d[:, 0])
    a, b = np.log(mu), -np.log(1 - np.arange(1, 61) / 61)
    assert abs(got[0]["dimension"] - (a @ b) / (a @ a)) < 1e-5
    assert np.isnan(got[1]["dimension"])


@pytest.mark.parametrize("group_rows", [9, 1024])
def test_streamed_ranks_equal_a_full_sort(spark, group_rows):
    rng, k = np.random.default_rng(12), 3
    x = {f"d{i:03d}": rng.standard_normal(6) for i in range(300)} | {f"q{i:02d}": rng.standard_normal(6) for i in range(40)}
    for i in range(100, 300, 7):  # copies tie: the smaller id is ahead
        x[f"d{i:03d}"] = x[f"d{i % 3:03d}"]
    wanted = {t: None if t[0] == "d" else [f"d{j:03d}" for j in rng.choice(300, 60, replace=False)] + ["gone"] for t in x}
    two = {t: None if i % 9 == 0 else [float("nan")] * 4 if i % 11 == 0 else rng.standard_normal(4).tolist() for i, t in enumerate(x)}
    rows = [(p, t, wanted[t], (v if p == "p" else -v * (t[0] == "q")).tolist(), two[t]) for p in "pr" for t, v in x.items()]
    texts = spark.createDataFrame(rows, "pass_name string, text_id string, wanted array<string>, one array<double>, two array<double>")
    families = [{"A": {"one": 1.0}}, {"B": {"two": 1.0}, "C": {"two": 2.0}}]
    want = set()
    for p in "pr":
        for m in "ABC":
            vec = {t: np.array(v if m == "A" else w) for q, t, _, v, w in rows if q == p and (m == "A" or w is not None and w[0] == w[0])}
            unit = {t: v / max(np.linalg.norm(v), 1e-10) for t, v in vec.items()}
            docs = sorted(t for t in unit if t[0] == "d")
            for q in (t for t in unit if t[0] == "q"):
                order = sorted(docs, key=lambda d: (-round(float(unit[q] @ unit[d]), 6), d))[:k]
                want |= {(m, p, q, d, r) for r, d in enumerate(order, 1) if r == 1 or d in wanted[q]}
    got = scoring.judged_ranks(texts, ["p", "r"], families, 40, k, group_rows)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_best_keeps_the_first_of_equals_over_chunks():
    docs, queries = np.ones((5000, 1)), np.array([[1.0], [-1.0]])
    best = scoring._Best(2, 4)
    for lo in range(0, 5000, 1700):
        part = docs[lo : lo + 1700]
        best.add(queries, np.arange(2), part, np.arange(lo, lo + len(part)))
    row, rank, place = best.settle()
    assert list(zip(row, rank, place)) == [(q, r + 1, r) for q in range(2) for r in range(4)]


def test_only_judged_candidates_leave_the_ranking(spark):
    rng = np.random.default_rng(13)
    rows = [("p", f"d{i:05d}", None, rng.standard_normal(8).tolist()) for i in range(20000)] + [("p", f"q{i:03d}", ["d00007"], rng.standard_normal(8).tolist()) for i in range(200)]
    texts = spark.createDataFrame(rows, "pass_name string, text_id string, wanted array<string>, v array<double>")
    assert 200 <= scoring.judged_ranks(texts, ["p"], [{"A": {"v": 1.0}}], 200, 100).count() <= 400


def test_every_pair_of_blocks_is_a_task_and_shares_round_half_up(spark):
    rng = np.random.default_rng(15)
    active = {f"t{i:02d}": {int(e) for e in rng.choice(200, rng.integers(1, 150), replace=False)} for i in range(40)}
    active |= {"x": set(range(128)), "y": {0}}  # 1 / 128 is a tie at six digits
    df = spark.createDataFrame([(t, e // 128, e % 128) for t, own in active.items() for e in own], "text_id string, layer int, expert int")
    want = {(a, b): len(active[a] & active[b]) / len(active[a] | active[b]) for a in active for b in active if a < b}
    for block in (9, 100):
        exact, rounded = (routing.jaccard_pairs(df, block=block, digits=d) for d in (None, 6))
        assert {(r["a"], r["b"]): r["jaccard"] for r in exact.collect()} == want and exact.count() == len(want)
        spark_rounds = {(r["a"], r["b"]): r["j"] for r in exact.select("a", "b", F.round("jaccard", 6).alias("j")).collect()}
        assert {(r["a"], r["b"]): r["jaccard"] for r in rounded.collect()} == spark_rounds
        tasks = rounded.rdd.getNumPartitions()
        assert tasks == (15 if block == 9 else 1)
    assert spark_rounds["x", "y"] == 0.007813
    assert routing.jaccard_pairs(df.limit(0)).count() == 0
