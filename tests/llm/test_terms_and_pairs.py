from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from routescope.llm import bitmaps, p1_terms, p5_pairs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 65535), min_size=1, max_size=300), min_size=1, max_size=4))
def test_bitmaps_round_trip_and_union(sets):
    parts = [bitmaps.encode(np.array(sorted(s), np.uint16)) for s in sets]
    assert all(set(bitmaps.decode(p).tolist()) == s for p, s in zip(parts, sets))
    whole = bitmaps.union(parts)
    assert set(bitmaps.decode(whole).tolist()) == set().union(*sets) and bitmaps.cardinality(whole) == len(set().union(*sets))


def test_bitmap_forms():
    run, some, many = np.arange(100, 9000), np.array([1, 5, 900]), np.arange(0, 65536, 2)
    raw = [bitmaps.encode(x.astype(np.uint16)) for x in (run, some, many)]
    assert [r[0] for r in raw] == [bitmaps.RUNS, bitmaps.ARRAY, bitmaps.BITS]
    assert [bitmaps.cardinality(r) for r in raw] == [8900, 3, 32768]
    assert bitmaps.cardinality(bitmaps.union(raw)) == len(set(run) | set(some) | set(many))


def test_term_frequency_against_counting(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # several batches a block: bitmaps are merged
    try:
        rng = np.random.default_rng(3)
        docs = [[int(x) for x in rng.zipf(1.5, rng.integers(0, 12)) % 40] for _ in range(400)] + [None, [], [-1, None, 7, 7]]
        df = spark.createDataFrame([(d, i, "x") for i, d in enumerate(docs)], "terms array<int>, term int, field string")
        got = {r["term"]: r for r in p1_terms.term_frequency(df, {"t": "terms"}, rare=3, common=0.3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    clean = [[t for t in d if t is not None and t >= 0] for d in docs if d is not None]
    occ, recs = Counter(t for d in clean for t in d), Counter(t for d in clean for t in set(d))
    assert got.keys() == occ.keys()
    for t, r in got.items():
        mark = "rare" if recs[t] <= 3 else "common" if recs[t] > 0.3 * len(clean) else "useful"
        assert (r["occurrences"], r["records"], r["records_with_field"], r["mark"], r["layer"]) == (occ[t], recs[t], len(clean), mark, -1)


def test_empty_tables_give_nothing(spark, payloads):
    folder = payloads([])
    assert p1_terms.p1_found(spark, folder).count() == 0 and p5_pairs.p5_found(spark, folder).count() == 0


def test_only_the_current_row_counts(spark, payloads, at):
    one = {"text_id": "a", "token_ids": [1, 1, 2]}
    folder = payloads([one, one, {**one, "token_ids": [9], "written_at": at(0), "loaded_at": at(9)}, {"text_id": None, "token_ids": [5]}, {"text_id": "b", "token_ids": None}, {"text_id": "c", "pass_name": "paper_rerouted", "token_ids": [8]}])
    got = {r["term"]: (r["occurrences"], r["records"]) for r in p1_terms.p1_terms(spark, folder).collect()}
    assert got == {1: (2, 1), 2: (1, 1)}


def test_pairs_by_hand(spark, payloads):
    nan = float("nan")
    ix = [[[1, 2, 2, 130, -1, 3, 4, 5, 128]], [[7, 8, 9, 9, 9, 9, 9, 9, 128]]]
    w = [[[0.5, 0.5, 0.5, 1.0, 1.0, nan, 0.0, None, 1.0]], [[1.0, 1.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]]]
    rows = [{"text_id": str(i), "routing_indices": ix, "routing_weights": w} for i in range(3)]
    rows += [{"text_id": "n1", "routing_indices": None, "routing_weights": w}, {"text_id": "n2", "routing_indices": ix, "routing_weights": None}, {"text_id": "short", "routing_indices": [[[1, 2]]], "routing_weights": [[[1.0]]]}]
    got = {(r["layer"], r["expert_a"], r["expert_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["baskets"]) for r in p5_pairs.p5_pairs(spark, payloads(rows)).collect()}
    assert got == {(0, 1, 2): (3, 4, 3, 4), (1, 7, 8): (3, 3, 3, 3)}


def test_pairs_against_counting(spark, payloads):
    rng = np.random.default_rng(5)
    rows, n, one, two = [], Counter(), Counter(), Counter()
    for t in range(60):
        ix, w = rng.integers(-1, 12, (2, 5, 9)), np.where(rng.random((2, 5, 9)) < 0.8, 1.0, 0.0)
        rows.append({"text_id": str(t), "routing_indices": ix.tolist(), "routing_weights": w.tolist()})
        for layer in range(2):
            for tok in range(5):
                basket = sorted({int(e) for e, x in zip(ix[layer, tok, :8], w[layer, tok, :8]) if e >= 0 and x > 0})
                n[layer] += bool(basket)
                one.update((layer, e) for e in basket)
                two.update((layer, a, b) for i, a in enumerate(basket) for b in basket[i + 1 :])
    got = {(r["layer"], r["expert_a"], r["expert_b"]): r for r in p5_pairs.p5_pairs(spark, payloads(rows)).collect()}
    assert got.keys() == two.keys()
    for k, r in got.items():
        assert (r["n_ab"], r["n_a"], r["n_b"], r["baskets"]) == (two[k], one[k[:2]], one[k[0], k[2]], n[k[0]])


def test_pairs_in_baskets_of_any_size(spark):
    rng = np.random.default_rng(6)
    baskets = [(["x", "y", None][i % 3], [f"i{j}" for j in rng.choice(12, rng.integers(0, 9))]) for i in range(200)] + [("x", ["i1", "i2", "i2", None])] * 90 + [("x", None), ("x", [None])]
    df = spark.createDataFrame([(*b, 1) for b in baskets], "scope string, items array<string>, n_ab int")
    want = {}
    for scope in ("x", "y", None):
        sets = [set(i) - {None} for s, i in baskets if s == scope and i]
        sets = [s for s in sets if s]
        count = lambda *names: sum(set(names) <= s for s in sets)
        for i in range(12):
            for j in range(12):
                a, b = f"i{i}", f"i{j}"
                if a < b and count(a, b):
                    want[scope, a, b] = (count(a, b), count(a), count(b), len(sets), round(count(a, b) * len(sets) / (count(a) * count(b)), 6))
    got = {(r["scope"], r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["baskets"], r["lift"]) for r in p5_pairs.basket_pairs(df).collect()}
    assert got == want
    assert p5_pairs.basket_pairs(df.limit(0)).count() == 0
