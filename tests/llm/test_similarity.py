import numpy as np
from pyspark.sql import functions as F

from routescope.llm import p3_similar, p4_clusters, p6_neighbours


def _sets(seed=1, n=60, universe=512):
    rng = np.random.default_rng(seed)
    out = [set(rng.choice(universe, 40, replace=False).tolist()) for _ in range(n)]
    for i in range(0, n, 3):  # near copies and copies
        out.append(set(list(out[i])[: 40 - i % 12]) | {int(x) for x in rng.choice(universe, i % 12)})
        out.append(set(out[i]))
    return out


def _pairs(sets, threshold):
    return {(f"{i:03d}", f"{j:03d}") for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


def _expand(pairs, members):
    of = {}
    for r in members.collect():
        of.setdefault(r["class_id"], []).append(r["id"])
    found = {tuple(sorted((x, y))) for r in pairs.collect() for x in of[r["id_a"]] for y in of[r["id_b"]]}
    return found | {(x, y) for m in of.values() for x in m for y in m if x < y}


def test_similar_pairs_against_brute_force(spark):
    sets = _sets()
    rows = [(f"{i:03d}", 0, [*s, *list(s)[:2], None], "x") for i, s in enumerate(sets)] + [("null", 0, None, "x"), ("none", 0, [], "x"), (None, 0, [1], "x")]
    df = spark.createDataFrame(rows, "id string, side int, items array<bigint>, words string")
    want = _pairs(sets, 0.6)
    assert len(want) > 20
    for universe in (512, None):
        assert _expand(*p3_similar.similar_classes(df, 0.6, universe=universe)) == want


def test_pairs_between_two_tables(spark):
    rows = [("a", 0, [1, 2, 3]), ("b", 0, [1, 2, 3, 4]), ("x", 1, [1, 2, 3]), ("y", 1, [9])]
    df = spark.createDataFrame(rows, "id string, side int, items array<bigint>")
    pairs, _ = p3_similar.similar_classes(df, 0.7, universe=64, across=True)
    assert sorted((r["id_a"], r["id_b"]) for r in pairs.collect()) == [("a", "x"), ("b", "x")]


def test_empty_tables(spark, payloads):
    folder = payloads([])
    for query in (p3_similar.p3_found, p3_similar.p3_links, p4_clusters.p4_found, p4_clusters.p4_clusters, p6_neighbours.p6_found, p6_neighbours.p6_neighbours):
        assert query(spark, folder).count() == 0


def test_a_hot_class_of_copies_is_one_representative(spark, payloads):
    ix = lambda e: [[[e] * 9, [e + 1] * 9]] * 4
    rows = [{"pass_name": "paper_rerouted", "text_id": f"c{i:02d}", "routing_indices": ix(3)} for i in range(30)] + [{"pass_name": "paper_rerouted", "text_id": "other", "routing_indices": ix(50)}, {"pass_name": "paper_rerouted", "text_id": "null", "routing_indices": None}]
    got = {r["text_id"]: (r["class_id"], r["class_size"], r["links"]) for r in p3_similar.p3_links(spark, payloads(rows)).collect()}
    assert got == {**{f"c{i:02d}": ("c00", 30, 29) for i in range(30)}, "other": ("other", 1, 0)}
    assert p3_similar.p3_found(spark, payloads(rows)).count() == 30 * 29 // 2


def _bytes(x):
    return np.asarray(x, np.float32).tobytes()


def _clustered(seed=0, groups=12, dim_a=48, dim_b=96):
    rng = np.random.default_rng(seed)
    a, b = [], []
    for g in range(groups):
        ca, cb = rng.standard_normal(dim_a), rng.standard_normal(dim_b)
        for _ in range(3 + 5 * g):
            a.append(ca + 0.3 * rng.standard_normal(dim_a))
            b.append(cb + 0.2 * rng.standard_normal(dim_b))
    for _ in range(30):
        a.append(rng.standard_normal(dim_a))
        b.append(rng.standard_normal(dim_b))
    for i in range(10):  # alike in one vector only
        a.append(a[i])
        b.append(rng.standard_normal(dim_b))
    return np.array(a, np.float32), np.array(b, np.float32)


def _brute_groups(a, b):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit(a.astype(float)) @ unit(a.astype(float)).T >= 0.75) & (unit(b.astype(float)) @ unit(b.astype(float)).T >= 0.8)
    label = list(range(len(a)))
    for _ in range(len(a)):
        new = [min(label[j] for j in np.flatnonzero(link[i])) for i in range(len(a))]
        if new == label:
            break
        label = new
    return {f"{i:04d}": f"{x:04d}" for i, x in enumerate(label)}


def test_groups_against_brute_force(spark):
    a, b = _clustered()
    want = _brute_groups(a, b)
    df = spark.createDataFrame([(f"{i:04d}", _bytes(x), _bytes(y)) for i, (x, y) in enumerate(zip(a, b))], "id string, a binary, b binary")
    for bucket_rows in (20000, 8):  # the second splits the larger buckets
        groups, links, _ = p4_clusters.link_groups(df, bucket_rows=bucket_rows)
        assert {r["id"]: r["group_id"] for r in groups.collect()} == want
        assert links.where("closeness < 1.55").count() == 0


def test_a_record_linked_only_to_a_member_that_is_no_pivot(spark):
    """Each core is linked to a peripheral record, that to a further one, which is near the core but not linked to it."""
    rng = np.random.default_rng(7)
    a, b = [], []
    corner = np.linalg.cholesky([[1, 0.8, 0.5], [0.8, 1, 0.78], [0.5, 0.78, 1]])  # core, peripheral, further one
    for _ in range(8):
        near = corner @ np.linalg.qr(rng.standard_normal((48, 3)))[0].T
        a += [near[0] + 0.1 * rng.standard_normal(48) / np.sqrt(48) for _ in range(300)] + [near[1], near[2]]
        cb = rng.standard_normal(96)
        b += [cb + 0.05 * rng.standard_normal(96) for _ in range(302)]
    a, b = np.array(a, np.float32), np.array(b, np.float32)
    want = _brute_groups(a, b)
    assert len(set(want.values())) == 8
    df = spark.createDataFrame([(f"{i:04d}", _bytes(x), _bytes(y)) for i, (x, y) in enumerate(zip(a, b))], "id string, a binary, b binary")
    assert {r["id"]: r["group_id"] for r in p4_clusters.link_groups(df)[0].collect()} == want


def test_pairs_that_just_reach_both_thresholds(spark):
    rng = np.random.default_rng(8)
    a, b = [], []
    for _ in range(1500):
        for out, dim, cosine in ((a, 48, 0.751), (b, 96, 0.801)):
            u, v = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
            out += [u, cosine * u + np.sqrt(1 - cosine**2) * v]
    df = spark.createDataFrame([(f"{i:04d}", _bytes(x), _bytes(y)) for i, (x, y) in enumerate(zip(a, b))], "id string, a binary, b binary")
    group = {r["id"]: r["group_id"] for r in p4_clusters.link_groups(df)[0].collect()}
    missed = sum(group[f"{i + 1:04d}"] != f"{i:04d}" for i in range(0, 3000, 2))
    assert missed <= 5  # 1.5 expected at most, at a miss probability of 0.001


def _meet_rate(n, pairs, cosine_a, cosine_b, seed=12):
    """Share of pairs at these cosines that meet in a table of the plan for n rows."""
    rng = np.random.default_rng(seed)
    hashes, m, tables = p4_clusters.plan_tables(n, p4_clusters.MIN_A, p4_clusters.MIN_B, p4_clusters.MISS)
    sides = {}
    for name, dim, cosine in (("a", 48, cosine_a), ("b", 512, cosine_b)):
        u, v = rng.standard_normal((2, pairs, dim)).astype(np.float32)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v -= (u * v).sum(axis=1, keepdims=True) * u
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        sides[name] = u, cosine * u + np.float32(np.sqrt(1 - cosine**2)) * v
    met = np.zeros(pairs, bool)
    for t in range(tables):
        x, y = sides["a" if t % 4 == 3 else "b"]
        met |= p4_clusters.corners(x, 1000 + t, hashes, m) == p4_clusters.corners(y, 1000 + t, hashes, m)
    return met.mean(), tables


def test_tables_are_planned_for_the_thresholds():
    for n in (3000, 30_000, 1_000_000):
        rate, tables = _meet_rate(n, 3000, p4_clusters.MIN_A, p4_clusters.MIN_B)
        assert rate >= 0.996, (n, rate, tables)


def test_links_in_a_split_bucket(spark):
    """All records are alike in the second vector and fill the same buckets; pairs alike in the first hide in them."""
    rng = np.random.default_rng(9)
    a, b = [], []
    cb = rng.standard_normal(96)
    for _ in range(300):
        u, v = np.linalg.qr(rng.standard_normal((48, 2)))[0].T
        a += [u, 0.8 * u + 0.6 * v]
    a += [a[0] + 0.01 * rng.standard_normal(48) for _ in range(400)]  # the hot group
    b = [cb + 0.02 * rng.standard_normal(96) for _ in a]
    a, b = np.array(a, np.float32), np.array(b, np.float32)
    df = spark.createDataFrame([(f"{i:04d}", _bytes(x), _bytes(y)) for i, (x, y) in enumerate(zip(a, b))], "id string, a binary, b binary")
    assert {r["id"]: r["group_id"] for r in p4_clusters.link_groups(df, bucket_rows=100)[0].collect()} == _brute_groups(a, b)


def test_rows_of_different_labels_share_a_cell(spark):
    labels = ["hot"] * 37 + ["warm"] * 12 + [f"l{i}" for i in range(9)]
    rows = [(f"r{i:02d}", x, 1) for i, x in enumerate(labels)] + [("s0", "x", 2), ("s1", "y", 2)] + [(f"t{i:02d}", "one", 3) for i in range(20)]
    got = p4_clusters._cells(spark.createDataFrame(rows, "id string, label string, bucket int"), 5).collect()
    cells = {}
    for r in got:
        cells.setdefault((r["bucket"], r["sub"]), []).append((r["id"], r["label"]))
    met = {(x, y) for c in cells.values() for x, lx in c for y, ly in c if x < y and lx != ly}
    assert met == {(x, y) for x, lx, bx in rows for y, ly, by in rows if x < y and lx != ly and bx == by}
    assert not any(k == 3 for k, _ in cells) and len(cells) > 10


def test_members_go_to_the_closest_of_all_pivots_of_their_group(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((40, 6)).astype(np.float32)
    group = ["g00"] * 30 + ["m30"] * 10
    ids = ["g00" if i == 0 else f"m{i:02d}" for i in range(40)]
    members = spark.createDataFrame([(g, i, _bytes(v), _bytes(v)) for g, i, v in zip(group, ids, x)], "group_id string, id string, a binary, b binary")
    links = spark.createDataFrame([(ids[i], ids[i % 5], i % 5 < 4) for i in range(5, 30)], "x string, p string, pivot boolean")
    sizes = spark.createDataFrame([("g00", 30), ("m30", 10)], "group_id string, size int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {ids[i]: ids[int((u[:4] @ u[i]).argmax())] if i < 30 else "m30" for i in range(40)}
    for part_rows in (20000, 7):
        assert {r["id"]: r["pivot"] for r in p4_clusters.closest_pivots(members, links, sizes, part_rows).collect()} == want


def test_typicality_and_recomputed_medoids(spark, payloads):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(5):
        ca, cb = rng.standard_normal(48), rng.standard_normal((4, 128))
        for i in range(3 + 4 * g):
            a, b = ca + 0.3 * rng.standard_normal(48), cb + 0.3 * rng.standard_normal((4, 128))
            rows.append({"pass_name": "paper_rerouted", "text_id": f"g{g}m{i:02d}", "hs_mean": [a.tolist()], "routing_full_last": b.tolist()})
    folder = payloads(rows)
    vec = {r["text_id"]: np.concatenate([v / np.linalg.norm(v) for v in (np.array(r["hs_mean"][0]), np.array(r["routing_full_last"]).ravel())]) for r in rows}
    best = lambda ids, k: sorted(ids, key=lambda i: (-round(float(vec[i] @ sum(vec[j] for j in ids)), 6), i))[:k]
    groups = {r["group_id"]: r for r in p4_clusters.p4_clusters(spark, folder).collect()}
    assert {k: (r["size"], r["typical"].split(",")) for k, r in groups.items()} == {f"g{g}m00": (3 + 4 * g, best([f"g{g}m{i:02d}" for i in range(3 + 4 * g)], 3)) for g in range(5)}
    members = p4_clusters.p4_members(spark, folder).collect()
    clusters = {}
    for r in members:
        clusters.setdefault(r["pivot"], []).append(r)
    assert sorted(r["text_id"] for r in members) == sorted(vec)
    for pivot, own in clusters.items():
        ids = [r["text_id"] for r in own]
        assert {(r["group_id"], r["cluster_size"], r["medoid"]) for r in own} == {(ids[0][:2] + "m00", len(ids), best(ids, 1)[0])}
    of_group = {}
    for p in clusters:
        of_group.setdefault(p[:2], []).append(p)
    assert all(r["pivot"] == min(of_group[r["text_id"][:2]], key=lambda p: (-round(float(vec[p] @ vec[r["text_id"]]), 6), p)) for r in members)


def test_coarse_cosines_keep_their_bound():
    rng = np.random.default_rng(13)
    for dim in (1, 2, 48, 512):
        x = np.concatenate([rng.standard_normal((500, dim)), np.zeros((2, dim)), rng.standard_normal((50, dim)) ** 5]).astype(np.float32)
        y = (x + rng.standard_normal(x.shape) * rng.random((len(x), 1))).astype(np.float32)
        got, off = p4_clusters._coarse_cosine(p4_clusters._coarse(x), p4_clusters._coarse(y))
        assert (np.abs(got - np.einsum("ij,ij->i", p4_clusters._unit(x), p4_clusters._unit(y))) <= off).all() and off[:500].max() < 0.06


def test_the_exact_mode(spark):
    a, b = _clustered(3, 6)
    df = spark.createDataFrame([(f"{i:04d}", _bytes(x), _bytes(y)) for i, (x, y) in enumerate(zip(a, b))], "id string, a binary, b binary")
    groups, _, _ = p4_clusters.link_groups(df, miss=0, bucket_rows=50)
    assert {r["id"]: r["group_id"] for r in groups.collect()} == _brute_groups(a, b)


def test_copies_of_zero_vectors_and_ties(spark):
    rows = [("b", _bytes([1, 0]), _bytes([1, 0])), ("a", _bytes([1, 0]), _bytes([1, 0])), ("c", _bytes([1, 0]), _bytes([1, 0])), ("z", _bytes([1, 0]), _bytes([0, 0])), ("y", _bytes([0, 1]), _bytes([0, 0]))]
    groups, _, _ = p4_clusters.link_groups(spark.createDataFrame(rows, "id string, a binary, b binary"))
    assert {r["id"]: r["group_id"] for r in groups.collect()} == {"a": "a", "b": "a", "c": "a", "z": "z", "y": "y"}


def _brute_nearest(x, ids, k, least=-2.0):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i and s[i, j] >= least), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in order}
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((300, 12)), np.repeat(rng.standard_normal((1, 12)), 9, axis=0), np.repeat(rng.standard_normal((5, 12)), 2, axis=0)])
    x[300:] = x[300:].astype(np.float32)
    ids = [f"t{i:03d}" for i in range(len(x))]
    nan, inf = float("nan"), float("inf")
    bad = [("n1", None), ("n2", [nan] * 12), ("n3", [inf] + [0.0] * 11), ("n4", [0.0] * 12), ("n5", []), ("n6", [None] + [1.0] * 11), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)] + [(i, v, 1) for i, v in bad], "text_id string, v array<float>, id int")
    want = _brute_nearest(x.astype(np.float32).astype(float), ids, 4)
    for cell_rows in (10000, 40):
        got = {(r["text_id"], r["neighbour"]) for r in p6_neighbours.nearest(df, ["v"], k=4, factor=1.0, cell_rows=cell_rows).collect()}
        assert got == want
    loose = {(r["text_id"], r["neighbour"]) for r in p6_neighbours.nearest(df, ["v"], k=4, factor=1.5, cell_rows=40).collect()}
    assert len(loose & want) >= 0.9 * len(want)
    near = {(r["text_id"], r["neighbour"]) for r in p6_neighbours.nearest(df, ["v"], k=4, factor=1.0, min_similarity=0.7, cell_rows=40).collect()}
    assert near == _brute_nearest(x.astype(np.float32).astype(float), ids, 4, 0.7)


def test_queries_named_by_a_condition(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(str(i), rng.standard_normal(6).tolist()) for i in range(40)], "text_id string, v array<float>")
    got = p6_neighbours.nearest(df, ["v"], k=2, query="cast(text_id as int) % 20 = 0")
    assert sorted({r["text_id"] for r in got.collect()}) == ["0", "20"] and got.count() == 4


def test_a_group_of_very_many_pivots_keeps_them_all(spark):
    rng = np.random.default_rng(14)
    x = rng.standard_normal((900, 6)).astype(np.float32)
    x[500:520] = x[3]  # equal pivots: the smaller id is closer
    ids = ["g000", *(f"m{i:03d}" for i in range(1, 900))]
    members = spark.createDataFrame([("g000", i, _bytes(v), _bytes(v)) for i, v in zip(ids, x)], "group_id string, id string, a binary, b binary")
    # 600 pivots; the first ones absorb two records, the others one
    links = spark.createDataFrame([(ids[600 + i % 300], ids[i % 600], True) for i in range(700)], "x string, p string, pivot boolean")
    sizes = spark.createDataFrame([("g000", 900)], "group_id string, size int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(2 * u.astype(np.float64) @ u[:600].T.astype(np.float64), 4)
    for part_rows in (20000, 100):
        got = {r["id"]: r for r in p4_clusters.closest_pivots(members, links, sizes, part_rows).collect()}
        assert len(got) == 900 and all(abs(near[i, ids.index(got[ids[i]]["pivot"])] - near[i].max()) < 1e-3 for i in range(900))
        assert all(got[ids[i]]["pivot"] == ids[i if i < 500 else 3] for i in range(520))
        assert all(abs(got[ids[i]]["typical"] - 2 * u[i] @ u.sum(axis=0)) < 1e-2 for i in range(900))
    # a cluster named by a record that went to another one still has its typical member
    lone = p4_clusters.closest_pivots(members.withColumn("group_id", F.lit("zz")), links.where("false"), spark.createDataFrame([("zz", 900)], "group_id string, size int"))
    assert {r["pivot"] for r in lone.collect()} == {"g000"}
