import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from routescope.functions.text import human_bytes
from routescope.operators import evaluation
from routescope.sources import files, npz
from routescope.sources.tables import latest
from routescope.streaming.incremental import record_stream, run_available


def test_latest_keeps_one_row_per_key(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 5, "n")]
    got = latest(spark.createDataFrame(rows, "k string, t int, v string"), ["k"], ["t"]).collect()
    assert sorted((r["k"], r["v"]) for r in got) == [("a", "y"), ("b", "z")]


def test_archives_round_trip(spark, tmp_path):
    folder = tmp_path / "embeddings" / "rerouted"
    folder.mkdir(parents=True)
    np.savez(folder / "doc_0000001.npz", token_ids=np.array([1, 2], np.int32), seq_len=np.int32(2), hs_mean=np.ones((2, 3), np.float16), routing_indices=np.arange(12, dtype=np.int16).reshape(2, 2, 3))
    r = npz.read_payload_archives(spark, str(tmp_path)).first()
    assert (r["pass_name"], r["filename"], r["token_ids"], r["seq_len"]) == ("rerouted", "doc_0000001.npz", [1, 2], 2)
    assert r["hs_mean"] == [[1.0] * 3] * 2 and r["routing_indices"][1][1] == [9, 10, 11] and r["hs_last_token"] is None
    npz.write_payloads(npz.read_payload_archives(spark, str(tmp_path), ["token_ids"]), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("pass_name = 'rerouted'").count() == 1


def _archive(rng, arch, tokens):
    heads, e, v = arch.value_dim // arch.head_dim, arch.hidden, arch.value_dim
    layers, attn, slots = arch.layers, len(arch.attention), arch.top_k + 1
    f16 = lambda *shape: rng.standard_normal(shape).astype(np.float16)
    out = {"token_ids": rng.integers(0, 9, tokens).astype(np.int32), "seq_len": np.int32(tokens), "hs_last_token": f16(layers, e), "hs_mean": f16(layers, e), "hs_final_all_tokens": f16(tokens, e)}
    order = np.argsort(rng.random((layers, tokens, arch.experts)), axis=2)[:, :, : arch.top_k]
    out["routing_indices"] = np.concatenate((order, np.full((layers, tokens, 1), 256)), axis=2).astype(np.int16)
    out["routing_weights"] = rng.random((layers, tokens, slots)).astype(np.float16)
    out["routing_full_last"] = rng.random((layers, arch.experts)).astype(np.float32)
    out |= {"va_mean": f16(attn, v), "va_all_tokens": f16(attn, tokens, v), "attn_weights_last": rng.random((attn, heads, tokens)).astype(np.float16), "attn_weights_reroute": rng.random((attn, heads)).astype(np.float16)}
    for family, rows, dim in (("va_expert", attn, v), ("expert_out", layers, e), ("expert_ffn", layers, e), ("expert_contrib", layers, e)):
        counts = rng.integers(0, 4, (rows, slots)).astype(np.int16)
        out |= {f"{family}_pool": np.where(counts[..., None] > 0, f16(rows, slots, dim), 0).astype(np.float16), f"{family}_mask": counts > 0, f"{family}_counts": counts}
    return out | {"shared_expert_index": np.int16(256), "value_dim": np.int32(v), "hidden_size": np.int32(e)}


def test_all_methods_from_archives(spark, tmp_path):
    rng = np.random.default_rng(3)
    arch = npz.ModelShape.from_architecture({"num_layers": 4, "num_experts": 6, "num_experts_per_tok": 2, "hidden_size": 5, "value_dim": 6, "head_dim": 3, "attn_layer_indices": [1, 3]})
    made = {}
    for name in ("rerouted", "paper_rerouted"):
        folder = tmp_path / "embeddings" / name
        folder.mkdir(parents=True)
        for i in range(9):
            kind, text = ("query", f"q{i}") if i < 3 else ("doc", f"d{i}")
            made[name, text] = _archive(rng, arch, 3 + i % 4) | {"text_id": np.asarray(text)}
            np.savez(folder / f"{kind}_{i:07d}.npz", **made[name, text])
    assert set(npz.FIELDS) == set(made["rerouted", "q0"]) and len(npz.FIELDS) == 28
    npz.write_payloads(npz.read_payload_archives(spark, str(tmp_path)), str(tmp_path / "table"))
    npz.write_payloads(npz.read_payload_archives(spark, str(tmp_path)).where("pass_name = 'rerouted' and kind = 'doc'"), str(tmp_path / "table"))  # replaces its own part only
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.count() == 18
    signals = npz.ArchiveSignals(table, arch)
    unit = lambda x: x / max(np.linalg.norm(x), 1e-10)

    def pools(p, family, rows, least):
        x, c = p[f"{family}_pool"].astype(float)[rows].reshape(-1, p[f"{family}_pool"].shape[-1]), p[f"{family}_counts"][rows].ravel()
        return x[c >= least] if (c >= least).any() else x[c > 0] if (c > 0).any() else np.zeros((1, x.shape[1]))

    def out_mean(p):
        c = p["expert_out_counts"].astype(float)
        kept = [(c[i][:, None] * p["expert_out_pool"][i].astype(float)).sum(0) / c[i].sum() for i in range(4) if c[i].sum()]
        return np.mean(kept, axis=0)

    def aligned(p):
        w = p["attn_weights_last"].astype(float)[1]
        w = w / w.sum(1, keepdims=True)
        return np.concatenate([w[h] @ p["va_all_tokens"].astype(float)[1][:, 3 * h : 3 * h + 3] for h in range(2)])

    def sparse(p):
        x = np.zeros(24)
        for layer in range(4):
            x[layer * 6 + p["routing_indices"][layer, -1, :2]] = p["routing_weights"][layer, -1, :2]
        return x

    want = {"VA": lambda p: p["va_mean"].astype(float)[1], "VA-all-attn": lambda p: p["va_mean"].astype(float).mean(0), "AlignedWVA": aligned, "ExpertOut-mean": out_mean, "MoEE-sparse": sparse, "KV-Embedding": lambda p: (p["hs_last_token"].astype(float)[-1] + p["hs_mean"].astype(float)[-1]) / 2}
    got = {(r["method"], r["pass_name"], r["text_id"]): r["vec"] for r in evaluation.represent(signals, evaluation.DENSE).collect()}
    assert len(got) == 12 * 18
    for (name, text), p in made.items():
        for method, build in want.items():
            assert np.allclose(got[method, name, text], unit(build(p)), atol=1e-6), (method, text)
    several = {}
    for r in evaluation.represent(signals, evaluation.MULTI).collect():
        several.setdefault((r["method"], r["pass_name"], r["text_id"]), []).append((r["vec_no"], r["vec"]))
    for (name, text), p in made.items():
        for method, x in (("ExpertPool-Value-attn", pools(p, "va_expert", slice(1, 2), 2)), ("ExpertPool-ExpertOut-delta", pools(p, "expert_out", [0, 2], 1)), ("TokenLevel-HS-final", p["hs_final_all_tokens"].astype(float))):
            assert np.allclose([v for _, v in sorted(several[method, name, text])], [unit(v) for v in x], atol=1e-6), (method, text)
    kinds = table.where("pass_name = 'rerouted'").select("text_id", "kind")
    judged = spark.createDataFrame([(f"q{i}", f"d{3 + i}", 1) for i in range(3)], "query_id string, doc_id string, rel int")
    stored = lambda key, build: files.materialised(spark, str(tmp_path), key, build)
    results = evaluation.evaluate(signals, kinds, judged, stored, k=4).collect()
    assert len(results) == 50 and {(r["num_vectors"], r["vec_dim"]) for r in results if r["method"] == "MoEE+VA-0.3"} == {(1.0, 24)}
    ranks = {}
    for q in range(3):  # a ranking and its metric by hand
        s = {d: float(unit(want["VA"](made["rerouted", f"q{q}"])) @ unit(want["VA"](made["rerouted", d]))) for d in (f"d{i}" for i in range(3, 9))}
        ranks[q] = sorted(s, key=lambda d: (-round(s[d], 6), d)).index(f"d{3 + q}") + 1
    r = next(r for r in results if (r["method"], r["pass_name"]) == ("VA", "rerouted"))
    assert r["ndcg_10"] == round(np.mean([1 / np.log2(x + 1) if x <= 4 else 0 for x in ranks.values()]), 6) and r["index_bytes"] == 4 * 6 * 6
    again = next(r for r in results if (r["method"], r["pass_name"]) == ("RouteSig-then-TokenLevel-HS", "rerouted"))
    assert again["num_vectors"] == round(np.mean([3 + i % 4 for i in range(3, 9)]), 6) and (again["vec_dim"], again["index_bytes"]) == (5, 0)
    lines = [x["line"] for x in evaluation.stats_lines(spark.createDataFrame(results), {"VA": 1.5}, human_bytes).collect()]
    assert "VA-rerouted: build_time=1.500s, index_size=144.00 B, avg_vectors=1.000" in lines and any(x.endswith("avg_nonzero_dims=8.000") for x in lines)
    bad = table.withColumn("va_mean", F.when(F.col("text_id") == "d5", F.transform("va_mean", lambda v: F.transform(v, lambda x: F.lit(float("nan")).cast("float")))).otherwise(F.col("va_mean")))
    with pytest.raises(Exception, match="non-finite vector of text d5"):
        evaluation.represent(npz.ArchiveSignals(bad, arch), {"VA": evaluation.DENSE["VA"]}).collect()


def test_manifest_and_corpus(spark, tmp_path):
    records = spark.createDataFrame([("doc", 1, "007", "doc_0000001.npz", "t")], "kind string, ordinal int, text_id string, filename string, text string")
    files.write_manifest(records, str(tmp_path / "m"))
    back = files.read_manifest(spark, str(tmp_path / "m"), "doc")
    assert back.first()["text_id"] == "007"
    assert files.pass_rows(back, "/r", "p", "doc").first()["path"] == "/r/embeddings/p/doc_0000001.npz"
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text(json.dumps({"_id": "1", "title": "t", "text": "x"}) + "\n")
    (tmp_path / "queries.jsonl").write_text("".join(json.dumps({"_id": i, "text": "x"}) + "\n" for i in ("a", "b")))
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\na\t1\t1\n")
    corpus, queries, qrels = files.read_corpus(spark, str(tmp_path))
    assert (corpus.count(), [r["query_id"] for r in queries.collect()], qrels.first()["rel"]) == (1, ["a"], 1)


def test_materialised_representation_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    key = files.representation_key({"method": "x"}, {"rows": 3})
    assert key != files.representation_key({"method": "x"}, {"rows": 4}) and len(key) == 16
    for rebuild in (False, False, True):
        assert files.materialised(spark, str(tmp_path), key, build, rebuild).count() == 3
    assert len(built) == 2


def test_stream_plans_each_record_once(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    ddl = "kind string, ordinal int, text_id string, text string, filename string, created_at timestamp_ntz, loaded_at timestamp_ntz"

    def deliver(rows):
        spark.createDataFrame(rows, "kind string, ordinal int, text_id string, text string, filename string").withColumn("created_at", F.expr("timestamp_ntz'2024-01-01 00:00:00'")).withColumn("loaded_at", F.expr("timestamp_ntz'2024-01-01 01:00:00'")).select(*[c.split()[0] for c in ddl.split(", ")]).write.mode("append").parquet(source)

    def run():
        run_available(record_stream(spark, source), ("p", "q"), out, ckpt).awaitTermination()
        return sorted((r["text_id"], r["pass_name"]) for r in spark.read.parquet(out).collect())

    deliver([("doc", 1, "a", "x", "doc_0000001.npz"), ("query", 1, "b", None, "query_000001.npz")])
    assert run() == [("a", "p"), ("a", "q")]
    # delivered again; a text that was null comes with content; one delivered twice at once
    deliver([("doc", 1, "a", "x", "doc_0000001.npz"), ("doc", 2, "c", "y", "doc_0000002.npz"), ("query", 1, "b", None, "query_000001.npz"), ("query", 1, "b", "now", "query_000001.npz"), ("doc", 2, "c", "y", "doc_0000002.npz")])
    assert run() == run() == [(t, p) for t in "abc" for p in "pq"]
