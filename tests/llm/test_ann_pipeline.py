import numpy as np

from glyphtide.llm import ann, common

from .data import DOCS, docs, empty, prose

VECTORS = "vec_id long, embedding array<float>, label int, score double, cells int, tab int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0.5, 1, 2) for i, v in rows], VECTORS).repartition(3)


def exact(rows, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([np.asarray(v, np.float32).astype(float) for _, v in rows])
    out = {}
    for r in np.flatnonzero(ids % 20 == 0):
        s = x @ x[r]
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[r])[:k]
        out[int(ids[r])] = [(int(i), -d) for d, i in order]
    return out


def by_query(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 16)) * 3
    rows = [(i, rng.standard_normal(16) + centres[i % 12]) for i in range(3000)]
    want, got = exact(rows), by_query(ann.search(vectors(spark, rows)).collect())
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, 21))
        scores = [(-s, i) for i, s, _ in found]
        assert scores == sorted(scores)
        truth = dict(want[q])
        hits += sum(i in truth for i, _, _ in found)
        assert all(abs(s - truth[i]) < 1e-9 for i, s, _ in found if i in truth)
    assert hits >= 0.9 * 20 * len(want)


def test_awkward_vectors(spark):
    rows = [(0, [1, 0, 0]), (1, [0, 1, 0]), (2, None), (3, [0, 0, 0]), (4, [1, None, 0]), (5, [float("nan"), 0, 0]), (6, [float("inf"), 0, 0]), (7, [1, 0, 0]), (8, [1, 0, 0]), (20, [2, 0, 0]), (40, [0, 0, 0]), (9, [1, 0]), (7, [1, 0, 0])]
    got = by_query(ann.search(vectors(spark, rows)).collect())
    assert {q: [i for i, _, _ in v] for q, v in got.items()} == {0: [20, 7, 8, 1], 20: [0, 7, 8, 1]}
    assert ann.search(vectors(spark, [])).collect() == [] and ann.search(vectors(spark, [(1, None)])).collect() == []
    assert ann.search(vectors(spark, [(0, [1, 1, 1])])).collect() == [] and ann.search(vectors(spark, [(1, [1, 1, 1]), (2, [1, 1, 1])])).collect() == []


def test_hot_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0, 0, 0] if i % 3 == 0 else rng.standard_normal(4)) for i in range(900)]
    want, got = exact(rows), by_query(ann.search(vectors(spark, rows)).collect())
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(want)
    hits = sum(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q], strict=True))
    assert hits >= 0.9 * 20 * len(want)


def test_pipeline_end_to_end(spark, tmp_path):
    import corpus_pipeline

    rows, labels = [], []
    item = prose(700, 40)
    for i in range(240):
        text = prose(1000 + i, 60)
        if i % 8 == 0:
            text += f" vexmor{prose(i, 1)} and more"
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        if i in (33, 34):
            text = f"{prose(i, 90)} {item} {prose(i + 5, 90)}"
        if i in (51, 52, 53):
            text = prose(4000, 80)
        rows.append((i, text))
    frame = docs(spark, rows)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    docs_now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs_now, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs_now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in docs_now.select("doc_id").collect()})
    toxic = {i for i, _, t in labels if t}
    assert len(kept[0] & toxic) <= 2 and len(kept[0]) >= 205
    assert kept[0] - kept[1] == {52, 53} & kept[0]
    assert kept[1] - kept[2] == {33, 34} & kept[1]
    before = len(common.settled_tables(spark))
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = common.settled_tables(spark)[before:]
    assert len([p for p in left if "pipeline-" in p]) == 1 and not any("near-" in p or "leak" in p for p in left)
    assert {r.doc_id for r in final} <= kept[2]
    sizes = [sum(r.shard == s for r in final) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and len(final) > 100


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_survives_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[2]
    shutil.copytree(root / "glyphtide", tmp_path / "glyphtide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_schema_of_docs_is_what_the_tests_say(spark):
    assert docs(spark).schema == empty(spark).schema and DOCS.startswith("doc_id long")
