"""Ties, repeats, nulls and very long texts, where the other tests don't have them."""

from collections import Counter

from glyphtide.llm import ann, mixing, toxicity

from .data import docs, prose
from .test_ann_pipeline import by_query, vectors


def test_ties_over_many_blocks_go_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "BASE_BLOCK", 64)
    monkeypatch.setattr(ann, "SPLIT_VECTORS", 200)
    rows = [(i, [1.0, 0.25, 0.5] if i % 3 == 0 else [0.1 * (i % 7), -0.2, 0.1]) for i in range(1500)]
    got = by_query(ann.search(vectors(spark, rows)).collect())
    for q, found in got.items():
        if q % 3 == 0:
            assert [i for i, _, _ in found] == [i for i in range(0, 66, 3) if i != q][:20]
            assert {s for _, s, _ in found} == {1.3125}


def test_probes_are_in_the_order_of_their_wall_distances():
    import numpy as np

    index = ann.Index(8, 4, 1.0, 1.0)
    q = index.lift(np.random.default_rng(2).standard_normal((5, 8)), True)
    for t in range(index.tables):
        cells, above = index._cells(q, t)
        for r, visited in enumerate(index.probes(q, t, 10**6)):
            assert len(set(visited)) == 81 == len(visited) and visited[0] == index.keys(q, t)[r]
            scores = []
            for key in visited:
                digits = np.array([key // ann.RADIX**k % ann.RADIX for k in range(4)]) + ann.LOW - 1
                step = digits - cells[r]
                scores.append(sum(above[r, k] ** 2 if step[k] < 0 else (index.width - above[r, k]) ** 2 if step[k] > 0 else 0.0 for k in range(4)))
            assert np.allclose(scores, sorted(scores))
    assert ann.perturbation_sets(4, 10) == ann.perturbation_sets(4)[:10]


def test_scores_of_repeated_and_very_long_texts(spark):
    weights = {"": -1.0, "=bad": 3.0, "bad": 0.5, "goo": -0.25, "=good": -1.0}
    rows = [(1, "bad words"), (2, "bad words " * 50_000), (3, "BAD  words"), (4, "good"), (5, "x" * 500_000 + " bad words"), (6, None), (7, "")]
    got = {r.doc_id: r for r in toxicity.score(docs(spark, rows), weights).collect()}
    assert got[1].score == got[2].score == got[3].score == got[5].score > 0.9 > got[6].score == got[7].score > got[4].score
    assert got[1].predicted == 1 and got[4].predicted == 0


def test_a_mix_of_rows_without_or_with_equal_ids(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, prose(i, 1 + i % 40)) for i in range(240)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == 240 and all(0 <= r.taken <= 3 * r.size for r in got)
    total, target = Counter(), {}
    for r in got:
        total[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(total[s] - t) <= 0.05 * t + 64 for s, t in target.items())


def test_the_pipeline_with_repeated_ids_and_null_texts(spark, tmp_path):
    import corpus_pipeline

    item = prose(500, 30)
    rows = [(i % 50, prose(i, 40)) for i in range(100)] + [(None, None), (None, None), (3, None), (3, ""), (4, ""), (None, prose(7, 40)), (60, f"{prose(61, 9)} {item}"), (60, prose(62, 40)), (61, prose(62, 40))]
    frame = docs(spark, rows)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = frame
    for name, stage in corpus_pipeline.STAGES[1:3]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    kept = Counter(r.text for r in now.collect())
    # One of each text stays, rows without an id and a text all do, and the leak goes.
    assert kept == Counter({t for _, t in rows if t is not None and item not in t}) + Counter({None: 3})
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = [sum(r.shard == s for r in final) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and final
