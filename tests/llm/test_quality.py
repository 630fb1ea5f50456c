import zlib

import numpy as np

from lullwatch.llm import quality as Q
from tests.llm.conftest import edge_texts, write_tables


def test_risk_separates_and_ignores_negative_labels():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 1, (1600, 4)), rng.normal(3, 1, (400, 4))))
    trusted = np.zeros(2000, bool)
    trusted[:800] = True
    net = Q.fit(x, trusted, 0.8)
    s = net.score(x)
    assert (s[:1600] >= 0.5).mean() > 0.95 and (s[1600:] < 0.5).mean() > 0.95


def test_prior_is_estimated_from_positives_and_unlabelled():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8):
        web, good = rng.random(6000) < share, rng.normal(0, 1, (3000, 4))
        x = np.concatenate((good, np.where(web[:, None], rng.normal(0, 1, (6000, 4)), rng.normal(2.5, 1, (6000, 4)))))
        order = rng.permutation(len(x))
        positive, unlabelled = (order < 3000), (order >= 3000)
        assert abs(Q.estimate_prior(x[order], positive, unlabelled) - share) < 0.06


def test_negative_labels_change_nothing(spark, edge_docs):
    labels = [(k, 1) for k in range(0, 15, 2)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    one, two = Q.train(edge_docs, frame(labels)), Q.train(edge_docs, frame(labels + [(k, 0) for k in range(1, 15, 2)]))
    assert all(np.array_equal(a, b) for a, b in zip(one.weights, two.weights))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["quality"].to_dict()
    rows = [(labels[r.doc_id], r.predicted, r.score) for r in Q.op4_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b, _ in rows]) > 0.98
    good, bad = [s for q, _, s in rows if q], [s for q, _, s in rows if not q]
    assert np.mean([g > b for g in good[:300] for b in bad]) > 0.99


def test_edges(spark, tmp_path, edge_docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(None, 1, 0), (5, None, None), (5, 1, 1), (5, 1, 1)], "doc_id long, quality int, score int")
    rows = Q.op4_quality(spark, write_tables(tmp_path / "t", documents=edge_docs, labels=labels)).collect()
    assert len(rows) == len(edge_texts()) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    neutral = Q.op4_quality(spark, write_tables(tmp_path / "n", documents=edge_docs, labels=labels.limit(0))).collect()
    assert {r.score for r in neutral} == {0.5}
    assert Q.op4_quality(spark, write_tables(tmp_path / "e", documents=edge_docs.limit(0), labels=labels)).count() == 0
