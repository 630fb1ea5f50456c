import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lullwatch.llm import decontaminate, quality
from tests.llm.conftest import SF, write_tables
from tests.llm.test_decontaminate import brute as benchmark_hits
from tests.llm.test_similarity import first_of_classes
from tests.llm.test_substrings import brute as repeats


def test_run_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    net = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    docs = {r.doc_id: r.text for r in rows if net.score(quality.statistics(r.text)[None])[0] >= quality.THRESHOLD}
    docs = {i: docs[i] for i in first_of_classes(docs)}
    docs = {i: left if gone else docs[i] for i, _, gone, left in repeats(list(docs.items())) if not gone or left}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {}
    for i, t in docs.items():
        n, hit, _ = benchmark_hits(t, items)
        if len(hit) <= 0.5 * n:
            words = decontaminate.words(t)
            clean[i] = [w for k, w in enumerate(words) if k not in hit] if hit else t
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(clean)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in clean.items():
        if isinstance(t, str):
            assert got[i].decoded == t
        else:
            assert decontaminate.words(got[i].decoded) == t
        assert np.frombuffer(got[i].ids, "<u4").tolist() == tokenizer.encode(got[i].decoded, add_special_tokens=False).ids


def test_stages_keep_the_columns(spark, tmp_path, edge_docs):
    labels = spark.createDataFrame([(k, 1 if k < 9 else 0) for k in range(14)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    for name, docs in (("t", edge_docs), ("e", edge_docs.limit(0))):
        sf = write_tables(tmp_path / name, documents=docs, labels=labels, benchmark=bench)
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for k, (_, build) in enumerate(corpus_pipeline.STAGES[:-1]):
            build(spark, docs, sf).write.parquet(f"{sf}/{k}")
            after = spark.read.parquet(f"{sf}/{k}")
            assert after.dtypes == docs.dtypes
            docs = after
        assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "ids", "n_tokens", "decoded"]
