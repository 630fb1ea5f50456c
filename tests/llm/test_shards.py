import zlib
from collections import defaultdict

from lullwatch.llm import shards as S
from tests.llm.conftest import SF, write_tables


def check(rows, texts, shards=40):
    by = defaultdict(list)
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    sizes = [sum(r.size for r in by.get(k, [])) for k in range(shards)]
    assert set(by) <= set(range(shards))
    return sizes, max(r.size for r in rows)


def test_sizes_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = S.op5_kd_shards(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == len(texts)
    sizes, largest = check(rows, texts)
    assert max(sizes) - min(sizes) <= 2 * largest


def test_one_text_and_one_source_for_all(spark, tmp_path):
    docs = spark.createDataFrame([(k, "same text", "en", "s") for k in range(4000)], "doc_id long, text string, lang string, source string")
    sizes, _ = check(S.op5_kd_shards(spark, write_tables(tmp_path / "t", documents=docs)).collect(), dict.fromkeys(range(4000), "same text"))
    assert max(sizes) - min(sizes) <= 3 * 25
    same = docs.withColumn("doc_id", S.F.lit(None).cast("long"))
    assert S.op5_kd_shards(spark, write_tables(tmp_path / "s", documents=same)).count() == 4000


def test_edges(spark, tmp_path, edge_docs):
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    got = S.op5_kd_shards(spark, write_tables(tmp_path / "t", documents=edge_docs))
    check(got.collect(), texts)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert S.op5_kd_shards(spark, write_tables(tmp_path / "e", documents=edge_docs.limit(0))).count() == 0
    assert {r.shard for r in S.shard(spark.read.parquet(f"{SF}/documents.parquet"), target_bytes=100_000).collect()} == set(range(-(-S.coordinates(spark.read.parquet(f"{SF}/documents.parquet")).agg({"size": "sum"}).first()[0] // 100_000)))
