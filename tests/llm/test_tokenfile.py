import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lullwatch.llm import tokenfile as T
from tests.llm.conftest import SF, edge_texts, write_tables

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def brute(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("seq", [[], [0], [5, 5, 5], list(np.random.default_rng(0).integers(0, 700, 3000)), [65535, 0, 70000] * 400])
def test_wavelet_matrix(seq):
    seq = np.array(seq, np.uint32)
    m = T.WaveletMatrix.build(seq)
    assert m.values().tolist() == seq.tolist()
    for i in range(0, len(seq), 97):
        assert m.access(i) == seq[i]
    for v in {*seq[:20].tolist(), 3, 1 << 20}:
        where = np.flatnonzero(seq == v).tolist()
        assert m.count(v) == len(where) and m.count(v, len(seq) // 2) == sum(i < len(seq) // 2 for i in where)
        assert [m.select(v, k) for k in range(min(5, len(where)))] == where[:5]


def test_edges_round_trip(spark, tmp_path, edge_docs):
    more = spark.createDataFrame([(99, "Tab\x0bfeed\x0cÉCOLÉ ſ <|ENDOFTEXT|> <|startoftext|>x İ"), (None, "no id")], "doc_id long, text string")
    path = T.write(edge_docs.select("doc_id", "text").union(more), PATH, str(tmp_path / "f"), shard_tokens=600)
    got = {(r.doc_id, bytes(r.ids)): r.start for r in T.read(spark, path).collect()}
    at = 0
    rows = [(None, "no id")] + sorted([*enumerate(edge_texts()), (3, "\n\t  \n")], key=lambda r: r[0]) + [(99, more.first().text)]
    for i, t in rows:
        ids = np.array(brute(t), "<u4")
        start = got[i, ids.tobytes()]
        assert start == at or i == 3
        at += len(ids)
    assert T.read(spark, path).count() == len(rows)
    token = brute("lorem")[0]
    assert sum(r.occurrences for r in T.count_token(spark, path, token).collect()) == 9000
    word = brute("word")[0]
    want = sorted((i, k) for i, t in rows for k, x in enumerate(brute(t)) if x == word)
    assert sorted((r.doc_id, r.offset) for r in T.find_token(spark, path, word).collect()) == want


def test_query(spark, tmp_path, edge_docs):
    at = 0
    got = {r.doc_id: r for r in T.op6_token_file(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(brute(r.text), "<u4")
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert T.op6_token_file(spark, write_tables(tmp_path / "e", documents=edge_docs.limit(0))).count() == 0
