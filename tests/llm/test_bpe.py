import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lullwatch.llm import bpe
from tests.llm.conftest import SF, edge_texts, write_tables

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def brute(text):
    t = TOKENIZER
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_edges_match_the_library(edge_docs):
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(edge_docs, PATH), PATH).collect()}
    for k, t in enumerate(edge_texts()):
        ids, text = brute(t)
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].decoded == text and got[k].n_tokens == len(ids)
    assert bpe.encode(edge_docs, PATH).count() == len(edge_texts()) + 1


def test_other_layouts_give_the_same(edge_docs):
    want = sorted((r.doc_id, bytes(r.ids)) for r in bpe.encode(edge_docs, PATH).collect())
    docs = edge_docs.repartition(5, "doc_id").orderBy("doc_id")
    assert sorted((r.doc_id, bytes(r.ids)) for r in bpe.encode(docs, PATH, buckets=3).collect()) == want


def test_empty_table(spark, tmp_path, edge_docs):
    out = bpe.op3_bpe_codec(spark, write_tables(tmp_path / "t", documents=edge_docs.limit(0)))
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_query_matches_the_library(spark):
    got = {r.doc_id: r for r in bpe.op3_bpe_codec(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text")).collect()
    assert len(rows) == len(got)
    for r in rows:
        ids, text = brute(r.text)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[r.doc_id].n_tokens == len(ids)


@pytest.mark.parametrize("text", ["'s't 's", "a b   c", "x\u0085y", "   z", "1/2 ½ ² ٣", "a\u3000b c\u00a0 d", "x<|endoftext|> y <|endoftext|>z", "it 's 've\n\n new", "a \x1c b\x1c c"])
def test_words_have_the_ids_of_the_text(text):
    parts = bpe.words_of(text)
    assert "".join(parts) == text and all(len(w) > 1 for w in parts[1:])
    assert sum((TOKENIZER.encode(w, add_special_tokens=False).ids for w in parts), []) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_word_lists_of_equal_length_have_other_hashes():
    lists = [["a", "bc"], ["ab", "c"], ["a\nb", "c"], ["a", "b\nc"], ["a", "b"], []]
    assert len({bpe.checksum(x) for x in lists}) == len(lists)
