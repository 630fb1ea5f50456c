import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from lullwatch.llm import alignment as C
from tests.llm.conftest import LONG, SF, write_tables

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(text):
    """Tokens of both kinds as (id, start, end) by the libraries, whole texts; empty if they do not spell the text."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    shown = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
    hidden = [b for b in range(256) if b not in shown.values()]
    shown.update({chr(256 + k): b for k, b in enumerate(hidden)})
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    ids = t.encode(" " + text, add_special_tokens=False).ids
    parts = [(i, bytes(shown[c] for c in t.id_to_token(i))) for i in ids]
    pieces = [(i, s.id_to_piece(i)) for i in s.encode(text)]
    pieces = [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and s.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
    out = []
    for kind in (parts, pieces):
        if not text or b"".join(p for _, p in kind) != (" " + text).encode():
            return [], []
        at, found = 0, []
        for i, p in kind:
            found.append((i, at, at + len(p)))
            at += len(p)
        out.append(found)
    return out


def brute(docs):
    rows, linked = [], []
    counts = Counter()
    for i, text in docs:
        a, b = spans(text or "")
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(x[0]) for x in a if low <= x[1] < e) + "|" + ",".join(str(x[0]) for x in b if low <= x[1] < e))
            low = e
        pairs = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        counts.update(set(pairs))
        linked.append(pairs)
        rows.append([i, len(a), len(b), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return sorted((*r[:5], sum(counts[p] == top[p[0]] for p in pairs), sum(counts[p] for p in pairs), r[5]) for r, pairs in zip(rows, linked, strict=True))


def got(spark, folder):
    return sorted(tuple(r) for r in C.op11_token_alignment(spark, folder).collect())


TEXTS = ["Hello  world, café 中文字 🙂!", "a\nb\r\n\tc   d", "<|endoftext|> </s> <0x41> <s>", "▁ odd", "x" * 60, None, "", " ", "tail ", "Hello  world, café 中文字 🙂!", "naïveté's 1234567 l'été\x00z", "ﬁ ½ é"]


@pytest.mark.parametrize("block", [C.BLOCK_CHARS, 30])
def test_query_matches_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(C.blocks, "__defaults__", (block,))
    docs = list(enumerate(TEXTS)) + [(100 + r.doc_id, r.text[:700]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(12).collect()]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, block string, n int").repartition(3)
    assert got(spark, write_tables(tmp_path / "t", documents=df)) == brute(docs)


def test_sample_tables_are_spelt(spark):
    rows = C.op11_token_alignment(spark, SF).collect()
    assert all(r.n_a and r.n_b and r.n_groups <= min(r.n_a, r.n_b) and r.n_links >= max(r.n_a, r.n_b) and r.count_sum >= r.n_links for r in rows)


def test_chunks_are_cut_without_a_trace(spark):
    encode_a, (encode_b, _, _, crossing) = C.byte_level(A)[0], C.sentence_pieces(B)
    assert not crossing
    for text in (LONG, "word  two " * 9000 + "x" * 70_000, "é" * 140_000, "a b\u3000c d\x1c e  f\n g", " lead it's 1 2"):
        parts = C.chunks_of(text)
        assert " ".join(parts) == text and len(parts) == len(C.GAP.split(text))
        assert sum(encode_b(parts), []) == encode_b([text])[0] and sum(encode_a(parts), []) == encode_a([text])[0]


def test_general_output_spells_the_groups(spark):
    rows = [r for r in C.align(spark.createDataFrame([(1, "Hello  world, 中文"), (2, None)], "doc_id long, text string"), A, B).collect() if r.pairs is None]
    a, b, x, y = (np.frombuffer(rows[0][c], "<u4") for c in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
    assert x.sum() == len(a) and y.sum() == len(b) and len(x) == len(y) and rows[1].a_ids == b""


def test_edges(spark, tmp_path, edge_docs):
    rows = got(spark, write_tables(tmp_path / "t", documents=edge_docs))
    assert len(rows) == edge_docs.count()
    assert C.op11_token_alignment(spark, write_tables(tmp_path / "e", documents=edge_docs.limit(0))).collect() == []
    blank = edge_docs.limit(2)
    assert [r[1:] for r in got(spark, write_tables(tmp_path / "b", documents=blank))] == [(0, 0, 0, 0, 0, 0, "")] * 2
