import random

import numpy as np
import pytest

from lullwatch.llm import substrings as S
from tests.llm.conftest import write_tables


def brute(rows, window=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k:k + window])] < i for j in range(window)}
        out.append((i, len(w), sorted(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def result(df):
    return [(r.doc_id, r.n_words, [k for a, b in zip(r.spans[::2], r.spans[1::2]) for k in range(a, b)], r.kept) for r in df.collect()]


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_exactly_the_windows(seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([np.append(rng.integers(1, 4 + seed, rng.integers(5, 60)), 0) for _ in range(8)])
    runs = [text[a:a + n][text[a:a + n] > 0] for a, n in zip(rng.integers(0, len(text), 20), rng.integers(1, 50, 20))] + [rng.integers(-1, 5, 60) for _ in range(10)]
    runs = [np.where(r == 0, -1, r).astype(np.int64) for r in runs]
    there = {tuple(text[k:k + 5]) for k in range(len(text) - 4)}
    size = np.array([len(r) for r in runs])
    hits = S.FMIndex(text.astype(np.int64)).windows(np.concatenate(runs), size, 5)
    for r, f in zip(runs, np.split(hits, np.cumsum(size)[:-1])):
        assert f.tolist() == [tuple(r[k:k + 5]) in there if k + 5 <= len(r) else False for k in range(len(r))]


def test_random_texts_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    passages = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([13, 14, 40, 700]))) for _ in range(8)]
    text = lambda: "  ".join(rng.choice([rng.choice(passages), " ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(30)))]) for _ in range(rng.randrange(6)))
    rows = [(k, text()) for k in range(120)] + [(None, passages[0]), (500, None), (501, passages[1]), (501, passages[1]), (502, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).sortWithinPartitions("doc_id")
    docs.write.parquet(path := str(__import__("tempfile").mkdtemp()) + "/d")
    docs = spark.read.parquet(path)
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    want = sorted(brute(rows), key=key)
    assert sorted(result(S.repeats(docs)), key=key) == want
    assert sorted(result(S.repeats(docs, buckets=1)), key=key) == want
    monkeypatch.setattr(S, "PART_BYTES", 1)
    monkeypatch.setattr(S, "STEP", 3)
    assert sorted(result(S.repeats(docs)), key=key) == want
    kept = {r.doc_id: r.text for r in S.clean(docs).collect()}
    texts = dict(rows)
    assert kept == {i: texts[i] if not gone else left for i, _, gone, left in want if not gone or left}


def test_edges(spark, tmp_path, edge_docs):
    sf = write_tables(tmp_path / "t", documents=edge_docs)
    got = {r.doc_id: r for r in S.op10_substrings(spark, sf).collect()}
    assert got[0].n_words == 0 and all(r.n_removed == 0 for r in got.values())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert S.clean(docs).columns == docs.columns and S.clean(docs).count() == docs.count()
    assert S.op10_substrings(spark, write_tables(tmp_path / "e", documents=edge_docs.limit(0))).count() == 0
