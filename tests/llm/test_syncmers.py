import hashlib
import random

import numpy as np

from lullwatch.llm import syncmers as S
from tests.llm.conftest import SF, edge_texts, write_tables


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def test_anchors_are_context_free_and_closed():
    rng = random.Random(2)
    core = "".join(rng.choice("abcdefgh ") for _ in range(400))
    a, at = S.anchors(points("xx yy" + core + "zz"))
    b, bt = S.anchors(points(core))
    inside = {(h, p - 5) for h, p in zip(a.tolist(), at.tolist()) if 5 <= p <= 5 + 400 - S.K}
    assert inside == set(zip(b.tolist(), bt.tolist())) and len(bt) > 20
    inner = S.rolling(points(core), S.S)
    for p in range(400 - S.K + 1):
        part = inner[p:p + S.K - S.S + 1]
        assert (p in bt) == (part.min() in (part[0], part[-1]))


def test_likeness():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    mine = S.sketch(text)
    assert S.likeness(mine, mine) == 1.0 and S.likeness(mine, S.sketch(other)) < 0.05 and S.likeness([], []) == 1.0
    assert 0.15 < S.likeness(mine, S.sketch(S.edited(text, other))) < 0.6
    assert S.likeness(mine, S.sketch("new start. " + text)) > 0.85
    assert S.parse(S.show(mine)) == mine


def brute(rows):
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: -r[0])
    out = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[:len(t) - half] + n[:half]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), S.show(S.sketch(t)), S.show(S.sketch(e)), S.likeness(S.sketch(t), S.sketch(e)), S.likeness(S.sketch(t), S.sketch(n))))
    return sorted(out)


def test_query(spark, tmp_path, edge_docs):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, S.op8_syncmers(spark, SF).collect())) == brute(rows)
    once = write_tables(tmp_path / "o", documents=edge_docs.where("lang is not null"))
    assert sorted(map(tuple, S.op8_syncmers(spark, once).collect())) == brute(enumerate(edge_texts()))
    one = write_tables(tmp_path / "1", documents=edge_docs.where("doc_id = 6"))
    assert sorted(map(tuple, S.op8_syncmers(spark, one).collect())) == brute([(6, edge_texts()[6])])
    more = edge_docs.unionByName(spark.createDataFrame([(None, "no id")], "doc_id long, text string"), allowMissingColumns=True)
    assert S.op8_syncmers(spark, write_tables(tmp_path / "t", documents=more)).count() == more.count()
    assert S.op8_syncmers(spark, write_tables(tmp_path / "e", documents=edge_docs.limit(0))).count() == 0
