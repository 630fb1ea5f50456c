import random
import re

import pytest
import xxhash

from lullwatch.llm import simhash as S
from tests.llm.conftest import SF, edge_texts, write_tables


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(rows):
    """Smallest id reachable, by plain search over all pairs."""
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, p in rows:
        least[find(p)] = min(least.get(find(p), i), i)
    return {(i, p): least[find(p)] for i, p in rows}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("hot", [512, 2, 0])
def test_links_match_all_pairs(spark, hot):
    rng = random.Random(3)
    rows = []
    for c in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            p = centre
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                p ^= 1 << rng.randrange(64 if c % 3 else 4)
            rows.append((len(rows), p))
    rows = [(1000 - i, p) for i, p in rows]
    nodes = spark.createDataFrame([(p, min(i for i, q in rows if q == signed_p)) for signed_p in {q for _, q in rows} for p in [signed(signed_p)]], "fp long, node long")
    edges = S.links(nodes, hot)
    prints = {min(i for i, q in rows if q == p): p for p in {q for _, q in rows}}
    want = {(max(a, b), min(a, b)) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2}
    assert {(r.u, r.v) for r in edges.collect()} == want
    roots = {r.node: r.root for r in S.components(edges).collect()}
    for (i, p), c in classes(rows).items():
        node = min(j for j, q in rows if q == p)
        assert roots.get(node, node) == c


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in random.Random(1).sample(range(300), 300)], "u long, v long")
    assert {(r.node, r.root) for r in S.components(edges).collect()} == {(i, 0) for i in range(301)}


@pytest.mark.parametrize("text", [*edge_texts(), "One two", "A b C d E"])
def test_fingerprint(text):
    assert S.fingerprint(text) & (1 << 64) - 1 == plain(text)


def test_query(spark, tmp_path, edge_docs):
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(i, f"{p:016x}", c) for (i, p), c in classes(docs).items()}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in S.op1_simhash(spark, SF).collect()} == want
    extra = edge_docs.unionByName(spark.createDataFrame([(None, "same text here")], "doc_id long, text string"), allowMissingColumns=True)
    got = S.op1_simhash(spark, write_tables(tmp_path / "t", documents=extra)).collect()
    assert len(got) == extra.count() and {r.component_id for r in got if r.doc_id in (0, 1, 2, 3)} == {0} and [r.component_id for r in got if r.doc_id is None] == [None]
    assert S.op1_simhash(spark, write_tables(tmp_path / "e", documents=edge_docs.limit(0))).count() == 0
    kept = S.one_of_each(extra)
    assert kept.columns == extra.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r.component_id for r in got if r.doc_id is not None})
