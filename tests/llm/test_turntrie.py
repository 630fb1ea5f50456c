import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lullwatch.llm import turntrie as C
from tests.llm.conftest import write_tables


def brute(convs):
    """Nodes of the trie of ``conv -> list of (role, text)``, each prefix walked by itself."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    rows, leaves, saved = [], defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    for p, m in members.items():
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                     hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return sorted(rows, key=repr)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else c + (-c) % 5
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def rows_of(df):
    return sorted((tuple(r[:8]) for r in df.collect()), key=repr)


def make(spark, convs, extra=()):
    rows = [(c, n, r, t, "clash", 1) for c, turns in convs.items() for n, (r, t) in enumerate(turns)] + list(extra)
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, node string, block int").repartition(7)


@pytest.fixture(scope="module")
def convs():
    rng = random.Random(3)
    out = {c: [(rng.choice(["user", "assistant"]), rng.choice(["", "a", "bb", "ü🙂"])) for _ in range(rng.choice([1, 2, 5, 8, 9, 16, 17, 30]))] for c in range(-6, 90)}
    out[200] = [("user", "hi")] * 400
    out[201] = [("user", "hi")] * 390 + [("user", "x" * 50_000)]
    out.update({c: [("user", "hi"), ("assistant", "yes")] for c in range(300, 340)})
    return out


def test_trie_of_given_conversations(spark, convs):
    assert rows_of(C.prefix_trie(make(spark, convs))) == brute(convs)


def test_query_matches_brute_force(spark, convs, tmp_path):
    sf = write_tables(tmp_path / "t", conversations=make(spark, convs))
    assert rows_of(C.op12_prefix_trie(spark, sf)) == brute(rebuilt(convs))


def test_hot_parents_and_packed_members(spark, convs, monkeypatch):
    monkeypatch.setattr(C, "HOT_LEAST", 2)
    monkeypatch.setattr(C, "PIECE", 20)
    assert rows_of(C.prefix_trie(make(spark, convs))) == brute(convs)


def test_edges(spark, tmp_path):
    extra = [(1, None, None, None, "x", 0), (None, 0, "user", "lost", "x", 0), (1, 2, "user", "b", "x", 0), (1, 2, "assistant", "z", "x", 0), (1, 2, "user", "b", "x", 0)]
    got = rows_of(C.prefix_trie(make(spark, {}, extra)))
    assert got == brute({1: [("", ""), ("assistant", "z"), ("user", "b"), ("user", "b")]})
    for k, df in enumerate((make(spark, {}, extra[1:2]), make(spark, {}, extra).limit(0))):
        assert C.op12_prefix_trie(spark, write_tables(tmp_path / str(k), conversations=df)).collect() == []


def test_conversation_without_turns_is_in_the_root(spark, tmp_path):
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    convs = {lone: [("user", "a")], 5000: [("user", "b")]}
    assert rows_of(C.op12_prefix_trie(spark, write_tables(tmp_path / "t", conversations=make(spark, convs)))) == brute(rebuilt(convs))
