import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lullwatch.llm import private as C
from tests.llm.conftest import SF, write_tables

PATTERN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def brute(text):
    return [(k, *m.span()) for k, p in PATTERN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_base_spans_are_the_regular_expressions():
    rng = random.Random(1)
    bits = ["a@b.c", "@", ".", "-", "+1 (555) 222-3333", "+", "4539578763621486", "4539 5787 6362 1486", "1.2.3.4", "256.1.1.1", "007.0.0.1", "0", "99", " ", "x", "é", "a.b@c-d.e.f", "@@", "..", "()"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert C.base_spans(text) == brute(text), text
    for text in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "a@" * 100_000, "+1" * 100_000, "1 " * 200_000 + "x", "0" * 5000 + ".1.1.1"):
        C.base_spans(text), list(C.candidates(text, []))


def test_query_over_sample_tables(spark):
    got = {r.doc_id: r for r in C.op13_private_spans(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = brute(r.text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        g = got[r.doc_id]
        assert [g[f"n_{k}"] for k in C.KINDS] == [sum(x[0] == k for x in base) for k in C.KINDS]
        assert g.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) <= set(g.spans.split(","))


def phone(rng):
    return f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"


def corpus():
    """Seeds in two telling contexts, unseen forms in them and in others, and numbers that are no identifiers."""
    rng = random.Random(7)
    rows = [f"You can call me at {phone(rng)} after lunch number {k}" for k in range(12)]
    rows += [f"please write to user{k}@mail.org for more news {k}" for k in range(12)]
    rows += ["You can call me at 555-201-4477 after lunch", "then dial 555-201-4477 twice", "the total was 555-201-4478 units", "please write to ann (at) mail (dot) org for more news",
             "ann (at) mail (dot) org", "bob (at) mail (dot) org", "serial 1234567890 is stamped", "You can call me at noon after lunch", None, ""]
    rows += [f"part no {rng.randrange(10**9, 10**10)} in stock" for _ in range(20)] + [f"part no {phone(rng)} in stock" for _ in range(5)]
    return rows + rows[-30:]


def test_patterns_find_unseen_forms_and_nothing_else(spark, tmp_path):
    docs = list(enumerate(corpus()))
    df = spark.createDataFrame([(i, t, "clash", "x") for i, t in docs], "doc_id long, text string, kind string, value string").repartition(5)
    found = defaultdict(set)
    for r in C.extract(df).collect():
        for s in r.found:
            found[docs[r.doc_id][1]].add((s.kind, docs[r.doc_id][1][s.start:s.end]))
    assert found == {"You can call me at 555-201-4477 after lunch": {("phone", "555-201-4477")}, "then dial 555-201-4477 twice": {("phone", "555-201-4477")},
                     "please write to ann (at) mail (dot) org for more news": {("email", "ann (at) mail (dot) org")}, "ann (at) mail (dot) org": {("email", "ann (at) mail (dot) org")}}
    rows = {r.doc_id: r.spans for r in C.op13_private_spans(spark, write_tables(tmp_path / "t", documents=df)).collect()}
    assert rows[24] == "phone:19:31" and rows[0].startswith("phone:19:") and rows[30] == ""


def test_scores_match_brute_force(spark):
    rng = random.Random(2)
    seen = [(f"p{rng.randrange(8)}", rng.randrange(60)) for _ in range(300)]
    kind = {v: rng.choice([None, "phone", "card"]) if v % 3 else "phone" for v in range(60)}
    allowed = {v: [kind[v]] if kind[v] else rng.choice([["phone"], ["card", "phone"], ["card"]]) for v in range(60)}
    df = spark.createDataFrame([([p], v, kind[v], allowed[v]) for p, v in seen], "patterns array<string>, value long, kind string, forms array<string>")
    pairs, known = set(seen), {}
    for _ in range(C.ROUNDS):
        conf = {}
        for p in {p for p, _ in pairs}:
            values = [v for q, v in pairs if q == p]
            for k in C.KINDS:
                yes = sum((kind[v] or known.get(v, (None,))[0]) == k for v in values)
                undecided = sum(not kind[v] and v not in known and k in allowed[v] for v in values)
                if yes >= C.SUPPORT and yes / (len(values) - undecided / 2) >= C.CONFIDENCE:
                    conf[p, k] = yes / (len(values) - undecided / 2)
        was, known = known, {}
        for v in range(60):
            best = []
            for n, k in enumerate(C.KINDS):
                left = 1.0
                for p in {p for p, w in pairs if w == v}:
                    if (p, k) in conf and k in allowed[v]:
                        left *= 1 - min(conf[p, k], 0.99)
                if not kind[v] and 1 - left >= C.ACCEPT:
                    best.append((1 - left, -n, k))
            if best:
                known[v] = (max(best)[2], max(best)[0])
        if len(was) == len(known):
            break
    trusted, found = C.learn(df)
    assert {(r.pattern, r.kind): round(r.confidence, 9) for r in trusted.collect()} == {k: round(c, 9) for k, c in conf.items()}
    assert {r.value: (r.kind, round(r.score, 9)) for r in found.collect()} == {v: (k, round(s, 9)) for v, (k, s) in known.items()}


def test_shuffled_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(C, "SMALL", 0)
    df = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    assert C.extract(df).where(F.size("found") > 0).count() == 4


def test_edges(spark, tmp_path, edge_docs):
    rows = C.op13_private_spans(spark, write_tables(tmp_path / "t", documents=edge_docs)).collect()
    assert len(rows) == edge_docs.count() and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert C.op13_private_spans(spark, write_tables(tmp_path / "e", documents=edge_docs.limit(0))).collect() == []
