import random
import re

from lullwatch.llm import decontaminate as D
from tests.llm.conftest import write_tables


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(doc, items):
    w, hit, found = plain_words(doc), set(), set()
    for name, text in items:
        t = plain_words(text)
        n = min(10, len(t))
        for k in range(len(t) - n + 1 if t else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == t[k:k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(name))
    return len(w), hit, found


def flat(spans):
    return {i for a, b in zip(spans[::2], spans[1::2]) for i in range(a, b)}


def test_random_texts_match_brute_force(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["a", "B", "ü", "1"]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(12)] + [(50, None), (51, "a b"), (52, "a  B!")]
    docs = [(k, text(rng.choice([0, 5, 12, 60, 200]))) for k in range(80)] + [(90, None), (91, "")]
    items = [(k, t) for k, t in items if t is None or len(t) != 1]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chars in (10**6, 40):
        got = {r.doc_id: r for r in D.find_spans(d, b, block_chars=chars).collect()}
        for k, t in docs:
            n, hit, found = brute(t, items)
            assert (got[k].n_words, flat(got[k].spans), set(got[k].items)) == (n, hit, found)


def test_clean_cuts_until_nothing_is_marked(spark, edge_docs):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "keep this, " * 9 + passage.upper() + "! end\n"), (2, passage), (3, "Quite  clean.\n"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage, 1), (8, None, 2)], "item_id long, text string, doc_id int")
    got = {r.doc_id: r.text for r in D.clean(docs, bench).collect()}
    assert got == {1: "keep this, " * 9 + "! end\n", 3: "Quite  clean.\n", 4: None}
    assert D.clean(edge_docs, bench).count() == edge_docs.count() and D.clean(docs, bench.limit(0)).count() == 4


def test_query_on_edges(spark, tmp_path, edge_docs):
    bench = spark.createDataFrame([(1, "same TEXT here"), (2, None), (3, ""), (None, "hello world again tis don t 123456")], "item_id long, text string")
    out = D.op7_decontaminate(spark, write_tables(tmp_path / "t", documents=edge_docs, benchmark=bench))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[7].contaminated and rows[7].n_hit == 3 and rows[5].n_items == 1 and rows[0].n_words == 0 and not rows[12].contaminated
    assert out.count() == edge_docs.count()
    empty = write_tables(tmp_path / "e", documents=edge_docs.limit(0), benchmark=bench.limit(0))
    assert D.op7_decontaminate(spark, empty).count() == 0
