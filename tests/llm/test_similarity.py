import random

import corpus_pipeline
from lullwatch.llm import simhash as S
from tests.llm.conftest import SF


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def first_of_classes(docs):
    """Smallest id of every class of texts linked by a similarity of 0.8, by search over all pairs."""
    sets, root = {i: shingle_set(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in docs}


def edited(rng, text, share):
    w = text.split()
    for k in rng.sample(range(len(w)), max(1, int(share * len(w)))):
        w[k] = f"new{rng.random()}"
    return " ".join(w)


def test_stage_drops_all_near_copies(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 20, 60, 200, 400]))) for _ in range(60)]
    texts += [edited(rng, rng.choice(texts), rng.choice([0, 0.01, 0.02, 0.05])) for _ in range(120)]
    texts += [edited(rng, texts[7], 0) for _ in range(150)] + [None, "", " ", "\n"]
    line = " ".join(f"line{k}" for k in range(40))
    texts += [line + " " + " ".join(f"v{rng.randrange(3000)}" for _ in range(20)) for _ in range(50)]
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame([*docs.items(), (None, "no id")], "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == first_of_classes(docs) | {None}
    given = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, given, SF).collect()} == first_of_classes({r.doc_id: r.text for r in given.collect()})


def test_other_text_under_the_same_doc_id_stays(spark):
    frame = spark.createDataFrame([(1, "one two three four five six seven"), (1, "quite another text of a few words"), (1, "One two  three four five six seven")], "doc_id long, text string")
    assert sorted(r.text.lower()[:3] for r in S.one_of_each(frame, 5, 0.8).collect()) == ["one", "qui"]


def boilerplate(n, seed=11):
    """Texts of 30 common paragraphs in two variants each; every second text copies one before it with two paragraphs in the other variant."""
    rng = random.Random(seed)
    paragraphs = [[" ".join(f"p{k}v{v}w{rng.randrange(10**6)}" for _ in range(20)) for v in range(2)] for k in range(30)]
    picks, copies = [], []
    for _ in range(n // 2):
        p = [rng.randrange(2) for _ in range(30)]
        q = list(p)
        for k in rng.sample(range(30), 2):
            q[k] = 1 - q[k]
        copies.append((len(picks), len(picks) + 1))
        picks += [p, q]
    return ["\n".join(paragraphs[k][v] for k, v in enumerate(p)) for p in picks], copies


def test_common_paragraphs_hide_no_copy(spark):
    for n in (600, 2400):
        texts, copies = boilerplate(n)
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
        left = {r.doc_id for r in S.one_of_each(frame, 5, 0.8).collect()}
        assert all(b not in left for _, b in copies), n


def test_columns_of_any_name_survive(spark):
    names = ["node", "key", "fp", "u", "v", "n", "benchmark_spans", "words", "least", "turned", "node_"]
    frame = spark.createDataFrame([(k, t, *(f"{c}{k}" for c in names)) for k, t in enumerate(["one two three four five six", "ONE two three four five six", "others", None])],
                                  ", ".join(["doc_id long", "text string", *(f"{c} string" for c in names)]))
    rows = {r.doc_id: r for r in S.one_of_each(frame, 5, 0.8).collect()}
    assert set(rows) == {0, 2, 3} and all(r[c] == f"{c}{k}" for k, r in rows.items() for c in names)


def test_large_buckets_are_searched_whole(spark, monkeypatch):
    # without a look at the neighbours in the order of min-hash values, the search of what they leave must find every link
    monkeypatch.setattr(S, "LATER", 0)
    monkeypatch.setattr(S, "BLOCK", 100, raising=False)
    texts, copies = boilerplate(400)
    rng = random.Random(3)
    texts += [edited(rng, texts[7], 0.004 * k) for k in range(40)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    frame = spark.createDataFrame([(k, texts[k]) for k in order], "doc_id long, text string").repartition(8)
    left = {r.doc_id for r in S.one_of_each(frame, 5, 0.8).collect()}
    assert all(b not in left for _, b in copies)
    assert left == first_of_classes(dict(enumerate(texts)))


def test_parities_differ_in_no_more_than_the_sets():
    rng = random.Random(1)
    for _ in range(200):
        a = {rng.getrandbits(64) for _ in range(rng.randrange(400))}
        b = {x for x in a if rng.random() < 0.8} | {rng.getrandbits(64) for _ in range(rng.randrange(60))}
        x, y = (int.from_bytes(S.parity_bits(S.np.array(sorted(s), S.np.uint64)), "little") for s in (a, b))
        assert (x ^ y).bit_count() <= len(a ^ b)
    a = S.np.array([rng.getrandbits(64) for _ in range(3000)], S.np.uint64)
    p, q = (S.np.frombuffer(S.parity_bits(x), S.np.uint8) for x in (a, a[:1500]))
    assert len(p) == 2 * len(q) == 512
    fold = p[:256] ^ p[256:] ^ q
    assert 0 < int.from_bytes(fold.tobytes(), "little").bit_count() <= 1500


def test_long_texts_of_large_buckets_meet(spark, monkeypatch):
    monkeypatch.setattr(S, "LATER", 0)
    rng = random.Random(8)
    common = [" ".join(f"c{k}w{rng.randrange(10**6)}" for _ in range(300)) for k in range(4)]
    texts = ["\n".join([*common, " ".join(f"t{t}w{rng.randrange(10**6)}" for _ in range(rng.choice([200, 300, 450, 900])))]) for t in range(50)]
    texts += [edited(rng, t, 0.01) for t in texts[::3]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in S.one_of_each(frame, 5, 0.8).collect()} == first_of_classes(dict(enumerate(texts)))
