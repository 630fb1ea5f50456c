import random

from lullwatch.llm import decontaminate as D


def test_clean_does_not_depend_on_blocks(spark):
    rng = random.Random(3)
    name = lambda k, n: " ".join(f"b{k}x{i}" for i in range(n))
    items = [(k, name(k, 12)) for k in range(12)]
    free = lambda n: " ".join(f"f{rng.randrange(999)}" for _ in range(n))
    docs = [(k, " ".join([name(k % 12, 12), free(16), name((k + 5) % 12, 12)])) for k in range(12)]  # 60 % marked, by two items
    # cutting one item closes another up
    docs += [(20 + k, " ".join([free(60), *items[k][1].split()[:6], name((k + 5) % 12, 12), *items[k][1].split()[6:], free(60)])) for k in range(12)]
    docs += [(50, free(30)), (51, None), (52, "Quite  clean.\n")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_chars int")
    b = spark.createDataFrame(items, "item_id long, text string")
    one, many = ({r.doc_id: r for r in D.clean(d, b, block_chars=n).collect()} for n in (10**6, 200))
    assert one == many and set(one) == {*range(20, 32), 50, 51, 52} and one[52].text == docs[-1][1]
    assert not any(r.spans for r in D.find_spans(D.clean(d, b, block_chars=200), b).collect())
    assert D.block_count(b, 200) > 2
