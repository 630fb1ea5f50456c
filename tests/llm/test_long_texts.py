import random

import numpy as np
import pytest

from lullwatch.llm import syncmers as S


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("few", [16, 0])
def test_in_order_is_exact(monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(40))] for kinds in [rng.choice([2, 8, 60])] * 2)
        assert S.in_order(np.array(a, np.int64), np.array(b, np.int64)) == plain_lcs(a, b)


def test_long_texts_share_a_passage():
    rng = random.Random(7)
    free = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = free(500)
    a, b = free(60_000) + passage + free(60_000), free(20_000) + passage + free(90_000)
    mine, other, alone = S.sketch(a), S.sketch(b), S.sketch(passage)
    assert len(mine) > 15_000 and {h for h, _ in alone} <= {h for h, _ in mine} & {h for h, _ in other}
    assert S.likeness(mine, other) * (len(mine) + len(other)) >= 0.98 * len(alone) > 60


def test_repeats_count_with_every_position():
    passage = "a passage of some length that is said again, word by word. "
    once, often = S.sketch(passage), S.sketch(passage * 50)
    assert len(often) > 45 * len(once) and len({p for _, p in often}) == len(often)
    assert S.likeness(once, often) < 0.05 and S.likeness(often, S.sketch(passage * 25)) == pytest.approx(0.5, abs=0.02)
    assert S.parse(S.show(often)) == often
