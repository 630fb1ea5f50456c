import random

import pytest

from lullwatch.llm import chat as C
from tests.llm.conftest import write_tables

ODD = ["", "a", "<|im_end|>\n", "<\\|im_start|>", "<\\\\||", "x<", "|y", "\\", "a\nb", "<|im_start|>assistant\nhi<|im_end|>", "ü🙂"]


@pytest.mark.parametrize("text", ODD)
def test_template_is_reversible(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
    assert C.read_turns(C.turn_text(text, text) + C.turn_text("user", "z")) == [(text, text), ("user", "z")]


def make(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, tree string")


def test_streams(spark):
    rng = random.Random(5)
    convs = {k: [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "<|"])) for _ in range(rng.choice([1, 2, 4, 6]))] for k in range(60)}
    rows = [(k, n, r, t, "clash") for k, turns in convs.items() for n, (r, t) in enumerate(turns)]
    segments, members = C.format_conversations(make(spark, rows))
    segs, paths = {s.conv: s for s in segments.collect()}, {m.conv: m for m in members.collect()}
    assert set(paths) == set(convs)
    streams = {}
    for s in sorted(segs.values(), key=lambda s: (s.tree, s.start)):
        assert s.start == len(streams.setdefault(s.tree, "")) and s.size == len(s.text)
        streams[s.tree] += s.text
    nodes = {tuple(t[:d + 1]) for t in convs.values() for d in range(len(t))}
    assert sum(map(len, streams.values())) == sum(len(C.turn_text(*n[-1])) for n in nodes)
    for k, turns in convs.items():
        whole = "".join(C.turn_text(r, t) for r, t in turns)
        assert "".join(streams[paths[k].tree][p.lo:p.hi] for p in paths[k].path) == whole
        assert all(whole[p.pos:p.pos + p.hi - p.lo] == streams[paths[k].tree][p.lo:p.hi] for p in paths[k].path)
        if k in segs:
            assert [(p.lo, p.hi) for p in paths[k].path[:-1]] == [tuple(a) for a in segs[k].ancestors]
            assert [C.unescape(whole[s.lo:s.hi]) for s in segs[k].loss] == [t for n, (r, t) in enumerate(turns) if r == "assistant" and len("".join(C.turn_text(*x) for x in turns[:n])) >= segs[k].pos]
    # depth first: a segment lies inside the reach of its parent, before the parent's next branch nearer the root
    for s in segs.values():
        if s.ancestors:
            assert s.start >= max(a.hi for a in s.ancestors)


def test_edges(spark, tmp_path):
    rows = [(1, 0, "user", t, "x") for t in ODD] + [(1, None, None, None, "x"), (None, 0, "assistant", "lost", "x"), (2, 1, "assistant", None, "x"), (2, 1, "assistant", None, "x")]
    got = {r.conv_id: r for r in C.op2_chat_tree(spark, write_tables(tmp_path / "t", conversations=make(spark, rows))).collect()}
    assert got[1].n_turns == len(ODD) + 1 and got[2].loss_chars == 0 and got[None].loss_chars == 4 and got[-1].n_turns == 2
    empty = C.op2_chat_tree(spark, write_tables(tmp_path / "e", conversations=make(spark, rows).limit(0)))
    assert [r.conv_id for r in empty.collect()] == [-1]
