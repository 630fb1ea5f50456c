"""Benchmark decontamination: documents are streamed through a generalised suffix automaton of the benchmark items.

Words are maximal runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII bytes. The automaton is built over word
numbers of the normalised items; every document word moves it, the longest match ending at each word is tracked, and a match
of at least ``window`` words (or of a whole item that is shorter than that) marks its words.

The benchmark is read in blocks of at most about ``block_chars`` characters, each with an automaton of its own that is sent to
the executors; every document meets every block, nothing is shuffled.

Defined results: a null text has no words and no hits; items without words and a null item text have no windows; an item with a
null id reports as an empty string; repeated rows are judged row by row; other columns of either table are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullwatch.llm.common import register, stage, table, thrifty_map

FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Suffix automaton of many word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.number = window, {}
        self.names = [name for name, _ in items]
        self.step, self.link, self.length = [{}], [-1], [0]
        ends = []
        for _, seq in items:
            last, path = 0, []
            for w in seq:
                last = self._grow(last, self.number.setdefault(w, len(self.number) + 1))
            ends.append(path)
        self._mark(items)
        self.shortest = min([window, *(len(s) for _, s in items if s)])

    def _new(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """State for the part of ``q`` that ``p`` reaches by ``c``."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    def _grow(self, last: int, c: int) -> int:
        if c in self.step[last]:
            return self._split(last, self.step[last][c], c)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, self.step[p][c], c)
        return state

    def _mark(self, items) -> None:
        """Items of every state that holds a window, and the short items that end in each state."""
        n = len(self.step)
        self.top, self.short = [-1] * n, [()] * n
        self.items: dict[int, set[int]] = {}
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= self.window:
                self.top[s] = s if self.length[self.link[s]] < self.window else self.top[self.link[s]]
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, (_, seq) in enumerate(items):
            s = 0
            for w in seq:
                s = self.step[s][self.number[w]]
                if self.top[s] >= 0:
                    self.items.setdefault(self.top[s], set()).add(k)
            if 0 < len(seq) < self.window:
                whole.setdefault(s, []).append((len(seq), k))
        for s in order:
            self.short[s] = (*self.short[self.link[s]], *whole.get(s, ()))

    def matches(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Marked word spans (merged, end exclusive) and the items that caused them."""
        get = self.number.get
        codes = np.array([get(w, 0) for w in seq], dtype=np.int64)
        known = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for a, b in known.reshape(-1, 2).tolist():
            if b - a >= self.shortest:
                self._run(codes[a:b].tolist(), a, spans, found)
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return [(a, b) for a, b in merged], {self.names[k] for k in found}

    def _run(self, codes: list[int], base: int, spans: list, found: set) -> None:
        step, link, length, window, top, short = self.step, self.link, self.length, self.window, self.top, self.short
        state = size = 0
        for i, c in enumerate(codes, base + 1):
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step[state].get(c)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= window:
                if spans and spans[-1] == (i - size, i - 1):
                    spans[-1] = (i - size, i)
                else:
                    spans.append((i - size, i))
                found |= self.items.get(top[state], set())
            for n, k in short[state]:
                if n <= size:
                    spans.append((i - n, i))
                    found.add(k)


def block_count(benchmark: DataFrame, block_chars: int) -> int:
    return 1 + (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars


def automata(benchmark: DataFrame, window: int, block_chars: int):
    """Automata of the benchmark, block by block."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = block_count(benchmark, block_chars)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        yield Automaton([(r.item, words(r.text)) for r in rows], window)


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 16_000_000) -> DataFrame:
    """``doc_id, n_words, spans, items``: marked word spans as flat start, end pairs and the ids of the items found."""
    spark = docs.sparkSession
    schema = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", text string, n_words bigint, spans array<int>, items array<string>"
    rows = docs.select("doc_id", "text", F.lit(0).cast("bigint").alias("n_words"), F.expr("cast(array() as array<int>)").alias("spans"),
                       F.expr("cast(array() as array<string>)").alias("items"))
    for k, automaton in enumerate(automata(benchmark, window, block_chars)):
        sent = spark.sparkContext.broadcast(automaton)

        def mark(batches, sent=sent):
            for b in batches:
                counts, spans, items = [], [], []
                old_spans, old_items = b["spans"].to_pylist(), b["items"].to_pylist()
                for t, was, had in zip(b["text"].to_pylist(), old_spans, old_items, strict=True):
                    seq = words(t)
                    new, names = sent.value.matches(seq)
                    counts.append(len(seq))
                    spans.append(joined(was, new))
                    items.append(sorted({*had, *names}))
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())),
                                                  pa.array(items, pa.list_(pa.string()))], names=b.schema.names)

        rows = (rows if k == 0 else stage(rows, "spans")).mapInArrow(thrifty_map(mark), schema)
    return rows.drop("text")


def joined(flat: list[int], more: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted([*zip(flat[::2], flat[1::2], strict=True), *more]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def without_spans(text: str, seq: list[bytes], spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of every span."""
    raw = text.encode("utf-8", "surrogatepass")
    edge = np.diff(np.concatenate(([0], (np.frombuffer(raw.translate(FOLD), np.uint8) != 32).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_chars: int = 16_000_000) -> DataFrame:
    """Documents with all benchmark spans cut out; those with a larger marked share than ``max_coverage`` are left out.

    Coverage is judged once, on the whole document and the spans of all blocks united. What closes up around a cut is marked and cut
    again until no block marks anything; with one block a document's rounds run in one pass, with several each round passes the documents
    that still had marks through all blocks. Untouched documents keep their text byte by byte, all columns stay, and ``n_chars`` (where present) follows the text.
    """
    rows = cut_in_one(docs, benchmark, window, max_coverage) if block_count(benchmark, block_chars) == 1 else cut_by_blocks(docs, benchmark, window, max_coverage, block_chars)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def too_much(spans: list[tuple[int, int]], seq: list[bytes], max_coverage: float) -> bool:
    return bool(spans) and sum(y - x for x, y in spans) > max_coverage * len(seq)


def cut_in_one(docs: DataFrame, benchmark: DataFrame, window: int, max_coverage: float) -> DataFrame:
    """``clean`` with one automaton for the whole benchmark."""
    sent = docs.sparkSession.sparkContext.broadcast(next(automata(benchmark, window, 1 << 62)))

    def cut(batches):
        for b in batches:
            texts, keep = b["text"].to_pylist(), []
            changed = False
            for i, t in enumerate(texts):
                seq = words(t)
                spans, _ = sent.value.matches(seq)
                keep.append(not too_much(spans, seq, max_coverage))
                while spans and keep[-1]:
                    changed = True
                    texts[i] = t = without_spans(t, seq, spans)
                    seq = words(t)
                    spans, _ = sent.value.matches(seq)
            if changed:
                b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, b["text"].type))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(thrifty_map(cut), docs.schema)


MARKS = "benchmark_spans"


def cut_by_blocks(docs: DataFrame, benchmark: DataFrame, window: int, max_coverage: float, block_chars: int) -> DataFrame:
    """``clean`` with one automaton at a time: spans of all blocks are united before anything is judged or cut."""
    spark = docs.sparkSession

    def put(b, name, values, kind):
        return b.set_column(b.schema.get_field_index(name), name, pa.array(values, kind))

    def cut(batches, limit):
        for b in batches:
            texts, keep = b["text"].to_pylist(), []
            for i, (t, flat) in enumerate(zip(b["text"].to_pylist(), b[MARKS].to_pylist(), strict=True)):
                seq, spans = words(t), list(zip(flat[::2], flat[1::2], strict=True))
                keep.append(not too_much(spans, seq, limit))
                if keep[-1]:
                    texts[i] = without_spans(t, seq, spans)
            b = put(put(b, "text", texts, b["text"].type), MARKS, [[]] * len(texts), pa.list_(pa.int32()))
            yield b.filter(pa.array(keep, pa.bool_()))

    rows, done, limit = docs.withColumn(MARKS, F.expr("cast(array() as array<int>)")), [], max_coverage
    while True:
        for automaton in automata(benchmark, window, block_chars):
            sent = spark.sparkContext.broadcast(automaton)

            def mark(batches, sent=sent):
                for b in batches:
                    spans = [joined(was, sent.value.matches(words(t))[0]) for t, was in zip(b["text"].to_pylist(), b[MARKS].to_pylist(), strict=True)]
                    yield put(b, MARKS, spans, pa.list_(pa.int32()))

            rows = stage(rows.mapInArrow(thrifty_map(mark), rows.schema), "clean")
            sent.unpersist()
        done.append(rows.where(F.size(MARKS) == 0).drop(MARKS))
        rows = rows.where(F.size(MARKS) > 0)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
        rows, limit = rows.mapInArrow(thrifty_map(lambda batches, limit=limit: cut(batches, limit)), rows.schema), 1.0


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, n)) AS u(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@register("op7_decontaminate", ORACLE)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("cast(aggregate(sequence(0, size(spans) - 1), 0L, (s, i) -> s + if(i % 2 = 1, spans[i], -spans[i])) as bigint)")
    return found.select(
        "doc_id", "n_words", F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("bigint")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))
