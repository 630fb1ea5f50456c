"""Substring dedup: repeated word windows are looked up in compressed FM-indexes by backward search.

A word is removed if a window of ``window`` words that covers it also starts in a document of smaller doc_id.

Documents are cut into blocks (runs of one input split). Which index a document has to visit is found by 64-bit window prints:
each block sends its distinct prints, bundled by bucket, with its smallest doc_id; a bucket answers which document and block hold the smallest
one. The windows a block holds first and others repeat are its shard: their text, every distinct window once, becomes a suffix array, a
Burrows-Wheeler transform and a wavelet matrix (packed bit-planes with ranks). Runs of windows that another document holds
first are streamed to that document's shard; backward search extends each match to the left over all runs in step, and where
it stops, goes on with the next window (matching statistics cut at ``window``). Only windows the index confirms are removed.

Equal runs are searched once per shard however many documents hold them, a print is sent once per block, so neither copies nor common
passages gather in one task; a shard that many distinct runs visit is searched in several tasks, each with a copy of its index. Block texts travel
twice, compressed.

Defined results: a null text has no words and stays null; rows with a null doc_id keep all words and are no source; rows with the same doc_id are no
reason to remove from each other; repeated rows are judged alike; other columns are carried along or ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullwatch.llm.common import SIZE_BYTES, partitions, register, stage, table, thrifty_cogroup, thrifty_group, thrifty_map

WINDOW = 13
PIECE = 256
"""Most windows of one streamed run; longer runs go in pieces that overlap."""
STEP = 32
"""Most windows of one backward search; the pieces of a run are searched side by side."""
PART_BYTES = 1 << 19
"""Least bytes of runs that share one copy of an index; a shard asked for more than this and its own text is searched in several tasks."""
ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of a block's texts in row order: ``ids`` number the entries of ``known``, row ``r`` holds ``ids[edge[r]:edge[r + 1]]``."""

    def __init__(self, texts: pa.ChunkedArray):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.combine_chunks(), ""))
        coded = lists.flatten().dictionary_encode()
        self.known, every = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        word = (pc.binary_length(self.known).to_numpy(zero_copy_only=False) > 0)[every]  # edges of a text give empty strings
        size = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)))
        self.ids = every[word]
        self.edge = np.concatenate(([0], np.cumsum(word)))[size]
        self.counts = np.diff(self.edge)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def join(self, ids: np.ndarray, counts: np.ndarray, by: str) -> pa.Array:
        """One text for each of ``counts`` consecutive words of ``ids``."""
        edge = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(edge), self.known.take(pa.array(ids))), by)


def window_prints(words: Words, window: int) -> np.ndarray:
    """64-bit print of the window that starts at each word, read on into the next rows."""
    n = len(words.ids) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    names = words.known.cast(pa.binary()).to_numpy(zero_copy_only=False)
    h = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))[words.ids]
    acc = np.zeros(n, np.uint64)
    for k in range(window):
        acc *= ODD
        acc += h[k:k + n]
    acc ^= acc >> np.uint64(32)
    acc *= np.uint64(0xD6E8FEB86659FD93)
    return acc ^ (acc >> np.uint64(32))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays, each as zstd of its byte planes."""
    parts = []
    for a in arrays:
        raw = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())
        parts += [len(raw).to_bytes(4, "little"), raw]
    return b"".join(parts)


def expand(packed: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(packed):
        n = int.from_bytes(packed[at:at + 4], "little")
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[at + 4:at + 4 + n]), np.uint8).reshape(8, -1)
        out.append(np.ascontiguousarray(raw.T).view("<u8").reshape(-1))
        at += 4 + n
    return out


def blocks(batches):
    """(number, table) of runs of rows of one input split; the same whenever the split is read."""
    from pyspark import TaskContext

    base, n, rows, size = TaskContext.get().partitionId() << 32, itertools.count(), [], 0
    for b in batches:
        lengths = np.cumsum(np.nan_to_num(np.array(pc.binary_length(b["text"]).to_pylist(), float)))
        at = 0
        while at < len(b):
            upto = int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + SIZE_BYTES - size)) + 1
            part = b.slice(at, upto - at)
            rows.append(part)
            size += lengths[min(upto, len(b)) - 1] - (lengths[at - 1] if at else 0)
            at += len(part)
            if size >= SIZE_BYTES:
                yield base + next(n), pa.Table.from_batches(rows)
                rows, size = [], 0
    if rows:
        yield base + next(n), pa.Table.from_batches(rows)


class Block:
    """Windows of a block's documents and their distinct prints in bucket order."""

    def __init__(self, rows: pa.Table, window: int, buckets: int):
        self.words = w = Words(rows["text"])
        ids = rows["doc_id"].combine_chunks()
        inside = np.zeros(len(w.ids), bool)
        if len(w.ids) >= window:
            inside[:len(w.ids) - window + 1] = w.row[:len(w.ids) - window + 1] == w.row[window - 1:]
        inside &= ids.is_valid().to_numpy(zero_copy_only=False)[w.row]
        self.at = np.flatnonzero(inside)  # first word of each window
        self.row = w.row[self.at]
        self.doc = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)[self.row]
        every = window_prints(w, window)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.print, self.slot = np.unique(every, return_inverse=True)
        self.least = np.full(len(self.print), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.slot, self.doc)
        most = np.full(len(self.print), np.iinfo(np.int64).min)
        np.maximum.at(most, self.slot, self.doc)
        self.shared = most > self.least
        bucket = (self.print % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
        self.order = np.argsort(bucket, kind="stable")
        self.bucket, self.edge = np.unique(bucket[self.order], return_index=True)
        self.edge = np.append(self.edge, len(self.order))

    def bundles(self):
        for b, x, y in zip(self.bucket.tolist(), self.edge, self.edge[1:], strict=False):
            mine = self.order[x:y]
            yield b, squeeze(np.diff(self.print[mine], prepend=np.uint64(0)), self.least[mine].view(np.uint64))


class FMIndex:
    """Backward search over a word sequence: wavelet matrix of its Burrows-Wheeler transform. Words are numbers from 1; 0 ends a run."""

    def __init__(self, text: np.ndarray, window: int = WINDOW):
        n = len(text)
        rank, width = text.astype(np.int64), 1  # suffixes in the order of their first window + STEP words, longer than any pattern
        while True:
            after = np.full(n, -1)
            after[:n - width] = rank[width:]
            order = np.argsort(rank * (n + 1) + after + 1)
            new = np.concatenate(([0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0))))
            rank = np.empty(n, np.int64)
            rank[order] = new
            width *= 2
            if width > window + STEP or new[-1] == n - 1:
                break
        seq, self.top = text[order - 1], int(text.max())
        self.n, self.first = n, np.searchsorted(text[order], np.arange(self.top + 2))
        self.levels, self.zeros, self.bits, self.ones = max(1, self.top.bit_length()), [], [], []
        for k in reversed(range(self.levels)):
            bit = (seq >> k & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(-n % 64 + 64, bool))), bitorder="little").view("<u8")
            count = np.cumsum(np.bitwise_count(packed), dtype=np.uint32)
            self.bits.append(packed)
            self.ones.append((count - np.bitwise_count(packed)).astype(np.int64))
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate((seq[~bit], seq[bit]))

        every = np.arange(self.top + 1)
        self.shift = self.first[every] - self.descend(every, np.zeros(len(every), np.int64))[0]

    def descend(self, c: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Wavelet descent of positions ``i`` along the bits of ``c``, and whether the symbol there is ``c``."""
        same = np.ones(len(i), bool)
        for k in range(self.levels):
            word, low = self.bits[k][i >> 6], (i & 63).astype(np.uint64)
            before = self.ones[k][i >> 6] + np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
            up = (c >> (self.levels - 1 - k) & 1).astype(bool)
            same &= (word >> low & np.uint64(1)).astype(bool) == up
            i = np.where(up, self.zeros[k] + before, i - before)
        return i, same

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of ``c`` followed by what each range stands for; a range of one suffix needs one descent."""
        lo, hi = self.first[c], self.first[c + 1]
        on = np.flatnonzero(high - low < self.n)
        wide = on[(high[on] - low[on]) > 1]
        of = np.concatenate((c[on], c[wide]))
        at, same = self.descend(of, np.concatenate((low[on], high[wide])))
        at += self.shift[of]
        lo[on] = at[:len(on)]
        hi[on] = at[:len(on)] + same[:len(on)]
        hi[wide] = at[len(on):]
        return lo, hi

    def windows(self, flat: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
        """Which words of ``flat`` (runs of ``size`` words on end; unknown words are -1) start a window of their run that occurs in the text.

        Runs are searched in pieces of ``STEP`` windows, all in step: a run whose matches break often holds nobody up.
        """
        hits = np.zeros(len(flat), bool)
        base = np.cumsum(size) - size
        count = np.maximum(0, size - window + 1)
        pieces = -(-count // STEP)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        # right: last word of the match, at: first word of it so far (exclusive to the left)
        origin = np.repeat(base, pieces) + nth * STEP
        right = np.minimum(origin + STEP + window - 1, np.repeat(base + size, pieces)) - 1
        at = right + 1
        low, high = np.zeros(len(origin), np.int64), np.full(len(origin), self.n)
        while len(origin):
            c = flat[at - 1]
            known = (at > origin) & (c > 0) & (c <= self.top)
            lo, hi = self.extend(np.where(known, c, 0), low, high)
            ok = known & (hi > lo)
            at, low, high = np.where(ok, at - 1, at), np.where(ok, lo, low), np.where(ok, hi, high)
            full = ok & (right - at + 1 >= window)
            hits[at[full]] = True
            # a stopped match goes on with the next window that it has not judged
            stop = ~ok
            right = np.where(stop, np.minimum(right - 1, at + window - 2), right)
            at, low, high = np.where(stop, right + 1, at), np.where(stop, 0, low), np.where(stop, self.n, high)
            keep = (right - origin + 1 >= window) & ~(ok & (at == origin))
            if not keep.all():
                origin, right, at, low, high = (x[keep] for x in (origin, right, at, low, high))
        return hits


def runs_of(mask: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of marked places whose keys agree."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in (mask, *keys)])))
    cut = np.flatnonzero(change)
    ends = np.append(cut[1:], len(mask))
    return cut[mask[cut]], ends[mask[cut]]


def repeats(docs: DataFrame, window: int = WINDOW, buckets: int | None = None, judge=None, schema: str | None = None) -> DataFrame:
    """``doc_id, n_words, spans, kept``: removed word spans as flat start, end pairs, and the kept words joined by one space.

    ``judge(rows, words, gone)`` may instead turn a block's rows, its words and which of them go into another table of ``schema``.
    """
    buckets = buckets or 4 * partitions(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if judge is None:
        docs = docs.select("doc_id", "text")
        judge, schema = plain_result, f"doc_id {kind}, n_words bigint, spans array<int>, kept string"

    def send_prints(batches):
        for number, rows in blocks(batches):
            out = [(b, number, p) for b, p in Block(rows, window, buckets).bundles()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["bucket", "block", "packed"])

    def resolve(rows: pa.Table) -> pa.Table:
        parts = [expand(p.as_py()) for p in rows["packed"]]
        prints = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        numbers = np.array(rows["block"].to_pylist(), np.int64)
        size = np.array([len(p) for p in prints])
        every, doc, block = np.concatenate(prints), np.concatenate([p[1].view(np.int64) for p in parts]), np.repeat(numbers, size)
        order = np.lexsort((block, doc, every))
        head = np.concatenate(([True], every[order][1:] != every[order][:-1]))
        group = np.cumsum(head) - 1
        first = order[head]
        several = np.bincount(group) > 1
        place = np.empty(len(every), np.int64)
        place[order] = group
        source = first[place]
        state = np.where(source == np.arange(len(every)), several[place].astype(np.uint64), np.uint64(2))
        cuts = np.cumsum(size)[:-1]
        packed = []
        for s, src in zip(np.split(state, cuts), np.split(source, cuts), strict=True):
            far = src[s == 2]
            packed.append(squeeze(s, doc[far].view(np.uint64), block[far].view(np.uint64)))
        return pa.table({"block": numbers, "bucket": rows["bucket"], "packed": pa.array(packed, pa.binary())})

    def send_texts(batches):
        for number, rows in blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as w:
                w.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())], pa.binary())], names=["block", "packed"])

    def open_block(texts: pa.Table) -> pa.Table:
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(texts["packed"][0].as_py())).read_all()

    shape = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("print", pa.binary()), ("size", pa.int64()), ("words", pa.binary()), ("places", pa.binary())])

    def route(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """Index text of the block's own shard (kind 0), runs to search elsewhere (kind 1) and where each run lies in the block."""
        number = texts["block"][0].as_py()
        b = Block(open_block(texts), window, buckets)
        found = {k: expand(p) for k, p in zip(answers["bucket"].to_pylist(), answers["packed"].to_pylist(), strict=True)}
        if sorted(found) != b.bucket.tolist():
            raise ValueError("an input split changed between two readings")
        state = np.zeros(len(b.print), np.uint64)
        doc, block = b.least.copy(), np.full(len(b.print), number)
        for k, x, y in zip(b.bucket.tolist(), b.edge, b.edge[1:], strict=False):
            mine = b.order[x:y]
            if len(found[k][0]) != len(mine):
                raise ValueError("an input split changed between two readings")
            state[mine] = found[k][0]
            far = mine[found[k][0] == 2]
            doc[far], block[far] = found[k][1].view(np.int64), found[k][2].view(np.int64)
        source = doc[b.slot]
        repeated = (state[b.slot] == 1) | b.shared[b.slot]
        first = np.zeros(len(b.slot), bool)
        own = np.flatnonzero((source == b.doc) & (block[b.slot] == number) & repeated)
        first[own[np.unique(b.slot[own], return_index=True)[1]]] = True  # every distinct window once
        asked = source < b.doc
        ids, edge, goal = b.words.ids, b.words.edge, block[b.slot]
        out: dict[tuple, list] = {}
        for x, y in zip(*runs_of(first, b.row), strict=True):
            out.setdefault((number, 0, ids[b.at[x]:b.at[y - 1] + window].tobytes()), [])
        for x, y in zip(*runs_of(asked, b.row, goal), strict=True):
            row, to = b.row[x], int(goal[x])
            for k in range(x, y, PIECE):
                out.setdefault((to, 1, ids[b.at[k]:b.at[min(y, k + PIECE) - 1] + window].tobytes()), []).extend((row, b.at[k] - edge[row]))
        if not out:
            return shape.empty_table()
        runs = [np.frombuffer(w, ids.dtype) for _, _, w in out]
        texts = b.words.join(np.concatenate(runs), np.array([len(w) for w in runs]), "\n").cast(pa.binary())
        marks = [hashlib.blake2b(w.as_buffer(), digest_size=16).digest() for w in texts]
        columns = [[s for s, _, _ in out], [k for _, k, _ in out], [number] * len(out), marks, pc.binary_length(texts).cast(pa.int64()), texts, [np.array(p, "<u4").tobytes() for p in out.values()]]
        return pa.table(dict(zip(shape.names, columns, strict=True)), schema=shape)

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("kind")
        own = int((rows["kind"].to_numpy() == 0).sum())
        lists = pc.split_pattern(rows["words"].combine_chunks(), "\n")
        number = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1  # of first sight: index words first
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        at, asked = int(size[:own].sum()), size[own:]
        edge = np.cumsum(asked) - asked
        if own:
            index = FMIndex(np.insert(number[:at], np.cumsum(size[:own]), 0), window)
            flat = number[at:]
            hits = index.windows(np.where(flat > index.top, -1, flat), asked, window)
        else:
            hits = np.zeros(len(number), bool)
        found = [np.packbits(hits[e:e + n]).tobytes() for e, n in zip(edge.tolist(), (asked - window + 1).tolist(), strict=True)]
        return pa.table({"shard": rows["shard"][own:], "print": rows["print"][own:], "hits": pa.array(found, pa.binary())})

    def cut(texts: pa.Table, results: pa.Table) -> pa.Table:
        rows = open_block(texts)
        words = Words(rows["text"])
        hit = np.zeros(len(words.ids) + window, bool)
        for places, hits in zip(results["places"].to_pylist(), results["hits"].to_pylist(), strict=True):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(hits, np.uint8)))
            row, k = np.frombuffer(places, "<u4").reshape(-1, 2).astype(np.int64).T
            hit[((words.edge[row] + k)[:, None] + at).ravel() + window] = True
        seen = np.cumsum(hit)
        return judge(rows, words, seen[window:] > seen[:-window])

    prints = docs.select("doc_id", "text").mapInArrow(thrifty_map(send_prints), "bucket bigint, block bigint, packed binary")
    answers = prints.groupBy("bucket").applyInArrow(thrifty_group(resolve), "block bigint, bucket bigint, packed binary")
    texts = docs.select("doc_id", "text").mapInArrow(thrifty_map(send_texts), "block bigint, packed binary")
    routed = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(thrifty_cogroup(route), "shard bigint, kind int, block bigint, print binary, size bigint, words binary, places binary")
    routed = stage(routed, "substring-runs")
    once = routed.groupBy("shard", "kind", "print").agg(F.first("words").alias("words"))
    # runs that visit one shard are dealt to so many tasks that the copies of its index stay smaller than the runs
    load = routed.groupBy("shard", "kind", "print").agg(F.first("size").alias("size")).groupBy("shard").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("size"))).alias("asked"), F.sum(F.when(F.col("kind") == 0, F.col("size"))).alias("own"))
    parts = load.where("asked > 0").select("shard", F.ceil(F.col("asked") / F.greatest("own", F.lit(PART_BYTES))).cast("int").alias("parts"))
    dealt = once.join(parts, "shard").select("shard", "kind", "print", "words", F.explode(F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("parts") - 1))
        .otherwise(F.array(F.pmod(F.hash("print"), "parts")))).alias("part"))
    hits = dealt.repartition("shard", "part").groupBy("shard", "part").applyInArrow(thrifty_group(search), "shard bigint, print binary, hits binary")
    results = routed.where("kind = 1").select("shard", "print", "block", "places").join(hits, ["shard", "print"]).select("block", "places", "hits")
    whole = docs.mapInArrow(thrifty_map(send_texts), "block bigint, packed binary")
    return whole.groupBy("block").cogroup(results.groupBy("block")).applyInArrow(thrifty_cogroup(cut), schema)


def kept_texts(words: Words, gone: np.ndarray) -> pa.Array:
    """Words that are not gone, joined by one space."""
    return words.join(words.ids[~gone], np.bincount(words.row[~gone], minlength=len(words.counts)), " ")


def plain_result(rows: pa.Table, words: Words, gone: np.ndarray) -> pa.Table:
    start, end = runs_of(gone, words.row)
    row = words.row[start]
    spans = (np.stack((start, end), 1) - words.edge[row][:, None]).astype(np.int32).ravel()
    edge = np.concatenate(([0], np.cumsum(2 * np.bincount(row, minlength=len(words.counts))))).astype(np.int32)
    return pa.table({"doc_id": rows["doc_id"], "n_words": pa.array(words.counts, pa.int64()), "spans": pa.ListArray.from_arrays(pa.array(edge), pa.array(spans)), "kept": kept_texts(words, gone)})


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without their repeated words, all columns kept; those of which nothing is left go. Texts without a cut stay byte by
    byte, others become their kept words joined by one space; ``n_chars`` (where present) follows the text."""
    def judge(rows: pa.Table, words: Words, gone: np.ndarray) -> pa.Table:
        left = words.counts - np.bincount(words.row[gone], minlength=len(words.counts))
        cut = left < words.counts
        texts = pc.if_else(pa.array(cut), kept_texts(words, gone), rows["text"].combine_chunks())
        return rows.set_column(rows.schema.get_field_index("text"), rows.schema.field("text"), texts).filter(pa.array(~cut | (left > 0)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = repeats(docs, window, judge=judge, schema=schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 12], ' ')) AS h FROM d, unnest(range(1, len(w) - 11)) AS u(i) WHERE len(w) >= 13),
m AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
r AS (SELECT DISTINCT p.doc_id, p.i + j AS k FROM p JOIN m USING (h), unnest(range(0, 13)) AS u(j) WHERE m.first < p.doc_id),
g AS (SELECT doc_id, list(k) AS gone, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce((SELECT string_agg(x, ' ' ORDER BY k) FROM (SELECT unnest(d.w) AS x, unnest(range(1, len(d.w) + 1)) AS k) WHERE NOT list_contains(coalesce(g.gone, []), k)), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


@register("op10_substrings", ORACLE)
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    removed = F.expr("cast(aggregate(spans, 0L, (s, x) -> x - s) as bigint)")  # alternating sum of ends and starts
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
