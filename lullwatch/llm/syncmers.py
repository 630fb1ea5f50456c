"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the smallest of its inner s-mers (by hash) is its first or its last one; whether it is depends on the
k-mer alone, so the same passage has the same anchors in any document. The fingerprint keeps all anchors with all their positions, as
``hash:position`` pairs in position order, so it grows with the text. Likeness matches two fingerprints positionally: the longest sequence of
anchors that both have in the same order, repeats included, against the union of both (as multisets). It is exact: by matching pairs
where these are few, by whole rows of bits where anchors repeat often.

To compare each document with the next one (descending doc_id; after the last, the first), rows are dealt to ranges of
doc_id; a range is read in order, and only the first row of every range is sent to the range before it as well.

Defined results: a null text counts as empty; a text shorter than a k-mer is one anchor, an empty one has none; two empty fingerprints
are alike 1.0; rows with a null doc_id come last in the order; rows of equal doc_id are ordered by text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullwatch.llm.common import partitions, register, table, thrifty_map

K, S = 16, 6
PIECE = 1 << 20
FEW = 16
"""Matching pairs for each anchor up to which they are gone through one by one."""
MASK_BYTES = 32 << 20
FLUSH_CHARS = 4 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def rolling(points: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` code points, by doubling."""
    out, done, have = points.astype(np.uint64) + np.uint64(1), 1, None
    power, acc = np.uint64(0x9E3779B97F4A7C15), None
    span = size
    while span:
        if span & 1:
            acc, have = (out, done) if acc is None else (acc[:len(acc) - done] * power + out[have:], have + done)
        span >>= 1
        if span:
            out = out[:len(out) - done] * power + out[done:]
            done, power = 2 * done, np.uint64((int(power) ** 2 + done) & (1 << 64) - 1)
    return mixed(acc)


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the closed syncmers of a text."""
    if len(points) < k:
        whole = int.from_bytes(hashlib.sha256(points.tobytes()).digest()[:8], "little")
        return np.array([whole] if len(points) else [], np.uint64), np.zeros(min(1, len(points)), np.int64)
    inner, width = rolling(points, s), k - s + 1
    least, done = inner, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:len(least) - step], least[step:])
        done += step
    n = len(least)
    at = np.flatnonzero((inner[:n] == least) | (inner[width - 1:width - 1 + n] == least))
    return rolling(points, k)[at], at


def all_anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of all anchors in position order; long texts are read in overlapping pieces."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    hashes, spots = [], []
    for start in range(0, max(1, len(points) - K + 1), PIECE):
        h, at = anchors(points[start:start + PIECE + K - 1])
        hashes.append((h >> np.uint64(32)).astype(np.int64))
        spots.append(at + start)
    return np.concatenate(hashes), np.concatenate(spots)


def sketch(text: str) -> list[tuple[int, int]]:
    """(hash, position) of all anchors in position order."""
    h, at = all_anchors(text)
    return list(zip(h.tolist(), at.tolist(), strict=True))


def show(fingerprint) -> str:
    return " ".join(map("%08x:%x".__mod__, fingerprint))


def shown(h: np.ndarray, at: np.ndarray) -> str:
    return show(zip(h.tolist(), at.tolist(), strict=True))


def parse(shown: str) -> list[tuple[int, int]]:
    return [(int(h, 16), int(p, 16)) for h, p in (a.split(":") for a in shown.split())]


def in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n:] != b[len(b) - n:])
    tail = n - 1 - int(differ[-1]) if len(differ) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    common = np.intersect1d(a, b)
    if not len(common):
        return head + tail
    a, b = (np.searchsorted(common, x[np.isin(x, common)]) for x in (a, b))
    times = np.bincount(b, minlength=len(common))
    if int(times[a].sum()) <= FEW * (len(a) + len(b)):
        order = np.argsort(b, kind="stable")
        spots = [x[::-1].tolist() for x in np.split(order, np.cumsum(times)[:-1])]
        ends: list[int] = []
        for c in a.tolist():
            for p in spots[c]:
                k = bisect_left(ends, p)
                ends[k:k + 1] = [p]
        return head + tail + len(ends)
    masks: dict[int, int] = {}
    every = rest = (1 << len(b)) - 1
    for c in a.tolist():
        mask = masks.get(c)
        if mask is None:
            mask = int.from_bytes(np.packbits(b == c, bitorder="little").tobytes(), "little")
            if len(masks) * len(b) < 8 * MASK_BYTES:
                masks[c] = mask
        met = rest & mask
        rest = ((rest + met) | (rest - met)) & every
    return head + tail + len(b) - rest.bit_count()


def alike(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return in_order(a, b) / (len(a) + len(b) - both) if both else 0.0


def likeness(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> float:
    """Share of the union's anchors that both fingerprints have in the same order."""
    return alike(*(np.array([h for h, _ in x], np.int64) for x in (a, b)))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following`` (or all it has)."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """``bucket, rank, doc_id, text``: every row in its range of doc_id (rank 0), and the first row of each range at the end of the one before (rank 1)."""
    spark = docs.sparkSession
    parts = 2 * partitions(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    step = F.array(*map(F.lit, cuts)) if cuts else F.expr("cast(array() as array<bigint>)")
    # buckets ascend as doc_id descends; a null doc_id comes last
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.expr("aggregate(cuts, 0, (n, c) -> n + if(c >= doc_id, 1, 0))"))
    rows = docs.withColumn("cuts", step).withColumn("bucket", bucket).drop("cuts")
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("a"), F.xxhash64("text").alias("b"))
    heads = rows.groupBy("bucket").agg(F.max(order).alias("head"))
    firsts = [r.asDict(recursive=True) for r in heads.orderBy("bucket").collect()]  # one row for each range
    spots = [r["bucket"] for r in firsts]
    before = {b: spots[k - 1] for k, b in enumerate(spots)}  # the first range follows the last
    lead = spark.createDataFrame([(r["bucket"], r["head"]["a"], r["head"]["b"], before[r["bucket"]]) for r in firsts] or [(-1, 0, 0, -1)], "bucket int, a bigint, b bigint, prior int")
    sent = rows.withColumn("a", order["a"]).withColumn("b", order["b"]).join(F.broadcast(lead), ["bucket", "a", "b"])
    sent = sent.select(F.col("prior").alias("bucket"), "doc_id", "text").dropDuplicates(["bucket"])
    return rows.select("bucket", F.lit(0).alias("rank"), "doc_id", "text").union(sent.select("bucket", F.lit(1), "doc_id", "text"))


def compare(docs: DataFrame) -> DataFrame:
    """``doc_id, text, edited, fingerprint, edited_fingerprint, near_edited, near_next`` with texts as their length and SHA-256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = 2 * partitions(docs.sparkSession)
    dealt = with_next(docs).repartition(parts, "bucket").sortWithinPartitions("bucket", "rank", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())

    def scan(batches):
        out: dict[str, list] = {}
        was = None

        size = 0

        def close(doc, mine, following, other):
            new = edited(doc[1], following)
            changed = all_anchors(new)
            for name, value in (("doc_id", doc[0]), ("n_chars", len(doc[1])), ("edited_sha256", hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()), ("fingerprint", shown(*mine)),
                                ("edited_fingerprint", shown(*changed)), ("near_edited", alike(mine[0], changed[0])), ("near_next", alike(mine[0], other[0]))):
                out.setdefault(name, []).append(value)
            return len(out["fingerprint"][-1]) + len(out["edited_fingerprint"][-1])

        for b in batches:
            for bucket, i, t in zip(b["bucket"].to_pylist(), b["doc_id"], b["text"], strict=True):
                t = t.as_py()
                now = (bucket, (i.as_py(), t), all_anchors(t))
                if was is not None and was[0] == bucket:
                    size += close(was[1], was[2], t, now[2])
                was = now
                if size >= FLUSH_CHARS or len(out.get("doc_id", ())) >= 1000:
                    yield pa.RecordBatch.from_pydict(out, schema=layout(b))
                    out.clear()
                    size = 0
            if out:
                yield pa.RecordBatch.from_pydict(out, schema=layout(b))
                out.clear()
                size = 0

    def layout(b):
        return pa.schema([("doc_id", b.schema.field("doc_id").type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                          ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    return dealt.mapInArrow(thrifty_map(scan), f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@register("op8_syncmers")
def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
