"""Token ids as wavelet matrices: one compressed file per shard answers access, count and occurrence lookup.

Documents are encoded in place (each distinct white-space chunk goes through the tokenizers library once per worker, behind a
bounded cache), dealt to ranges of doc_id and written in ascending order. A shard holds whole documents, about ``SHARD_TOKENS`` ids
(more only if a single document has more). Its file is one Parquet row: for every bit of an id a bit-plane in wavelet order with
its number of zeros and cumulative ranks per 512 bits, plus the document directory. The fixed layout:

    shard, bucket, base, n, width, zeros list<int64>, planes list<binary>, ranks list<binary of uint32>, doc_ids list, sizes list<int64>

Only range totals (one row per range) are combined across shards to place documents in the whole corpus.

Defined results: a null or empty text has only the end id; rows with a null doc_id come first; repeated rows are written each; rows of
equal doc_id follow each other in the order of their ids' bytes; other columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lullwatch.llm.common import partitions, register, stage_path, table

SHARD_TOKENS = 1 << 21
CACHE = 200_000
END = 2
STEP = 512

PIECES = re.compile(rb"[A-Za-z]+|[0-9]")
STOP = r"([a-z])([.,])([ \t\n\r\f\v]|$)"

_known: dict[str, list[dict[bytes, bytes]]] = {}
_tokenizers: dict[str, tuple] = {}


def word_ends(chunk: bytes) -> int:
    """How many word ends a chunk of letters and digits has: one for each run of ASCII letters and each digit, one for a run of any letters; 0 for other chunks."""
    if chunk.isalnum():
        return len(PIECES.findall(chunk))
    return int(chunk.decode("utf-8", "surrogatepass").isalpha())


def encode_texts(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Ids of whole texts, by the tokenizers library.

    For vocabularies that drop white space and mark word ends: texts are cut at ASCII white space, and a full stop or comma between
    a letter and white space is a chunk of its own. Texts are cut and their chunks numbered by Arrow, so only distinct chunks are looked up. The library encodes what is
    in neither of the two cache generations; chunks of letters and digits go many at a time, told apart by their word ends.
    """
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's own threads only cost time
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        ends = np.zeros(t.get_vocab_size(), bool)
        ends[[i for s, i in t.get_vocab().items() if s.endswith("</w>")]] = True
        _tokenizers[path], _known[path] = (t, ends), [{}, {}]
    t, ends = _tokenizers[path]
    encode = t.encode_batch_fast
    if len(_known[path][0]) > CACHE:
        _known[path] = [{}, _known[path][0]]
    young, old = _known[path]
    raw = pc.fill_null(texts, "")
    raw = pc.if_else(pc.match_substring(raw, "<|"), raw, pc.ascii_lower(raw))
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(raw, pattern=STOP, replacement=r"\1 \2\3"))
    chunks = lists.flatten()
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(lists).to_numpy())
    filled = pc.not_equal(chunks, "")
    coded = chunks.filter(filled).dictionary_encode()
    doc, codes = doc[filled.to_numpy(zero_copy_only=False)], coded.indices.to_numpy()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    found = list(map(young.get, distinct))
    gaps = [k for k, x in enumerate(found) if x is None]
    missing = [distinct[k] for k in gaps]
    young.update((c, old[c]) for c in missing if c in old)
    fresh = [c for c in missing if c not in young]
    runs = {c: n for c in fresh if (n := word_ends(c))}
    words = list(runs)
    others = [c for c in fresh if c not in runs]
    for k in range(0, len(words), 5000):
        part = [words[x:x + 100] for x in range(k, min(k + 5000, len(words)), 100)]
        for group, e in zip(part, encode([b" ".join(g).decode() for g in part], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            last, upto = np.flatnonzero(ends[ids]), np.cumsum([runs[c] for c in group])
            if len(last) != upto[-1] or last[-1] != len(ids) - 1:
                others += group  # a letter that the library's normaliser splits
                continue
            cuts, flat = (4 * (last[upto - 1] + 1)).tolist(), ids.tobytes()
            young.update((c, flat[x:y]) for c, x, y in zip(group, [0, *cuts], cuts, strict=False))
    for k in range(0, len(others), 5000):
        part = others[k:k + 5000]
        for c, e in zip(part, encode([c.decode("utf-8", "surrogatepass") for c in part], add_special_tokens=False), strict=True):
            young[c] = np.array(e.ids, "<u4").tobytes()
    for k in gaps:
        found[k] = young[distinct[k]]
    sizes, flat = np.fromiter(map(len, found), np.int64, len(found)) // 4, np.frombuffer(b"".join(found), "<u4")
    many = sizes[codes]
    upto = np.concatenate(([0], np.cumsum(many)))
    ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - upto[:-1], many) + np.arange(upto[-1])]
    cuts = upto[np.searchsorted(doc, np.arange(len(texts) + 1))]
    return np.split(ids, cuts[1:-1])


class WaveletMatrix:
    """Sequence of unsigned integers as bit-planes, highest bit first; every plane stably sorts the sequence by its bit."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, seq: np.ndarray) -> "WaveletMatrix":
        zeros, planes, ranks = [], [], []
        for k in reversed(range(max(1, int(seq.max(initial=0)).bit_length()))):
            bit = (seq >> k & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % (STEP // 8) + STEP // 8, np.uint8)))
            ones = np.bitwise_count(packed).reshape(-1, STEP // 8).sum(axis=1, dtype=np.uint32)
            planes.append(packed.tobytes())
            ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())
            zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate((seq[~bit], seq[bit]))
        return cls(len(bit), zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position ``i``: a stored rank and the bits of one block."""
        block, rest = divmod(i, STEP)
        part = self.planes[level][block * STEP // 8:block * STEP // 8 + rest // 8 + 1]
        inside = int(np.bitwise_count(part[:-1]).sum()) + (int(part[-1]) & ((1 << rest % 8) - 1)).bit_count() if rest else 0
        return int(self.ranks[level][block]) + inside

    def access(self, i: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            ones = self._ones(level, i)
            value, i = value << 1 | bit, zeros + ones if bit else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before ``end`` lie after the last plane."""
        a, b = 0, end
        if value >> len(self.zeros):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (zeros + x, zeros + y) if value >> (len(self.zeros) - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def count(self, value: int, end: int | None = None) -> int:
        a, b = self._range(value, self.n if end is None else end)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Position of occurrence number ``k`` (from 0): up through the planes by binary search over ranks."""
        a, b = self._range(value, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(len(self.zeros))):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            goal = i - self.zeros[level] if bit else i
            low, high = 0, self.n - 1
            while low < high:
                mid = (low + high) // 2
                ones = self._ones(level, mid + 1)
                if (ones if bit else mid + 1 - ones) > goal:
                    high = mid
                else:
                    low = mid + 1
            i = low
        return i

    def values(self) -> np.ndarray:
        """The whole sequence."""
        seq = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in reversed(range(len(self.zeros))):
            bit = np.unpackbits(self.planes[level], bitorder="little")[:self.n].view(bool)
            below, seq = seq, np.empty_like(seq)
            seq[~bit] = below[:self.zeros[level]]
            seq[bit] = below[self.zeros[level]:] | seq.dtype.type(1 << len(self.zeros) - 1 - level)
        return seq


SHARD = ("bucket int, shard bigint, base bigint, n bigint, zeros array<bigint>, planes array<binary>, ranks array<binary>, doc_ids array<{}>, sizes array<bigint>")


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END, shard_tokens: int = SHARD_TOKENS) -> str:
    """Write the shard files of ``docs`` (``doc_id, text``) below ``path``."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = 2 * partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
    cuts = np.array(sorted(set(cuts)))

    def tokens(batches):
        for b in (b.slice(k, 1000) for b in batches for k in range(0, len(b), 1000)):
            ids = [np.append(x, np.uint32(end_id)) for x in encode_texts(b["text"], tokenizer)]
            small = [x.astype("<u2").tobytes() if x.max() < 65536 else b"\xff" + x.astype("<u4").tobytes() for x in ids]
            where = [0 if i is None else int(np.searchsorted(cuts, i)) for i in b["doc_id"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), b["doc_id"], pa.array(small, pa.binary())], names=["bucket", "doc_id", "ids"])

    def shards(batches):
        bucket, base, number, ids, seqs, size = None, 0, 0, [], [], 0

        def close():
            m = WaveletMatrix.build(np.concatenate(seqs))
            row = {"bucket": [bucket], "shard": [(bucket << 32) + number], "base": [base], "n": [m.n], "zeros": [m.zeros], "planes": [[p.tobytes() for p in m.planes]],
                   "ranks": [[r.tobytes() for r in m.ranks]], "doc_ids": [ids], "sizes": [[len(s) for s in seqs]]}
            return pa.RecordBatch.from_pydict(row, schema=layout)

        layout = None
        for b in batches:
            layout = layout or pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("base", pa.int64()), ("n", pa.int64()), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
                                          ("ranks", pa.list_(pa.binary())), ("doc_ids", pa.list_(b.schema.field("doc_id").type)), ("sizes", pa.list_(pa.int64()))])
            for to, i, x in zip(b["bucket"].to_pylist(), b["doc_id"].to_pylist(), b["ids"], strict=True):
                x = x.as_py()
                seq = np.frombuffer(x, "<u4", offset=1) if len(x) % 2 else np.frombuffer(x, "<u2")
                if seqs and (to != bucket or size + len(seq) > shard_tokens):
                    yield close()
                    base, number, ids, seqs, size = base + size, number + 1, [], [], 0
                if to != bucket:
                    bucket, base, number = to, 0, 0
                ids.append(i)
                seqs.append(seq)
                size += len(seq)
        if seqs:
            yield close()

    dealt = docs.mapInArrow(tokens, f"bucket int, doc_id {kind}, ids binary").repartition(parts, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    dealt.mapInArrow(shards, SHARD.format(kind)).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return path


def open_shards(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    return spark.read.schema(SHARD.format(kind)).parquet(path)


def matrix(row) -> WaveletMatrix:
    return WaveletMatrix(row["n"], row["zeros"], row["planes"], row["ranks"])


def read(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """``doc_id, start, ids`` of every document, read from the shard files; ``start`` counts the ids of all documents before it."""
    shards = open_shards(spark, path, kind)
    totals = shards.groupBy("bucket").agg(F.sum("n").alias("total"))
    before = totals.select("bucket", (F.sum("total").over(Window.orderBy("bucket")) - F.col("total")).alias("offset"))

    def unfold(batches):
        for b in batches:
            for k in range(len(b)):
                row = b.slice(k, 1).to_pylist()[0]
                values, ends = matrix(row).values().astype("<u4"), np.cumsum(row["sizes"])
                starts = ends - row["sizes"]
                for j in range(0, len(ends), 2000):
                    ids = [values[x:y].tobytes() for x, y in zip(starts[j:j + 2000].tolist(), ends[j:j + 2000].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]] * len(ids), pa.int32()), pa.array(row["doc_ids"][j:j + 2000], b["doc_ids"].type.value_type),
                                                      pa.array(starts[j:j + 2000] + row["base"], pa.int64()), pa.array(ids, pa.binary())], names=["bucket", "doc_id", "at", "ids"])

    rows = shards.mapInArrow(unfold, f"bucket int, doc_id {kind}, at bigint, ids binary")
    return rows.join(F.broadcast(before), "bucket").select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "ids")


def count_token(spark: SparkSession, path: str, token: int, kind: str = "bigint") -> DataFrame:
    """``shard, occurrences`` of one id, without unfolding any sequence."""
    def scan(batches):
        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_pydict({"shard": [row["shard"]], "occurrences": [matrix(row).count(token)]})

    return open_shards(spark, path, kind).mapInArrow(scan, "shard bigint, occurrences bigint")


def find_token(spark: SparkSession, path: str, token: int, kind: str = "bigint") -> DataFrame:
    """``doc_id, offset`` of every occurrence of one id, by select."""
    def scan(batches):
        for b in batches:
            for row in b.to_pylist():
                m, ends = matrix(row), np.cumsum(row["sizes"])
                at = np.array([m.select(token, k) for k in range(m.count(token))], np.int64)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][d] for d in doc], b["doc_ids"].type.value_type),
                                                  pa.array(at - (ends - row["sizes"])[doc] if len(at) else at, pa.int64())], names=["doc_id", "offset"])

    return open_shards(spark, path, kind).mapInArrow(scan, f"doc_id {kind}, offset bigint")


def with_checksum(rows: DataFrame) -> DataFrame:
    def scan(batches):
        for b in batches:
            raw = [x.as_py() for x in b["ids"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint")


@register("op6_token_file")
def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = write(docs, public_tokenizers.path("word_bpe_49k.json"), stage_path(spark, "token-file"))
    return with_checksum(read(spark, path, kind))
