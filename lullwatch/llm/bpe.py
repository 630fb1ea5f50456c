"""Byte-level BPE over a distinct-word table: every word is encoded once, its ids go back by position.

Documents are split into words at single spaces between other characters; a word keeps the space before it. No token of a byte-level vocabulary, and no match of its
pattern, goes on over such a place, so the ids of the words are those of the text. A block is a run of documents of one input split of at most about ``SIZE_BYTES``. The word table
is laid out by a hash of the word into buckets; a row holds a block's distinct words of one bucket, so the task of a bucket sees each distinct word of the corpus
and encodes it a single time. A word counts once per block however often it occurs, so no word is hot. The ids return to
their blocks, where they replace the words at their positions. Texts travel once, compressed; nothing is collected.

Decoding joins ids to the id-to-piece table (its size is that of the vocabulary) at their positions and concatenates the pieces.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows give repeated rows; other columns are
ignored; an empty table gives an empty table. The table is read twice; if an input split differs between the two readings, the hashes of the block's word
lists differ and the task fails.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lullwatch.llm.common import SIZE_BYTES, partitions, register, table, thrifty_cogroup, thrifty_map

GAP = re.compile(r"(?<=\S) (?=\S)")
SPACES = re.compile(r"\s\s|^\s|\s\Z")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def words_of(text: str) -> list[str]:
    """``text`` cut before every single space between other characters."""
    if not text:
        return []
    first, *rest = GAP.split(text) if SPACES.search(text) else text.split(" ")
    return [first, *[" " + w for w in rest]]


def blocks(batches):
    """Runs of documents (ids, texts) with a number that is the same whenever the split is read."""
    from pyspark import TaskContext

    base, n = TaskContext.get().partitionId() << 32, itertools.count()
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b["doc_id"], b["text"].to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= SIZE_BYTES:
                yield base + next(n), ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield base + next(n), ids, texts


def bundles(words, buckets: int) -> dict[int, list[str]]:
    """Distinct words of a block by bucket, each list sorted."""
    parts: dict[int, list[str]] = {}
    for w in sorted(words):
        parts.setdefault(zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets, []).append(w)
    return parts


def checksum(words: list[str]) -> int:
    """Hash of a word list, as a signed long."""
    return xxhash.xxh64_intdigest(repr((words, len(words))).encode("utf-8", "surrogatepass")) - (1 << 63)


def narrow(path: str) -> str:
    """Type that holds every id of the vocabulary: ids travel in two bytes where they fit."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def pack(items: list[bytes]) -> bytes:
    sizes = np.array([len(items), *map(len, items)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(items))


def unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u4", n, 4), raw[4 + 4 * n:]


def encode(docs: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """``doc_id, ids, n_tokens``: ids as little-endian unsigned 32-bit integers.

    ``buckets``: parts of the word table; one task holds the distinct words of one part (default: four per shuffle partition).
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = buckets or 4 * partitions(docs.sparkSession)

    def own_words(batches):
        for block, _, texts in blocks(batches):
            found: set[str] = set()
            for t in texts:
                found.update(words_of(t))
            parts = bundles(found, buckets)
            if parts:
                rows = [pack([w.encode("utf-8", "surrogatepass") for w in ws]) for ws in parts.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(np.full(len(rows), block)), pa.array(list(map(checksum, parts.values())), pa.int64()),
                                                  pa.array(rows, pa.binary())], names=["bucket", "block", "sum", "packed"])

    def word_ids(batches):
        encode_all, known, at, small = tokenizer(path).encode_batch_fast, {}, None, narrow(path)
        for b in batches:
            rows = []
            for bucket, packed in zip(b["bucket"].to_pylist(), b["packed"].to_pylist(), strict=True):
                if bucket != at:
                    known, at = {}, bucket
                sizes, raw = unpack(packed)
                ends = np.cumsum(sizes).tolist()
                words = [raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip([0, *ends], ends, strict=False)]
                fresh = [w for w in words if w not in known]
                for w, e in zip(fresh, encode_all(fresh, add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, small).tobytes()
                rows.append(pack([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays([b["block"], b["bucket"], b["sum"], pa.array(rows, pa.binary())], names=["block", "bucket", "sum", "packed"])

    def packed_texts(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for block, ids, texts in blocks(batches):
            for k in range(0, len(ids), 512):
                part = [squeeze(t.encode("utf-8", "surrogatepass")) for t in texts[k:k + 512]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array([i.as_py() for i in ids[k:k + 512]], ids[0].type),
                                                  pa.array(part, pa.binary())], names=["block", "doc_id", "packed"])

    def place(texts: pa.Table, table: pa.Table) -> pa.Table:
        expand, small = zstandard.ZstdDecompressor().decompress, narrow(path)
        number: dict[str, int] = defaultdict(itertools.count().__next__)
        words = [words_of(expand(p.as_py()).decode("utf-8", "surrogatepass")) for p in texts["packed"]]
        codes = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words]
        ids_of = dict(zip(table["bucket"].to_pylist(), zip(table["sum"].to_pylist(), table["packed"].to_pylist(), strict=True), strict=True))
        parts, sizes, first, flat, at = bundles(number, buckets), np.zeros(len(number), np.int64), np.zeros(len(number), np.int64), [], 0
        if sorted(parts) != sorted(ids_of):
            raise ValueError("an input split changed between two readings")
        for bucket, words in parts.items():
            said, packed = ids_of[bucket]
            lengths, raw = unpack(packed)
            if said != checksum(words):
                raise ValueError("an input split changed between two readings")
            slots = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            lengths = lengths // int(small[2])
            sizes[slots] = lengths
            first[slots] = at + np.cumsum(lengths) - lengths
            flat.append(np.frombuffer(raw, small))
            at += len(flat[-1])
        flat = (np.concatenate(flat) if flat else np.zeros(0)).astype("<u4")
        out = []
        for c in codes:
            n = sizes[c]
            out.append(flat[np.repeat(first[c] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
        return pa.table({"doc_id": texts["doc_id"], "ids": pa.array(out, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64())})

    words = docs.mapInArrow(thrifty_map(own_words), "bucket int, block bigint, sum bigint, packed binary").repartition("bucket").sortWithinPartitions("bucket")
    words = words.mapInArrow(thrifty_map(word_ids), "block bigint, bucket int, sum bigint, packed binary")
    texts = docs.mapInArrow(thrifty_map(packed_texts), f"block bigint, doc_id {kind}, packed binary")
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(thrifty_cogroup(place), f"doc_id {kind}, ids binary, n_tokens bigint")


def pieces(path: str) -> list[bytes]:
    """Id-to-piece table of a byte-level vocabulary: the byte string of every id."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: the bytes that stand for themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


def decode(encoded: DataFrame, path: str, column: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ``ids`` stand for."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(column, T.StringType())])

    sent = encoded.sparkSession.sparkContext.broadcast(pieces(path))

    def read(batches):
        get = sent.value.__getitem__
        for b in (b.slice(k, 500) for b in batches for k in range(0, len(b), 500)):
            text = [b"".join(map(get, np.frombuffer(x.as_py() or b"", "<u4").tolist())).decode("utf-8", "replace") for x in b["ids"]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, column])

    return encoded.mapInArrow(thrifty_map(read), schema)


@register("op3_bpe_codec")
def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
