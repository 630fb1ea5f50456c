"""Cross-tokenizer alignment by interval coalescing: which tokens of one vocabulary share bytes with which tokens of another.

Texts are cut into chunks at single spaces between other characters: neither vocabulary has a token across such a place (B's is searched for one; if it has one, a text
is one chunk). Each distinct chunk of a block is encoded by both tokenizers, behind a bounded cache. Its tokens are byte intervals of the chunk with a space before it; all intervals of
both kinds (of many chunks side by side) are sorted by their start, ``maximum.accumulate`` runs over their ends, and a group breaks where a start reaches the running
maximum. Within groups, overlapping intervals of the two kinds are expanded to links. Documents take tokens, groups and links from their chunks.

A block is some documents of one input split, about ``BLOCK_CHARS`` characters together. A task gives a row per document and one row per block with the block's distinct id
pairs and in how many of its documents each is linked. Only these pairs are shuffled: their counts are summed over the corpus, the highest count of each A id is
joined, and both go back to the blocks, where documents hold their links as numbers into the block's pairs. Texts are encoded once; the rows are written to the shared folder.

Defined results: a null or empty text, or one whose tokens do not spell it (characters that B's model rewrites), has no tokens and zeros; control strings inside texts are
plain text; repeated rows are documents of their own, each counted; a null doc_id is kept; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullwatch.llm import bpe
from lullwatch.llm.common import register, stage, table, thrifty_cogroup, thrifty_map

BLOCK_CHARS = 2 << 20
PART = 1 << 16
CACHE = 100_000
SPACE = "▁"


@lru_cache(maxsize=2)
def byte_level(path: str):
    """Encoder of many texts, the byte string of every id and its length."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    spelt = bpe.pieces(path)
    return lambda texts: [e.ids for e in t.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)], spelt, np.array([len(p) for p in spelt])


@lru_cache(maxsize=2)
def sentence_pieces(path: str):
    """As ``byte_level``, and whether a piece has a space behind another character."""
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_file=path)
    spelt, crossing = [], False
    for i in range(t.get_piece_size()):
        piece = t.id_to_piece(i)
        spelt.append(bytes([int(piece[3:5], 16)]) if t.is_byte(i) else piece.replace(SPACE, " ").encode())
        crossing |= SPACE in piece.lstrip(SPACE)
    return lambda texts: t.encode(texts, num_threads=1), spelt, np.array([len(p) for p in spelt]), crossing


GAP = re.compile(r"(?<=\S) (?=\S)")
SPACES = re.compile(r"\s\s|^\s|\s\Z")


def chunks_of(text: str) -> list[str]:
    """``text`` without the single spaces it is cut at; none for an empty text."""
    if not text:
        return []
    return GAP.split(text) if SPACES.search(text) else text.split(" ")


_known: dict[tuple[str, str], list[dict[str, tuple[bytes, bytes] | None]]] = {}


def encode_chunks(chunks: list[str], a_path: str, b_path: str) -> list[tuple[bytes, bytes] | None]:
    """Tokens of both kinds (32-bit ids) of distinct chunks; None where they do not spell the chunk. Looked up in two cache generations first."""
    (encode_a, spelt_a, _), (encode_b, spelt_b, _, _) = byte_level(a_path), sentence_pieces(b_path)
    young, old = _known.get((a_path, b_path), [{}, {}])
    if len(young) > CACHE:
        young, old = {}, young
    _known[a_path, b_path] = [young, old]
    missing = [c for c in chunks if c not in young]
    young.update((c, old[c]) for c in missing if c in old)
    fresh, size, sent = [c for c in missing if c not in young], 0, []
    for k, c in enumerate(fresh):
        sent.append(c)
        size += len(c)
        if size < PART and k + 1 < len(fresh):
            continue
        for chunk, a, b in zip(sent, encode_a(sent), encode_b(sent), strict=True):
            raw = b" " + chunk.encode("utf-8", "surrogatepass")
            spells = b"".join(map(spelt_a.__getitem__, a)) == raw and b"".join(map(spelt_b.__getitem__, b)) == raw
            young[chunk] = (np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()) if spells else None
        sent, size = [], 0
    return [young[c] for c in chunks]


def taken(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray, words: np.ndarray) -> list[bytes]:
    """For every document the values of its chunks: ``sizes`` values a chunk, ``codes`` the chunks of all documents, ``words`` how many each has."""
    n = sizes[codes]
    upto = np.concatenate(([0], np.cumsum(n)))
    flat = values[np.repeat((np.cumsum(sizes) - sizes)[codes] - upto[:-1], n) + np.arange(upto[-1])].astype("<u4").tobytes()
    cuts = (4 * upto[np.concatenate(([0], np.cumsum(words)))]).tolist()
    return [flat[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


def coalesce(starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Group number of every interval: a group ends where the next start reaches the furthest end so far."""
    order = np.lexsort((kind, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.zeros(len(starts), np.int64)
    group[order[1:]] = np.cumsum(starts[order][1:] >= reach[:-1])
    return group


def blocks(batches, size: int = BLOCK_CHARS):
    """Documents of about ``size`` characters together: a number, their ids and texts."""
    from pyspark import TaskContext

    base, n = TaskContext.get().partitionId() << 32, itertools.count()
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b["doc_id"], b["text"], strict=True):
            ids.append(i)
            texts.append(t.as_py() or "")
            held += len(texts[-1])
            if held >= size or len(ids) >= 20_000:
                yield base + next(n), ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield base + next(n), ids, texts


PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def align(docs: DataFrame, a_path: str, b_path: str, then=None, schema: str | None = None) -> DataFrame:
    """A row per document and one per block.

    Documents: ``block, doc_id, a_ids, b_ids`` (the tokens), ``a_sizes, b_sizes`` (how many of them each group holds, in order), ``links`` (each link as a number into the block's
    pairs), all as little-endian unsigned 32-bit integers. Blocks: ``block, pairs`` with each distinct id pair and the number of the block's documents that link it.
    ``then``: a function of the record batches that the same tasks apply, with its ``schema``.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        long_a, (_, _, long_b, crossing) = byte_level(a_path)[2], sentence_pieces(b_path)
        for block, ids, texts in blocks(batches):
            number: dict[str, int] = defaultdict(itertools.count().__next__)
            codes = []
            for t in texts:
                parts = [t] if crossing and t else chunks_of(t)
                codes.append(np.fromiter(map(number.__getitem__, parts), np.int64, len(parts)))
            found = encode_chunks(list(number), a_path, b_path)
            wrong = np.array([x is None for x in found], bool)
            codes = [c[:0] if wrong[c].any() else c for c in codes]
            words, codes = np.array([len(c) for c in codes]), np.concatenate(codes)
            found = [x or (b"", b"") for x in found]
            n_a, n_b = (np.array([len(x[k]) // 4 for x in found], np.int64) for k in (0, 1))
            a, b = (np.frombuffer(b"".join(x[k] for x in found), np.int32) for k in (0, 1))
            a_end, b_end = np.cumsum(long_a[a]), np.cumsum(long_b[b])
            a_start, b_start = a_end - long_a[a], b_end - long_b[b]
            group = coalesce(np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end)), np.repeat([False, True], [len(a), len(b)]))
            a_group, b_group = group[:len(a)], group[len(a):]
            total = int(group.max(initial=-1)) + 1
            a_sizes, b_sizes = np.bincount(a_group, minlength=total), np.bincount(b_group, minlength=total)
            chunk = np.repeat(np.arange(len(found)), n_a)
            opened = np.concatenate(([True], a_group[1:] != a_group[:-1])) if len(a) else np.zeros(0, bool)
            n_groups = np.bincount(chunk[opened], minlength=len(found))
            # links: the B tokens from the first that ends behind an A token's start to the last that starts before its end
            low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
            many = high - low
            to = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            pairs, links = np.unique(np.repeat(a, many).astype(np.int64) * len(long_b) + b[to], return_inverse=True)
            n_links = np.bincount(np.repeat(chunk, many), minlength=len(found))
            columns = [taken(a, n_a, codes, words), taken(b, n_b, codes, words), taken(a_sizes, n_groups, codes, words), taken(b_sizes, n_groups, codes, words),
                       taken(links, n_links, codes, words)]
            doc = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in columns[-1]])
            once = np.unique(doc * max(1, len(pairs)) + np.frombuffer(b"".join(columns[-1]), "<u4"))
            held = np.bincount(once % max(1, len(pairs)), minlength=len(pairs))
            shown = np.flatnonzero(held)  # chunks of documents without tokens add no pair
            if len(shown) < len(pairs):
                renumbered = np.cumsum(held > 0) - 1
                columns[-1] = [renumbered[np.frombuffer(x, "<u4")].astype("<u4").tobytes() for x in columns[-1]]
                pairs, held = pairs[shown], held[shown]
            for k in range(0, len(ids), 500):
                part = ids[k:k + 500]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array([i.as_py() for i in part], ids[0].type),
                                                  *(pa.array(c[k:k + 500], pa.binary()) for c in columns), pa.nulls(len(part), pa.list_(PAIR))], names=names)
            rows = pa.StructArray.from_arrays([pa.array(pairs // len(long_b), pa.int32()), pa.array(pairs % len(long_b), pa.int32()), pa.array(held, pa.int64())], fields=list(PAIR))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, ids[0].type), *(pa.nulls(1, pa.binary()) for _ in columns),
                                              pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), rows)], names=names)

    names = ["block", "doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes", "links", "pairs"]
    if then is not None:
        return docs.mapInArrow(thrifty_map(lambda batches: then(scan(batches))), schema)
    return docs.mapInArrow(thrifty_map(scan), f"block bigint, doc_id {kind}, a_ids binary, b_ids binary, a_sizes binary, b_sizes binary, links binary, pairs array<struct<a: int, b: int, n: bigint>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n, best``: in how many documents of the corpus each id pair is linked, and whether no pair of the same A id has more."""
    counts = aligned.where("pairs is not null").select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.join(counts.groupBy("a").agg(F.max("n").alias("top")), "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def scored(aligned: DataFrame, keep: str) -> DataFrame:
    """The documents with ``keep`` (a schema of further columns of ``aligned``), ``n_links, n_best, count_sum``. ``aligned`` is read twice: pass a written table."""
    kind = aligned.schema["doc_id"].dataType.simpleString()
    kept = [c.split()[0] for c in keep.split(", ")]
    pairs = aligned.where("pairs is not null").select(F.col("block").alias("home"), F.posexplode("pairs").alias("k", "p")).select("home", "k", "p.a", "p.b")
    answers = pairs.join(pair_counts(aligned), ["a", "b"]).select("home", "k", "n", "best")

    def total(docs: pa.Table, answers: pa.Table) -> pa.Table:
        k = answers["k"].to_numpy()
        n, best = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        n[k], best[k] = answers["n"].to_numpy(), answers["best"].to_numpy()
        links = [np.frombuffer(x.as_buffer(), "<u4") for c in docs["links"].chunks for x in c]
        found = [[len(x) for x in links], [int(best[x].sum()) for x in links], [int(n[x].sum()) for x in links]]
        return pa.table([docs["doc_id"], *(docs[c] for c in kept), *(pa.array(x, pa.int64()) for x in found)], names=["doc_id", *kept, "n_links", "n_best", "count_sum"])

    docs = aligned.where("pairs is null").select("block", "doc_id", "links", *kept)
    return docs.groupBy("block").cogroup(answers.groupBy("home")).applyInArrow(thrifty_cogroup(total), f"doc_id {kind}, {keep}, n_links bigint, n_best bigint, count_sum bigint")


@lru_cache(maxsize=2)
def written_ids(size: int) -> list[bytes]:
    """Decimal ids with a comma, a bar or a semicolon behind them."""
    return [f"{i}{mark}".encode() for mark in ",|;" for i in range(size)]


def group_text(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, size: int) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of every group."""
    a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_upto, b_upto = np.cumsum(a_sizes), np.cumsum(b_sizes)
    a_last[a_upto - 1], b_last[b_upto - 1] = 1, 2
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.repeat(b_upto - b_sizes, a_sizes)] = a + size * a_last
    codes[np.arange(len(b)) + np.repeat(a_upto, b_sizes)] = b + size * b_last
    return b"".join(map(written_ids(size).__getitem__, codes.tolist()))[:-1]


def digest(size: int):
    """Record batches of ``align`` with the number of tokens and groups and a digest of the groups in place of the tokens. ``size``: the larger vocabulary's."""
    def each(batches):
        for b in batches:
            rows = []
            for x in zip(*(b[c] for c in ("a_ids", "b_ids", "a_sizes", "b_sizes")), strict=True):
                if x[0].is_valid:
                    x = [np.frombuffer(v.as_buffer(), "<u4").astype(np.int64) for v in x]
                    rows.append((len(x[0]), len(x[1]), len(x[2]), hashlib.sha256(group_text(*x, size)).hexdigest() if len(x[0]) else ""))
                else:
                    rows.append((None, None, None, None))
            found = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b["block"], b["doc_id"], *found, b["links"], b["pairs"]], names=["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pairs"])

    return each


@register("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    size = max(len(byte_level(a)[1]), len(sentence_pieces(b)[1]))
    docs = table(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, pairs array<struct<a: int, b: int, n: bigint>>"
    aligned = stage(align(docs, a, b, digest(size), schema), "aligned")
    found = scored(aligned, "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
