"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by multi-index hashing.

A fingerprint is cut into a high and a low half. Two fingerprints at distance 2 or less have high halves at distance 1 or less, or equal
low halves. So every fingerprint enters a table under both halves, and probes it with the Hamming ball of radius 1 around its high
half and of radius 0 around its low half; matches are verified over all 64 bits. A pair whose high halves differ in one bit is
found from the side that has the bit set, so only cleared bits are enumerated.

Fingerprints are distinct before they are linked, so copies cost nothing. A half shared by more than ``HOT`` distinct
fingerprints (a large group of near copies) is not expanded into pairs: its members enumerate the full fingerprints within
the distance that keep that half, at most 529 each, and look those up exactly. Links are joined to components by alternating
large-star and small-star rounds; every round is written to the shared folder.

``similar_nodes`` finds near copies by the Jaccard similarity of their shingle sets, which a radius of a few bits does not reach. Two sets with
a similarity of t or more share one of their (1 - t) smallest shingle hashes, so texts meet under those; in a bucket of at most
``ALL + 1`` texts all pairs are compared. A larger bucket is sorted by min-hash values of the whole sets: each text has ``ROWS`` of them, four bits each, in four words,
and the bucket's key says which word and from which value on. Near copies agree in a long run of these values, others do not, so they lie side by side in many of
the buckets they share; a text is compared with the ``LATER`` before it in each. Pairs whose smallest shingles already differ in more than the similarity
allows are left out, which loses none; the others are verified over both whole sets; their number grows with
the number of rows. Copies of a text are one node.

What this misses in the larger buckets is found exactly: every pair of such a bucket that the links so far do not join is looked at (``rest_pairs``), in blocks of ``BLOCK`` texts. A pair goes on
only if the similarity is possible by the numbers of shingles, by the places of the bucket's shingle among the smallest ones, and by ``parity_bits``: 1,024 bits a text or more, of which two sets
differ in no more than in their shingles. None of it loses a pair. The looks grow with the square of a bucket (of texts that are not one class already), the pairs that go on do not.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; fewer words than a shingle give the whole
sequence; rows with a null doc_id have a fingerprint and no component; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullwatch.llm.common import partitions, register, stage, table, thrifty_group, thrifty_map

HOT = 512
SEED = 42


ALL = 16
"""Texts of a bucket that are compared with all before them; later ones with the ``LATER`` before them."""
LATER = 4
BLOCK = 2048
"""Texts of a larger bucket that one task holds on each side, about."""
SLOTS = 1 << 24
"""Bits of the map that tells entries of larger buckets from others, before the exact join."""
ROWS = 64
"""Min-hash values of a text: four words of 16."""
TURNS = np.random.default_rng(SEED).integers(0, 1 << 64, ROWS, np.uint64, endpoint=False) | np.uint64(1)


def shingles(text: str | None, size: int):
    """Hashes of all word shingles of a text, in pieces."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    first, last = starts[:n].tolist(), ends[min(size, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, 1 << 16):
        yield np.fromiter((digest(flat[a:b], SEED) for a, b in zip(first[k:k + (1 << 16)], last[k:k + (1 << 16)], strict=True)), np.uint64)


def majority(pieces) -> int:
    """Bits that more than half of the hashes have, as a signed long."""
    ones, n = np.zeros(64, np.int64), 0
    for h in pieces:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    return majority(shingles(text, size))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order; a text without words has the one hash 0."""
    pieces = list(shingles(text, size))
    return np.unique(np.concatenate(pieces)) if pieces else np.zeros(1, np.uint64)


def min_words(hashes: np.ndarray) -> np.ndarray:
    """Four words of 16 min-hash values of four bits: the smallest product of the hashes with each odd number, mixed once more."""
    least = np.full(ROWS, ~np.uint64(0))
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k:k + (1 << 14)]
        for r in range(ROWS):
            least[r] = min(least[r], (part * TURNS[r]).min())
    least = (least ^ least >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)
    return (least.reshape(4, 16) << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def parity_bits(hashes: np.ndarray) -> bytes:
    """1,024 bits, twice as many for each doubling of the set beyond 800, each the parity of the hashes that fall on it: two sets differ in at least as many hashes as their bits.

    The halves of a longer map, one upon the other, are the shorter one.
    """
    width = 1024
    while width < 1 << 15 and 800 * width < 1024 * len(hashes):
        width *= 2
    at = (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(49)).astype(np.int64) & (width - 1)
    return np.packbits(np.bincount(at, minlength=width) & 1).tobytes()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where a column has it."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""
    def scan(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([fingerprint(t.as_py(), size) for t in b["text"]], pa.int64())], names=["doc_id", "fp"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(thrifty_map(scan), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


HIGH, LOW = "shiftrightunsigned(fp, 32)", "(fp & 4294967295L)"
KEY_HIGH, KEY_LOW = HIGH, f"({LOW} | 4294967296L)"
BITS = "sequence(0, 31)"


def ball(radius: int) -> str:
    """SQL array of the masks of at most ``radius`` bits of a 32-bit half."""
    masks = "array(0L)"
    if radius >= 1:
        masks = f"concat({masks}, transform({BITS}, i -> shiftleft(1L, i)))"
    if radius >= 2:
        masks = f"concat({masks}, flatten(transform({BITS}, i -> transform(filter({BITS}, j -> j < i), j -> shiftleft(1L, i) | shiftleft(1L, j)))))"
    return masks


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """``u, v`` with u > v: pairs of nodes whose fingerprints (``fp``, one row each with its ``node`` id) differ in 1 or 2 bits."""
    entries = nodes.select("fp", "node", F.explode(F.expr(f"array({KEY_HIGH}, {KEY_LOW})")).alias("key"))
    busy = stage(entries.groupBy("key").count().where(F.col("count") > hot).select("key"), "simhash-busy")
    cleared = f"transform(filter({BITS}, i -> {HIGH} & shiftleft(1L, i) != 0), i -> struct({HIGH} - shiftleft(1L, i) as key, shiftleft(1L, i + 32) as flip))"
    probes = nodes.select("fp", "node", F.explode(F.expr(f"concat(array(struct({KEY_HIGH} as key, 0L as flip), struct({KEY_LOW} as key, 0L as flip)), {cleared})")).alias("p"))
    probes = probes.select("fp", "node", "p.key", "p.flip")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))).between(1, 2) & ((F.col("flip") != 0) | (F.col("fp") > F.col("fp2")))
    cold = entries.join(busy, "key", "left_anti").select("key", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    found = probes.join(cold, "key").where(near).select("node", "node2")
    high_same = f"transform({ball(2)}, m -> fp ^ m)"
    high_flip = f"transform({ball(1)}, m -> fp ^ flip ^ m)"
    low_same = f"transform({ball(2)}, m -> fp ^ shiftleft(m, 32))"
    wanted = F.expr(f"case when flip != 0 then {high_flip} when key >= 4294967296L then {low_same} else {high_same} end")
    asked = probes.join(busy, "key", "left_semi").select("fp", "node", "flip", F.explode(wanted).alias("fp2"))
    asked = asked.where((F.col("fp") != F.col("fp2")) & ((F.col("flip") != 0) | (F.col("fp") > F.col("fp2"))))
    members = nodes.select(F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    both = found.union(asked.join(members, "fp2").select("node", "node2"))
    return both.where("node != node2").select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with an edge: the smallest node it reaches. ``edges``: ``u, v`` with u > v."""
    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    now = stage(edges, "simhash-edges")
    seen = state(now)
    while seen[0]:
        sides = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.union(least).distinct(), "simhash-round")
        was, seen = seen, state(now)
        if was == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp, component_id``: the class of every row is the smallest doc_id that its links reach."""
    prints = stage(fingerprints(docs, size), "simhash-prints")
    nodes = stage(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    roots = components(links(nodes))
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    joined = prints.join(classes, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name``: a hash of the text, the same for copies."""
    return docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))


def smallest(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """``node, n, words, least, parity``: number of shingles, min-hash words, smallest shingle hashes and parities of every node, written."""
    share = Fraction(str(similarity))

    def scan(batches):
        for b in batches:
            nodes, sizes, words, least, parity = [], [], [], [], []
            for node, t in zip(b["node"].to_pylist(), b["text"], strict=True):
                h = shingle_set(t.as_py(), size)
                nodes.append(node)
                sizes.append(len(h))
                words.append(min_words(h))
                least.append(h[:len(h) - ceil(share * len(h)) + 1].view(np.int64))
                parity.append(parity_bits(h))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64())),
                                              pa.array(parity, pa.binary())], names=["node", "n", "words", "least", "parity"])

    rows = texts.select("node", "text").mapInArrow(thrifty_map(scan), "node bigint, n bigint, words array<bigint>, least array<bigint>, parity binary")
    rows = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "words", "least", "parity")])
    return stage(rows, "simhash-least")


def candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """``u, v`` with u > v: nodes that share one of their smallest shingles and whose numbers of shingles allow the similarity; of larger buckets, those near each other.

    A row ``(key, NULL)`` names each larger bucket.
    """
    share = Fraction(str(similarity))

    def meet(batches):
        empty = np.zeros(0, np.int64)
        key, node, n, rank = empty, empty, empty, empty
        for b in batches:
            had, base = len(key), int(rank[0]) if len(rank) else 0
            key, node, n = (np.concatenate((old, b[c].to_numpy())) for old, c in ((key, "key"), (node, "node"), (n, "n")))
            at = np.arange(len(key))
            start = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
            rank = at - start + np.where(start == 0, base, 0)
            us, vs = [empty], [empty]
            for back in range(1, ALL + 1):
                i = at[max(had, back):]
                j = i - back
                low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                near = (key[i] == key[j]) & (node[i] != node[j]) & (low * share.denominator >= high * share.numerator)
                near &= (rank[i] <= ALL) | (back <= LATER)
                us.append(np.maximum(node[i], node[j])[near])
                vs.append(np.minimum(node[i], node[j])[near])
            u, v = np.concatenate(us), np.concatenate(vs)
            large = key[had:][rank[had:] == ALL + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((u, large))), pa.concat_arrays([pa.array(v), pa.nulls(len(large), pa.int64())])], names=["u", "v"])
            key, node, n, rank = key[-ALL:], node[-ALL:], n[-ALL:], rank[-ALL:]

    entries = rows.select("node", "n", "words", F.explode("least").alias("key"))
    word, shift = "words[cast(key >> 4 & 3L as int)]", "cast(4 * (key & 15L) as int)"
    turned = F.expr(f"if(key & 15L = 0, {word}, shiftleft({word}, {shift}) | shiftrightunsigned({word}, 64 - {shift}))").alias("turned")
    entries = entries.select("key", turned, "node", "n")
    dealt = entries.repartition(4 * partitions(rows.sparkSession), "key").sortWithinPartitions("key", "turned", "node").select("key", "node", "n")
    return dealt.mapInArrow(thrifty_map(meet), "u bigint, v bigint").distinct()


def rest_pairs(rows: DataFrame, large: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """``u, v`` with u > v: pairs in the buckets named by ``large`` (``key``) that are not of one class of ``roots`` and that may have the similarity."""
    share = Fraction(str(similarity))
    more, less = share.denominator + share.numerator, share.denominator - share.numerator
    slot = F.col("key").bitwiseAND(SLOTS - 1)
    found = large.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("bits")).collect()
    held = np.zeros(SLOTS // 8, np.uint8)
    for r in found:
        held[r.part * 4096:(r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    bits = rows.sparkSession.sparkContext.broadcast(held)

    def pick(batches):
        known = bits.value
        for b in (b.slice(k, 1000) for b in batches for k in range(0, len(b), 1000)):
            least = b["least"]
            key = least.flatten().to_numpy()
            sizes = np.diff(least.offsets.to_numpy())
            row = np.repeat(np.arange(len(b)), sizes)
            at = key & (SLOTS - 1)
            keep = np.flatnonzero(known[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            place = (np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[keep]
            of = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(place), *(b[c].take(of) for c in ("node", "n", "parity"))], names=["key", "place", "node", "n", "parity"])

    def look(table):
        root, node, n, place, side = (table[c].to_numpy() for c in ("root", "node", "n", "place", "side"))
        bits_of = table["parity"].to_pylist()
        level = np.fromiter(((len(p) // 128).bit_length() - 1 for p in bits_of), np.int64, len(bits_of))
        parity = {}
        for g in np.unique(level).tolist():
            parity[g] = np.zeros((len(level), 16 << g), np.uint64)
            for k in np.flatnonzero(level >= g).tolist():
                p = np.frombuffer(bits_of[k], np.uint64)
                while len(p) > 16 << g:
                    p = p[:len(p) // 2] ^ p[len(p) // 2:]
                parity[g][k] = p
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(left), 64):
            a = left[k:k + 64]
            b = right[k:] if lo == hi else right
            both = n[a][:, None] + n[b][None, :]
            low, high = np.minimum(n[a][:, None], n[b][None, :]), np.maximum(n[a][:, None], n[b][None, :])
            ahead = np.minimum((n - place)[a][:, None], (n - place)[b][None, :])
            i, j = np.nonzero((root[a][:, None] != root[b][None, :]) & (low * share.denominator >= high * share.numerator) & (ahead * more >= both * share.numerator))
            least = np.minimum(level[a[i]], level[b[j]])
            for g, step in ((g, (1 << 16) >> g) for g in np.unique(least).tolist()):
                i_, j_ = i[least == g], j[least == g]
                for c in range(0, len(i_), step):
                    x, y = a[i_[c:c + step]], b[j_[c:c + step]]
                    apart = np.bitwise_count(parity[g][x] ^ parity[g][y]).sum(axis=1, dtype=np.int64)
                    near = apart * more <= (n[x] + n[y]) * less
                    us.append(np.maximum(node[x], node[y])[near])
                    vs.append(np.minimum(node[x], node[y])[near])
        return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})

    members = rows.select("node", "n", "least", "parity").mapInArrow(thrifty_map(pick), "key bigint, place bigint, node bigint, n bigint, parity binary")
    members = members.join(large, "key", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = stage(members, "simhash-members")
    mixed = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("times")).where("a != b")
    sides = mixed.select("key", F.ceil(F.col("times") / BLOCK).alias("sides"))
    dealt = members.join(sides, "key").withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")))
    dealt = dealt.select("*", F.explode(F.expr("sequence(0L, sides - 1)")).alias("other")).withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")})
    dealt = dealt.select("key", "lo", "hi", "side", "place", "node", "n", "root", "parity")
    return dealt.groupBy("key", "lo", "hi").applyInArrow(thrifty_group(look), "u bigint, v bigint").distinct()


def allowed(rows: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` without those whose smallest shingles differ in more than the similarity allows."""
    share = Fraction(str(similarity))

    def common(x, y):
        """Values of ``x`` that are in ``y``; both are sorted."""
        return np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x) if len(y) else 0

    def allow(batches):
        for b in batches:
            keep = []
            for n, x, m, y in zip(b["n"].to_pylist(), b["x"], b["m"].to_pylist(), b["y"], strict=True):
                x, y = (a.values.to_numpy().view(np.uint32) for a in (x, y))
                top = min(x[-1], y[-1])
                x, y = x[:np.searchsorted(x, top)], y[:np.searchsorted(y, top)]
                most = min(n - len(x) + common(x, y), m - len(y) + common(y, x))
                keep.append(bool(most * (share.numerator + share.denominator) >= (n + m) * share.numerator))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # upper halves of the hashes: equal halves of different hashes can only let a pair through
    short = rows.select("node", "n", F.expr("transform(least, h -> cast(shiftright(h, 32) as int))").alias("x"))
    asked = pairs.join(short.withColumnRenamed("node", "u"), "u").join(short.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("x").alias("y")), "v")
    return asked.select("u", "v", "n", "x", "m", "y").mapInArrow(thrifty_map(allow), "u bigint, v bigint")


def verified(docs: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``pairs`` whose whole shingle sets have the similarity."""
    share = Fraction(str(similarity))
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["node"], pa.array([shingle_set(t.as_py(), size).tobytes() for t in b["text"]], pa.binary())], names=["node", "hashes"])

    def verify(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["a"], b["b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * share.denominator >= (len(x) + len(y) - both) * share.numerator)
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select("node", "text").join(asked, "node", "left_semi").dropDuplicates(["node"])
    known = stage(texts.mapInArrow(thrifty_map(sets), "node bigint, hashes binary"), "simhash-sets")
    both = pairs.join(known.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(known.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(thrifty_map(verify), "u bigint, v bigint")


def similar_nodes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``u, v`` with u > v: nodes (of ``keyed`` documents) whose shingle sets have at least the Jaccard ``similarity``, as far as other links do not join them."""
    rows = smallest(docs, size, similarity)
    met = stage(candidates(rows, similarity), "simhash-met")
    pairs = stage(allowed(rows, met.where("v is not null"), similarity), "simhash-pairs")
    large = met.where("v is null").select(F.col("u").alias("key"))
    if large.isEmpty():
        return verified(docs, pairs, size, similarity)
    links_ = stage(verified(docs, pairs, size, similarity), "simhash-links")
    more = stage(allowed(rows, rest_pairs(rows, large, components(links_), similarity), similarity), "simhash-pairs")
    return links_ if more.isEmpty() else links_.union(verified(docs, more, size, similarity))


def one_of_each(docs: DataFrame, size: int = 3, similarity: float | None = None) -> DataFrame:
    """Documents without their near-duplicates: the smallest doc_id of each class stays, once; rows without doc_id stay.

    Classes are those of ``near_duplicates``, or, with a ``similarity``, of texts linked by that similarity of their shingle sets.
    """
    if similarity is None:
        kept = near_duplicates(docs, size).where("doc_id = component_id").select("doc_id").distinct()
        return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null")).select(docs.columns)
    node = free_name(docs, "node")
    named = keyed(docs.where("doc_id is not null"), node)
    nodes = stage(named.groupBy(F.col(node).alias("node")).agg(F.min("doc_id").alias("doc_id")), "simhash-nodes")
    roots = components(similar_nodes(named.select(F.col(node).alias("node"), "text"), size, similarity))
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("doc_id", "node")).alias("kept"))
    kept = kept.select("kept.doc_id", F.col("kept.node").alias(node))
    # a doc_id with several texts keeps those that lead a class each
    return named.join(kept, ["doc_id", node], "left_semi").dropDuplicates(["doc_id", node]).select(docs.columns).unionByName(docs.where("doc_id is null"))


@register("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
