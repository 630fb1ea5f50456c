"""Conversation prefix trie: every sequence of first turns is a node, and SQL ROLLUP aggregates all prefixes together.

A turn id is a digest of role and text with the text's length behind it. Conversations are laid out in blocks of ``BLOCK`` positional turn-id columns; a
block's key is the node that the block before it ended in, so ``GROUP BY block, base, ROLLUP(t1, ..., t8)`` over all blocks at once gives every
node of the trie, and ``grouping_id`` tells which columns are rolled up. A node's name is the sum of its turns' hashes by position (four lanes of 32 bits),
which blocks of one conversation can add up in any order: a running sum over its blocks names their bases without walking it turn by turn.

A node belongs to the smallest conversation in it. What a subtree holds below the end of a block is therefore the sum, over the conversations that go on, of what
they own further down: a second ROLLUP over the nodes, with that sum added where a block ends, gives all subtree totals. No step runs once a level.

What moves: texts once (to sort turns), then turn ids. Positions and running sums are taken in key ranges, with one carried row for each range
that starts inside a conversation, so a conversation of any length is spread over tasks. Counts are aggregated before they are shuffled; parents with very many
children are looked up from a broadcast table of at most ``HOT_ROWS`` rows. The digest of a node's last members reads their ids packed into pieces.

Defined results: a null role or text is empty; a null turn comes first; rows of equal turn follow each other by role, then text; repeated rows are turns of their
own; rows with a null conv_id are left out; other columns are ignored; an empty table has no members and gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lullwatch.llm.common import partitions, register, stage, table, thrifty_map

BLOCK = 8
HOT_ROWS = 100_000
HOT_LEAST = 1000
PIECE = 1 << 16

COLUMNS = [f"t{k}" for k in range(1, BLOCK + 1)]
LANES = ["a", "b", "c", "d"]


def mixed(turn: str, position: str) -> dict[str, str]:
    """SQL of the four lanes that a turn adds to the name of its node; nothing where there is no turn."""
    halves = (f"xxhash64({turn}, cast({position} as bigint))", f"xxhash64(cast({position} as bigint), {turn})")
    parts = [p for h in halves for p in (f"{h} & 4294967295L", f"shiftrightunsigned({h}, 32)")]
    return {lane: f"if({turn} is null, 0L, {p})" for lane, p in zip(LANES, parts, strict=True)}


def name_of(lanes: dict[str, str]) -> str:
    return "concat_ws('-', " + ", ".join(f"hex({lanes[x]})" for x in LANES) + ")"


def turn_id(role: str = "role", text: str = "text") -> Column:
    return F.expr(f"concat(md5(cast(concat(octet_length({role}), ':', {role}, {text}) as binary)), ':', octet_length({text}))")


def ordered_sums(df: DataFrame, key: str, order: list[Column], values: list[str], keep: list[str], name: str) -> DataFrame:
    """``keep`` and, for each of ``values``, ``before_<value>``: the sum over the rows of the same ``key`` that come before in ``order``.

    Rows are dealt to ranges of key and order. Only the key a range starts with can have rows in ranges before it, so what is carried over is one row
    for a range and key, at most two for each range.
    """
    spark = df.sparkSession
    held = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType([*held, *(T.StructField(f"before_{v}", T.LongType()) for v in values), T.StructField("part", T.IntegerType()), T.StructField("edge", T.BooleanType()),
                           *(T.StructField(f"own_{v}", T.LongType()) for v in values)])

    def scan(batches):
        from pyspark import TaskContext

        part, first, last = TaskContext.get().partitionId(), None, None
        run, offset = [0] * len(values), [0] * len(values)
        for b in batches:
            k = b[key].to_numpy(zero_copy_only=False)
            if not len(k):
                continue
            first = k[0] if first is None else first
            new = np.concatenate(([last is None or k[0] != last], k[1:] != k[:-1]))
            group, last = np.cumsum(new), k[-1]
            before, own = [], []
            for i, v in enumerate(values):
                x = b[v].to_numpy(zero_copy_only=False)
                past = run[i] + np.cumsum(x) - x
                starts = np.concatenate(([offset[i]], past[new]))
                before.append(pa.array(past - starts[group], pa.int64()))
                own.append(pa.array(x, pa.int64()))
                run[i], offset[i] = int(past[-1] + x[-1]), int(starts[-1])
            yield pa.RecordBatch.from_arrays([*(b[f.name] for f in held), *before, pa.array(np.full(len(k), part, np.int32)), pa.array(k == first), *own],
                                             names=[f.name for f in schema.fields])

    dealt = df.repartitionByRange(partitions(spark), F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    staged = stage(dealt.select(list(dict.fromkeys([*keep, key, *values]))).mapInArrow(thrifty_map(scan), schema), name)
    begun = staged.where("edge").select(key).distinct()
    totals = staged.join(F.broadcast(begun), key).groupBy(key, "part").agg(*(F.sum(f"own_{v}").alias(v) for v in values))
    upto = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "part", *(F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(f"carried_{v}") for v in values))
    joined = staged.join(F.broadcast(carried), [key, "part"], "left")
    return joined.select(*keep, *((F.col(f"before_{v}") + F.coalesce(f"carried_{v}", F.lit(0))).alias(f"before_{v}") for v in values))


def number_turns(conversations: DataFrame) -> DataFrame:
    """``conv, pos, turn_id``: the turns of every conversation in order, numbered from 1."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv", "turn", "role", "text", turn_id().alias("turn_id"), F.lit(1).cast("bigint").alias("one"))
    numbered = ordered_sums(rows, "conv", [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], ["one"], ["conv", "turn_id"], "trie-turns")
    return numbered.select("conv", (F.col("before_one") + 1).alias("pos"), "turn_id")


def member_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` from ``node, conv``: digest of the ascending ids, joined by commas.

    Ids are packed into pieces in key ranges; the digest of a node then reads pieces, so a node that very many conversations end in is some long strings.
    """
    def packed(batches):
        node, first, ids, size = None, None, [], 0
        for b in batches:
            rows = []
            for n, c in zip(b["node"].to_pylist(), b["conv"].to_pylist(), strict=True):
                if ids and (n != node or size >= PIECE):
                    rows.append((node, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    node, first = n, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield as_batch(rows)
        if ids:
            yield as_batch([(node, first, ",".join(ids))])

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["node", "first", "ids"])

    def digested(batches):
        node, state = None, None
        for b in batches:
            out = {"node": [], "ends_sha256": []}
            for n, ids in zip(b["node"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if n != node:
                    if node is not None:
                        out["node"].append(node)
                        out["ends_sha256"].append(state.hexdigest())
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict(out, schema=layout)
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]}, schema=layout)

    layout = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])
    n = partitions(ends.sparkSession)
    pieces = ends.repartitionByRange(n, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(thrifty_map(packed), "node string, first bigint, ids string")
    return pieces.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(thrifty_map(digested), "node string, ends_sha256 string")


def rolled(rows: DataFrame, measures: str) -> DataFrame:
    """The ROLLUP of ``measures`` over the positional columns: one row for every prefix that is a node, with its ``depth``, ``node`` and ``parent``."""
    ids = ", ".join(COLUMNS)
    every = rows.sparkSession.sql(f"SELECT block, a, b, c, d, {ids}, {measures}, {BLOCK} - cast(bit_count(grouping_id()) as int) AS level "
                                  f"FROM {{rows}} GROUP BY block, a, b, c, d, ROLLUP({ids})", rows=rows)
    # a prefix that some conversations end in is also grouped with its missing turns as values: only the rolled-up row counts
    last = f"element_at(array({ids}), level)"
    nodes = every.where(f"if(level = 0, block = 0, {last.replace('level', 'greatest(level, 1)')} is not null)")
    nodes = nodes.withColumn("depth", F.expr(f"block * {BLOCK} + level")).withColumn("last", F.expr(f"if(level = 0, null, element_at(array({ids}), greatest(level, 1)))"))
    adds = [mixed(t, f"block * {BLOCK} + {k}") for k, t in enumerate(COLUMNS, 1)]
    here = {x: " + ".join([x, *(add[x] for add in adds)]) for x in LANES}
    nodes = nodes.withColumns({f"at_{x}": F.expr(here[x]) for x in LANES})
    own = mixed("last", "depth")
    return (nodes.withColumn("node", F.expr(name_of({x: f"at_{x}" for x in LANES})))
            .withColumn("parent", F.expr(f"if(depth = 0, null, {name_of({x: f'(at_{x} - {own[x]})' for x in LANES})})")).drop("level", *(f"at_{x}" for x in LANES)))


def trie(turns: DataFrame, order: str, conversations: DataFrame | None = None) -> DataFrame:
    """The nodes of the trie of ``turns`` (``conv, turn_id`` and the column ``order``, distinct within a conversation).

    ``conversations``: one row per ``conv`` where some have no turn at all. Result: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, node, parent``; saved tokens are UTF-8 bytes of texts that further members share.
    """
    one = turns.select("conv", "turn_id", F.col(order).alias("order"), F.lit(1).cast("bigint").alias("one"))
    numbered = ordered_sums(one, "conv", [F.col("order")], ["one"], ["conv", "turn_id"], "trie-order").withColumnRenamed("before_one", "at")
    lanes = mixed("turn_id", "at + 1")
    cells = numbered.select("conv", "turn_id", F.expr(f"at div {BLOCK}").alias("block"), F.expr(f"at % {BLOCK}").alias("slot"), *(F.expr(lanes[x]).alias(x) for x in LANES))
    if conversations is not None:
        cells = cells.unionByName(conversations.select("conv", F.lit(0).cast("bigint").alias("block")), allowMissingColumns=True)
    pivot = [F.max(F.when(F.col("slot") == k, F.col("turn_id"))).alias(t) for k, t in enumerate(COLUMNS)]
    laid = cells.groupBy("conv", "block").agg(*pivot, *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in LANES))
    own = [f"own_{x}" for x in LANES]
    laid = laid.withColumnsRenamed(dict(zip(LANES, own, strict=True)))
    based = ordered_sums(laid, "conv", [F.col("block")], own, ["conv", "block", *COLUMNS, *own], "trie-blocks")
    blocks = based.withColumnsRenamed({f"before_{o}": x for o, x in zip(own, LANES, strict=True)})

    nodes = rolled(blocks, "count(*) AS n_convs, min(conv) AS conv_id")
    nodes = nodes.withColumn("own", F.expr("coalesce((n_convs - 1) * cast(substring(last, 34) as bigint), 0)")).drop("last")
    nodes = stage(nodes, "trie-nodes")
    reach = blocks.groupBy("conv").agg(F.max(F.struct("block", *(F.expr(f"{x} + own_{x}").alias(x) for x in LANES))).alias("e"))
    ends = member_digests(reach.select(F.expr(name_of({x: f"e.{x}" for x in LANES})).alias("node"), "conv"))
    seen = nodes.where("parent is not null").select(F.col("parent").alias("node"), F.lit(1).cast("bigint").alias("child"), F.lit(None).cast("string").alias("ends_sha256"))
    seen = seen.unionByName(ends.withColumn("child", F.lit(0).cast("bigint"))).groupBy("node").agg(F.sum("child").alias("n_children"), F.max("ends_sha256").alias("ends_sha256"))
    full = stage(nodes.join(seen, "node"), "trie-counted").withColumn("leaf", F.expr("if(n_children = 0, 1L, 0L)"))

    # what conversations own behind the end of a block, at the node the block ends in
    owned = full.where(f"depth > {BLOCK}").groupBy(F.col("conv_id").alias("conv"), F.expr(f"(depth - 1) div {BLOCK}").alias("block")).agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    later = blocks.where("block > 0").select("conv", "block", F.expr(name_of({x: x for x in LANES})).alias("node")).unionByName(owned, allowMissingColumns=True)
    later = later.groupBy("conv", "block").agg(F.max("node").alias("node"), F.coalesce(F.sum("own"), F.lit(0)).alias("own"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaf"))
    later = ordered_sums(later, "conv", [F.desc("block")], ["own", "leaf"], ["conv", "node", "own", "leaf"], "trie-later")
    below = later.groupBy("node").agg(F.sum(F.expr("before_own + own")).alias("below_own"), F.sum(F.expr("before_leaf + leaf")).alias("below_leaf"))
    weighed = full.join(below, "node", "left").select("block", *LANES, *COLUMNS, F.expr("own + coalesce(below_own, 0)").alias("own"), F.expr("leaf + coalesce(below_leaf, 0)").alias("leaf"))
    sums = rolled(weighed, "sum(own) AS saved_tokens, sum(leaf) AS n_leaves").select("node", "saved_tokens", "n_leaves")

    hot = max(HOT_LEAST, full.count() // HOT_ROWS)
    parents = full.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many, few = F.broadcast(parents.where(f"n_children > {hot}").drop("n_children")), parents.where(f"n_children <= {hot}").drop("n_children")
    plain = full.drop("block", *LANES, *COLUMNS, "own", "leaf")
    known = plain.join(many, "parent").unionByName(plain.join(many, "parent", "left_anti").join(few, "parent", "left"))
    return known.join(sums, "node").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node", "parent")


EMPTY = hashlib.sha256(b"").hexdigest()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    return trie(number_turns(conversations), "pos").fillna(EMPTY, ["ends_sha256"])


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start alike: the first turns of the first of five neighbours, then their own. Turns (``conv, turn_id, order``) and all ``conv``."""
    head = F.expr("crc32(cast(cast(conv as string) as binary)) % 9")
    convs = numbered.where("pos = 1").select("conv", F.expr("conv - conv % 5").alias("base"), head.alias("h"))
    heads = numbered.where("pos <= 8").select(F.col("conv").alias("base"), "pos", "turn_id")
    firsts = convs.join(heads, "base").where("pos <= h").select("conv", "turn_id", F.col("pos").alias("order"))
    own = numbered.where(F.col("pos") > head).select("conv", "turn_id", (F.col("pos") + 8).alias("order"))
    return firsts.union(own), convs.select("conv")


# CRC-32 of a string of ASCII digits in SQL: reflected polynomial, eight shifts a byte
CRC = ("xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({0}, ''), lambda x: ascii(x)::UBIGINT)), "
       "lambda s, x: list_reduce(list_concat([xor(s, x)], range(8)::UBIGINT[]), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))))")

ORACLE = f"""
WITH n AS (SELECT CAST(conv_id AS BIGINT) AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                  {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv, list(turn ORDER BY pos) AS turns, {CRC.format("CAST(conv AS VARCHAR)")} % 9 AS h FROM n GROUP BY conv),
whole AS (SELECT o.conv, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns FROM own o LEFT JOIN own b ON b.conv = o.conv - o.conv % 5),
steps AS (SELECT conv, d, len(turns) AS n, turns[1:d] AS path FROM whole, unnest(range(len(turns) + 1)) AS u(d)),
nodes AS (SELECT path, d AS depth, min(conv) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv, ',' ORDER BY conv) FILTER (n = d), '') AS ends,
                 (count(*) - 1) * coalesce(octet_length(encode(path[d].t)), 0) AS own FROM steps GROUP BY path, d),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
sums AS (SELECT path[1:d] AS path, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM full_nodes, unnest(range(depth + 1)) AS u(d) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN sums s USING (path) LEFT JOIN nodes p ON f.depth > 0 AND p.path = f.path[1:f.depth - 1]
"""


@register("op12_prefix_trie", ORACLE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = rebuilt(number_turns(table(spark, sf_dir, "conversations")))
    nodes = trie(turns, "order", convs).fillna(EMPTY, ["ends_sha256"])
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
