"""Conversation prefix trie by van Emde Boas recursion: sequences cut at half depth, prefixes named, totals grafted upward."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

#: A conversation shares up to HEADS - 1 of its first turns with the first conversation of its FAMILY.
FAMILY, HEADS = 100, 6


def _salted(*of: Column) -> list[Column]:
    """Two independent 64-bit digests of the columns."""
    return [F.xxhash64(F.lit(k), *of).alias(f"x{k}") for k in (1, 2)]


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, x1, x2, len): the turns of each conversation by place from 1, as digests of (role, text).

    Turns are sorted over all conversations at once, by ranges, and counted up within a range; only the counts of ranges
    run up along a conversation, so that one that holds a large part of all turns is spread over tasks too. The order is
    that of turn, null first; equal turns go by the first 64 characters of role and text, then by digest. A repeated row is
    a turn of its own. Rows without conv_id are left out.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), *_salted(role, text), F.length(text).cast("long").alias("len"), F.substring(role, 1, 64).alias("r"), F.substring(text, 1, 64).alias("t"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), *(F.col(c).asc() for c in ("r", "t", "x1", "x2"))]
    ranges = stored(slim.orderBy(*order).select("conv_id", "turn", "r", "t", "x1", "x2", "len", F.spark_partition_id().alias("range")))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(ranges.groupBy("conv_id", "range").count().select("conv_id", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")))
    within = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    rows = ranges.withColumn("within", within).join(counts, ["conv_id", "range"])
    return rows.select("conv_id", (F.col("before") + F.col("within")).alias("pos"), "x1", "x2", "len")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, x1, x2, len), the turns of the rebuilt conversations, and (conv_id, n), their numbers of turns.

    Conversation c starts with the first h turns of conversation c - c % FAMILY, all if there are fewer and none if there
    is no such conversation, h = crc32(c in decimal) % HEADS; then come its own turns after its first h."""
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("long")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("of_base", F.lit(0).cast("long"))))
    convs = stored(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n")))
    heads = turns.where(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("pos <= h")
    tails = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("pos > h")
    columns = ("x1", "x2", "len")
    rows = heads.select("conv_id", F.col("pos").alias("depth"), *columns).union(tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), *columns))
    return rows, convs.select("conv_id", "n")


def _power(most: int) -> int:
    """The least power of two above most."""
    return 1 << max(1, int(most).bit_length())


def prefix_names(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, n1, n2, len): a name for each first `depth` turns of each conversation (conv_id, depth, x1, x2,
    len); names are equal where the turns are, n1 and n2 are 64 bits each. lengths has (conv_id, n).

    The recursion cuts a problem of 2B levels below depth o at o + B and names what it cuts off by (name of depth o, turns
    o + 1 to o + B); above and below are problems of B levels. Depth d is cut once, with B its lowest bit and o = d - B.
    As names are digests, no level waits for another: all blocks of turns are digested in one aggregation, and the blocks
    that lead from the root to a depth (its bits, the highest first) are gathered into its name in a second. Both combine
    before the shuffle by exclusive or of digests that are salted with their place, so no conversation is held whole.
    """
    depth, low = F.col("depth"), F.expr("shiftleft(1L, k)")
    longest = turns.agg(F.max("depth")).first()[0] or 0
    bits = _power(longest).bit_length()
    block_end = (F.floor((depth - 1) / low) + 1) * low  # of the block of 2^k turns that this one lies in
    parts = turns.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).withColumn("end", block_end).where(F.expr("(end div shiftleft(1L, k)) % 2 = 1"))
    xor = lambda *of: [F.bit_xor(c).alias(f"{name}") for c, name in zip(_salted(*of), ("b1", "b2"))]
    blocks = parts.groupBy("conv_id", F.col("end").alias("cut"), "k").agg(*xor("depth", "x1", "x2"), F.max(F.when(depth == F.col("end"), F.col("len"))).alias("len"))
    blocks = blocks.join(lengths, "conv_id").where("cut <= n")
    reach = blocks.withColumn("depth", F.explode(F.sequence("cut", F.least(F.col("n"), F.col("cut") + low - 1))))
    return reach.groupBy("conv_id", "depth").agg(*(c.alias(n) for c, n in zip(xor("cut", "b1", "b2"), ("n1", "n2"))), F.max(F.when(F.col("cut") == depth, F.col("len"))).alias("len"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the decimal ids of each node's rows, which come sorted by (node_conv, depth, conv_id)."""
    node, digest = None, None
    for batch in batches:
        done = []
        for a, d, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (a, d) != node:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = (a, d), hashlib.sha256(str(c).encode())
            else:
                digest.update(b",%d" % c)
        yield _digests(done)
    if node:
        yield _digests([(*node, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, d, s = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.string())], names=["conv_id", "depth", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes; ends (node_conv, depth, conv_id) has the conversations that end in each. The
    ids of a node stream through one digest in order, none is kept."""
    dealt = ends.select("node_conv", "depth", "conv_id").repartition("node_conv", "depth").sortWithinPartitions("node_conv", "depth", "conv_id")
    return dealt.mapInArrow(_ends, "conv_id long, depth long, ends_sha256 string")


def grafted(nodes: DataFrame, members: DataFrame, deepest: int) -> DataFrame:
    """nodes (conv_id, depth, parent, leaves, saved) with leaves and saved summed over each node's subtree.

    members has the node (node_conv, depth) of each conversation's first turns. The halves of every problem are totalled
    apart, smallest problems first: at height 2B the trees below the cut at B are complete within the problem, so the sums
    of a cut node's children are grafted on it and on the B - 1 nodes above it in the problem, found along the smallest
    conversation that passes. Heights double, so that rounds grow as the logarithm of the depth; no round's rows are more
    than half the turns of one conversation per node.
    """
    b = 1
    while b < _power(deepest):
        roots = nodes.where((F.col("depth") > b) & (F.col("depth") % (2 * b) == (b + 1) % (2 * b)))
        grafts = roots.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("cut")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        up = grafts.withColumn("depth", F.explode(F.sequence(F.col("cut") - (b - 1), F.col("cut"))))
        more = up.join(members, ["conv_id", "depth"]).groupBy(F.col("node_conv").alias("conv_id"), "depth").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
        zero = F.lit(0).cast("long")
        nodes = stored(nodes.join(more, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent", (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved")))
        b *= 2
    return nodes


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of sequences: turns (conv_id, depth from 1, x1, x2, len), lengths (conv_id, n), n being 0 without turns.

    One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No
    sequences, no rows."""
    names = stored(prefix_names(turns, lengths))
    groups = stored(names.groupBy("depth", "n1", "n2").agg(F.min("conv_id").alias("node_conv"), F.count("*").alias("n_convs"), F.max("len").alias("len")))
    members = stored(names.join(groups.select("depth", "n1", "n2", "node_conv"), ["depth", "n1", "n2"]).select("conv_id", "depth", "node_conv"))
    above = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node_conv").alias("parent"))
    whole = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    top = whole.where("n_convs > 0").first()
    if top is None:
        return lengths.select("conv_id", *(F.lit(None).cast("long").alias(c) for c in _COLUMNS), F.lit(None).cast("string").alias("ends_sha256")).where("false")
    tree = groups.select(F.col("node_conv").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("len")).alias("own"))
    tree = tree.join(above, ["conv_id", "depth"], "left").withColumn("parent", F.when(F.col("depth") == 1, F.lit(top["conv_id"])).otherwise(F.col("parent")))
    tree = stored(tree)
    children = tree.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = stored(tree.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    leaf = (F.col("n_children") == 0).cast("long").alias("leaves")
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    sums = grafted(tree.select("conv_id", "depth", "parent", leaf, F.col("own").alias("saved")), members, deepest)
    all_of = sums.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).first()
    root = whole.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(all_of["n_children"]).alias("n_children"),
        F.lit(all_of["n_leaves"] or 1).cast("long").alias("n_leaves"), F.lit(all_of["saved_tokens"] or 0).cast("long").alias("saved_tokens"),
    )
    rest = tree.join(sums.select("conv_id", "depth", "leaves", "saved"), ["conv_id", "depth"])
    rest = rest.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    last = lengths.withColumnRenamed("n", "depth")
    ends = members.join(last, ["conv_id", "depth"]).select("node_conv", "depth", "conv_id").union(last.where("depth = 0").select(F.lit(top["conv_id"]), "depth", "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return root.union(rest).join(end_digests(ends), ["conv_id", "depth"], "left").select("conv_id", "depth", *_COLUMNS[1:], F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


_COLUMNS = ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """trie of the rebuilt conversations of a table (conv_id, turn, role, text).

    Null roles and texts are empty; rows without conv_id are left out; other columns are ignored. conv_id of a node is its
    smallest member, saved_tokens the code points that its subtree's texts need not be read again for all but one
    member, ends_sha256 the SHA-256 of the ids of the members that end there. An empty table has no nodes, not even a root.
    """
    turns, lengths = rebuilt(stored(placed_turns(conversations)))
    return trie(stored(turns), lengths)


def trie_sql() -> str:
    """DuckDB SQL for prefix_trie over the view conversations; crc32 is built from its table, subtrees from every member path."""
    digits = "[" + ", ".join(str(_crc_entry(i)) for i in range(256)) + "]"
    return rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, own, conv_id - conv_id % {FAMILY} AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, c: xor(a >> 8, {digits}[(xor(a, c) & 255) + 1]))) % {HEADS} AS h
  FROM (SELECT conv_id, count(*) AS own FROM t GROUP BY 1)),
b AS (SELECT h.*, least(h.h, coalesce(o.own, 0)) AS head FROM h LEFT JOIN h o ON o.conv_id = h.base),
r AS (SELECT b.conv_id, pos AS depth, role, text FROM t JOIN b ON b.base = t.conv_id AND pos <= h UNION ALL SELECT conv_id, pos - h + head, role, text FROM t JOIN b USING (conv_id) WHERE pos > h),
n AS (SELECT conv_id, depth, length(text) AS len, md5(string_agg(md5(role) || md5(text), '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS name FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM b),
l AS (SELECT conv_id, max(depth) AS n FROM n GROUP BY 1),
m AS (SELECT n.*, min(conv_id) OVER (PARTITION BY depth, name) AS node, l.n = depth AS last FROM n JOIN l USING (conv_id)),
g AS (SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * max(len) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM m GROUP BY ALL),
p AS (SELECT g.*, m.node AS parent FROM g LEFT JOIN m ON m.conv_id = g.node AND m.depth = g.depth - 1),
c AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
q AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN c USING (node, depth)),
s AS (SELECT m.node, m.depth, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM q JOIN m ON m.conv_id = q.node AND m.depth <= q.depth GROUP BY ALL)
SELECT node AS conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM q JOIN s USING (node, depth)
"""


def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i
