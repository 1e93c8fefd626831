"""Prefix trie of conversations by Spark SQL ROLLUP over positional turn columns.

A turn is its role and text; a 128-bit digest of both is its id. A block of a conversation is one row with the ids of up to
``WIDTHS`` turns as columns p1, p2, ... and the node of the trie where the block begins. ``GROUP BY node, ROLLUP (p1, p2,
...)`` gives all nodes of the block at once; grouping_id tells their depth, and a prefix that is longer than the
conversation shows as a null in the last column of its group. A node is named by its depth and its smallest member, so the
next block is keyed by a number.

Conversations that share no more than their whole rest with the others of their node leave the loop: their tail is a path
with the same members all along, read directly from the turns. The number of rounds so depends on how deep conversations
still part, not on how long they are. The equal rest is known from two 64-bit sums over (position, id).

Sums over subtrees come from a second ROLLUP over the same rows. The smallest member of a node is the smallest of
every deeper node on its way, so a conversation owns the nodes of its way from some depth on. Words that its turns save are
those before that depth: a node saves the sum of these over its members other than the owner, less what lies above it.

No conversation is held in one row, and none is ordered in one task: turns are range-partitioned by (conversation, turn), and
positions and running sums inside a piece are completed by what stands in earlier pieces. Members that end at a node
are hashed in order from pieces of text that tasks have joined before, in constant memory.

A null role or text counts as empty. Turns are ordered by turn number, null first; equal turn numbers by the digest of role
and text; repeated rows are repeated turns. Rows with a null conversation id take no part. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from riskloom.session import cut_lineage

#: Turn columns of the first block and of all later ones. Later blocks have few rows, which ROLLUP expands width + 1 times.
WIDTHS = (8, 32)
_NOTHING = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums within each key, in the given order; a key may hold any share of the rows.

    Rows are range-partitioned by (key, order). Windows end at the border of a piece; what earlier pieces hold of
    the key is added. Only keys that reach over a border need that, at most two for each piece, so the table is broadcast.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(df.select("*", *[e.cast("long").alias(f"__{n}") for n, e in sums.items()])
                       .repartitionByRange(pieces, F.col(key), *order).withColumn("__piece", F.spark_partition_id()))
    totals = rows.groupBy(key, "__piece").agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
    crossing = totals.groupBy(key).agg(F.count(F.lit(1)).alias("__k")).filter("__k > 1").select(key)
    before = Window.partitionBy(key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut_lineage(totals.join(crossing, key).select(
        key, "__piece", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums]))
    inside = Window.partitionBy(key, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(carried), [key, "__piece"], "left")
    return out.select(*df.columns, *[(F.sum(f"__{n}").over(inside) + F.coalesce(f"__b_{n}", F.lit(0))).alias(n) for n in sums])


def turns(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, pos (from 1), id (digest of role and text), words."""
    said, who = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = df.select(
        F.col(conversation).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary"))).alias("id"),
        F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).filter("conv is not null")
    return running(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("id")], {"pos": F.lit(1)}).drop("turn")


def with_prefix_of(rows: DataFrame, base: Column, length: Column) -> tuple[DataFrame, DataFrame]:
    """Replace the first ``length`` turns of every conversation by those of the conversation ``base`` (fewer, if it has fewer).

    Both are expressions of ``conv``. Returns the turns and the conversations (conv), of which some may have no turn left.
    """
    sizes = cut_lineage(rows.groupBy("conv").agg(F.max("pos").alias("n")))
    wanted = sizes.select("conv", base.alias("base"), length.cast("long").alias("h"))
    have = sizes.select(F.col("conv").alias("base"), F.col("n").alias("m"))
    shift = (wanted.join(have, "base", "left").select("conv", (F.least("h", F.coalesce("m", F.lit(0))) - F.col("h")).alias("shift"))
             .filter("shift <> 0"))
    own = rows.filter(F.col("pos") > length).join(shift, "conv", "left").select(
        "conv", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "id", "words")
    first = (wanted.filter("h > 0").join(rows.withColumnRenamed("conv", "base"), "base").filter("pos <= h")
             .select("conv", "pos", "id", "words"))
    return own.unionByName(first), sizes.select("conv")


def _columns(width: int) -> list[str]:
    return [f"p{j}" for j in range(1, width + 1)]


def _rollup(wide: DataFrame, width: int, values: str) -> DataFrame:
    """One row for each prefix of the block that a conversation has: node, level, path (its ids joined), and ``values``."""
    names = _columns(width)
    grouped = wide.sparkSession.sql(
        f"SELECT node, {width} - bit_count(grouping_id()) AS level, {', '.join(names)}, {values} FROM {{wide}} "
        f"GROUP BY node, ROLLUP ({', '.join(names)})", wide=wide)
    held = " + ".join(f"int({p} is not null)" for p in names)
    path = "concat(" + ", ".join(f"coalesce({p}, x'')" for p in names) + ")"
    return grouped.filter(f"level = {held}").withColumn("path", F.expr(path)).drop(*names)


def _key(path: Column | str) -> Column:
    """Name of a node inside a round: digest of the block's first node and the path from it."""
    return F.unhex(F.md5(F.concat(F.col("node").cast("string").cast("binary"), F.lit(b":"), F.col(path) if isinstance(path, str) else path)))


def _round(alive: DataFrame, rest: DataFrame, start: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One block. ``alive``: conv, node, len, y1, y2 (sums over what follows ``start``); ``rest``: the turns of these
    conversations. Returns the block's rows, its nodes, and for each conversation where it went."""
    inside = rest.filter(F.col("pos").between(start + 1, start + width))
    block = inside.groupBy("conv").agg(
        *[F.max(F.when(F.col("pos") == start + j, F.col("id"))).alias(p) for j, p in enumerate(_columns(width), 1)],
        F.bit_xor("y1").alias("b1"), F.bit_xor("y2").alias("b2"))
    xor = lambda y, b: F.col(y).bitwiseXOR(F.coalesce(b, F.lit(0)))
    wide = cut_lineage(alive.join(block, "conv", "left").withColumns({"y1": xor("y1", "b1"), "y2": xor("y2", "b2")}).drop("b1", "b2"))
    found = _rollup(wide, width, "min(conv) AS conv_id, count(*) AS n, min(y1) AS l1, max(y1) AS g1, min(y2) AS l2, "
                                 "max(y2) AS g2, min(len) AS l, max(len) AS g")
    found = found.filter("level > 0" if start else "true").select(
        "node", "level", "conv_id", "n", _key("path").alias("key"),
        _key(F.expr("substring(path, 1, 16 * (level - 1))")).alias("parent_key"),
        (F.col("level").eqNullSafe(width) & F.expr("l1 = g1 AND l2 = g2 AND l = g")).alias("alike"))
    found = cut_lineage(found)
    parents = found.filter("level > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    nodes = found.join(parents, "parent_key", "left").select(
        "conv_id", (F.col("level") + start).alias("depth"), "n",
        F.when(F.col("level") == 1, F.col("node")).when(F.col("level") > 1, F.col("parent")).alias("parent"))
    # Where each conversation stands at the end of the block: the node of its last turn here.
    last = F.concat(*[F.coalesce(p, F.lit(b"")) for p in _columns(width)])
    went = (wide.select("conv", "len", "y1", "y2", _key(last).alias("key"))
            .join(found.select("key", F.col("conv_id").alias("node"), "n", "alike"), "key").drop("key"))
    return wide, cut_lineage(nodes), cut_lineage(went)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the ids of each run of one node in a batch of rows sorted by (conv_id, depth, conv)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node, depth, conv = (batch.column(i).to_numpy() for i in range(3))
        cut = np.flatnonzero((np.diff(node) != 0) | (np.diff(depth) != 0)) + 1
        at = np.concatenate(([0], cut, [len(node)]))
        said = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(node[at[:-1]]), pa.array(depth[at[:-1]]), pa.array(conv[at[:-1]]), pa.array(said)],
                                         names=["conv_id", "depth", "first", "said"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each node, from rows sorted by (conv_id, depth, first)."""
    now, state = None, None

    def done(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.string())], names=["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        out = []
        for node, depth, said in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (node, depth) == now:
                state.update(b"," + said.encode())
                continue
            if now is not None:
                out.append((*now, state.hexdigest()))
            now, state = (node, depth), hashlib.sha256(said.encode())
        yield done(out)
    if now is not None:
        yield done([(*now, state.hexdigest())])


def ends_digest(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 from the rows (conv_id, depth, conv) of members that end at a node."""
    long = lambda *names: [StructField(n, LongType()) for n in names]
    pieces = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["conv_id", "depth", "conv"]
    chunks = ends.select(*by).repartitionByRange(pieces, *by).sortWithinPartitions(*by).mapInArrow(
        _chunks, StructType([*long("conv_id", "depth", "first"), StructField("said", StringType())]))
    return chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(
        _hashes, StructType([*long("conv_id", "depth"), StructField("ends_sha256", StringType())]))


def prefix_trie(rows: DataFrame, conversations: DataFrame | None = None, widths: tuple[int, int] = WIDTHS) -> DataFrame:
    """All nodes of the trie of ``rows`` (conv, pos from 1 without gaps, id, words).

    ``conversations`` (conv) may name further ones, without turns. Returns conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows = running(rows, "conv", [F.col("pos")], {"upto": F.col("words")}).withColumns({
        "y1": F.xxhash64("pos", "id"), "y2": F.xxhash64("id", "pos", F.lit(1))})
    rows = cut_lineage(rows)
    own = rows.groupBy("conv").agg(F.max("pos").alias("len"), F.max("upto").alias("total"), F.bit_xor("y1").alias("y1"), F.bit_xor("y2").alias("y2"))
    names = own.select("conv") if conversations is None else conversations.select("conv").distinct()
    convs = cut_lineage(names.join(own, "conv", "left").na.fill(0, ["len", "total", "y1", "y2"]))
    least = convs.agg(F.min("conv")).first()[0]  # names the root
    alive = convs.select("conv", F.lit(least).cast("long").alias("node"), "len", "y1", "y2")
    rest, start, width = rows.select("conv", "pos", "id", "y1", "y2"), 0, widths[0]
    blocks, nodes, ends = [], [], []
    while True:
        wide, found, went = _round(alive, rest, start, width)
        start += width
        blocks.append((wide, start - width, width))
        nodes.append(found)
        over = F.col("len") > start
        ends.append(went.filter(~over | F.col("alike")).select(F.col("node").alias("conv_id"), F.col("len").alias("depth"), "conv"))
        paths = went.filter(over & F.col("alike") & (F.col("conv") == F.col("node"))).select("conv", "n")
        nodes.append(rows.filter(F.col("pos") > start).join(paths, "conv").select(
            F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), "n", F.col("conv").alias("parent")))
        alive = went.filter(over & ~F.col("alike")).select("conv", "node", "len", "y1", "y2")
        if not alive.limit(1).count():
            break
        rest = cut_lineage(rest.filter(F.col("pos") > start).join(alive.select("conv"), "conv", "left_semi"))
        width = widths[1]
    every = _union(nodes)
    if len(nodes) > 2:
        every = cut_lineage(every)
    ended = ends_digest(_union(ends))

    # What each conversation owns: the nodes of its way from some depth on, and the words before that.
    children = every.filter("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    owned = every.filter("depth > 0").groupBy(F.col("conv_id").alias("conv")).agg(F.count(F.lit(1)).alias("owned"))
    depths = convs.select("conv", "len").join(owned, "conv", "left").select(
        "conv", "len", F.coalesce("owned", F.lit(0)).alias("owned"), (F.col("len") - F.coalesce("owned", F.lit(0))).alias("pos"))
    shared = depths.join(rows.select("conv", "pos", "upto"), ["conv", "pos"], "left")
    inner = children.select(F.col("conv_id").alias("conv"), F.col("depth").alias("len"), F.lit(True).alias("inner"))
    shared = cut_lineage(shared.join(inner, ["conv", "len"], "left").select(
        "conv", F.coalesce("upto", F.lit(0)).alias("a"), ((F.col("owned") > 0) & F.col("inner").isNull()).cast("long").alias("leaf")))
    sums = [_rollup(wide.join(shared, "conv"), k, "min(struct(conv, a)) AS owner, sum(a) AS a, sum(leaf) AS leaves")
            .select(F.col("owner.conv").alias("conv_id"), (F.col("level") + at).alias("depth"), "leaves",
                    (F.col("a") - F.col("owner.a")).alias("others"))
            .filter(F.col("depth") > at if at else F.lit(True)) for wide, at, k in blocks]
    # One row for each node from the parts that know something about it.
    parts = [every.select("conv_id", "depth", "n", "parent"), children, ended, _union(sums),
             rows.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), "words", "upto")]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part.withColumn("depth", F.col("depth").cast("long")), allowMissingColumns=True)
    fields = ["n", "parent", "n_children", "ends_sha256", "leaves", "others", "words", "upto"]
    merged = merged.groupBy("conv_id", "depth").agg(*[F.max(c).alias(c) for c in fields]).filter("n is not null")
    merged = merged.join(convs.select(F.col("conv").alias("conv_id"), "total"), "conv_id")
    above = F.coalesce(F.col("upto") - F.col("words"), F.lit(0))
    others = F.coalesce("others", (F.col("n") - 1) * F.col("total"))  # of a tail all members are alike
    return merged.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.greatest(F.coalesce("leaves", F.lit(1)), F.lit(1)).cast("long").alias("n_leaves"),
        (others - (F.col("n") - 1) * above).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].withColumn("depth", F.col("depth").cast("long"))
    for one in frames[1:]:
        out = out.unionByName(one.withColumn("depth", F.col("depth").cast("long")))
    return out
