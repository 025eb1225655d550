"""Conversation prefix trie: nodes by prefix sums of hashes, subtree totals by centroid decomposition.

Turns are numbered within their conversation by sorted ranges: a range is numbered locally and shifted by what its first
conversation has in earlier ranges, so that no task holds a conversation. A node is the pair of sums, over the turns of its
path, of the two halves of an MD5 digest of (depth, role, text); sums are taken per block of BLOCK turns and shifted by the
sums of earlier blocks. Texts never leave the scan; nodes are compared by depth and 2 x 64 bits.

Subtree totals: the parent-edge forest (the nodes under the textless root, by first turn) is split recursively. A component's
centroid is the deepest node with more than half of the component under it, and the nodes with more than half under them are
exactly the path from the centroid to the component's top. The totals of what lies under the centroid are added along that
path; then the part above the centroid and the parts under each of its children go on alone, none over half as large. Every
node is in at most log2(n) components, so deep and wide trees are alike. Components of over LIMIT nodes are split by joins: the
size under a node is a sum over its member conversations (each counts the nodes that it is the smallest member of), and the
children under a centroid are read from the paths of its members. Smaller components are split in their tasks, many at once.
The root's totals are the sums over all tops.

Ends: the ids that end at a node are sorted by range, joined to texts of up to CHUNK ids there, and these are hashed one after
the other, so that a node at which a third of all conversations end is never held; single ends are hashed in the aggregate.

Defined cases: rows without a conv_id belong to no conversation and are left out; turns are ordered by turn, null first, ties by
the MD5 digest of role and text; repeated rows are turns of their own; null role or text is empty; a rebuilt conversation without
turns is a member of the root and ends there; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import drop_stored, ship, stored, table

BLOCK = 1024
LIMIT = 100_000
CHUNK = 4096
MODULUS, GROUP = 9, 5
ROOT = hashlib.md5(b"0,0,0").digest()
EMPTY_HASH = hashlib.sha256().hexdigest()


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % MODULUS).cast("long")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, pos from 1, digest, bytes): the original turns of each conversation in order; a stored table."""
    text, role = (F.coalesce(c, F.lit("")) for c in ("text", "role"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv", F.col("turn").asc_nulls_first(), "digest", "_id"]
    ranged = turns.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()), "turns")
    here = W.partitionBy("conv", "_part").orderBy(*order[1:])
    counts = ranged.groupBy("conv", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("conv").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    begun = counts.withColumn("_before", before).where("_before > 0").select(F.col("conv").alias("_c"), F.col("_part").alias("_p"), "_before")
    # one conversation at most has begun before a range: no more rows than ranges
    local = ranged.withColumn("_rn", F.row_number().over(here)).join(F.broadcast(begun), (F.col("conv") == F.col("_c")) & (F.col("_part") == F.col("_p")), "left")
    out = stored(local.select("conv", (F.coalesce("_before", F.lit(0)) + F.col("_rn")).alias("pos"), "digest", "bytes"), "numbered")
    drop_stored(ranged)
    return out


def members(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, parent, conv, depth, bytes, ends) of every turn of every rebuilt conversation, and (conv, size); stored tables."""
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n")).withColumns({"h": head_length(F.col("conv")), "base": F.col("conv") - F.col("conv") % GROUP})
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = stored(convs.select("conv", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "convs")
    own = turns.join(convs.select("conv", "h", "head", "size"), "conv").where("pos > h")
    own = own.select("conv", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "digest", "bytes", "size")
    firsts = turns.where(F.col("pos") < MODULUS).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "digest", "bytes")
    heads = convs.select("conv", "base", "head", "size").join(firsts, "base").where("depth <= head").select("conv", "depth", "digest", "bytes", "size")
    hashed = F.md5(F.concat(F.col("digest"), F.encode(F.col("depth").cast("string"), "UTF-8")))
    half = lambda at: F.conv(F.substring("hash", at, 16), 16, 10).cast("decimal(20,0)")
    rows = own.unionByName(heads).withColumns({"hash": hashed, "block": F.floor((F.col("depth") - 1) / BLOCK)})
    rows = rows.select("conv", "block", "depth", "bytes", "size", half(1).alias("a"), half(17).alias("b"))
    up_to = W.partitionBy("conv", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"s{x}": F.sum(x).over(up_to).cast("decimal(38,0)") for x in "ab"})
    long_ = rows.where(F.col("size") > BLOCK)
    totals = long_.groupBy("conv", "block").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    earlier = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("conv", "block", *(F.coalesce(F.sum(f"t{x}").over(earlier), F.lit(0)).cast("decimal(38,0)").alias(f"t{x}") for x in "ab"))
    shifted = long_.join(totals, ["conv", "block"]).withColumns({f"s{x}": (F.col(f"s{x}") + F.col(f"t{x}")).cast("decimal(38,0)") for x in "ab"}).select(rows.columns)
    rows = rows.where(F.col("size") <= BLOCK).unionByName(shifted)
    key = lambda depth, a, b: F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), a.cast("decimal(38,0)").cast("string"), b.cast("decimal(38,0)").cast("string"))))
    node, parent = key(F.col("depth"), F.col("sa"), F.col("sb")), key(F.col("depth") - 1, F.col("sa") - F.col("a"), F.col("sb") - F.col("b"))
    out = rows.select(node.alias("node"), parent.alias("parent"), "conv", "depth", "bytes", (F.col("depth") == F.col("size")).alias("ends"))
    return stored(out, "members"), convs


def rolled(top: np.ndarray, parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals of values (n, k) in a forest by centroid decomposition. parent: index of a node's parent, -1 for tops;
    top: index of each node's top, itself for tops. All trees and all components of a round go on together."""
    n, total = len(top), np.zeros_like(values)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if n else []
    size = np.ones(n, np.int64)
    for i in reversed(levels):
        i = i[parent[i] >= 0]
        np.add.at(size, parent[i], size[i])
    full, pre, at = size.copy(), np.zeros(n, np.int64), 0
    for i in levels:  # numbers in depth-first order: a subtree is a run of them
        tops, inner = i[parent[i] < 0], i[parent[i] >= 0]
        pre[tops] = at + np.cumsum(full[tops]) - full[tops]
        at += full[tops].sum()
        inner = inner[np.argsort(parent[inner], kind="stable")]
        run = np.cumsum(full[inner]) - full[inner]
        first = np.flatnonzero(np.r_[True, np.diff(parent[inner]) != 0]) if len(inner) else np.zeros(0, np.int64)
        pre[inner] = pre[parent[inner]] + 1 + run - np.repeat(run[first], np.diff(np.r_[first, len(inner)]))
    label, left = top.copy(), np.arange(n)
    centroid = np.full(n, -1)
    while len(left):
        path = left[2 * size[left] > size[label[left]]]
        path = path[np.argsort(depth[path], kind="stable")]
        centroid[label[path]] = path  # the deepest stays
        v = centroid[label[left]]
        below = (pre[left] > pre[v]) & (pre[left] < pre[v] + full[v])
        is_v = left == v
        under = left[below | is_v]
        sums = np.zeros_like(values)
        np.add.at(sums, label[under], values[under])
        total[path] += sums[label[path]]
        above = path[path != centroid[label[path]]]
        size[above] -= size[centroid[label[above]]]
        low, v = left[below], v[below]
        child = low[parent[low] == v]
        child = child[np.lexsort((pre[child], label[child]))]
        keys = label[child] * n + pre[child]
        label[low] = child[np.searchsorted(keys, label[low] * n + pre[low], "right") - 1]
        left = left[~is_v]
    return total


def roll_up_small(nodes: DataFrame) -> DataFrame:
    """(node, leaves, saved) from (comp, node, parent, depth, leaf, own, leaves, saved): whole components, many to a task. What
    leaves and saved hold already is added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            whole = pa.concat_tables(held).combine_chunks()
            comp = whole["comp"]
            cut = whole.num_rows - 1
            last = comp[cut]
            while cut > 0 and comp[cut - 1] == last:
                cut -= 1
            if cut:
                yield rolled_up(whole.slice(0, cut))
            held = [whole.slice(cut)]
        if held and held[0].num_rows:
            yield rolled_up(pa.concat_tables(held))

    def rolled_up(t: pa.Table) -> pa.RecordBatch:
        names = t["node"].to_pylist()
        place = {x: i for i, x in enumerate(names)}
        comp = t["comp"].to_pylist()
        tops = np.array([place[c] for c in comp], np.int64)
        parent = np.array([-1 if x == c else place[p] for x, p, c in zip(names, t["parent"].to_pylist(), comp, strict=True)], np.int64)
        values = np.stack([t["leaf"].to_numpy(), t["own"].to_numpy()], 1).astype(np.int64)
        total = rolled(tops, parent, t["depth"].to_numpy().astype(np.int64), values) + np.stack([t["leaves"].to_numpy(), t["saved"].to_numpy()], 1)
        return pa.RecordBatch.from_arrays([t["node"].combine_chunks(), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["node", "leaves", "saved"])

    ship(nodes.sparkSession)
    together = nodes.select("comp", "node", "parent", "depth", "leaf", "own", "leaves", "saved").repartition("comp").sortWithinPartitions("comp")
    return together.mapInArrow(run, "node binary, leaves long, saved long")


def split_large(big: DataFrame, member_rows: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Splits components of over `limit` nodes at their centroids, all of them once a round, until none is left: (parts for
    roll_up_small, finished centroids), stored tables."""
    small, done = [], []
    paths = stored(member_rows.join(big.select("node"), "node", "left_semi").select("node", "conv", "depth"), "paths")
    owned = big.groupBy("conv").agg(F.count(F.lit(1)).alias("owned"), F.max("depth").alias("last"))
    under = F.when(F.col("conv") == F.col("rep"), F.col("last") - F.col("depth") + 1).otherwise(F.col("owned"))
    sizes = paths.join(owned, "conv").join(big.select("node", F.col("conv").alias("rep")), "node").groupBy("node").agg(F.sum(under).alias("size"))
    now = stored(big.join(sizes, "node"), "large")
    while not now.isEmpty():
        counts = now.groupBy("comp").agg(F.max("size").alias("whole"))
        marked = now.join(counts, "comp").withColumn("on_path", F.col("size") * 2 > F.col("whole"))
        best = F.max_by(F.struct("node", "size", "depth"), "depth")
        found = stored(marked.where("on_path").groupBy("comp").agg(best.alias("v"), F.max("whole").alias("whole")).select("comp", "whole", F.col("v.node").alias("v"), F.col("v.size").alias("v_size"), F.col("v.depth").alias("v_depth")), "centroids")
        # where each conversation's path goes on after the centroid, for those that pass it
        pieces = now.select("comp", "conv").distinct().join(found.select("comp", "v", "v_depth"), "comp").select("*", F.explode(F.array("v_depth", F.col("v_depth") + 1)).alias("depth"))
        met = pieces.join(paths, ["conv", "depth"]).groupBy("comp", "conv").agg(F.max(F.col("node") == F.col("v")).alias("passes"), F.max(F.when(F.col("depth") > F.col("v_depth"), F.col("node"))).alias("child"))
        after = now.join(found, "comp").join(met, ["comp", "conv"], "left")
        below = F.coalesce("passes", F.lit(False)) & (F.col("depth") > F.col("v_depth"))
        after = after.withColumns({"below": below, "is_v": F.col("node") == F.col("v"), "on_path": F.col("size") * 2 > F.col("whole")})
        after = stored(after, "placed")
        sums = after.where("below OR is_v").groupBy("comp").agg(F.sum("leaf").alias("t_leaf"), F.sum("own").alias("t_own"))
        add = lambda c, t: (F.col(c) + F.when(F.col("on_path"), F.col(t)).otherwise(F.lit(0))).alias(c)
        size = F.when(F.col("on_path") & ~F.col("is_v"), F.col("size") - F.col("v_size")).otherwise(F.col("size"))
        moved = after.join(sums, "comp").select(F.when(F.col("below"), F.col("child")).otherwise(F.col("comp")).alias("comp"), "node", "parent", "conv", "depth", "leaf", "own", add("leaves", "t_leaf"), add("saved", "t_own"), size.alias("size"), "is_v")
        moved = stored(moved, "split")
        rest = moved.where("NOT is_v").drop("is_v")
        kept = rest.groupBy("comp").agg(F.max("size").alias("whole")).where(F.col("whole") > limit)
        done.append(stored(moved.where("is_v").select("node", "leaves", "saved"), "centroid_totals"))
        small.append(stored(rest.join(kept, "comp", "left_anti"), "small"))
        following = stored(rest.join(kept.select("comp"), "comp", "left_semi"), "large")
        drop_stored(now, found, after, moved)
        now = following
    drop_stored(now, paths)
    return small, done


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv): ids by number, comma-joined; sorted in ranges, joined in chunks, hashed in order."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, convs = b.column(0).to_pylist(), b.column(1).to_pylist()
            out, at = ([], [], []), 0
            for i in range(1, len(nodes) + 1):
                if i == len(nodes) or nodes[i] != nodes[at] or i - at == CHUNK:
                    for column, value in zip(out, (nodes[at], convs[at], ",".join(map(str, convs[at:i]))), strict=True):
                        column.append(value)
                    at = i
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["node", "conv", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            out = ([], [])
            for x, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if x != node:
                    if digest:
                        out[0].append(node)
                        out[1].append(digest.hexdigest())
                    node, digest = x, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["node", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    ship(ends.sparkSession)
    parts = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(chunks, "node binary, conv long, ids string")
    return parts.repartition("node").sortWithinPartitions("node", "conv").mapInArrow(hashes, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark, turns = conversations.sparkSession, numbered(conversations)
    rows, convs = members(turns)
    last = F.when(F.col("ends"), F.col("conv"))
    nodes = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.count(last).alias("n_ends"), F.min(last).alias("end"))
    nodes = stored(nodes, "nodes")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tops = rows.where("depth = 1").select("conv", F.col("node").alias("comp"))
    known = known.join(tops, "conv").withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "own": (F.col("n_convs") - 1) * F.col("bytes")})
    known = stored(known, "known")
    large = stored(known.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("comp"), "large_comps")
    start = known.select("comp", "node", "parent", "conv", "depth", "leaf", "own", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    if large.isEmpty():
        totals, pieces = roll_up_small(start), []
    else:
        small, done = split_large(stored(start.join(large, "comp", "left_semi"), "large"), rows, limit)
        parts = start.join(large, "comp", "left_anti")
        for s in small:
            parts = parts.unionByName(s.select(parts.columns))
        totals = roll_up_small(parts)
        for d in done:
            totals = totals.unionByName(d)
        pieces = [*small, *done]
    totals = stored(totals, "totals")

    whole = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("size") == 0).alias("n_ends"), F.min(F.when(F.col("size") == 0, F.col("conv"))).alias("end")).first()
    below = totals.join(known.where("depth = 1").select("node"), "node", "left_semi").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).first()
    long_ = lambda x: F.lit(x).cast("long")
    root = spark.range(1 if whole["n_convs"] else 0).select(
        F.lit(ROOT).alias("node"), long_(None).alias("parent_conv"), long_(whole["conv"]).alias("conv"), long_(0).alias("depth"), *(long_(whole[c]).alias(c) for c in ("n_convs", "n_ends", "end")), long_(below["n_children"]).alias("n_children"),
        long_(below["leaves"] or 1).alias("leaves"), long_(below["saved"] or 0).alias("saved"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    parent_conv = F.when(F.col("depth") == 1, F.lit(whole["conv"]).cast("long")).otherwise(F.col("parent_conv"))
    every = known.join(totals, "node").join(parents, "parent", "left").withColumn("parent_conv", parent_conv).select(root.columns).unionByName(root)

    ended = rows.where("ends").select("node", "conv").join(known.where("n_ends > 1").select("node"), "node", "left_semi").unionByName(convs.where("size = 0").select(F.lit(ROOT).alias("node"), "conv"))
    hashed = stored(ends_hashed(ended), "ends")
    single = F.when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string"), 256)).otherwise(F.lit(EMPTY_HASH))
    out = every.join(hashed, "node", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", single).alias("ends_sha256"))
    result = stored(out, "trie")
    drop_stored(turns, rows, convs, nodes, known, large, totals, hashed, *pieces)
    return result


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


#: CRC-32, bit by bit, of a string column s.
CRC32 = (
    "(4294967295 - list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({s}) + 1), lambda i: ord(substr({s}, i::INT, 1))::UBIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)))"
)

OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv, conv - conv % 5 AS base, CAST({CRC32.format(s="conv::VARCHAR")} % 9 AS BIGINT) AS h FROM (SELECT DISTINCT conv FROM turns)),
heads AS (SELECT c.conv, c.h, t.pos AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.base AND t.pos <= c.h),
lengths AS (SELECT c.conv, c.h, (SELECT count(*) FROM heads x WHERE x.conv = c.conv) AS head FROM convs c),
rebuilt AS (
  SELECT conv, depth, role, text FROM heads
  UNION ALL SELECT t.conv, l.head + t.pos - l.h, t.role, t.text FROM turns t JOIN lengths l USING (conv) WHERE t.pos > l.h),
paths AS (
  SELECT conv, depth, text, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, ',') OVER (PARTITION BY conv ORDER BY depth)) AS node FROM rebuilt
  UNION ALL SELECT conv, 0, '', '' FROM convs),
sizes AS (SELECT conv, max(depth) AS size FROM paths GROUP BY conv),
nodes AS (
  SELECT node, depth, min(conv) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(strlen(text)) AS own,
    sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE depth = size), '')) AS ends_sha256
  FROM paths JOIN sizes USING (conv) GROUP BY node, depth),
edges AS (SELECT n.node, n.depth, p.node AS parent FROM nodes n JOIN paths p ON p.conv = n.conv_id AND p.depth = n.depth - 1),
children AS (SELECT parent AS node, count(*) AS n_children FROM edges GROUP BY parent),
known AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)),
totals AS (
  SELECT p.node, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(k.own) AS saved_tokens
  FROM known k JOIN paths p ON p.conv = k.conv_id AND p.depth <= k.depth GROUP BY p.node)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(k.n_convs AS BIGINT) AS n_convs, CAST(k.n_children AS BIGINT) AS n_children,
  CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known k JOIN totals t USING (node) LEFT JOIN edges e ON e.node = k.node LEFT JOIN nodes q ON q.node = e.parent
"""
