"""Sharding: best-fit-decreasing bin packing of indivisible groups of documents.

Groups are texts with all their copies. Group sizes are summed per group on the executors. The EXACT largest groups are
packed one by one at their own sizes; the others are counted in size classes of a relative width of 1/256 (at most 14,600
classes whatever the input), so that the packing on the driver sees a bounded table and still places every group: groups
of a class are interchangeable. Largest sizes enter first, each group going to the bin with the tightest remaining
capacity that holds it, found in a balanced tree. The placement is carried back as runs of ranks within a class. Groups
with over a thousandth of the rows (there are at most a thousand) are joined by broadcast; the rest by key, so that a hot
group is never one task's.

A class stands for its mean size when shards are filled evenly, so that a shard's load is off by the deviations of the
groups that it draws from the classes, each under 1/256 of a group; for its largest size when a capacity must hold, so
that no bin overflows and at most 1/256 of a bin stays empty for it.

pack(capacity=...) opens as few bins of that capacity as the method finds; pack(shards=n) looks for the smallest
capacity that n bins suffice for, after groups larger than an even share have got bins of their own.

Defined cases: a null text counts as an empty one (one byte, crc 0) and shares its group; repeated rows each get a slot;
very long texts are groups of their size, which may exceed an even share and then have a shard each; ties (equal sizes) go by
the group's digest; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import slots, stored, table

SHARDS = 8
HOT_SHARE = 1000
EXACT = 10_000


class CapacityTree:
    """A treap of (remaining capacity, bin): insert, remove and the least key from a bound on, each O(log bins)."""

    def __init__(self):
        self.root = None

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, node, key):
        """(keys below key, the others)"""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def insert(self, key):
        left, right = self._split(self.root, key)
        node = [key, crc32(repr(key).encode()), None, None]
        self.root = self._merge(self._merge(left, node), right)

    def remove(self, key):
        left, right = self._split(self.root, key)
        _, right = self._split(right, (key[0], key[1] + 1))
        self.root = self._merge(left, right)

    def ceiling(self, key):
        node, best = self.root, None
        while node is not None:
            if node[0] >= key:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best


def best_fit_decreasing(classes: list[tuple[int, int, int]], capacity: int) -> tuple[list[tuple[int, int, int]], int]:
    """Runs (class, bin, groups) and the number of bins. classes: (class, size, groups); sizes over the capacity get a bin each."""
    tree, bins, runs = CapacityTree(), 0, []
    for cls, size, count in sorted(classes, key=lambda c: (-c[1], c[0])):
        while count:
            found = tree.ceiling((size, -1))
            if found is None:
                room, own = max(capacity, size), bins
                bins += 1
            else:
                room, own = found
                tree.remove(found)
            k = min(count, room // size)  # the tightest bin stays the tightest while it holds one more
            runs.append((cls, own, k))
            tree.insert((room - k * size, own))
            count -= k
    return runs, bins


def pack_evenly(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs that use `shards` bins, filled as evenly as the smallest fitting capacity allows."""
    left, own = sorted(classes, key=lambda c: (-c[1], c[0])), []
    total = sum(s * n for _, s, n in left)
    while left and shards - len(own) > 1 and left[0][1] * (shards - len(own)) > total:
        cls, size, n = left[0]
        own.append((cls, len(own), 1))
        total -= size
        left[0] = (cls, size, n - 1)
        if n == 1:
            left.pop(0)
    bins = shards - len(own)
    if not left:
        return own
    low = max(-(-total // bins), left[0][1])
    high = low + left[0][1]
    while best_fit_decreasing(left, high)[1] > bins:
        high += max(1, high // 4)
    while low < high and high - low > low // 100_000:
        mid = (low + high) // 2
        if best_fit_decreasing(left, mid)[1] <= bins:
            high = mid
        else:
            low = mid + 1
    return own + [(c, b + len(own), k) for c, b, k in best_fit_decreasing(left, high)[0]]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, row): what packing needs of each document, written once so that texts are read once."""
    text = F.coalesce("text", F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"), F.monotonically_increasing_id().alias("row"))
    return stored(small, "digests")


def size_class(size: str) -> F.Column:
    """A number that grows with the size; sizes of a class differ by 1/256 at most, those under 512 not at all."""
    return F.expr(f"CASE WHEN {size} < 512 THEN {size} ELSE (length(bin({size})) - 9) * 512 + shiftright({size}, CAST(length(bin({size})) - 9 AS INT)) END").cast("long")


def buckets(rows: int) -> int:
    """Buckets in which a group is numbered: 512, and more for more rows, so that one holds a million at most."""
    return max(512, rows // 1_000_000)


def pack(rows: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """rows (key, size, row, ...) with an int shard: equal keys share one. The EXACT largest groups and the classes' rows are broadcast."""
    spark = rows.sparkSession
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes"))
    groups = stored(groups.withColumn("class", size_class("bytes")), "groups")
    most = groups.orderBy(F.desc("bytes"), "key").limit(EXACT).select("key", "bytes").collect()
    large = spark.createDataFrame([(r["key"], i) for i, r in enumerate(most)], "key binary, place int")
    rest = groups.join(F.broadcast(large), "key", "left_anti")
    per_class = rest.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.avg("bytes")).alias("mean"), F.max("bytes").alias("most")).collect()
    total = rows.count()
    sizes = [(-1 - i, r["bytes"], 1) for i, r in enumerate(most)]  # classes of their own
    if capacity is not None:
        runs, _ = best_fit_decreasing(sizes + [(r["class"], r["most"], r["n"]) for r in per_class], capacity)
    else:
        runs = pack_evenly(sizes + [(r["class"], r["mean"], r["n"]) for r in per_class], shards or SHARDS)
    by_class = defaultdict(lambda: ([], []))
    at = defaultdict(int)
    for cls, own, k in runs:
        by_class[cls][0].append(at[cls])
        by_class[cls][1].append(own)
        at[cls] += k
    own_bins = spark.createDataFrame([(r["key"], by_class[-1 - i][1][0]) for i, r in enumerate(most)], "key binary, shard int")
    placed = spark.createDataFrame([(c, *x) for c, x in by_class.items() if c >= 0], "class long, starts array<long>, bins array<int>")
    ranked = slots(rest, "class", ["key"], ["key"], "rank", buckets(total)).join(F.broadcast(placed), "class")
    of_group = ranked.select("key", "copies", F.element_at("bins", F.size(F.filter("starts", lambda s: s <= F.col("rank")))).alias("shard"))
    of_group = of_group.unionByName(groups.select("key", "copies").join(F.broadcast(own_bins), "key"))
    of_group = stored(of_group, "placement")
    hot = F.col("copies") * HOT_SHARE > total
    first = rows.join(F.broadcast(of_group.where(hot).select("key", F.col("shard").alias("_hot"))), "key", "left")
    cold = first.where("_hot IS NULL").drop("_hot").join(of_group.where(~hot).select("key", "shard"), "key")
    return first.where("_hot IS NOT NULL").withColumnRenamed("_hot", "shard").unionByName(cold)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digests(table(spark, sf_dir, "documents", "doc_id", "text"))
    numbered = slots(pack(rows, shards=SHARDS), "shard", ["row"], ["doc_id", "row"], "slot", buckets(rows.count()))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
