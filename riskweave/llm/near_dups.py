"""MinHash near-dedup: BagMinHash signatures of weighted word shingles, banded, verified by multiset overlap.

A text is the multiset of its five-word shingles (lower case, words between white space; a shorter text is one shingle).
Signatures: every shingle drives Poisson processes over the registers, one for each dyadic interval of its weight
(0-1, 1-2, 2-4, ...), so that a weight of w costs log w processes; a point belongs to the shingle if its cell lies under
the weight. Each register keeps its earliest point. Two texts' registers agree with the probability of their weighted
Jaccard similarity. Processes run only up to the time by which all registers have a point.

REGISTERS = BANDS x ROWS: a pair of similarity 0.8 misses all 25 bands of 4 with a probability of 2e-6.

Links: texts that share a band key are a bucket. Copies of one text are one node. In each bucket the members are
verified (exact multiset overlap of at least 0.8) against a leader, the member that shares bands with the most texts
(in a group of edited copies that is the text they come from), and links are contracted to components; members that
a bucket's leader doesn't connect are verified against another one, and so on as long as that finds many links.

What is then still apart in some bucket goes through an exact prefix filter instead of all pairs of the bucket. The
occurrences of these texts are ordered by how many of the texts hold them, rarest first. Two bags of w and z
occurrences that overlap by 0.8 have 4/9 (w + z) in common at least, so they share one of the first
w - 4/9 (w + z) + 1. A text enters its prefix once for each class of partner sizes (STEPS classes to a factor of 0.8),
as long as that class needs; occurrences that no other text holds count in the prefix but make no row. So a passage that
very many texts share, however close to 0.8 it brings them, is joined on only by texts that own less than the prefix
beside it. Rows of a prefix entry's most frequent component meet the others there, not each other; entries meet only if
sizes and positions leave 4/9 (w + z) possible, and each pair is verified once. Entries carry the parity of the text's
occurrences in each of PARITY classes; two texts differ in no more parities than in occurrences, of which linked ones have (w + z)
/ 9 at most, so that of texts that consist of the same common passages only near ones leave the join. This stage loses no link among the texts
that enter it, also between texts that share no band.

A pair of similarity exactly 0.8 that shares no bucket (2e-6) is found only if both texts enter the last stage. Links
within a component are not looked for: they can't change it. No bucket is ever gathered in one task, nothing is capped.
Hot texts, bands, leaders, hubs and classes are joined by broadcast if they hold over a thousandth of the rows (so that
there are at most a thousand, or a thousand a band), else by key with skewed partitions split.

Defined cases: equal texts, also empty or null ones (null as empty), are one class; a text of white space has no shingles
and is alone but for its copies; repeated rows share a class; class_id is the least doc_id of the class (null if all are
null); an empty table gives no rows; very long texts are signed whole; of other columns, near_duplicates() looks at none and
keep_one() keeps all, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .base import add_columns, drop_stored, stored, table

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 4
REGISTERS = BANDS * ROWS
FRUITFUL = 20  # a leader round is followed by another if more than one in so many of its pairs are links
HOT_SHARE = 1000
MOST_NEIGHBOURS = 1 << 22
GROUP = 30_000  # shingles that are signed together
STEPS = 4
PARITY = 512  # classes of occurrences, 64 to a column
PARITIES = [f"parity{i}" for i in range(PARITY // 64)]
SHARED_BANDS = 3  # that a further leader and a member have in common, to be verified in a leader round
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _words() -> dict[str, int]:
    return {}


def word_hashes(words: list[str]) -> np.ndarray:
    known = _words()
    out = list(map(known.get, words))
    if None in out:
        if len(known) > 200_000:
            known.clear()
        for i, h in enumerate(out):
            if h is None:
                w = words[i]
                out[i] = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.array(out, U)


#: Odd multipliers, one for each word of a shingle.
FACTORS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the SHINGLE-word shingles, ascending, and their counts."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = word_hashes(words)
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    out = h[:n] * FACTORS[0]
    for j in range(1, size):
        out += h[j : j + n] * FACTORS[j]
    out = np.sort(mix(out + U(size)))
    first = np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]]))
    return out[first], np.diff(first, append=n)


def occurrences(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sorted 32-bit hashes of (shingle, occurrence): the multiset as a set.

    Of a text of n shingles, n / 2^32 are expected to meet another's by chance, so the overlap is exact but for that.
    """
    if len(w) and w.max() > 1:
        nth = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        x = np.repeat(x, w)
        x = np.where(nth > 0, mix(x + nth.astype(U) * U(0x9E3779B97F4A7C15)), x)
    return np.sort((x >> U(32)).astype(np.uint32))


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """Per bag (shingles, integer weights) the 32-bit ids of its m registers' earliest points; empty bags get zeros.

    All bags of a batch advance together, so that the work per shingle is that of whole-array operations.
    """
    x, weight = (np.concatenate([b[i] for b in bags]) if bags else np.zeros(0, U) for i in (0, 1))
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    total = np.bincount(doc, weight, len(bags))
    until = (np.log(m) + 2) / np.maximum(total, 1)
    parts = [(mix(x), np.zeros(len(x)), np.ones(len(x)), weight, doc)]
    level, lo = 1, 1
    while len(weight) and lo < weight.max():  # the interval from lo to 2 lo, for the weights above lo
        own = np.flatnonzero(weight > lo)
        parts.append((mix(x[own] ^ mix(np.full(1, U(level)))), np.full(len(own), float(lo)), np.full(len(own), float(lo)), weight[own], doc[own]))
        level, lo = level + 1, 2 * lo
    state, base, width, weight, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
    first, who = np.full(len(bags) * m, np.inf), np.zeros(len(bags) * m, U)
    run, waiting = (np.zeros(len(state)), state, base, width, weight, doc), []
    while True:
        while len(run[0]):
            at, state, base, width, weight, doc = run
            state = mix(state + U(0x9E3779B97F4A7C15))
            at = at - np.log(((state >> U(11)).astype(float) + 0.5) * 2.0**-53) / (m * width)
            late = at > until[doc]
            waiting.append(tuple(c[late] for c in (at, state, base, width, weight, doc)))
            run = tuple(c[~late] for c in (at, state, base, width, weight, doc))
            _points(run, first, who, m)
        empty = ~np.isfinite(first.reshape(len(bags), m)).all(1) & (total > 0)
        if not empty.any():
            return (who >> U(32)).astype(np.uint32).reshape(len(bags), m)
        until[empty] *= 2
        rest = tuple(np.concatenate(c) for c in zip(*waiting, strict=True))
        rest = tuple(c[open_] for open_ in [empty[rest[5]]] for c in rest)
        due = rest[0] <= until[rest[5]]
        waiting, run = [tuple(c[~due] for c in rest)], tuple(c[due] for c in rest)
        _points(run, first, who, m)


def _points(run, first, who, m):
    """Enters points into the registers they fall on, if their cell lies under the shingle's weight."""
    at, state, base, width, weight, doc = run
    if not len(at):
        return
    drawn = mix(state ^ U(0xD1B54A32D192ED03))
    register = ((drawn & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64) + doc * m
    cell = base + np.floor((drawn >> U(32)).astype(float) * 2.0**-32 * width)
    ok = cell < weight
    if not ok.all():
        register, at, drawn = register[ok], at[ok], drawn[ok]
    np.minimum.at(first, register, at)
    best = at == first[register]
    who[register[best]] = mix(drawn[best] + U(1))


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(bags, bands) 64-bit keys of consecutive registers."""
    r = registers.astype(U).reshape(len(registers), bands, -1)
    key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(U)), r.shape[:2])
    for j in range(r.shape[2]):
        key = mix(key + r[:, :, j])
    return key.view(np.int64)


SIGNED = [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("weight", T.LongType()), T.StructField("bag", T.BinaryType())]


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, row, bands, weight, bag) of each document, written once."""

    def run(texts):
        bands, weight, bag, group, size = [], [], [], [], 0

        def flush():
            keys = band_keys(bag_minhash(group)).tolist()
            bands.extend(k if len(g[0]) else [] for k, g in zip(keys, group, strict=True))
            group.clear()

        for t in texts:
            x, w = shingles(t)
            group.append((x, w))
            weight.append(int(w.sum()))
            bag.append(occurrences(x, w).tobytes())
            size += len(x)
            if size >= GROUP:
                flush()
                size = 0
        if group:
            flush()
        return bands, weight, bag

    small = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    return stored(add_columns(small, ["text"], SIGNED, run).drop("text").withColumn("row", F.monotonically_increasing_id()), "signed")


def join_unique(left: DataFrame, right: DataFrame, on: str, copies: str, total: int) -> DataFrame:
    """left joined with its unique partner in right (inner), which is hot if its `copies` are over a thousandth of total.

    Hot partners are broadcast: there are at most HOT_SHARE of them for each time that copies add up to total.
    """
    hot = F.col(copies) * HOT_SHARE > total
    cols = [c for c in right.columns if c != on]
    marked = left.join(F.broadcast(right.where(hot).select(on, F.struct(*cols).alias("_hot"))), on, "left")
    near = marked.where("_hot IS NOT NULL").select(*left.columns, *(F.col(f"_hot.{c}").alias(c) for c in cols))
    far = marked.where("_hot IS NULL").drop("_hot").join(right.where(~hot), on)
    return near.unionByName(far.select(near.columns))


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Those rows of pairs (a, b, ...) whose multisets overlap by THRESHOLD at least."""

    def run(left, right):
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            merged = np.sort(np.concatenate([x, y]), kind="stable")  # two sorted runs
            both = int((merged[1:] == merged[:-1]).sum())
            out.append(9 * both >= 4 * (len(x) + len(y)))  # that is 0.8 of the union
        return [out]

    a, b = (bags.select(F.col("node").alias(s), F.col("weight").alias(f"w{s}"), F.col("bag").alias(f"bag{s}")) for s in "ab")
    both = pairs.join(a, "a").join(b, "b").where(F.least("wa", "wb") * 5 >= F.greatest("wa", "wb") * 4)
    return add_columns(both, ["baga", "bagb"], [T.StructField("linked", T.BooleanType())], run).where("linked").select(*pairs.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the edges' nodes, comp the least node of its component, by large-star and small-star steps; a stored table.

    A node's least neighbour comes from a window where there are MOST_NEIGHBOURS edges at most, so that no node has more; else it is
    an aggregate that is joined back, by broadcast for hubs, so that no task holds all neighbours of one.
    """
    state = None

    def with_least(rows):
        """(rows with the least b of each a as m, the table that they read)."""
        if now[0] <= MOST_NEIGHBOURS:
            return rows.withColumn("m", F.min("b").over(W.partitionBy("a"))), None
        least = stored(rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        return join_unique(rows, least, "a", "n", 2 * now[0]).drop("n"), least

    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sums = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    now = edges.select(*sums).first()
    while now != state and now[0]:
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both, least = with_least(both)
        large = both.withColumn("m", F.least("m", "a")).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large, "large") if least else large
        small, least2 = with_least(large)
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        after = stored(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        drop_stored(edges, least, large, least2)
        edges, now = after, after.select(*sums).first()
    comps = edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
    out = stored(comps, "components")
    drop_stored(edges)
    return out


def by_leaders(links: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """(node, comp) of each of texts by links (a, b) of leaders a and members b; a stored table.

    A member has a leader for each of its bands at most, so it is one row with all its leaders; what is contracted step by
    step is the graph of leaders only, and a leader's many members are then joined with its component.
    """
    led = stored(links.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "led")
    star = links.groupBy("b").agg(F.min("a").alias("lead"), F.collect_set("a").alias("leads"))
    star = stored(star.join(led.select(F.col("a").alias("b"), F.lit(True).alias("leads_too")), "b", "left"), "stars")
    edges = star.select(F.col("lead").alias("a"), F.explode("leads").alias("b")).unionByName(star.where("leads_too").select(F.col("lead").alias("a"), "b"))
    comps = components(edges)
    homes = stored(led.join(comps.withColumnRenamed("node", "a"), "a", "left").select(F.col("a").alias("lead"), F.coalesce("comp", "a").alias("comp"), "n"), "homes")
    members = join_unique(star.where("leads_too IS NULL").select(F.col("b").alias("node"), "lead"), homes, "lead", "n", total).select("node", "comp")
    placed = stored(members.unionByName(homes.select(F.col("lead").alias("node"), "comp")), "placed")
    out = stored(texts.select("node").join(placed, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "comps")
    drop_stored(led, star, comps, homes, placed)
    return out


def prefix_entries(bags: DataFrame) -> DataFrame:
    """The prefixes of bags (node, comp, weight, bag): (occ, low, high, node, comp, weight, pos), low and high the size
    classes of the text and of the partners that the entry is for, pos the entry's place in the text."""

    def unpack(values):
        ends = np.cumsum([0, *(len(v) // 4 for v in values)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), np.int32)))]

    def parities(values):
        out = np.zeros((len(values), PARITY // 64), np.int64)
        for i, v in enumerate(values):
            bits = np.bincount(np.frombuffer(v, np.uint32) % PARITY, minlength=PARITY) & 1
            out[i] = np.packbits(bits.astype(np.uint8)).view(np.int64)
        return [pa.array(c) for c in out.T]

    occurring = add_columns(bags.select("node", "bag"), ["bag"], [T.StructField("occ", T.ArrayType(T.IntegerType()))], unpack)
    occurring = stored(occurring.select("node", F.explode("occ").alias("occ")), "occurring")
    total = occurring.count()
    held = stored(occurring.groupBy("occ").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "held")
    known = join_unique(occurring, held, "occ", "df", total)
    known = known.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "occ"))).alias("known"))
    e = add_columns(bags.select("node", "comp", "weight", "bag"), ["bag"], [T.StructField(p, T.LongType()) for p in PARITIES], parities).drop("bag").join(known, "node")
    step, w = float(np.log(1 / THRESHOLD) / STEPS), F.col("weight")
    size_class = lambda n: F.floor(F.log(n.cast("double")) / step + 1e-9).cast("int")
    own, alone = size_class(w), (w - F.size("known")).cast("int")
    least = F.ceil(w * THRESHOLD - 1e-9)

    def entered(c):
        partner = F.greatest(F.ceil(F.exp(c * step) * (1 - 1e-9)), least)  # the least weight of a partner in class c
        length = w - F.expr("4L") * (w + partner) / 9 + 1
        rows = F.slice("known", 1, F.greatest(F.floor(length + 1e-9).cast("int") - alone, F.lit(0)))
        return F.transform(rows, lambda x, i: F.struct(x["occ"].alias("occ"), F.least(own, c).alias("low"), F.greatest(own, c).alias("high"), (alone + i).alias("pos")))

    all_ = F.flatten(F.transform(F.sequence(size_class(least), size_class(F.floor(w / THRESHOLD + 1e-9))), entered))
    out = stored(e.select("node", "comp", "weight", *PARITIES, F.explode(all_).alias("e")).select("e.*", "node", "comp", "weight", *PARITIES), "entries")
    drop_stored(occurring, held)
    return out


def prefix_pairs(bags: DataFrame) -> DataFrame:
    """Pairs (a, b) of bags of different components that may overlap by THRESHOLD; every pair that does is among them."""
    key = ["occ", "low", "high"]
    entries = prefix_entries(bags)
    per_comp = entries.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("n"))
    most = per_comp.groupBy(*key).agg(F.max(F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    most = stored(most.select(*key, F.col("most.comp").alias("main")), "main")
    met = stored(entries.join(most, key), "met")
    others = met.where("comp <> main").select(*key, *(F.col(c).alias(f"{c}_a") for c in ("node", "comp", "weight", "pos", *PARITIES)))
    ahead = F.least(F.col("weight") - F.col("pos"), F.col("weight_a") - F.col("pos_a"))  # what may be common from here on
    sizes = F.least("weight", "weight_a") * 5 >= F.greatest("weight", "weight_a") * 4
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}_a"))) for p in PARITIES), F.lit(0)) * 9 <= F.col("weight") + F.col("weight_a")
    once = (F.col("comp") == F.col("main")) | (F.col("node") > F.col("node_a"))
    found = met.join(others, key).where((F.col("comp") != F.col("comp_a")) & once & sizes & (ahead * 9 >= (F.col("weight") + F.col("weight_a")) * 4) & differ)
    swapped = F.col("node_a") < F.col("node")
    ends = lambda first, other: F.when(swapped, F.col(first)).otherwise(F.col(other))
    pairs = found.select(ends("node_a", "node").alias("a"), ends("node", "node_a").alias("b"), ends("comp_a", "comp").alias("comp_a"), ends("comp", "comp_a").alias("comp_b"))
    out = stored(pairs.distinct(), "pairs")
    drop_stored(entries, most, met)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, row, class_id, kept): one row per document; row numbers the documents, key is the text's digest, kept marks
    one row of each class. A stored table; all others that it is made of are deleted."""
    rows = signed(docs)
    total = rows.count()
    nodes = rows.groupBy("key").agg(F.min(F.struct("row", "bands")).alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes.select("key", "copies", F.col("first.row").alias("node"), F.col("first.bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    sizes = stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    shared = stored(join_unique(banded, sizes, "band", "n", total), "shared")
    popular = shared.groupBy("node").agg(F.sum("n").alias("popular"))
    led = shared.join(popular, "node").groupBy("band").agg(F.max_by("node", F.struct("popular", -F.col("node"))).alias("leader"), F.count(F.lit(1)).alias("n"))
    led = stored(led, "leaders")
    members = stored(join_unique(shared.select("band", "node"), led, "band", "n", total).select("band", "leader", "node"), "members")
    bags = stored(rows.select(F.col("row").alias("node"), "weight", "bag").join(shared.select("node"), "node", "left_semi"), "bags")
    drop_stored(sizes, led)
    tested = stored(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = stored(verified(tested, bags), "links")
    comps = by_leaders(links, bags, total)
    drop_stored(shared, tested, links)

    def mixed(among):
        """(band, leader, node, comp) of the bands in `among` whose texts are in several components."""
        placed = stored(among.select("band", "leader", "node").join(comps, "node"), "placed")
        several = stored(placed.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.max(F.when(F.col("node") == F.col("leader"), F.col("comp"))).alias("lead_comp")).where("least <> most").select("band", "lead_comp"), "several")
        out = stored(placed.join(several, "band"), "mixed")
        drop_stored(placed, several)
        return out

    def merged(found):
        """The components after the found pairs' (comp_a, comp_b) have become one."""
        again = components(found.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
        after = comps.join(again.select(F.col("node").alias("comp"), F.col("comp").alias("joined")), "comp", "left")
        after = stored(after.select("node", F.coalesce("joined", "comp").alias("comp")), "comps")
        drop_stored(again, comps)
        return after

    rest, turn, fruitful = mixed(members), 0, True
    while fruitful:  # another leader for each band, as long as a good part of its pairs are links
        apart = rest.where("comp <> lead_comp")
        first = apart.groupBy("band").agg(F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(turn))).alias("f")).select("band", F.col("f.node").alias("a"), F.col("f.comp").alias("comp_a"))
        first = stored(first, "first")  # a table, so that the rows of a hot band can be split in the join
        met = rest.join(first, "band").where("comp <> comp_a").groupBy("a", F.col("node").alias("b")).agg(F.min("comp_a").alias("comp_a"), F.min("comp").alias("comp_b"), F.count(F.lit(1)).alias("n"))
        new = stored(met.where(F.col("n") >= SHARED_BANDS).drop("n"), "pairs")
        found = stored(verified(new, bags), "links")
        tried, hits = new.count(), found.count()
        fruitful, turn = hits * FRUITFUL > tried, turn + 1
        if hits:
            comps = merged(found)
            before, rest = rest, mixed(rest)
            drop_stored(before)
        drop_stored(new, found, first)
    rest_texts = stored(rest.groupBy("node").agg(F.first("comp").alias("comp")).join(bags, "node"), "rest")
    new = prefix_pairs(rest_texts)
    found = stored(verified(new, bags), "links")
    if not found.isEmpty():
        comps = merged(found)
    drop_stored(rest, rest_texts, new, found, members, bags)

    by_text = nodes.join(comps, "node", "left").select("key", "copies", F.coalesce("comp", "node").alias("comp"))
    by_text = stored(by_text, "classes")
    placed = stored(join_unique(rows.select("doc_id", "key", "row"), by_text, "key", "copies", total).drop("copies"), "placed")
    classes = stored(placed.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "class_ids")
    out = join_unique(placed, classes, "comp", "copies", total)
    out = stored(out.select("doc_id", "key", "row", "class_id", (F.col("row") == F.col("comp")).alias("kept")), "near_duplicates")
    drop_stored(rows, nodes, comps, by_text, placed, classes)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, all columns kept: a stored table. Only rows whose doc_id and text repeat are told apart."""
    marked = near_duplicates(docs)
    kept = marked.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept")).where("kept")
    kept = stored(kept.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"), "rows"), "kept_ids")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    chosen = whole.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    once = chosen.where("rows = 1").select("doc.*").unionByName(chosen.where("rows > 1").dropDuplicates(["id", "key"]).select("doc.*"))
    out = stored(once, "kept")
    drop_stored(marked, kept)
    return out


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "kept")
