"""LM scoring with an Elias-Fano n-gram trie: trigrams by interpolated absolute discounting.

Texts become chunks: arrays of word numbers, documents one after the other, each with an end token. Words are counted by ranges of
their 64-bit hashes and numbered there, frequent ones first; a chunk gets the numbers and counts of its words back. It then sends
the bigrams and trigrams of its texts, as sorted arrays with their counts in training texts, to shards by the first word, and
gets quantised probabilities back, from which it scores each text:

    p(z | x y) = max(c(xyz) - D, 0) / c(xy) + l3(xy) (max(c(yz) - D, 0) / c(y) + l2(y) (c(z) + 1) / (N + V + 1))

where l2 and l3 are D times the number of a context's different followers by its count, 1 for unseen contexts.

A shard builds a trie of its training n-grams: level 1 the first words, level 2 the second under each, level 3 the third, with
pointers from each node to its children. Pointers, and the children's numbers made monotone by adding the last value of the
siblings before, are Elias-Fano sequences; probabilities and weights are 8-bit logarithms (QUANTUM to a decade, an error of 0.025
at most). The levels are one memory-mapped file. A look-up adds the value before the context's children to the number, and finds
its successor among them: the high bits name a bucket, a binary search in the low bits does the rest.

Nothing is pruned or capped: what is gathered grows with the corpus, over more shards. Words of over a HOT-th of all tokens (fewer
than HOT of them) and the begin of a text are hot: their bigrams are dealt by both words, and trigrams of two hot words by all
three. What only all shards together know of a hot context is summed and broadcast: at most HOT^2 rows. The tries are used in the
tasks that build them, and kept as a table where score() is given a path.

Limits: words are compared by 64-bit hashes (m distinct ones share one with a chance of m^2 / 2^65) and numbered below 2^31; more
raise an error. Defined cases: null texts are empty and score their end; a null doc_id counts as empty text in the hold-out rule (it
is learned from); repeated rows are learned from and scored each; no training rows: p is 1 / (N + V + 1) = 1 for all; an empty table
gives no rows; long texts are read step by step and a text is never split between chunks; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import new_folder
from .base import drop_stored, ship, sliced, stored, table
from .packed import Numbers, U, mix, pack, pack_sorted, steps, targets, unpack, unpack_sorted, word_hashes

DISCOUNT = 0.75
QUANTUM, NONE = 20, 255
HOT = 256
CHUNK = 1_000_000  # tokens of a chunk
RANGE = 1_000_000  # words of a range
SHARD = 750_000  # n-grams of a shard
END = b"\n"  # no word: it is white space
BEGIN, UNKNOWN = 0, (1 << 31) - 1  # numbers of the begin of a text and of words that training texts lack


def quantised(p: np.ndarray) -> np.ndarray:
    """8-bit logarithms of probabilities; NONE for 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-QUANTUM * np.log10(p)), 0, NONE - 1), NONE).astype(np.uint8)


VALUES = np.r_[10.0 ** (-np.arange(NONE) / QUANTUM), 0.0]


class EliasFano:
    """An ascending sequence: low bits packed, high bits in unary. arrays: what build() made, memory-mapped or not."""

    def __init__(self, arrays: list[np.ndarray]):
        (self.n, self.bits), self.low, self.high = (int(x) for x in arrays[0]), arrays[1], arrays[2]
        ones = np.unpackbits(self.high, bitorder="little").view(bool)
        self.place = np.flatnonzero(ones)[: self.n]
        self.starts = np.flatnonzero(~ones)
        self.starts = np.r_[0, self.starts - np.arange(len(self.starts))]  # the first element of each bucket

    @staticmethod
    def build(values: np.ndarray) -> list[np.ndarray]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(bits, dtype=U)) & U(1)).astype(np.uint8)
        high = np.zeros((top >> bits) + n + 2, np.uint8)
        high[(values >> U(bits)).astype(np.int64) + np.arange(n)] = 1
        return [np.array([n, bits], np.int64), np.r_[np.packbits(low.ravel(), bitorder="little"), np.zeros(8, np.uint8)], np.packbits(high, bitorder="little")]

    def lows(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        word = np.zeros(len(i), U)
        for k in range(8):
            word |= self.low[(at >> 3) + k].astype(U) << U(8 * k)
        return (word >> (at & 7).astype(U)) & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.place[i] - i).astype(U) << U(self.bits) | self.lows(i)

    def successor(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """In begin..end the first place with at least the value; end if there is none."""
        bucket = np.minimum((values >> U(self.bits)).astype(np.int64), len(self.starts) - 2)
        low = values & U((1 << self.bits) - 1)
        beyond = values >> U(self.bits) > bucket.astype(U)
        lo, hi = np.clip(self.starts[bucket], begin, end), np.clip(self.starts[bucket + 1], begin, end)
        lo = np.where(beyond, hi, lo)
        go = np.flatnonzero(lo < hi)
        while len(go):
            mid = (lo[go] + hi[go]) >> 1
            less = self.lows(mid) < low[go]
            lo[go[less]] = mid[less] + 1
            hi[go[~less]] = mid[~less]
            go = go[lo[go] < hi[go]]
        return lo


class Trie:
    """firsts: ascending first words; second and third: their children. Codes: p2, l3 and p3 by node, l2 by first word."""

    NAMES = ("firsts", "l2", "p2", "l3", "p3")

    def __init__(self, blob: bytes | np.ndarray):
        raw = np.frombuffer(blob, np.uint8) if isinstance(blob, bytes) else blob
        sizes, at, arrays = raw[:160].view(np.int64), 160, []
        kinds = [np.int64, np.uint8, np.uint8] * 4 + [U] + [np.uint8] * 4
        for kind, size in zip(kinds, sizes, strict=False):
            arrays.append(raw[at : at + int(size)].view(kind))
            at += int(size + 7) // 8 * 8
        self.to_second, self.second, self.to_third, self.third = (EliasFano(arrays[3 * i : 3 * i + 3]) for i in range(4))
        for name, a in zip(self.NAMES, arrays[12:], strict=True):
            setattr(self, name, a)

    @classmethod
    def build(cls, xy: np.ndarray, xy_count: np.ndarray, at: np.ndarray, z: np.ndarray, z_count: np.ndarray, counts_of: dict[int, int], whole: int, hot: np.ndarray) -> bytes:
        """From ascending pairs with their counts, and third words z with counts under the pairs number `at`, ascending."""
        x = xy >> U(32)
        firsts, first = np.unique(x, return_index=True)
        total2 = np.add.reduceat(xy_count, first) if len(first) else np.zeros(0, np.int64)
        for i in np.flatnonzero(np.isin(firsts, hot)):  # whose pairs are dealt to all shards
            total2[i] = counts_of[int(firsts[i])]
        followers2 = np.add.reduceat((xy_count > 0).astype(np.int64), first) if len(first) else total2
        total3, followers3 = np.bincount(at, z_count, len(xy)).astype(np.int64), np.bincount(at, minlength=len(xy))
        both = np.isin(x, hot) & np.isin(xy & U(0xFFFFFFFF), hot)
        share = lambda n, of: np.maximum(n - DISCOUNT, 0) / np.maximum(of, 1)
        weight = lambda n, of: np.where(of > 0, DISCOUNT * n / np.maximum(of, 1), 1.0)
        in_first = np.repeat(np.arange(len(firsts)), np.diff(np.r_[first, len(xy)]))
        p3_of = np.where(both, whole, total3)[at]  # a context of two hot words is only counted when all shards are known
        codes = [quantised(weight(followers2, total2)), quantised(share(xy_count, total2[in_first])), quantised(weight(followers3, total3)), quantised(share(z_count, p3_of))]
        ends2, ends3 = np.r_[first, len(xy)].astype(U), np.searchsorted(at, np.arange(len(xy) + 1)).astype(U)
        arrays = [*EliasFano.build(ends2), *EliasFano.build(monotone(xy & U(0xFFFFFFFF), ends2)), *EliasFano.build(ends3), *EliasFano.build(monotone(z, ends3)), firsts, *codes]
        parts = [np.array([a.nbytes for a in arrays] + [0] * (20 - len(arrays)), np.int64).tobytes()]
        for a in arrays:
            parts.append(a.tobytes() + bytes(-a.nbytes % 8))
        return b"".join(parts)

    def pairs(self, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, -1 if none; place of the pair, -1 if none)."""
        x, y = xy >> U(32), xy & U(0xFFFFFFFF)
        i = np.minimum(np.searchsorted(self.firsts, x), max(len(self.firsts) - 1, 0))
        if not len(self.firsts):
            return np.full(len(xy), -1), np.full(len(xy), -1)
        i = np.where(self.firsts[i] == x, i, -1)
        return i, below(self.to_second, self.second, i, y)

    def triples(self, pair: np.ndarray, z: np.ndarray) -> np.ndarray:
        return below(self.to_third, self.third, pair, z)


def monotone(children: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Children's numbers, each list raised by the last value of the one before."""
    if not len(children):
        return children.astype(U)
    full = ends[1:][np.diff(ends) > 0].astype(np.int64)
    last = children[full - 1].astype(U)
    base = np.r_[U(0), np.cumsum(last)[:-1]]
    return children.astype(U) + np.repeat(base, np.diff(np.r_[0, full]))


def below(pointers: EliasFano, level: EliasFano, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """Places of the children in a level, -1 where there are none."""
    out = np.full(len(parent), -1)
    go = np.flatnonzero(parent >= 0)
    begin, end = pointers.get(parent[go]).astype(np.int64), pointers.get(parent[go] + 1).astype(np.int64)
    go, begin, end = (a[end > begin] for a in (go, begin, end))
    base = np.where(begin > 0, level.get(np.maximum(begin - 1, 0)), U(0))
    value = base + child[go]
    found = level.successor(value, begin, end)
    there = found < end
    there[there] = level.get(found[there]) == value[there]
    out[go[there]] = found[there]
    return out


def chunked(docs: DataFrame, held: F.Column) -> tuple[DataFrame, DataFrame]:
    """(chunk, doc_ids, held, sizes, order, ids) and (chunk, tokens, hashes, counts): tables of texts and of their words. Number 0
    is the end token; hashes of words are ascending, with training counts; order has the words' numbers in that order."""
    kind = docs.schema["doc_id"].dataType
    fields = [("chunk", T.LongType()), ("doc_ids", T.ArrayType(kind)), ("held", T.ArrayType(T.BooleanType())), ("sizes", T.ArrayType(T.LongType())), ("order", T.BinaryType()), ("ids", T.BinaryType()), ("tokens", T.LongType()), ("hashes", T.BinaryType()), ("counts", T.BinaryType()), ("part", T.IntegerType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        made, size, numbers, parts, rows = (context.partitionId() if context else 0) << 32, 0, Numbers({END: 0}), [], ([], [], [])

        def closed():
            ids = np.concatenate(parts)
            hashes = word_hashes(list(numbers))
            order = np.argsort(hashes)
            counts = np.bincount(ids[learned(rows[1], rows[2])], minlength=len(order))[order]
            texts = made, *rows, pack(order.astype(np.uint32)), pack(ids), None, None, None, 0
            words = made, None, None, None, None, None, len(ids), pack_sorted(hashes[order]), pack(counts.astype(U)), 1
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(texts, words, strict=True), arrow, strict=True)], schema=arrow)

        for whole in batches:
            for b in sliced(whole):
                for doc_id, out, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                    n = 0
                    for part in steps(text.lower()):
                        parts.append(numbers.of(part.split()))
                        n += len(parts[-1])
                    parts.append(np.zeros(1, np.uint32))
                    for column, value in zip(rows, (doc_id, out, n + 1), strict=True):
                        column.append(value)
                    size += n + 1
                    if size >= CHUNK:
                        yield closed()
                        made, size, numbers, parts, rows = made + 1, 0, Numbers({END: 0}), [], ([], [], [])
        if size:
            yield closed()

    ship(docs.sparkSession)
    rows = docs.select("doc_id", held.alias("held"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    path = new_folder(docs.sparkSession, "chunks")
    rows.mapInArrow(run, schema).write.option("compression", "zstd").partitionBy("part").parquet(path)
    texts, words = (docs.sparkSession.read.schema(schema).parquet(path).where(F.col("part") == i) for i in (0, 1))
    texts.stored_at, words.stored_at = path, f"{path}/part=1"
    return texts, words


def learned(held: list[bool], sizes: list[int]) -> np.ndarray:
    return np.repeat(~np.array(held, bool), sizes)


def count_words(words: DataFrame, ranges: int) -> DataFrame:
    """(chunk, range, numbers, counts, train, distinct): for each chunk the numbers and training counts of its words, in order of
    their hashes; a stored table. train and distinct of all rows add up to N and V."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                chunk, hashes, counts = (b.column(c)[row].as_py() for c in range(3))
                h, counts = unpack_sorted(hashes), unpack(counts)
                cuts = np.searchsorted(targets(h, ranges), np.arange(ranges + 1))
                full = np.flatnonzero(np.diff(cuts))
                columns = [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), *(pa.array([f(x[cuts[i] : cuts[i + 1]]) for i in full], pa.binary()) for f, x in ((pack_sorted, h), (pack, counts)))]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "chunk", "hashes", "counts"])

    def numbered(t: pa.Table) -> pa.Table:
        own, keys = t["range"][0].as_py(), [unpack_sorted(x) for x in t["hashes"].to_pylist()]
        words, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, back, np.concatenate([unpack(x) for x in t["counts"].to_pylist()]).astype(np.int64))
        number = np.empty(len(words), np.int64)
        number[np.argsort(-total, kind="stable")] = 1 + own + ranges * np.arange(len(words))
        number[total == 0] = UNKNOWN
        if (number[total > 0] >= UNKNOWN).any():
            raise OverflowError("over 2^31 different words")
        out, at = ([], []), 0
        for k in keys:
            mine = back[at : at + len(k)]
            at += len(k)
            out[0].append(pack(number[mine].astype(np.uint32)))
            out[1].append(pack(total[mine].astype(U)))
        once = np.zeros(len(keys), np.int64)
        once[0] = 1
        return pa.table([t["chunk"], t["range"], pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(once * total.sum()), pa.array(once * (total > 0).sum())], names=["chunk", "range", "numbers", "counts", "train", "distinct"])

    ship(words.sparkSession)
    parts = words.select("chunk", "hashes", "counts").mapInArrow(sent, "range int, chunk long, hashes binary, counts binary")
    return stored(parts.groupBy("range").applyInArrow(numbered, "chunk long, range int, numbers binary, counts binary, train long, distinct long"), "words")


@dataclass
class Grams:
    """The n-grams of a chunk: pairs and triples by shard, then ascending, and for each token the place of its own.

    pair: places of (y, z), -1 for an unknown y; triple: places of (x, y, z), -1 for an unknown x or y; context: the pair (x, y)
    that stands for the triple's context in its shard.
    """

    xy: np.ndarray
    xy_count: np.ndarray
    shard: np.ndarray
    parent: np.ndarray
    z: np.ndarray
    z_count: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    context: np.ndarray


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, place of each key among them)."""
    order = np.argsort(key)
    inner = key[order]
    new = np.r_[True, inner[1:] != inner[:-1]] if len(key) else np.zeros(0, bool)
    place = np.empty(len(key), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return inner[new], place


def grams(word: np.ndarray, train: np.ndarray, sizes: list[int], hot: np.ndarray, shards: int) -> Grams:
    n, begins = len(word), np.cumsum([0, *sizes])[:-1]
    y, x = np.r_[U(0), word[:-1]], np.r_[U(0), U(0), word[:-2]][:n]
    y[begins] = x[begins] = BEGIN
    second = begins[np.array(sizes, np.int64) > 1] + 1
    x[second] = BEGIN
    xy, place = ranked(np.r_[y << U(32) | word, U(0)])  # the last is that of two begins
    known = y != UNKNOWN
    context_known = known & (x != UNKNOWN)
    del x, y
    xy_count = np.bincount(place[:n][train & known], minlength=len(xy)).astype(np.int32)
    context = np.r_[np.int32(0), place[: n - 1]]
    context[begins] = place[n]
    is_hot = lambda w: np.isin(w, hot)
    first, follow = xy >> U(32), xy & U(0xFFFFFFFF)
    hot_first = is_hot(first)
    shard = targets(mix(np.where(hot_first, xy, first)), shards)
    spread = hot_first & is_hot(follow)
    key, triple = ranked(context.astype(U) << U(32) | word)
    z_count = np.bincount(triple[train & context_known], minlength=len(key)).astype(np.int32)
    parent, z = (key >> U(32)).astype(np.int32), (key & U(0xFFFFFFFF)).astype(np.uint32)
    del context, key, known, context_known
    ok3 = ((xy[parent] >> U(32)) != UNKNOWN) & ((xy[parent] & U(0xFFFFFFFF)) != UNKNOWN)
    # contexts of two hot words stand in the shard of each of their triples too
    away = np.flatnonzero(spread[parent] & ok3)
    z_shard = targets(mix(mix(xy[parent[away]]) + z[away]), shards)
    away, z_shard = (a[z_shard != shard[parent[away]]] for a in (away, z_shard))
    extra, of_extra = ranked(z_shard.astype(U) << U(32) | parent[away].astype(U))
    ok2 = first != UNKNOWN
    every_shard, every_xy = np.r_[shard, (extra >> U(32)).astype(np.int64)], np.r_[xy, xy[(extra & U(0xFFFFFFFF)).astype(np.int64)]]
    every_count, keep = np.r_[xy_count, np.zeros(len(extra), np.int32)], np.r_[ok2, np.ones(len(extra), bool)]
    narrow = every_shard.astype(np.uint16) if shards < 1 << 16 else every_shard
    order = np.lexsort((every_xy, narrow)) if len(extra) else np.argsort(narrow, kind="stable")
    order = order[keep[order]]
    moved = np.full(len(every_xy), -1, np.int32)
    moved[order] = np.arange(len(order), dtype=np.int32)
    own = moved[parent]
    own[away] = moved[len(xy) + of_extra]
    z_order = np.argsort(own, kind="stable")
    z_order = z_order[ok3[z_order]]
    z_moved = np.full(len(parent), -1, np.int32)
    z_moved[z_order] = np.arange(len(z_order), dtype=np.int32)
    triples = z_moved[triple]
    return Grams(every_xy[order], every_count[order], every_shard[order], own[z_order], z[z_order], z_count[z_order], moved[place[:n]], triples, np.where(triples >= 0, own[triple], -1))


def words_of(order: bytes, ids: bytes, replies: list) -> tuple[np.ndarray, np.ndarray]:
    """(number, training count) of each token."""
    replies = sorted(replies, key=lambda r: r["range"])
    order, i, out = unpack(order), unpack(ids), []
    for name in ("numbers", "counts"):
        a = np.empty(len(order), U)
        a[order] = np.concatenate([unpack(r[name]) for r in replies])
        out.append(a[i])
    return out[0], out[1]


def sent_grams(chunks: DataFrame, hot: np.ndarray, shards: int) -> DataFrame:
    """(shard, chunk, xy, xy_count, parent_z, z_count): what each chunk asks of and tells each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                chunk, held, sizes, order, ids, replies = (b.column(c)[row].as_py() for c in range(6))
                g = grams(words_of(order, ids, replies)[0], learned(held, sizes), sizes, hot, shards)
                cuts = np.searchsorted(g.shard, np.arange(shards + 1))
                z_cuts = np.searchsorted(g.parent, cuts)
                out = ([], [], [], [], [], [])
                for s in np.flatnonzero(np.diff(cuts)):
                    i, k = slice(cuts[s], cuts[s + 1]), slice(z_cuts[s], z_cuts[s + 1])
                    row_ = int(s), chunk, pack_sorted(g.xy[i]), pack(g.xy_count[i].astype(np.uint32)), pack_sorted((g.parent[k] - cuts[s]).astype(U) << U(32) | g.z[k].astype(U)), pack(g.z_count[k].astype(np.uint32))
                    for column, value in zip(out, row_, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["shard", "chunk", "xy", "xy_count", "parent_z", "z_count"])

    ship(chunks.sparkSession)
    return chunks.select("chunk", "held", "sizes", "order", "ids", "replies").mapInArrow(run, "shard int, chunk long, xy binary, xy_count binary, parent_z binary, z_count binary")


def mapped(blob: bytes) -> np.ndarray:
    """The bytes as a memory-mapped file, whose name is gone at once."""
    with tempfile.NamedTemporaryFile(delete=False) as f:
        f.write(blob)
    out = np.memmap(f.name, np.uint8, "r")
    os.unlink(f.name)
    return out


def answered(sent: DataFrame, hot: dict[int, int], whole: int, keep_tries: bool) -> DataFrame:
    """(shard, chunk, p2, l3, l2, p3, hot_keys, hot_counts, hot_followers, trie): answers, in the order asked; stored."""
    words = np.array(sorted(hot), U)

    def run(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        asked = [unpack_sorted(x) for x in t["xy"].to_pylist()]
        xy, place = ranked(np.concatenate(asked))
        xy_count = np.bincount(place, np.concatenate([unpack(x) for x in t["xy_count"].to_pylist()]), len(xy)).astype(np.int64)
        at, keys, ends = 0, [], [0]
        for a, x in zip(asked, t["parent_z"].to_pylist(), strict=True):
            k = unpack_sorted(x)
            keys.append(place[at : at + len(a)][(k >> U(32)).astype(np.int64)].astype(U) << U(32) | k & U(0xFFFFFFFF))
            at += len(a)
            ends.append(ends[-1] + len(k))
        key, z_place = ranked(np.concatenate(keys))
        z_count = np.bincount(z_place, np.concatenate([unpack(x) for x in t["z_count"].to_pylist()]), len(key)).astype(np.int64)
        seen = z_count > 0
        parent, z = (key >> U(32)).astype(np.int64), key & U(0xFFFFFFFF)
        node = xy_count > 0
        node[parent[seen]] = True
        number = np.cumsum(node) - 1
        blob = Trie.build(xy[node], xy_count[node], number[parent[seen]], z[seen], z_count[seen], hot, whole, words)
        trie = Trie(mapped(blob))
        first, pair = trie.pairs(xy)
        third = trie.triples(pair[parent], z)
        code = lambda codes, i, none: np.where(i >= 0, codes[np.maximum(i, 0)], none).astype(np.uint8) if len(codes) else np.full(len(i), none, np.uint8)
        p2, l3, l2, p3 = code(trie.p2, pair, NONE), code(trie.l3, pair, 0), code(trie.l2, first, 0), code(trie.p3, third, NONE)
        out, at = ([], [], [], []), 0
        for i, a in enumerate(asked):
            mine = place[at : at + len(a)]
            at += len(a)
            for column, value in zip(out, (p2[mine], l3[mine], l2[mine], p3[z_place[ends[i] : ends[i + 1]]]), strict=True):
                column.append(pack(value))
        # hot contexts: followers of one word; counts and followers of two
        x, y = xy >> U(32), xy & U(0xFFFFFFFF)
        ones, twos = np.isin(x, words), np.isin(x, words) & np.isin(y, words)
        k1, i1 = np.unique(x[ones & (xy_count > 0)], return_counts=True)
        own = seen & twos[parent]
        k2, back = np.unique(xy[parent[own]], return_inverse=True)
        rows = [(int(k) << 32 | UNKNOWN, 0, int(n)) for k, n in zip(k1, i1, strict=True)]
        rows += [(int(k), int(c), int(n)) for k, c, n in zip(k2, np.bincount(back, z_count[own], len(k2)), np.bincount(back, minlength=len(k2)), strict=True)]
        none = [None] * len(asked)
        columns = [pa.array([shard] * (len(asked) + 1), pa.int32()), pa.array([*t["chunk"].to_pylist(), None], pa.int64()), *(pa.array([*o, None], pa.binary()) for o in out)]
        hot_rows = pa.array([*none, [{"key": k, "n": n, "followers": f} for k, n, f in rows]], pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64()), ("followers", pa.int64())])))
        return pa.table([*columns, hot_rows, pa.array([*none, blob if keep_tries else None], pa.binary())], names=["shard", "chunk", "p2", "l3", "l2", "p3", "hot", "trie"])

    schema = "shard int, chunk long, p2 binary, l3 binary, l2 binary, p3 binary, hot array<struct<key:long,n:long,followers:long>>, trie binary"
    return stored(sent.groupBy("shard").applyInArrow(run, schema), "answers")


def score(docs: DataFrame, held: F.Column, model_path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, learned from the rows not held; a stored
    table. model_path: a folder for the model, one trie a shard."""
    chunks, own_words = chunked(docs, held)
    tokens = own_words.agg(F.sum("tokens")).first()[0] or 0
    ranges, shards = tokens // (8 * RANGE) + 1, 2 * tokens // SHARD + 1
    words = count_words(own_words, ranges)
    drop_stored(own_words)
    totals = words.agg(F.sum("train"), F.sum("distinct")).first()
    n, v = totals[0] or 0, totals[1] or 0

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {}
            for numbers, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = unpack(counts)
                found |= dict(zip(unpack(numbers)[c * HOT > n].tolist(), c[c * HOT > n].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    # fewer than HOT words have over a HOT-th of the tokens each
    hot = {r["word"]: r["n"] for r in words.select("numbers", "counts").mapInArrow(heavy, "word long, n long").distinct().collect()} if n else {}
    hot[BEGIN] = chunks.select(F.explode("held").alias("h")).where("NOT h").count()
    hot_words = np.array(sorted(hot), U)
    told = words.groupBy("chunk").agg(F.collect_list(F.struct("range", "numbers", "counts")).alias("replies"))
    answers = answered(sent_grams(chunks.join(told, "chunk"), hot_words, shards), hot, max(n, 1), model_path is not None)
    if model_path:
        answers.where("trie IS NOT NULL").select("shard", "trie").write.parquet(model_path)
    shared = answers.where("chunk IS NULL").select(F.explode("hot").alias("h")).groupBy("h.key").agg(F.sum("h.n").alias("n"), F.sum("h.followers").alias("followers")).orderBy("key").collect()
    key, count, followers = (np.array([r[c] for r in shared], np.int64) for c in ("key", "n", "followers"))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def of_hot(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, followers) of hot contexts; 0 where there are none."""
        if not len(key):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        i = np.minimum(np.searchsorted(key, keys.astype(np.int64)), len(key) - 1)
        there = key[i] == keys.astype(np.int64)
        return np.where(there, count[i], 0), np.where(there, followers[i], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                doc_ids, held_, sizes, order, ids, replies, said = (b.column(c)[row].as_py() for c in range(7))
                word, c = words_of(order, ids, replies)
                g = grams(word, learned(held_, sizes), sizes, hot_words, shards)
                said = sorted(said, key=lambda r: r["shard"])
                p2, l3, l2, p3 = (np.r_[VALUES[np.concatenate([unpack(r[name]) for r in said])] if said else np.zeros(0), last] for name, last in (("p2", 0.0), ("l3", 1.0), ("l2", 1.0), ("p3", 0.0)))
                x, y = g.xy >> U(32), g.xy & U(0xFFFFFFFF)
                one = np.flatnonzero(np.isin(x, hot_words))
                if len(one):
                    total = np.array([hot[w] for w in x[one].tolist()])
                    l2[one] = np.where(total > 0, DISCOUNT * of_hot(x[one] << U(32) | U(UNKNOWN))[1] / np.maximum(total, 1), 1.0)
                    two = one[np.isin(y[one], hot_words)]
                    total, more = of_hot(g.xy[two])
                    l3[two] = np.where(total > 0, DISCOUNT * more / np.maximum(total, 1), 1.0)
                    scale = np.ones(len(g.xy))
                    scale[two] = max(n, 1) / np.maximum(total, 1)
                    p3[: len(g.parent)] *= scale[g.parent]
                base = (c.astype(float) + 1) / (n + v + 1)
                p = p3[g.triple] + l3[g.context] * (p2[g.pair] + l2[g.pair] * base)
                begins = np.cumsum([0, *sizes])[:-1]
                per_doc = lambda a: np.add.reduceat(a, begins)  # noqa: E731, B023
                columns = [doc_ids, held_, sizes, per_doc((c > 0).astype(np.int64)), [n] * len(sizes), per_doc(np.log10(base)), per_doc(np.log10(p))]
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(columns, arrow, strict=True)], schema=arrow)

    asked = answers.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("shard", "p2", "l3", "l2", "p3")).alias("said"))
    whole = chunks.join(told, "chunk").join(asked, "chunk", "left").select("doc_ids", "held", "sizes", "order", "ids", "replies", F.coalesce("said", F.array()).alias("said"))
    out = stored(whole.mapInArrow(run, schema), "scores")
    drop_stored(chunks, words, answers)
    return out


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text"), is_held_out())
