"""Phrase collocations by SON partitioning: shards are mined at lowered support, the union is counted exactly.

Texts become chunks: arrays of word numbers with piece breaks, one language each, beside their words. A phrase of 1 to 4 words is
a 64-bit key made from its words' hashes; a chunk counts its phrases locally and sends them as sorted blocks to ranges of keys.
SHARDS shards deal the chunks of a language; a phrase that occurs SUPPORT times has in one shard at least its share of SUPPORT
(the shard's part of the language's words, rounded up). Each range mines every shard completely at this local support,
unites what is frequent in some shard, and counts this union exactly over all shards. That a shard is mined range by range
keeps it from having to fit in a task; a hot phrase is one entry a chunk.

One chunk that holds a frequent phrase is then asked for its words. Cuts, scores, what longer phrases cover, and ranks are joins
and aggregates of frequent phrases only, with exact decimal arithmetic.

Keys are 64 bits: among m distinct phrases of a language, m^2 / 2^65 pairs are expected to share one (under 0.001 for the largest
check tables).

Defined cases: a null lang is `und`, a null or empty text has no words; doc_id is not read, repeated rows count again; ties as the contract ranks them; an empty
table gives no rows; long texts are read step by step, and a chunk ends at a piece break only, so that no phrase is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import drop_stored, ship, sliced, stored, table
from .packed import Numbers, U, mix, pack, pack_sorted, steps, targets, unpack, unpack_sorted, word_hashes

SUPPORT, LONGEST, SHARDS, TOP = 30, 4, 16, 2000
CHUNK = 1_000_000  # words of a chunk
RANGE = 2_000_000  # entries of a range of keys
PARTS = 64
BREAK = b"\xff"  # in no UTF-8 text
FACTOR = U(0x9E3779B97F4A7C15)
#: A-Z lower-cased, tabs as spaces, piece breaks marked.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, lang, n words, vocabulary, ids): a stored table. Number 0 is a break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        open_: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}
        made = (context.partitionId() if context else 0) << 32

        def closed(lang):
            nonlocal made
            (numbers, parts), made = open_.pop(lang), made + 1
            sizes.pop(lang)
            ids = np.concatenate(parts)
            row = [made], [lang], [int((ids > 0).sum())], [b" ".join(list(numbers)[1:])], [pack(ids)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "lang", "n", "vocabulary", "ids"])

        for whole in batches:
            for b in sliced(whole):
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for part in steps(text.translate(TABLE) + BREAK):
                        numbers, parts = open_.setdefault(lang, (Numbers({BREAK: 0}), []))
                        parts.append(numbers.of(part.replace(BREAK, b" \xff ").split()))
                        sizes[lang] = sizes.get(lang, 0) + len(parts[-1])
                        if sizes[lang] >= CHUNK and len(parts[-1]) and not parts[-1][-1]:
                            yield closed(lang)
                    if sum(sizes.values()) >= 2 * CHUNK:
                        yield closed(max(sizes, key=sizes.get))
        for lang in list(open_):
            yield closed(lang)

    ship(docs.sparkSession)
    words = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return stored(words.mapInArrow(run, "chunk long, lang string, n long, vocabulary binary, ids binary"), "chunks")


def phrase_keys(vocabulary: bytes, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, keys) of the phrases of 1, 2, ... LONGEST words."""
    h = np.concatenate([np.zeros(1, U), word_hashes(vocabulary.split(b" ")) if vocabulary else np.zeros(0, U)])[ids]
    at, key, out = np.flatnonzero(ids), mix(h[ids > 0]), []
    real = ids > 0
    out.append((at, key))
    for n in range(1, LONGEST):
        go = at + n < len(ids)
        go[go] = real[at[go] + n]
        at, key = at[go], key[go]
        key = mix(key * FACTOR + h[at + n])
        out.append((at, key))
    return out


def blocks(chunks: DataFrame, ranges: int) -> DataFrame:
    """(range, lang, shard, least, chunk, keys, counts): each chunk's phrases with their counts, by ranges of keys."""
    schema = "range int, lang string, shard int, least long, chunk long, keys binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                chunk, lang, shard, least, vocabulary, ids = (b.column(c)[row].as_py() for c in range(6))
                keys = np.sort(np.concatenate([k for _, k in phrase_keys(vocabulary, unpack(ids))]))
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
                counts, keys = np.diff(first, append=len(keys)).astype(np.uint32), keys[first]
                cuts = np.searchsorted(targets(keys, ranges), np.arange(ranges + 1))
                full = np.flatnonzero(np.diff(cuts))
                columns = [pa.array(full, pa.int32()), *(pa.array([x] * len(full), t) for x, t in ((lang, pa.string()), (shard, pa.int32()), (least, pa.int64()), (chunk, pa.int64())))]
                columns += [pa.array([f(x[cuts[i] : cuts[i + 1]]) for i in full], pa.binary()) for f, x in ((pack_sorted, keys), (pack, counts))]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "lang", "shard", "least", "chunk", "keys", "counts"])

    ship(chunks.sparkSession)
    return chunks.select("chunk", "lang", "shard", "least", "vocabulary", "ids").mapInArrow(run, schema)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their summed counts, of (keys, counts) with few counts over 1."""
    keys = np.sort(np.concatenate([k for k, _ in parts]))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(first, append=len(keys))
    keys = keys[first]
    more, extra = (np.concatenate(x) for x in zip(*((k[c > 1], c[c > 1] - 1) for k, c in parts), strict=True))
    np.add.at(counts, np.searchsorted(keys, more), extra.astype(np.int64))
    return keys, counts


def found_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `wanted` in ascending keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def mined(shards: dict[int, tuple[int, list]], support: int = SUPPORT) -> tuple[np.ndarray, np.ndarray]:
    """SON: (keys, counts) of at least `support`, from {shard: (local support, blocks)}."""
    local = {s: merged(parts) for s, (_, parts) in shards.items()}
    union = np.unique(np.concatenate([local[s][0][local[s][1] >= least] for s, (least, _) in shards.items()]))
    total = np.zeros(len(union), np.int64)
    for keys, counts in local.values():
        at, there = found_in(keys, union)
        total[there] += counts[at[there]]
    return union[total >= support], total[total >= support]


def frequent(sent: DataFrame) -> DataFrame:
    """(chunk, keys, counts): frequent phrases with their exact counts, each beside one chunk that holds it."""

    def run(t: pa.Table) -> pa.Table:
        out, by_lang = ([], [], []), {}
        for lang, shard, least, chunk, keys, counts in zip(*(t[c].to_pylist() for c in ("lang", "shard", "least", "chunk", "keys", "counts")), strict=True):
            by_lang.setdefault(lang, {}).setdefault(shard, (least, [], []))
            _, parts, chunks = by_lang[lang][shard]
            parts.append((unpack_sorted(keys), unpack(counts)))
            chunks.append(chunk)
        for shards in by_lang.values():
            keys, counts = mined({s: (least, parts) for s, (least, parts, _) in shards.items()})
            if not len(keys):
                continue
            best, holder = np.full(len(keys), np.iinfo(U).max, U), np.zeros(len(keys), np.int64)
            for _, parts, chunks in shards.values():
                for (own, _), chunk in zip(parts, chunks, strict=True):
                    turn = mix(keys ^ mix(np.full(1, chunk, U)))
                    better = found_in(own, keys)[1] & (turn <= best)
                    best[better], holder[better] = turn[better], chunk
            for chunk in np.unique(holder):
                mine = holder == chunk
                for column, value in zip(out, (int(chunk), pack_sorted(keys[mine]), pack(counts[mine].astype(U))), strict=True):
                    column.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["chunk", "keys", "counts"])

    return sent.groupBy("range").applyInArrow(run, "chunk long, keys binary, counts binary")


PHRASES = "lang string, words int, phrase string, key long, a long, first array<long>, rest array<long>, inner array<long>"


def spelled(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Frequent phrases with their words and the keys of their parts: first and rest for each cut, inner for phrases inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                lang, vocabulary, ids, some = (b.column(c)[row].as_py() for c in range(4))
                keys = np.concatenate([unpack_sorted(x["keys"]) for x in some])
                counts = np.concatenate([unpack(x["counts"]) for x in some])
                order = np.argsort(keys)
                yield spell(lang, vocabulary, unpack(ids), keys[order], counts[order])

    def spell(lang, vocabulary, ids, wanted, counts):
        words, of_length = [b"", *vocabulary.split(b" ")], phrase_keys(vocabulary, ids)
        by_place = []
        for at, key in of_length:
            dense = np.zeros(len(ids), U)
            dense[at] = key
            by_place.append(dense)
        maybe = np.zeros(1 << 22, bool)
        maybe[wanted >> U(42)] = True
        out = {c: [] for c in ("words", "phrase", "key", "a", "first", "rest", "inner")}
        for n, (at, key) in enumerate(of_length, 1):
            some = np.flatnonzero(maybe[key >> U(42)])
            place, there = found_in(wanted, key[some])
            some, place = some[there], place[there]
            place, once = np.unique(place, return_index=True)
            start = at[some[once]]
            part = lambda i, k: by_place[k - 1][start + i].view(np.int64)  # noqa: E731, B023  # key of k words from the i-th
            rows = [ids[start + i] for i in range(n)]
            out["words"] += [n] * len(start)
            out["phrase"] += [b" ".join(map(words.__getitem__, x)).decode("utf-8", "replace") for x in zip(*(r.tolist() for r in rows), strict=True)]
            out["key"] += wanted[place].view(np.int64).tolist()
            out["a"] += counts[place].astype(np.int64).tolist()
            lists = {"first": [part(0, k) for k in range(1, n)], "rest": [part(k, n - k) for k in range(1, n)], "inner": [part(i, k) for k in range(2, n) for i in range(n - k + 1)]}
            for name, columns in lists.items():
                out[name] += np.stack(columns, 1).tolist() if columns else [[]] * len(start)
        kinds = {"words": pa.int32(), "phrase": pa.string(), "key": pa.int64(), "a": pa.int64()}
        arrays = [pa.array([lang] * len(out["key"]), pa.string()), *(pa.array(v, kinds.get(c, pa.list_(pa.int64()))) for c, v in out.items())]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", *out])

    asked = found.groupBy("chunk").agg(F.collect_list(F.struct("keys", "counts")).alias("found"))
    both = chunks.select("chunk", "lang", "vocabulary", "ids").join(asked, "chunk").select("lang", "vocabulary", "ids", "found")
    return stored(both.mapInArrow(run, PHRASES), "phrases")


def exact(column: str) -> str:
    return f"CAST({column} AS DECIMAL(20, 0))"


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PHRASES of at least SUPPORT occurrences, and (lang, n) with all words of each language; stored tables."""
    chunks = chunked(docs)
    dealt = chunks.withColumn("shard", F.pmod(F.xxhash64("chunk"), F.lit(SHARDS)).cast("int"))
    sizes = stored(dealt.groupBy("lang", "shard").agg(F.sum("n").alias("n")), "sizes")
    n = stored(sizes.groupBy("lang").agg(F.sum("n").alias("n")), "words")
    share = f"CAST(n AS DECIMAL(30, 0)) * {SUPPORT}"
    least = sizes.join(n.withColumnRenamed("n", "all"), "lang").select("lang", "shard", F.expr(f"greatest(1L, ({share} + all - 1) DIV greatest(all, 1))").alias("least"))
    total = n.agg(F.sum("n")).first()[0] or 0
    sent = blocks(dealt.join(least, ["lang", "shard"]), 3 * total // RANGE + 1)
    found = stored(frequent(sent), "frequent")
    out = spelled(chunks, found)
    drop_stored(chunks, sizes, found)
    return out, n


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases."""
    phrases, n = frequent_phrases(docs)
    known = phrases.select("lang", "key", "a")
    longer = phrases.where("words > 2").select("lang", F.explode("inner").alias("key"), F.col("a").alias("longer")).groupBy("lang", "key").agg(F.max("longer").alias("longer"))
    kept = phrases.where("words > 1").join(longer, ["lang", "key"], "left").where(f"longer IS NULL OR {exact('longer')} * 100 < {exact('a')} * 80")
    cuts = kept.select("lang", "key", "a", F.posexplode(F.arrays_zip("first", "rest")).alias("k", "cut")).select("lang", "key", "a", "k", "cut.first", "cut.rest")
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("key").alias(part), F.col("a").alias(count)), ["lang", part])
    cuts = cuts.withColumn("score", F.expr(f"CAST({exact('a')} * 2000000 AS DECIMAL(38, 0)) DIV ({exact('l')} + {exact('r')})"))
    lowest = cuts.groupBy("lang", "key").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "key", "c.score", "c.l", "c.r")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = kept.select("lang", "key", "phrase", "a").join(lowest, ["lang", "key"]).withColumn("part", F.pmod("key", F.lit(PARTS)))
    # the first of each part, then of those, so that a language's last task reads PARTS x top rows at most
    for by in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    out = stored(ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    drop_stored(phrases, n)
    return out


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "lang", "text"))


_GRAMS = "\n  UNION ALL ".join(
    f"SELECT lang, {k} AS words, {' || '.join(['w1', *(chr(39) + ' ' + chr(39) + f' || w{i}' for i in range(2, k + 1))])} AS phrase, [{', '.join(f'w{i}' for i in range(1, k + 1))}] AS w FROM followed WHERE w{k} IS NOT NULL" for k in range(1, LONGEST + 1)
)

OP13_SQL = f"""
WITH lowered AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT doc, lang, unnest(string_split_regex(text, '[.,;:!?\\n\\x0B\\f\\r]')) AS piece, generate_subscripts(string_split_regex(text, '[.,;:!?\\n\\x0B\\f\\r]'), 1) AS p FROM lowered),
words AS (SELECT doc, lang, p, unnest(regexp_extract_all(piece, '[^ \\t]+')) AS w, generate_subscripts(regexp_extract_all(piece, '[^ \\t]+'), 1) AS i FROM pieces),
followed AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY doc, p ORDER BY i)),
grams AS ({_GRAMS}),
counted AS (SELECT lang, words, phrase, any_value(w) AS w, count(*) AS a FROM grams GROUP BY lang, words, phrase HAVING count(*) >= {SUPPORT}),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM counted, range(1, {LONGEST}) s(i), range(2, {LONGEST}) t(k) WHERE k < words AND i + k - 1 <= words GROUP BY ALL),
kept AS (SELECT c.* FROM counted c LEFT JOIN inner_ x USING (lang, phrase) WHERE words > 1 AND (x.longer IS NULL OR 100 * x.longer < 80 * a)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, f.a AS l, s.a AS r, CAST(2000000::HUGEINT * c.a // (f.a + s.a) AS BIGINT) AS score
  FROM kept c JOIN range(1, {LONGEST}) t(k) ON k < c.words
  JOIN counted f ON f.lang = c.lang AND f.phrase = array_to_string(c.w[1:k], ' ') JOIN counted s ON s.lang = c.lang AND s.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM lowest JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
