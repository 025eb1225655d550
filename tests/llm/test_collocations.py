"""Collocations against a brute-force count and the SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from riskweave.llm import collocations as co
from riskweave.llm import packed

SCHEMA = "doc_id long, text string, lang string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if a >= 30}
        inside = defaultdict(int)
        for p, a in good.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in good.items():
            if len(p) > 1 and 100 * inside[p] < 80 * a:
                score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def texts():
    r, rows = random.Random(2), []
    words = "the of and to river Stone été naïve 😀 x\x00y café\x1ctwo".split(" ") + ["rare%d" % i for i in range(40)]
    for i in range(400):
        parts = [r.choice(words[: r.choice((4, 11, 51))]) for _ in range(r.randrange(60))]
        for _ in range(3):
            parts.insert(r.randrange(len(parts) + 1), r.choice(("New York City", "once upon a time", "a b a b a b", "one two. three", "hot hot hot hot hot")))
        rows.append((i, "".join(p + r.choice((" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?")) for p in parts), ("en", "fr", None, "und", "")[i % 5]))
    return rows + [(1, None, "en"), (None, "", None), (2, " \t\n", "xx"), (3, "!", "xx")] + [rows[0]] * 40


def test_against_brute_force_and_sql(spark, texts, tmp_path):
    spark.createDataFrame(texts, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    mine, expected = rows_of(co.op13_collocations(spark, str(tmp_path))), brute(texts)
    assert len(expected) > 70 and mine == expected
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duck.sql(co.OP13_SQL).select(*COLUMNS).fetchall()) == expected


def test_small_chunks_and_ranges(spark, texts, monkeypatch):
    """Many chunks, ranges and steps give the same; so does a short list."""
    monkeypatch.setattr(co, "CHUNK", 150)
    monkeypatch.setattr(co, "RANGE", 900)
    monkeypatch.setattr(co, "steps", lambda raw: packed.steps(raw, 17))
    assert rows_of(co.collocations(spark.createDataFrame(texts, SCHEMA).repartition(3), 20)) == brute(texts, 20)


def test_empty(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).isEmpty()
    assert co.collocations(spark.createDataFrame([(1, None, None), (2, "few words", "en")], SCHEMA)).isEmpty()


def test_local_support_loses_nothing():
    """A phrase that is frequent overall is frequent in one shard at its share, however it is spread."""
    r = np.random.default_rng(5)
    shards, total = {}, Counter()
    size = r.integers(1, 4000, 16)
    for s in range(16):
        counts = Counter(r.integers(0, 60, size[s]).tolist())
        total.update(counts)
        least = max(1, -(-30 * int(size[s]) // int(size.sum())))
        shards[s] = (least, [(np.array(sorted(counts), np.uint64), np.array([counts[k] for k in sorted(counts)], np.uint32))])
    keys, counts = co.mined(shards)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {k: v for k, v in total.items() if v >= 30}


def test_packed_arrays():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        for kind in (np.uint8, np.uint32, np.uint64):
            a = r.integers(0, np.iinfo(kind).max, n, kind, endpoint=True)
            assert (packed.unpack(packed.pack(a)) == a).all()
        a = np.sort(r.integers(0, np.iinfo(np.uint64).max, n, np.uint64, endpoint=True))
        assert (packed.unpack_sorted(packed.pack_sorted(a)) == a).all()
        cuts = packed.targets(a, 7)
        assert (np.diff(cuts) >= 0).all() and (not n or 0 <= cuts[0] and cuts[-1] < 7)
