"""LM scores against a plain trigram model, with and without hot words; the trie against a dictionary."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskweave.llm import ngram_trie as nt

SCHEMA = "doc_id long, text string"
D = nt.DISCOUNT


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base, score) in exact arithmetic."""
    split = lambda t: re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c, c2, c3 = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = split(t)
            c.update(w)
            s = ["<", "<", *w]
            c2.update(zip(s[1:], w))
            c3.update(zip(s, s[1:], w))
    total2, total3, f2, f3 = Counter(), Counter(), Counter(), Counter()
    for (y, z), k in c2.items():
        total2[y] += k
        f2[y] += 1
    for (x, y, z), k in c3.items():
        total3[x, y] += k
        f3[x, y] += 1
    n, v, out = c.total(), len(c), []
    for i, t in rows:
        w, base, score = split(t), 0.0, 0.0
        s = ["<", "<", *w]
        for x, y, z in zip(s, s[1:], w):
            p = (c[z] + 1) / (n + v + 1)
            base += math.log10(p)
            if total2[y]:
                p = max(c2[y, z] - D, 0) / total2[y] + D * f2[y] / total2[y] * p
            if total3[x, y]:
                p = max(c3[x, y, z] - D, 0) / total3[x, y] + D * f3[x, y] / total3[x, y] * p
            score += math.log10(p)
        out.append((i, held(i), len(w), sum(c[z] > 0 for z in w), n, base, score))
    return out


@pytest.fixture(scope="module")
def texts(prose):
    r = random.Random(3)
    rows = [(i, prose(i, 5 + i % 60)) for i in range(150)]
    rows += [(200 + i, " ".join(r.choice(("the", "a", "of", f"w{r.randrange(40)}")) for _ in range(80))) for i in range(60)]
    rows += [(300 + i, rows[5][1]) for i in range(9)] + [(400, None), (None, "no id"), (401, ""), (402, " \n\x0b"), (403, "Étude étude ÉTUDE the THE\x1cthe x\x00y 😀"), (404, prose(4, 4000)), rows[3], rows[3], (405, "unseen" if zlib.crc32(b"405") % 7 == 2 else "x")]
    held = next(i for i in range(500, 600) if zlib.crc32(str(i).encode()) % 7 == 2)
    return rows + [(held, "never seen words here the of river"), (held, "the unseen the unseen the")]


def compared(got, expected):
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    got, expected = sorted((tuple(r) for r in got), key=key), sorted(expected, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[5] == pytest.approx(e[5], abs=1e-6) and abs(g[6] - e[6]) <= 0.051 * e[2], (g, e)
    assert abs(sum(g[6] - e[6] for g, e in zip(got, expected, strict=True))) < 0.02 * sum(e[2] for e in expected)


@pytest.mark.parametrize("hot", [0, 40, 10**9])
def test_against_plain_model(spark, texts, tmp_path, monkeypatch, hot):
    """No word hot, some, and all; several chunks, ranges and shards."""
    for name, value in (("HOT", hot), ("CHUNK", 700), ("RANGE", 20), ("SHARD", 3000)):
        monkeypatch.setattr(nt, name, value)
    spark.createDataFrame(texts, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    compared(nt.op12_lm_scores(spark, str(tmp_path)).collect(), brute(texts))


def test_default_sizes_and_model(spark, texts, tmp_path):
    out = nt.score(spark.createDataFrame(texts, SCHEMA), nt.is_held_out(), f"{tmp_path}/model").collect()
    compared(out, brute(texts))
    tries = spark.read.parquet(f"{tmp_path}/model").collect()
    assert tries and all(len(nt.Trie(bytes(r["trie"])).firsts) for r in tries)
    learned = [r for r in out if not r["held_out"] and r["n_tokens"] > 20]
    assert np.mean([r["score"] > r["base_score"] for r in learned]) > 0.95


def test_nothing_to_learn(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = nt.score(spark.createDataFrame([(held, "a b")], SCHEMA), nt.is_held_out()).collect()
    assert [tuple(r) for r in rows] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert nt.score(spark.createDataFrame([], SCHEMA), nt.is_held_out()).isEmpty()


def test_probabilities_sum_to_one(spark, prose):
    """All words after one context, the unknown one too, take up the whole probability but for the quantisation."""
    free = [i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    held = [i for i in range(9999) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(free[0], "a b a c"), (free[1], "a b a b"), (free[2], "b c a b")]
    asked = [(i, f"a b {w}") for i, w in zip(held, ("a", "b", "c", "new"), strict=False)] + [(held[9], "a b")]
    got = {r["doc_id"]: r["score"] for r in nt.score(spark.createDataFrame(rows + asked, SCHEMA), nt.is_held_out()).collect()}
    exact = {r[0]: r[6] for r in brute(rows + asked)}
    assert all(abs(got[i] - exact[i]) < 0.2 for i in got)


def test_elias_fano():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        for top in (1, 50, 10**6, 10**14):
            a = np.sort(r.integers(0, top, n, np.uint64))
            e = nt.EliasFano(nt.EliasFano.build(a))
            i = np.arange(n)
            assert (e.get(i) == a).all()
            q = np.r_[r.integers(0, top + 9, 300, np.uint64), a]
            begin, end = np.sort(r.integers(0, n + 1, (2, len(q))), 0)
            want = [b + int(np.searchsorted(a[b:c], v)) for v, b, c in zip(q, begin, end, strict=True)]
            assert (e.successor(q, begin, end) == want).all()


def test_trie_lookups():
    r = np.random.default_rng(6)
    grams = Counter(map(tuple, r.integers(1, 30, (3000, 3)).tolist()))
    pairs = defaultdict(int)
    for (x, y, _), c in grams.items():
        pairs[x, y] += c
    xy = np.array(sorted(x << 32 | y for x, y in pairs), np.uint64)
    place = {int(k): i for i, k in enumerate(xy)}
    rows = sorted((place[x << 32 | y], z, c) for (x, y, z), c in grams.items())
    at, z, c = (np.array(a) for a in zip(*rows, strict=True))
    blob = nt.Trie.build(xy, np.array([pairs[int(k) >> 32, int(k) & 0xFFFFFFFF] for k in xy]), at, z.astype(np.uint64), c, {}, 1, np.zeros(0, np.uint64))
    trie = nt.Trie(nt.mapped(blob))
    asked = r.integers(0, 33, (5000, 3))
    _, pair = trie.pairs(asked[:, 0].astype(np.uint64) << np.uint64(32) | asked[:, 1].astype(np.uint64))
    third = trie.triples(pair, asked[:, 2].astype(np.uint64))
    for (x, y, w), p, t in zip(asked.tolist(), pair, third, strict=True):
        assert (p >= 0) == ((x, y) in pairs) and (t >= 0) == ((x, y, w) in grams)
    total = Counter(a for a, _, _ in rows)
    assert all(abs(nt.VALUES[code] / (max(n - D, 0) / sum(k for b, _, k in rows if b == a)) - 1) < 0.06 for code, (a, _, n) in list(zip(trie.p3, rows, strict=True))[::37])
