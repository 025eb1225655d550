"""The prefix trie against a brute-force one, at component limits that leave all, some or nothing to the tasks."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in sorted(rebuilt.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for p, m in members.items():
        subtree = [q for q in members if q[: len(p)] == p]
        children = lambda q: [x for x in members if len(x) == len(q) + 1 and x[: len(q)] == q]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in subtree if q)
        ended = ",".join(str(c) for c in m if len(rebuilt[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children(p)), sum(not children(q) for q in subtree), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def talk():
    """Shared heads, copies, a first turn that most share, a long chain, turnless conversations, ties, repeats and nulls."""
    r, rows = random.Random(4), []
    for c in range(60):
        first = ("system", "be kind é") if c % 3 else ("user", f"hi {c % 2}")
        turns = [first] + [("user" if i % 2 else "assistant", f"t{r.randrange(3)}") for i in range(r.randrange(12))]
        rows += [(c, i, a, b) for i, (a, b) in enumerate(turns)]
    rows += [(c, i, "user", f"same {i}") for c in (100, 105, 110, 115, 120) for i in range(10)]  # copies
    rows += [(200, i, "user", "x") for i in range(60)]  # one turn again and again
    rows += [(301, 0, "user", "its base is absent"), (302, 0, None, None), (303, None, "user", "first"), (303, 0, "user", "second"), (303, 0, "user", "tie")]
    rows += [(400, 1, "a", "b")] * 3 + [(None, 0, "user", "no conversation"), (-7, 0, "user", "negative"), (-7, 1, "user", "more")]
    return rows


@pytest.mark.parametrize("limit", [4, pt.LIMIT])
def test_against_brute_force(spark, talk, limit):
    df = spark.createDataFrame(talk, SCHEMA).repartition(5)
    assert rows_of(pt.prefix_trie(df, limit)) == brute(talk)


def test_blocks(spark, talk, monkeypatch):
    """Conversations of many blocks have the nodes of unblocked ones; chunks of ends are joined in order."""
    monkeypatch.setattr(pt, "BLOCK", 3)
    monkeypatch.setattr(pt, "CHUNK", 2)
    assert rows_of(pt.prefix_trie(spark.createDataFrame(talk, SCHEMA), 10)) == brute(talk)


def test_query_and_sql(spark, talk, tmp_path):
    spark.createDataFrame(talk, SCHEMA).withColumn("node", F.lit("extra")).write.parquet(f"{tmp_path}/conversations.parquet")
    mine = rows_of(pt.op11_prefix_trie(spark, str(tmp_path)))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert mine == sorted((tuple(x) for x in duck.sql(pt.OP11_SQL).select(*COLUMNS).fetchall()), key=repr) == brute(talk)


def test_empty(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).isEmpty()
    assert rows_of(pt.prefix_trie(spark.createDataFrame([(301, 0, "user", "x")], SCHEMA))) == brute([(301, 0, "user", "x")])  # turnless: the root alone


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest"])
def test_rolled(shape):
    n, r = 3000, np.random.default_rng(1)
    parent = {"chain": np.arange(n) - 1, "star": np.r_[-1, np.zeros(n - 1, int)], "random": np.r_[-1, [r.integers(0, i) for i in range(1, n)]], "forest": np.array([-1 if i % 50 == 0 else r.integers(i - i % 50, i) for i in range(n)])}[shape]
    depth, top = np.zeros(n, np.int64), np.arange(n)
    for i in range(n):
        if parent[i] >= 0:
            depth[i], top[i] = depth[parent[i]] + 1, top[parent[i]]
    values = r.integers(0, 1 << 40, (n, 2))
    expected = values.copy()
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            expected[parent[i]] += expected[i]
    mixed = r.permutation(n)
    back = np.argsort(mixed)
    got = pt.rolled(back[top[mixed]], np.where(parent[mixed] >= 0, back[parent[mixed]], -1), depth[mixed], values[mixed])
    assert (got == expected[mixed]).all()
