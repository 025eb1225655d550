"""Sharding, fingerprints, near-dedup, classifiers and the pipeline against brute force on small tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskweave.llm import fingerprints, near_dups, quality, sharding, toxicity
from riskweave.llm.base import slots
from riskweave.llm.models import BoostedTrees, Isotonic, Logistic

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def naive_bfd(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= s]
        i = min(fit, key=lambda i: (room[i], i)) if fit else len(room)
        if i == len(room):
            room.append(max(capacity, s))
        room[i] -= s
    return sorted(room)


def test_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(60):
        sizes = [r.choice((1, 3, 7, 20, 50, 90)) for _ in range(r.randint(1, 80))]
        runs, bins = sharding.best_fit_decreasing([(s, s, n) for s, n in Counter(sizes).items()], 100)
        room = defaultdict(lambda: 100)
        for s, b, k in runs:
            room[b] -= s * k
        assert sorted(room.values()) == naive_bfd(sizes, 100) and len(room) == bins and min(room.values()) >= 0


def test_tree():
    r, tree, keys = random.Random(3), sharding.CapacityTree(), set()
    for i in range(400):
        k = (r.randint(0, 60), i)
        tree.insert(k)
        keys.add(k)
        if r.random() < 0.4:
            gone = r.choice(sorted(keys))
            tree.remove(gone)
            keys.discard(gone)
        q = (r.randint(0, 60), -1)
        assert tree.ceiling(q) == min((k for k in keys if k >= q), default=None)


def test_sharding(spark, prose, tmp_path):
    texts = [prose(i, 1 + i % 90) for i in range(400)] + [prose(1, 50)] * 30 + [None, "", ""]
    docs_of(spark, texts).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op2_sharding(spark, str(tmp_path)).toPandas()
    assert len(out) == len(texts) and set(out["shard"]) == set(range(8))
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    home = defaultdict(set)
    for i, s in zip(out["doc_id"], out["shard"], strict=True):
        home[texts[i] or ""].add(s)
    assert all(len(s) == 1 for s in home.values())
    loads = out.groupby("shard")["size"].sum()
    assert loads.max() <= 1.05 * loads.mean()


def test_sharding_one_huge_group(spark):
    classes = [(1, 900, 1)] + [(2, 10, 70)]
    loads = defaultdict(int)
    for c, b, k in sharding.pack_evenly(classes, 8):
        loads[b] += {1: 900, 2: 10}[c] * k
    assert sorted(loads.values()) == [100] * 7 + [900]
    assert sharding.pack_evenly([], 8) == []


def test_slots(spark):
    df = spark.range(300).select(F.when(F.col("id") < 200, "hot").alias("g"), F.col("id"))
    got = slots(df, "g", ["id"], ["id"], "slot", buckets=4).toPandas()
    for _, rows in got.groupby("g", dropna=False):
        assert sorted(rows["slot"]) == list(range(len(rows)))


def test_fingerprints(spark, prose, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_A_RANGE", 5)
    texts = [prose(i, n) for i, n in enumerate((1, 2, 40, 300, 5, 80, 33, 60, 500, 9))] + ["", None, "é😀" * 30, "x", prose(3, 300), prose(8, 500)]
    ids = [3 * i * i % 101 for i in range(len(texts))]
    docs_of(spark, texts, ids).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprints.op4_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(range(len(texts)), key=lambda i: ids[i])
    for at, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[ids[i]]["n_chars"] == len(t) and got[ids[i]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    a, b = got[ids[3]], got[ids[14]]
    assert a["fingerprint"] == b["fingerprint"] and len(a["fingerprint"]) >= 8 + 16 * fingerprints.SKETCH
    assert got[ids[10]]["fingerprint"] == "" and 0.1 < a["near_edited"] < 0.7


@pytest.mark.parametrize("hot", [0, 40, 1000, None])
def test_one_id_on_half_of_all_rows_is_split(spark, monkeypatch, hot):
    monkeypatch.setattr(fingerprints, "ROWS_A_RANGE", 5)
    rows = [(7 * i % 101, f"text {i}") for i in range(60)] + [(hot, f"row {i % 70}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    signed = lambda t: (h := xxhash.xxh64_intdigest(t, seed=42)) - (h >> 63 << 64)
    place = lambda r: (fingerprints.LAST_ID if r[0] is None else r[0], signed(r[1]), r[1])
    order = sorted(rows, key=place)
    want = Counter((*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order))
    out = fingerprints.with_next(df, "doc_id", ["text"])
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in out.collect()) == want
    keyed = df.selectExpr(f"coalesce(doc_id, {fingerprints.LAST_ID}) AS key", "xxhash64(text) AS tie")
    starts, first = fingerprints.range_starts(keyed)
    sizes = Counter(r[0] for r in keyed.select(fingerprints.starts_before(starts)).collect())
    assert max(sizes.values()) < 25 and len(sizes) > 12 and first[0] == order[0][0]


def test_anchors_of_parts_are_those_of_the_whole(spark):
    r = random.Random(5)
    made = lambda n: "".join(r.choice("ab\u00e9\U0001f600") for _ in range(n))
    rows = [(made(n), made(m)) for n in (*range(0, 16), 40) for m in (*range(0, 16), 24, 60)]
    df = spark.createDataFrame([(a, b, a + made(i % 30), a + b) for i, (a, b) in enumerate(rows)], "first string, rest string, longer string, whole string")
    df = df.withColumn("found", F.expr(fingerprints.anchors_sql("longer", packed=True)))
    df = df.select(F.expr(fingerprints.joined_sql("first", "found", "rest")).alias("joined"), F.expr(fingerprints.anchors_sql("whole", packed=True)).alias("packed"), fingerprints.anchors("whole").alias("anchors"))
    # arrays that may hold nulls would be sorted as objects
    assert not df.select(F.expr(fingerprints.anchors_sql("'text'", packed=True)).alias("x")).schema["x"].dataType.containsNull
    for row in df.collect():
        assert row["joined"] == row["packed"] == [a["anchor"] >> 32 << 32 | a["position"] for a in row["anchors"]]


def test_edited_texts_are_not_hashed_anew(spark, tmp_path):
    docs_of(spark, ["some text", "another one"]).write.parquet(str(tmp_path / "documents.parquet"))
    plan = fingerprints.op4_fingerprints(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "sort_array(found#" in line]
    assert len(made) == 1 and "AS edited_sketch" in made[0] and "xxhash64(substring(" in made[0]


def test_syncmers_are_closed_and_context_free(spark):
    t = "".join(random.Random(5).choice("abcdef") for _ in range(200))
    df = spark.createDataFrame([(t,), ("zz" + t + "yyy",)], "text string")
    s = [[(a["position"], a["anchor"]) for a in r[0]] for r in df.select(fingerprints.anchors("text")).collect()]
    assert {(p + 2, h) for p, h in s[0]} <= set(s[1])
    hashes = [r[0] for r in spark.createDataFrame([(t[i : i + 10],) for i in range(191)], "s string").select(F.xxhash64(F.encode("s", "UTF-32"))).collect()]
    expected = [i for i in range(189) if min(hashes[i : i + 3]) in (hashes[i], hashes[i + 2])]
    assert [p for p, _ in s[0]] == expected
    wide = [a["position"] for a in df.limit(1).select(fingerprints.anchors("text", 14, 8)).first()[0]]
    h8 = [r[0] for r in spark.createDataFrame([(t[i : i + 8],) for i in range(193)], "s string").select(F.xxhash64(F.encode("s", "UTF-32"))).collect()]
    assert wide == [i for i in range(187) if min(h8[i : i + 7]) in (h8[i], h8[i + 6])]


def test_bag_minhash_is_unbiased():
    rng, est, true = np.random.default_rng(1), [], []
    for _ in range(120):
        x = near_dups.mix(rng.integers(0, 2**63, 150).astype(np.uint64))
        w1 = rng.integers(0, 6, 150)
        w2 = np.where(rng.random(150) < 0.3, rng.integers(0, 20, 150), w1)
        s = near_dups.bag_minhash([(x[w > 0], w[w > 0]) for w in (w1, w2)] + [(x[:0], w1[:0])])
        est.append((s[0] == s[1]).mean())
        true.append(np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum())
    assert abs(np.mean(est) - np.mean(true)) < 0.02 and np.std(np.array(est) - true) < 0.07


def brute_classes(texts):
    bags = []
    for t in texts:
        w = (t or "").lower().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if (texts[i] or "") == (texts[j] or "") or both and both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                root[find(i)] = find(j)
    out = defaultdict(set)
    for i in range(len(texts)):
        out[find(i)].add(i)
    return {frozenset(v) for v in out.values()}


def near_texts(prose):
    r, texts = random.Random(7), []
    for base in range(6):
        words = prose(base, 120).split()
        for _ in range(7):
            w = words[:]
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return texts + texts[:5] + [prose(50 + i, 30) for i in range(10)] + ["", None, " ", "one two", "one  two", "the " * 80, "the " * 78, "the " * 20]


@pytest.mark.parametrize("fruitful", [0, 20])
def test_near_dedup(spark, prose, monkeypatch, fruitful):
    monkeypatch.setattr(near_dups, "FRUITFUL", fruitful)
    texts = near_texts(prose)
    got = near_dups.near_duplicates(docs_of(spark, texts).repartition(3)).toPandas()
    mine = defaultdict(set)
    for i, c in zip(got["doc_id"], got["class_id"], strict=True):
        mine[c].add(i)
    assert {frozenset(v) for v in mine.values()} == brute_classes(texts)
    assert got[got["kept"]]["class_id"].is_unique and got["kept"].sum() == len(mine) and all(c == min(v) for c, v in mine.items())


def test_keep_one(spark, prose):
    texts = near_texts(prose)
    df = docs_of(spark, texts).withColumn("key", F.lit("x"))
    kept = near_dups.keep_one(df.unionByName(df)).collect()
    assert len(kept) == len(brute_classes(texts)) and kept[0]["key"] == "x"


def test_star_contraction(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    comp = {r["node"]: r["comp"] for r in near_dups.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {comp[i] for i in range(41)} == {0} and {comp[i] for i in (100, 101, 102)} == {100}
    assert near_dups.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_models():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = BoostedTrees().fit(x[:1500], y[:1500])
    assert ((t.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    z = (x @ [2, -1, 0, 0, 0.5] > 0).astype(float)
    assert ((Logistic().fit(x[:1500], z[:1500]).margin(x[1500:]) > 0) == z[1500:]).mean() > 0.95
    p = Isotonic().fit(t.margin(x), y)(np.linspace(-9, 9, 50))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() <= p.max() <= 1


def labelled(spark, prose, n=400):
    texts, rows, r = [], [], random.Random(9)
    for i in range(n):
        w = prose(i, 30 + i % 40).split()
        toxic, bad = i % 4 == 0, i % 5 == 1
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(("morlock", "morlin", "scum", "grubzit")))
        texts.append(" ".join(f"{x.upper()}!!" for x in w) if bad else " ".join(w))
        rows.append((i, int(not bad), int(toxic)))
    texts += [None, "", " "]
    return docs_of(spark, texts), spark.createDataFrame(rows[: n * 3 // 4], "doc_id long, quality int, toxic int"), rows


def test_toxicity(spark, prose):
    docs, labels, rows = labelled(spark, prose)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs.withColumn("toxicity", F.lit("x")), model).collect()}
    assert len(got) == 403 and all(0 <= v <= 1 for v in got.values()) and got[400] == got[401]
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, _, t in rows[300:]]) >= 0.97
    assert {r["toxicity"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    f = dict(zip(toxicity.FEATURES, toxicity.dense("You scum! sc@m sc*m GO AWAY!! really?", toxicity.Lexicon(["scum"])), strict=True))
    assert f["hits"] > 0 and f["near_second"] > 0 and f["capital_words"] > 0 and f["exclaim_rate"] > 0 and f["mixed_rate"] > 0 and f["obfuscated"] > 0


def test_quality(spark, prose):
    docs, labels, rows = labelled(spark, prose)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == 403 and np.mean([(got[i] >= 0.5) == bool(q) for i, q, _ in rows[300:]]) >= 0.97
    assert {r["quality_score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {1.0}


def test_pipeline(spark, prose, tmp_path):
    import corpus_pipeline as cp

    docs, labels, rows = labelled(spark, prose, 200)
    extra = docs_of(spark, [f"{prose(7, 60)} mail a@b.example now", f"{prose(7, 60)} mail a@b.example now today"], [900, 901])
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    step, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, f in cp.STAGES:
        step = f(spark, step, str(tmp_path))
        step.write.parquet(str(tmp_path / name))
        step = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"] for r in step.select("doc_id").collect()})
        if name != "packing":
            assert set(step.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    bad, toxic = {i for i, q, _ in rows if not q}, {i for i, _, t in rows if t}
    good = set(range(203)) | {900, 901}
    assert len(seen[0] ^ (good - bad)) <= 5 and len((seen[0] - toxic) ^ seen[1]) <= 5
    assert len({900, 901} & seen[2]) == 1 and seen[2] <= seen[1] and seen[3] == seen[2] == seen[4]
    masked = {r["text"] for r in spark.read.parquet(str(tmp_path / "pii")).where("doc_id >= 900").collect()}
    assert all("[EMAIL]" in t for t in masked)
    again = cp.run(spark, str(tmp_path))
    assert again.count() == step.count()


def test_entry_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "riskweave", tmp_path / "riskweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and 'w2_ranking' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
