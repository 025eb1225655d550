"""Every query of the subpackage over small tables: awkward rows, empty tables, clashing columns, and brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from riskweave.llm import base, bpe, fingerprints, mpeg_audio, near_dups, packing, pii, quality, sharding, toxicity, url_filters
from riskweave.llm.registry import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
#: Names that the operators use inside or return.
CLASHING = "row key part shift before ids band node comp weight pos kept kept_id kept_key rows doc id y fold _mark view0 view1 range place guest found sketch host_ rule_ _score fp size shard slot".split()


def written(spark, folder, docs, labels=(), pages=(), more=()):
    df = spark.createDataFrame(docs, DOCS)
    for c in more:
        df = df.withColumn(c, F.lit("kept"))
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    df.selectExpr("doc_id DIV 3 AS conv_id", "CAST(IF(doc_id % 4 = 0, NULL, doc_id) AS long) AS turn", "lang AS role", "text").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def labelled(prose, n=120):
    """Documents of which a quarter is toxic and a fifth bad, with their labels."""
    r, docs, labels = random.Random(3), [], []
    for i in range(n):
        words = prose(i, 30 + i % 20).split()
        toxic, bad = i % 4 == 0, i % 5 == 1
        for _ in range(4 * toxic):
            words.insert(r.randrange(len(words)), r.choice(("morlock", "morlin", "scum", "grubzit")))
        text = " ".join(f"{w.upper()}!!" for w in words) if bad else " ".join(words)
        docs.append((i, text, ("en", "de", None)[i % 3], f"s{i % 4}", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def odd(spark, prose, tmp_path_factory):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    docs, labels = labelled(prose)
    long_ = " ".join(prose(i, 5000) for i in range(12))
    docs += [(200, None, None, None, None), (None, "no id at all", "en", "s", 3), (None, None, None, None, None), (201, "", "en", "s", 0), (202, " \n ", "en", "s", 3), (203, long_, "en", "s", len(long_)), (204, "x" * 300_000, "en", "s", 300_000)]
    docs += [(205, "é😀 tie", "en", "s", 6), (205, "another text of one id", "en", "s", 6)] + [docs[7]] * 5 + [(206 + i, docs[9][1], "en", "s", 1) for i in range(4)]
    labels += [(None, 1, 1), (3, None, None), (5, 0, 1), (203, 1, 0)]
    pages = [(i, u, None) for i, u in enumerate([None, "", "http://example.org/en/1?x#y", "no", "x://" + "a" * 300_000, "https://a.com/fr/1", "https://a.com/fr/1", "://", "HTTP://EXAMPLE.ORG/ES/2", "https://notes.example.net/é\n"])] + [(None, "https://b.net/", "h"), (3, "no", None)]
    folder = written(spark, tmp_path_factory.mktemp("odd"), docs, labels, pages)
    return folder, docs, pages


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_rows(spark, odd, name):
    folder, docs, pages = odd
    out = QUERIES[name](spark, folder).collect()
    key = "page_id" if name == "op8_url_filters" else "doc_id"
    given = Counter(r[0] for r in (pages if key == "page_id" else docs))
    if name in ("op11_prefix_trie", "op13_collocations"):  # neither has a row for each document
        assert out or name == "op13_collocations"
    elif name == "op3_packing":
        assert Counter(r[key] for r in out if r["start"] == 0) == given
    else:
        assert Counter(r[key] for r in out) == given
    text = {d[0]: d[1] or "" for d in docs if d[0] not in (None, 205)}
    same = {"op12_lm_scores": ["n_tokens", "base_score"], "op1_toxicity": ["score"], "op2_sharding": ["shard", "text_crc32"], "op4_fingerprints": ["fingerprint", "n_chars"], "op5_media_columns": ["media_sha256", "feature"], "op6_near_dedup": ["class_id"], "op9_pii": ["spans"], "op10_bpe": ["ids_sha256"]}
    by_text = defaultdict(set)
    for r in out:
        if name in same and r["doc_id"] in text:
            by_text[text[r["doc_id"]]].add(tuple(r[c] for c in same[name]))
    assert all(len(v) == 1 for v in by_text.values())


@pytest.mark.parametrize("name", [*sorted(QUERIES), "pipeline"])
def test_empty_table(spark, tmp_path, name):
    folder = written(spark, tmp_path, [])
    assert (cp.run if name == "pipeline" else QUERIES[name])(spark, folder).isEmpty()


def test_clashing_columns(spark, prose):
    """Extra columns pass through every operator with a general interface, whatever their names."""
    docs, labels = labelled(prose, 40)
    df, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("kept"))
    pages = df.withColumn("url", F.lit("https://a.com/x"))
    results = {
        "toxicity": toxicity.score(df, toxicity.fit(df, known)), "quality": quality.score(df, quality.fit(df, known)), "near": near_dups.keep_one(df), "pii": pii.find_pii(df, mask=True), "packing": packing.pack(df),
        "url": url_filters.judge(pages, url_filters.fit(steps=2)), "media": mpeg_audio.read_media(mpeg_audio.encode_media(df)), "bpe": bpe.encode_column(df.drop("ids")), "next": fingerprints.with_next(df, "doc_id", ["text"]),
    }
    for name, out in results.items():
        rows = out.collect()
        assert rows, name
        mine = [c for c in CLASHING if not (name == "bpe" and c == "ids")]
        assert all(r[c] == "kept" for r in rows[:5] for c in mine), name


def test_pipeline_keeps_columns(spark, prose, tmp_path):
    docs, labels = labelled(prose, 40)
    folder = written(spark, tmp_path, docs, labels, more=("pii", "quality_score", "key", "part", "_score"))
    step = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, step, folder)
        assert out.columns == step.columns and all(r["pii"] == r["quality_score"] == "kept" for r in out.collect())
        step = base.stored(out, "step")
    assert cp.STAGES[-1][1](spark, step, folder).select("doc_id").distinct().count() == step.count()


def naive_near(codes, reach=5):
    you = [i for i, v in enumerate(codes) if v & 16]
    return sum(any(abs(i - j) <= reach for j in you) for i, v in enumerate(codes) if v & 15)


@pytest.mark.parametrize("k", [1, 99, 100, 101, 700])
def test_near_hits_at_every_size(k):
    """One rule for short and long texts: each hit's nearest second-person word on either side."""
    text = ("you scum " + "filler " * 20) * k
    lexicon = toxicity.Lexicon(["scum"])
    f = dict(zip(toxicity.FEATURES, toxicity.dense(text, lexicon), strict=True))
    assert round(np.expm1(f["near_second"])) == k == naive_near(lexicon.codes(toxicity.words_of(text)))
    r = random.Random(k)
    codes = [r.choice((0, 0, 0, 0, 1, 2, 16)) for _ in range(300)]
    hit, you = [i for i, v in enumerate(codes) if v & 15], [i for i, v in enumerate(codes) if v & 16]
    assert toxicity.near_hits(hit, you) == naive_near(codes)


def test_obfuscated_terms():
    lex = toxicity.Lexicon(["morlock", "grub*", "scum"])
    code = {w: lex.codes([w])[0] for w in ("morlock", "m0rlock", "m*rlock", "mor*lock", "grubzit", "gr*bzit", "grub", "scvm", "sc*m", "s**m", "*", "mor1ock", "river")}
    assert code["morlock"] == 1 and code["grubzit"] == 2 and all(code[w] == 4 for w in ("m0rlock", "m*rlock", "mor*lock", "gr*bzit", "sc*m"))
    assert all(code[w] == 0 for w in ("scvm", "s**m", "*", "river"))


def test_repeated_labelled_rows_are_one(spark, prose):
    """A labelled doc_id with 50,000 rows brings one to the driver."""
    docs, labels = labelled(prose, 40)
    many = spark.createDataFrame(docs, DOCS).unionByName(spark.range(50_000).select(F.lit(2).cast("long").alias("doc_id"), F.lit(docs[2][1]).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")))
    known = spark.createDataFrame(labels, LABELS)
    for label, inputs in ((F.max("toxic"), ["text"]), (F.min("quality"), quality.INPUTS)):
        rows = base.training_rows(many, known, label, 1000, inputs).collect()
        free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
        assert sorted(r["doc_id"] for r in rows) == free
    few = base.training_rows(many.where("doc_id < 9"), known, F.max("toxic"), 3, ["text"]).collect()
    assert len(few) == 3 and all(r["doc_id"] < 9 for r in few)  # the limit comes after the join


def test_labels_of_one_kind_warn(spark, prose):
    docs, labels = labelled(prose, 40)
    df, one = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], LABELS)
    with pytest.warns(UserWarning, match="both kinds"):
        assert {r["toxicity"] for r in toxicity.score(df, toxicity.fit(df, one)).collect()} == {0.0}
    with pytest.warns(UserWarning, match="both kinds"):
        assert {r["quality_score"] for r in quality.score(df, quality.fit(df, one)).collect()} == {1.0}


def walked(trees, x):
    """The margin of one row, node by node."""
    total = trees.start
    for feature, threshold, value in trees.trees:
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(x[feature[node]] > threshold[node])
        total += value[node - len(feature)]
    return total


def stepped(iso, m):
    """Linear between the calibration's points, flat outside."""
    if m <= iso.x[0]:
        return iso.y[0]
    for (a, p), (b, q) in zip(zip(iso.x, iso.y), zip(iso.x[1:], iso.y[1:])):
        if m <= b:
            return q if b == a else p + (q - p) * (m - a) / (b - a)
    return iso.y[-1]


def naive_words(text):
    return re.findall(r"[^\W_](?:[\w@$!*|'’-]*\w)?", (text or "").lower())


def naive_terms(rows):
    """The lexicon from (text, toxic) training rows: terms with enough words before them in toxic rows, far likelier there."""
    forms = lambda w: [w] + [f"{w[:n]}*" for n in (4, 5, 6) if len(w) > n]
    before, holds, size = defaultdict(set), [Counter(), Counter()], Counter(y for _, y in rows)
    for t, y in rows:
        words = naive_words(t)
        holds[y].update({f for w in words for f in forms(w)})
        if y:
            for a, w in zip([""] + words, words):
                for f in forms(w):
                    before[f].add(a)
    odds = lambda f: np.log((holds[1][f] + 0.5) / (size[1] + 1) / ((holds[0][f] + 0.5) / (size[0] + 1)))
    kept = {f for f, a in before.items() if len(a) >= max(toxicity.LEAST, toxicity.SHARE * size[1]) and odds(f) >= toxicity.LOG_ODDS}
    return {f for f in kept if not any(f"{f[:n]}*" in kept for n in (4, 5, 6) if len(f.rstrip("*")) > n)}


def naive_toxic(text, terms):
    """The toxicity features for texts without look-alike characters."""
    text = text or ""
    words, n = naive_words(text), max(1, len(naive_words(text)))
    listed, begins = [w in terms for w in words], [any(f"{w[:k]}*" in terms for k in (4, 5, 6)) for w in words]
    hit, you = [i for i in range(len(words)) if listed[i] or begins[i]], [i for i, w in enumerate(words) if w in toxicity.SECOND]
    near = sum(any(abs(i - j) <= 5 for j in you) for i in hit)
    caps = sum(len(w) > 2 and w.isupper() for w in text.split())
    size = max(1, len(text))
    return [np.log(1 + sum(listed)), sum(listed) / n, len({words[i] for i in hit}), np.log(1 + sum(begins)), sum(begins) / n, np.log(1 + near), len(you) / n, 0.0, 0.0, sum(c.isupper() for c in text) / size, caps / n, text.count("!") / n, text.count("?") / n, (text.count("!!") + text.count("??")) / n, np.log(1 + len(words))]


def test_toxicity_query(spark, prose, tmp_path):
    docs, labels = labelled(prose, 300)
    folder = written(spark, tmp_path, docs, labels[:200])
    out = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, folder).collect()}
    model = toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:200], LABELS))
    terms = naive_terms([(docs[i][1], y) for i, _, y in labels[:200] if zlib.crc32(str(i).encode()) % 5])
    assert terms == model.lexicon.words | {f"{x}*" for x in model.lexicon.stems} and terms
    for i, t, *_ in docs:
        expected = stepped(model.calibration, walked(model.trees, naive_toxic(t, terms)))
        assert abs(out[i]["score"] - expected) < 1e-9 and out[i]["predicted"] == int(out[i]["score"] >= 0.5)
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert np.mean([out[i]["predicted"] == t for i, _, t in labels[200:]]) >= 0.97


def test_quality_query(spark, prose, tmp_path):
    docs, labels = labelled(prose, 300)
    folder = written(spark, tmp_path, docs, labels[:200])
    out = {r["doc_id"]: r for r in quality.op7_quality(spark, folder).collect()}
    model = quality.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:200], LABELS))
    for i, t, lang, source, n in docs[::7]:
        odds = []
        for view, calibrated, x in zip(model.views, model.calibrations, (naive_content(t), naive_metadata(docs, source, lang, n)), strict=True):
            z = [min(8, max(-8, (a - m) / s)) for a, m, s in zip(x, view.mean, view.scale, strict=True)]
            p = min(1 - 1e-4, max(1e-4, stepped(calibrated, sum(a * w for a, w in zip([*z, 1], view.w, strict=True)))))
            odds.append(np.log(p / (1 - p)))
        c = model.combined
        m = sum(min(8, max(-8, (o - a) / s)) * w for o, a, s, w in zip(odds, c.mean, c.scale, c.w[:2], strict=True)) + c.w[2]
        assert abs(out[i]["score"] - 1 / (1 + np.exp(-m))) < 1e-6
    assert np.mean([out[i]["keep"] == q for i, q, _ in labels[200:]]) >= 0.97


def test_metadata_view_sees_no_text():
    assert "text" not in quality.metadata.__code__.co_varnames


def of_junk(r, kind, n=24):
    """Plain words, or such with one of two kinds of junk."""
    words = [r.choice(("river", "stone", "garden", "window", "letter", "market")) for _ in range(n)]
    if kind == "echo":
        words = [w for w in words[: n // 3 + 1] for _ in range(3)]
    return " ".join(w + "!!" * (kind == "bangs") for w in words)


def test_both_views_teach(spark, tmp_path):
    """Labels know one kind of junk and half of the sources. The other kind comes from known sources, and the known kind from other
    sources: each view can learn the rest from the other only, and does."""
    r, docs, labels = random.Random(5), [], []
    names, taken = [], set()
    for i in range(400):
        if zlib.crc32(f"site{i}".encode()) % quality.SOURCES not in taken and len(names) < 20:
            taken.add(zlib.crc32(f"site{i}".encode()) % quality.SOURCES)
            names.append(f"site{i}")
    groups = [("labelled", range(10), "bangs")] * 3 + [("pool", range(10), "echo"), ("pool", range(10, 20), "bangs")] * 3
    for i in range(6000):
        group, sources, junk = groups[i % len(groups)]
        s = r.choice(sources)
        text = of_junk(r, junk if s % 2 else "plain", r.randrange(15, 40))
        docs.append((i, text, "en", names[s], len(text)))
        if group == "labelled":
            labels.append((i, int(s % 2 == 0), 0))
    df, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    before, after = (fitted(df, known, rounds) for rounds in (0, quality.ROUNDS))
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 0 and groups[d[0] % len(groups)][0] == "pool"]
    right = lambda model, k, junk: np.mean([(model.views[k].margin(np.array([x]))[0] >= 0) == (names.index(d[3]) % 2 == 0) for d in held if groups[d[0] % len(groups)][2] == junk for x in [(quality.content(d[1]), quality.metadata(d[3], d[2], d[4], model.known))[k]]])
    content, metadata = [right(m, 0, "echo") for m in (before, after)], [right(m, 1, "bangs") for m in (before, after)]
    assert content[0] < 0.8 and content[1] > 0.95, (content, metadata)
    assert metadata[0] < 0.93 and metadata[1] > 0.97, (content, metadata)
    scored = after.scores(*([d[i] for d in held] for i in (1, 3, 2, 4)))
    assert np.mean([(p >= 0.5) == (names.index(d[3]) % 2 == 0) for p, d in zip(scored, held, strict=True)]) > 0.97


def fitted(df, known, rounds):
    was, quality.ROUNDS = quality.co_train.__defaults__, rounds
    quality.co_train.__defaults__ = (rounds, *was[1:])
    try:
        return quality.fit(df, known)
    finally:
        quality.co_train.__defaults__, quality.ROUNDS = was, was[0]


def test_one_round_of_teaching(spark):
    """bounds() and pseudo_labelled() against loops over rows."""
    r = np.random.default_rng(3)
    x = [r.normal(size=(900, 3)), r.normal(size=(900, 2))]
    truth = x[0][:, 0] + x[1][:, 0] > 0
    views = [quality.Logistic().fit(v[:300], truth[:300].astype(float)) for v in x]
    pool = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(*x, strict=True)], "view0 array<float>, view1 array<float>").repartition(3)
    sure = [np.r_[np.abs(r.normal(size=(60, 1))) * 4, np.abs(r.normal(size=(60, 1))) * -4][:, [0] * v.shape[1]] * np.r_[1, np.zeros(v.shape[1] - 1)] for v in x]
    y = np.r_[np.ones(60), np.zeros(60)]
    limits = quality.bounds(pool, views, sure, y, 0.5, 0.4)
    for (low, high), view, v, s in zip(limits, views, x, sure, strict=True):
        m, own = np.sort(view.margin(v.astype(np.float32).astype(float))), view.margin(s)
        far = [t for t in own if (sum(y[i] == 0 for i in range(120) if own[i] <= t) + 1) / (sum(own <= t) + 2) >= quality.PRECISION]
        up = [t for t in own if (sum(y[i] == 1 for i in range(120) if own[i] >= t) + 1) / (sum(own >= t) + 2) >= quality.PRECISION]
        assert low == max(far) or (low <= max(far) and abs(np.searchsorted(m, low) / len(m) - 0.2) < 0.01)
        assert high == min(up) or (high >= min(up) and abs(np.searchsorted(m, high) / len(m) - 0.8) < 0.01)
    assert not np.isinf(limits[0]).all() and not np.isinf(limits[1]).all()
    said = [[None if lo < m < hi else float(m >= hi) for m in view.margin(v.astype(np.float32).astype(float))] for view, v, (lo, hi) in zip(views, x, limits, strict=True)]
    for k, (g, h, n) in enumerate(quality.pseudo_labelled(pool, views, limits, views)):
        rows = [i for i in range(900) if said[1 - k][i] is not None and said[k][i] is None]
        assert n == len(rows) > 20
        expected = views[k].slopes(x[k][rows].astype(np.float32).astype(float), np.array([said[1 - k][i] for i in rows]), np.ones(len(rows)))
        assert np.allclose(g, expected[0], atol=1e-4) and np.allclose(h, expected[1], atol=1e-4)


def naive_content(text):
    """The content view's features, character by character and word by word."""
    text = text or ""
    raw = text.encode()
    size = max(1, len(raw))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    count = lambda chars: sum(b < 128 and chr(b) in chars for b in raw)
    classes = [lower, upper, "0123456789", ".", ",;:", "#$%&*+/<=>@\\^_`|~{}[]", "!?", " \n\t\r"]
    words, lines = text.split(), text.split("\n")
    n, lengths = max(1, len(words)), [len(x) for x in lines]
    mean = sum(lengths) / len(lengths)
    sd = (sum((x - mean) ** 2 for x in lengths) / len(lengths)) ** 0.5
    out = [count(c) / size for c in classes] + [sum(b >= 128 for b in raw) / size]
    out += [count(upper) / max(1, count(lower) + count(upper)), count(classes[5]) / n, count("!?") / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n]
    out += [np.log(1 + len(set(words))) - 0.8 * np.log(1 + len(words)), size / n, np.log(1 + len(words)), size / max(1, len(text)), np.log(1 + len(lines)), np.log(1 + mean), np.log(1 + max(lengths)), sd / (1 + mean)]
    return out + [len(set(lines)) / len(lines), sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines)]


def naive_metadata(docs, source, lang, n):
    """The metadata view's features from all records (id, text, lang, source, n_chars)."""
    home = lambda s: -1 if s is None else zlib.crc32(s.encode()) % 64
    mine = [d for d in docs if home(d[3]) == home(source)]
    sizes = sorted(d[4] for d in mine if d[4] is not None)
    cuts = [sizes[max(0, -(-len(sizes) * i // 20) - 1)] for i in range(1, 20)]
    place = sum(c < n for c in cuts) / 19
    same = [d for d in mine if d[2] == lang or (d[2] not in quality.LANGS and lang not in quality.LANGS)]
    repeated = max(0.0, 1 - len(set(sizes)) / len(sizes))
    langs = [float(lang == x) for x in quality.LANGS]
    return [*langs, float(not any(langs)), *(float(i == home(source)) for i in range(64)), 0.0, np.log(1 + n), np.log(1 + n) ** 2, np.log(1 + len(mine)), repeated, place, abs(2 * place - 1), len(same) / len(mine)]


def test_packing_query(spark, prose, tmp_path):
    docs, _ = labelled(prose, 60)
    docs += [(90, None, "en", "s", 0), (91, "", "en", "s", 0), (92, prose(5, 3000), "en", "s", 0)]
    folder = written(spark, tmp_path, docs)
    library = Tokenizer.from_file(packing.default_path())
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t, *_ in docs}
    place, used = 0, Counter()
    for p in packing.op3_packing(spark, folder).orderBy("sequence_id", "offset").collect():
        assert p["sequence_id"] * 1024 + p["offset"] == place and p["offset"] + p["length"] <= 1024 and p["start"] == used[p["doc_id"]]
        piece = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(piece) == p["length"] and p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)) and p["doc_tokens"] == len(ids[p["doc_id"]])
        place += p["length"]
        used[p["doc_id"]] += p["length"]
    assert dict(used) == {i: len(x) for i, x in ids.items()}


def naive_sketch(text):
    """(distinct anchors, {hash: first position}) of closed syncmers, straight from the definition."""
    h = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed=seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    raw, k, s = text.encode("utf-32-be"), fingerprints.K, fingerprints.S
    found = {}
    if len(text) < k:
        found = {signed(h(raw)) >> 32: 0} if text else {}
    else:
        g = [signed(h(raw[4 * i : 4 * (i + s)])) for i in range(len(text) - s + 1)]
        for i in range(len(text) - k + 1):
            inner = g[i : i + k - s + 1]
            if min(inner) in (inner[0], inner[-1]):
                a = h(struct.pack("<q", inner[-1]), h(struct.pack("<q", inner[0])))
                found.setdefault(signed(a) >> 32, i)
    kept = sorted(found)[: max(fingerprints.SKETCH, len(found) // fingerprints.SPARSE)]
    return len(found), {x: found[x] for x in kept}


def naive_likeness(a, b):
    (n, x), (m, y) = a, b
    if not n or not m:
        return float(n == m)
    cut = min(max(s) if len(s) < k else 1 << 40 for k, s in (a, b))
    x, y = ({h: p for h, p in s.items() if h <= cut} for s in (x, y))
    offsets = [x[h] - y[h] for h in x.keys() & y.keys()]
    grids = [Counter((o + shift) // fingerprints.SLACK for o in offsets) for shift in (0, fingerprints.SLACK // 2)]
    return max(max(g.values(), default=0) for g in grids) / len(x.keys() | y.keys())


def test_fingerprint_query(spark, prose, tmp_path):
    r = random.Random(1)
    texts = [prose(i, n) for i, n in enumerate((1, 2, 3, 40, 300, 5, 80, 3000, 60))] + ["", None, "é😀" * 30, "aaaa" * 20, prose(4, 300), "".join(r.choice("abcé😀 ") for _ in range(5000))]
    docs = [(3 * i, t, "en", "s", 0) for i, t in enumerate(texts)]
    folder = written(spark, tmp_path, docs)
    out = {row["doc_id"]: row for row in fingerprints.op4_fingerprints(spark, folder).collect()}
    spell = lambda sk: "" if not sk[0] else f"{sk[0]:08x}" + "".join(f"{(h << 32 | p) & (1 << 64) - 1:016x}" for h, p in sorted(sk[1].items()))
    for i, t in enumerate(texts):
        t, nxt, row = t or "", texts[(i + 1) % len(texts)] or "", out[3 * i]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        own, changed, follows = map(naive_sketch, (t, edited, nxt))
        assert (row["n_chars"], row["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (row["fingerprint"], row["edited_fingerprint"]) == (spell(own), spell(changed))
        assert row["near_edited"] == pytest.approx(naive_likeness(own, changed)) and row["near_next"] == pytest.approx(naive_likeness(own, follows))


def test_likeness_is_positional(spark, prose):
    a, b = prose(1, 120), prose(2, 120)
    df = spark.createDataFrame([(f"{a} {b}", f"{b} {a}"), (f"{a} {b}", f"{a} {b}"), (f"{a} {b}", f"xx {a} {b}"), (a, b)], "x string, y string")
    df = df.select(fingerprints.anchors("x").alias("fx"), fingerprints.anchors("y").alias("fy")).select(fingerprints.sketch("fx").alias("sx"), fingerprints.sketch("fy").alias("sy"))
    got = [row[0] for row in df.select(fingerprints.likeness("sx", "sy")).collect()]
    assert 0.2 < got[0] < 0.65 and got[1] == 1 and got[2] > 0.9 and got[3] < 0.1
    back = df.withColumn("ux", fingerprints.unpacked(fingerprints.fingerprint("sx"))).withColumn("uy", fingerprints.unpacked(fingerprints.fingerprint("sy")))
    assert [row[0] for row in back.select(fingerprints.likeness("ux", "uy")).collect()] == got


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def linked_classes(texts):
    """{index: class} by exact overlaps of all texts that share a shingle."""
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders, same, links = defaultdict(list), {}, set()
    for i, b in enumerate(bags):
        root[find(i)] = find(same.setdefault(texts[i] or "", i))
        seen = Counter()
        for s in b:
            for j in holders[s]:
                seen[j] += 1
            holders[s].append(i)
        for j in seen:
            both = sum((b & bags[j]).values())
            if 9 * both >= 4 * (b.total() + bags[j].total()):  # an overlap of 0.8 of the union
                links.add((j, i))
                root[find(i)] = find(j)
    return {i: find(i) for i in range(len(texts))}, links


def test_near_dedup_query_finds_every_link(spark):
    """All links of the sf0.01 documents, counted through an inverted index."""
    sf = "/root/testdata/sf0.01"
    rows = base.table(spark, sf, "documents", "doc_id", "text").collect()
    expected, links = linked_classes([r["text"] for r in rows])
    got = {r["doc_id"]: r["class_id"] for r in near_dups.op6_near_dedup(spark, sf).collect()}
    assert links and all(got[rows[i]["doc_id"]] == got[rows[j]["doc_id"]] for i, j in links)
    theirs = defaultdict(set)
    for i, c in expected.items():
        theirs[c].add(rows[i]["doc_id"])
    mine = defaultdict(set)
    for i, c in got.items():
        mine[c].add(i)
    assert {frozenset(x) for x in mine.values()} == {frozenset(x) for x in theirs.values()}


def test_common_passage_does_not_pair_all(spark, prose):
    """Texts that share a passage that makes them 0.7 alike: no pair of them is tested, while the linked ones among them are found."""
    passage = prose(999, 90)
    texts = [f"{passage} {' '.join(f'w{i}x{k}' for k in range(18))}" for i in range(300)]
    texts += [texts[5] + " end", texts[6] + " end"]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, comp long, text string")
    signed = near_dups.signed(rows.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), F.col("doc_id").alias("comp"), "weight", "bag")
    pairs = {(r["a"], r["b"]) for r in near_dups.prefix_pairs(signed).collect()}
    assert {(5, 300), (6, 301)} <= pairs and len(pairs) < 20


def test_prefix_pairs_lose_nothing(spark):
    """Pieces of one text, some with a word changed, so that overlaps of exactly 0.8 and all size ratios occur."""
    r, texts = random.Random(8), []
    for _ in range(250):
        start = r.randint(0, 6)
        words = [f"w{i * i % 23}" for i in range(start, start + r.randint(6, 34))]
        if r.random() < 0.4:
            words[r.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    signed = near_dups.signed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(F.col("doc_id").alias("node"), F.col("doc_id").alias("comp"), "weight", "bag")
    pairs = {(x["a"], x["b"]) for x in near_dups.prefix_pairs(signed).collect()}
    bags = [bag(t) for t in texts]
    true = {(i, j) for j in range(len(texts)) for i in range(j) if 9 * sum((bags[i] & bags[j]).values()) >= 4 * (bags[i].total() + bags[j].total())}
    assert len(true) > 500 and true <= pairs
    assert any(10 * sum((bags[i] & bags[j]).values()) == 8 * (bags[i] | bags[j]).total() for i, j in true)


def pii_base(text):
    out = []
    for k, rx in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0, 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_query_digests(spark, prose, tmp_path):
    docs, _ = labelled(prose, 20)
    texts = [f"{d[1]} é😀 a{i}@b.co 4111 1111 1111 1111 +1 (375) 555-4393 10.0.0.{i} password=e3b3ed{i}c99" for i, d in enumerate(docs)] + [None, "", "4111-1111 1111 1112", "1.2.3.4.5.6.7.8"]
    folder = written(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    names = ("email", "ip", "card", "phone")
    for r in pii.op9_pii(spark, folder).collect():
        spans = pii_base(texts[r["doc_id"]])
        assert [r[f"n_{n}"] for n in names] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        spelled = [f"{names[k]}:{a}:{b}" for a, k, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert set(spelled) <= set(every) and ("password" not in (texts[r["doc_id"]] or "") or any(x.startswith("secret:") for x in every))


def test_bpe_query_digests(spark, prose, tmp_path):
    texts = [prose(i, 50) for i in range(20)] + [None, "", " ", "İΣς ﬁ <|endoftext|> é", "x" * 5000, prose(3, 30_000), "<|startoftext|>" + prose(4, 20_000)]
    folder = written(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    for r in bpe.op10_bpe(spark, folder).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_steps(prose):
    e = bpe.encoder(bpe.default_path())
    for t in (prose(1, 3000), "é " * 900, "x" * 700, " a  b\n\tc " * 300, "İΣς <|endoftext|> " * 90):
        whole = e.encode(t)
        for step in (1, 7, 100):
            assert b"".join(e.stream(t, step)) == whole


def test_sharding_query_columns(spark, prose, tmp_path):
    texts = [prose(i, 1 + i % 40) for i in range(200)] + [None, "", "é😀"]
    folder = written(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    for r in sharding.op2_sharding(spark, folder).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


@pytest.mark.parametrize("exact", [0, 5, 10_000])
def test_sharding_by_capacity(spark, prose, exact, monkeypatch):
    monkeypatch.setattr(sharding, "EXACT", exact)
    texts = [prose(i, 5 + i % 60) for i in range(150)] + [prose(1, 60)] * 4
    placed = sharding.pack(sharding.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), capacity=3000).toPandas()
    assert len(placed) == len(texts) and placed.groupby("shard")["size"].sum().max() <= 3000 and (placed.groupby("key")["shard"].nunique() == 1).all()


def test_url_model_on_unseen_hosts():
    """Five parts of the labelled table, each judged by a model of the others: no host is in two parts."""
    rows, right, n = url_filters.read_labelled(), Counter(), Counter()
    assert len({url_filters.split_url(u)[0] for u, _ in rows}) > 0.9 * len(rows)
    for k in range(5):
        part = lambda u: zlib.crc32(url_filters.split_url(u)[0].encode()) % 5  # noqa: E731, B023
        w = url_filters.fit([x for x in rows if part(x[0]) != k], more=url_filters.composed())
        for u, y in rows:
            if part(u) == k:
                f = url_filters.features(*url_filters.split_url(u))
                right[y] += (w[f].sum() / np.sqrt(len(f)) + w[-1] >= 0) == bool(y)
                n[y] += 1
    assert right[0] >= 0.85 * n[0] and right[1] >= 0.6 * n[1]
    made = url_filters.composed()
    assert len(made) > 2000 and len({u for u, _ in made}) > 0.97 * len(made) and {y for _, y in made} == {0, 1}


def test_pipeline_against_plain_python(spark, prose, tmp_path):
    """run()'s rows from the models' scores, exact overlaps, masks and the tokenizers library, without Spark."""
    docs, labels = labelled(prose, 160)
    base_text = prose(77, 80)
    docs += [(900, f"{base_text} mail a@b.example now", "en", "s1", 100), (901, f"{base_text} mail a@b.example now today", "en", "s2", 101), (902, None, "en", "s1", 0), (903, "", "en", "s1", 0), docs[3]]
    folder = written(spark, tmp_path, docs, labels)
    df, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    good = quality.fit(df, known)
    left = [d for d in docs if good.scores([d[1]], [d[3]], [d[2]], [d[4]])[0] >= 0.5]
    mean = toxicity.fit(spark.createDataFrame(left, DOCS), known)
    left = [d for d in left if mean.scores([d[1]])[0] < 0.5]
    classes, _ = linked_classes([d[1] for d in left])
    library = Tokenizer.from_file(packing.default_path())
    tokens = {i: len(library.encode(pii.masked(t, pii.find_spans(t)) or "", add_special_tokens=False).ids) + 1 for i, t, *_ in left}
    of = {left[i][0]: c for i, c in classes.items()}
    rows = cp.run(spark, folder).collect()
    kept = {r["doc_id"] for r in rows}
    assert len(kept) == len(set(classes.values())) == len({of[i] for i in kept}) and kept <= set(of)
    assert all(r["doc_tokens"] == tokens[r["doc_id"]] for r in rows)
    assert sum(r["length"] for r in rows) == sum(tokens[i] for i in kept) and len({900, 901} & kept) == 1


def test_texts_of_common_passages(spark):
    """Texts of 5 of 20 common passages, of which pairs with 4 of 5 in common are just under 0.8: only links leave the join."""
    r = random.Random(1)
    passages = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(20)]
    texts = [" ".join(r.sample(passages, 5)) for _ in range(600)]
    signed = near_dups.signed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(F.col("doc_id").alias("node"), F.col("doc_id").alias("comp"), "weight", "bag")
    pairs = {(x["a"], x["b"]) for x in near_dups.prefix_pairs(signed).collect()}
    bags = [bag(t) for t in texts]
    true = {(i, j) for j in range(len(texts)) for i in range(j) if 9 * sum((bags[i] & bags[j]).values()) >= 4 * (bags[i].total() + bags[j].total())}
    assert true <= pairs and len(pairs) < 2 * len(true) + 20


def test_pipeline_over_awkward_rows(spark, odd):
    """Nulls, empty and very long texts, ties and repeats through all stages: one of each class of the kept rows is packed, whole."""
    folder, docs, _ = odd
    df, known = spark.createDataFrame(docs, DOCS), spark.read.parquet(f"{folder}/labels.parquet")
    good = quality.fit(df, known)
    left = [d for d, s in zip(docs, good.scores([d[1] for d in docs], [d[3] for d in docs], [d[2] for d in docs], [d[4] for d in docs]), strict=True) if s >= 0.5]
    mean = toxicity.fit(spark.createDataFrame(left, DOCS), known)
    left = [d for d in left if mean.scores([d[1]])[0] < 0.5]
    classes, _ = linked_classes([d[1] for d in left])
    rows = cp.run(spark, folder).collect()
    starts = [r["doc_id"] for r in rows if r["start"] == 0]
    assert len(starts) == len(set(classes.values()))
    library = Tokenizer.from_file(packing.default_path())
    lengths = defaultdict(set)
    for i, t, *_ in left:
        lengths[i].add(len(library.encode(pii.masked(t, pii.find_spans(t)) or "", add_special_tokens=False).ids) + 1)
    assert all(r["doc_tokens"] in lengths[r["doc_id"]] for r in rows)


@pytest.mark.parametrize("most", [0, near_dups.MOST_NEIGHBOURS])
def test_components(spark, monkeypatch, most):
    """Chains, stars, rings and loose edges, by windows and by aggregates joined back."""
    monkeypatch.setattr(near_dups, "MOST_NEIGHBOURS", most)
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(60)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 301), (302, 303), (7, 7)]
    edges += [(400 + r.randrange(50), 400 + r.randrange(50)) for _ in range(60)]
    r.shuffle(edges)
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x["node"]: x["comp"] for x in near_dups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in joined}
