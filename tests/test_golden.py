"""Golden vectors of FIXTURES.md on tiny DataFrames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave import params
from riskweave.functions import code as fc
from riskweave.functions import commits as fm
from riskweave.functions import paths as fp
from riskweave.functions import score as fs
from riskweave.functions import text as ft
from riskweave.operators import churn, code, coupling, explain, history, review, risk, tree
from riskweave.sources import report, snapshot, tables


def values(spark, items, f, schema="v string"):
    df = spark.createDataFrame([(x,) for x in items], schema)
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


LOG = "\n".join([
    "a1\0Alice Smith\x002026-06-20T10:00:00+00:00\0fix null deref in parser", "", "10\t2\tsrc/core/gitReader.ts", "5\t0\tsrc/core/types.ts", "",
    "b2\0Bob Jones\x002026-06-20T14:00:00+09:00\0add logo asset", "", "3\t1\tsrc/core/gitReader.ts", "-\t-\tassets/logo.png", "",
    "c3\0Carol Lee\x002026-06-19T10:00:00+00:00\0refactor util helpers", "", "2\t1\tsrc/core/{old => new}/util.ts", "",
    "d4\0Carol Lee\x002026-06-18T10:00:00+00:00\0fixes #42 broken link", "", "7\t0\tREADME.md", "4\t4\tlib/a.ts => lib/b.ts", "", "junk line", "",
])


@pytest.fixture(scope="module")
def log(spark):
    return history.parse_log(spark.createDataFrame([("r", LOG)], "repo string, value string")).cache()


def test_recorded_log(log):
    f = {r["path"]: r for r in churn.file_churn(churn.file_author(log), arrays=True).collect()}
    assert set(f) == {"src/core/gitReader.ts", "src/core/types.ts", "assets/logo.png", "src/core/new/util.ts", "README.md", "lib/b.ts"}
    g = f["src/core/gitReader.ts"]
    assert (g["commits"], g["lines_added"], g["lines_deleted"], g["bugfix_commits"]) == (2, 13, 3, 1)
    assert g["first_seen"].startswith("2026-06-20T14:00:00+09:00") and g["last_seen"].startswith("2026-06-20T10:00:00+00:00")
    assert g["authors"] == ["Alice Smith", "Bob Jones"] and (f["assets/logo.png"]["lines_added"], f["assets/logo.png"]["commits"]) == (0, 1)


def test_recorded_pairs(log):
    pairs = {(r["path_a"], r["path_b"], r["shared_commits"]) for r in coupling.co_change(log).collect()}
    assert pairs == {("src/core/gitReader.ts", "src/core/types.ts", 1), ("assets/logo.png", "src/core/gitReader.ts", 1), ("README.md", "lib/b.ts", 1)}


def touches(spark, dates, author="a", path="f"):
    rows = [("r", i + 1, d, author, path) for i, d in enumerate(dates)]
    df = spark.createDataFrame(rows, "repo string, walk_seq long, author_date string, author string, path string")
    return df.withColumns({"author_ts": F.try_to_timestamp("author_date"), "is_bugfix": F.lit(False), "added": F.lit(1).cast("long"), "deleted": F.lit(0).cast("long")})


@pytest.mark.parametrize(
    ("dates", "commits", "weight", "recent"),
    [
        (["2027-01-01", "2026-01-01"], 2, 1.5, 1), (["2027-01-01", "2026-12-02", "2026-01-01"], 3, 1.5 + 0.5 ** (30 / 365), 2), (["2026-06-01", "2026-07-01"], 2, 2, 2),
        (["2026-06-01", "not-a-date"], 2, 1, 1), (["garbage", "2026-06-01"], 2, 1, 1), (["garbage"], 1, 0, 0),
    ],
)
def test_recency(spark, dates, commits, weight, recent):
    r = churn.file_churn(churn.file_author(touches(spark, dates))).first()
    assert (r["commits"], r["recent_commits"]) == (commits, recent) and r["recency_weight"] == pytest.approx(weight)
    if dates == ["garbage"]:
        assert r["first_seen"] == r["last_seen"] == ""


def test_paths(spark):
    raw = ["src/core/{old => new}/util.ts", "src/{ => sub}/a.ts", "src/{old => }/a.ts", "lib/a.ts => lib/b.ts", "src/a=>b.ts", "src/{a}/ => x"]
    assert values(spark, raw, fp.resolve_rename)[:5] == ["src/core/new/util.ts", "src/sub/a.ts", "src/a.ts", "lib/b.ts", "src/a=>b.ts"]
    out = ["node_modules/lodash/index.js", "packages/app/node_modules/x/y.js", "dist/extension.js", "src/build/thing.js", "public/app.min.js", "Cargo.lock", "package-lock.json", "dist\\extension.js", "./dist/extension.js"]
    assert all(values(spark, out, lambda c: fp.is_excluded(c, params.EXCLUDE)))
    assert not any(values(spark, ["src/core/scorer.ts", "src/distance.ts", "src/outline.ts"], lambda c: fp.is_excluded(c, params.EXCLUDE)))
    assert not any(values(spark, out, lambda c: fp.is_excluded(c, [])))


def test_subjects(spark):
    yes = ["fix null pointer in parser", "bugfixes for the importer", "closes #12", "resolve #99 in the API", "FIX crash", "broke the date parser", "ébug"]
    no = ["prefix the config keys", "the bugbear of legacy code", 'Revert "fix the parser bug"', "cherry pick the hotfix", "", None]
    assert values(spark, yes, fm.is_bugfix) == [True] * len(yes) and values(spark, no, fm.is_bugfix) == [False] * len(no)
    assert values(spark, ["-", "12", "x", None], fm.line_count) == [0, 12, 0, 0]


@pytest.mark.parametrize(
    ("authors", "threshold", "expected"),
    [({"A": 10}, 0.05, (1, 0, 0)), ({"A": 5, "B": 5}, 0.05, (0.5, 0.5, 0)), ({"O": 80, **{f"m{i}": 4 for i in range(5)}}, 0.05, (0.8, 0.2, 5)), ({"O": 80, **{f"m{i}": 4 for i in range(5)}}, 0.03, (0.8, 0.2, 0)), ({"": 3}, 0.05, (0, 0, 0))],
)
def test_ownership(spark, authors, threshold, expected):
    rows = [("r", "f", a, n, 0, 0, 0, 0.0, 0, None, None) for a, n in authors.items()]
    k = "struct<k:struct<author_ts:timestamp,walk_seq:long>,d:string>"
    df = spark.createDataFrame(rows, f"repo string, path string, author string, commits long, bugfix_commits long, lines_added long, lines_deleted long, recency_weight double, recent_commits long, first {k}, last {k}")
    r = churn.file_churn(df, threshold).first()
    assert (r["top_share"], r["fragmentation"], r["minor_contributors"]) == pytest.approx(expected)


def links(spark, revs, pairs, **k):
    f = spark.createDataFrame([("r", p, n) for p, n in revs.items()], "repo string, path string, commits long")
    p = spark.createDataFrame([("r", a, b, n) for a, b, n in pairs], "repo string, path_a string, path_b string, shared_commits long")
    return coupling.strengths(p, f, **k)


def test_coupling(spark):
    both = {(r["path"], r["partner"]): r["strength"] for r in links(spark, {"a": 10, "b": 8}, [("a", "b", 6)]).collect()}
    assert both == {("a", "b"): 0.6, ("b", "a"): 0.6}
    assert links(spark, {"a": 10, "b": 10}, [("a", "b", 4)]).isEmpty()
    assert links(spark, {"a": 10}, [("a", "b", 9)]).first()["strength"] == 0.9 and links(spark, {"z": 1}, [("a", "b", 9)]).isEmpty()
    hub = links(spark, {"hub": 20, "p1": 6, "p2": 16, "p3": 10}, [("hub", "p1", 6), ("hub", "p2", 16), ("hub", "p3", 10)])
    assert [r["partner"] for r in coupling.partners(hub).where("path = 'hub'").orderBy("partner_rank").collect()] == ["p2", "p3", "p1"]
    assert coupling.coupling_signal(hub).where("path = 'hub'").first()["coupling"] == 0.8
    many = links(spark, {"hub": 100} | {f"p{i}": 20 for i in range(8)}, [("hub", f"p{i}", 10 + i) for i in range(8)])
    kept = coupling.partners(many).where("path = 'hub'").orderBy("partner_rank").collect()
    assert len(kept) == 5 and (kept[0]["partner"], kept[0]["strength"]) == ("p7", 0.17)


def test_mega_commits(spark):
    t = spark.createDataFrame([("r", 1, p) for p in "xyzx"], "repo string, walk_seq long, path string")
    assert coupling.co_change(t, 2).isEmpty() and coupling.co_change(t, 3).count() == 3


RAW = "repo string, path string, freq long, churn long, recency double, authors long, ownership double, coupling double, complexity double, bugfix_density double, commits long, recent_commits long"


def rows(spark, *items):
    return spark.createDataFrame([("r", *i, 0.0, 1, 1) for i in items], RAW)


def test_score(spark):
    df = rows(spark, ("top", 50, 1400, 50.0, 6, 0.9, 0.9, 900.0), ("bottom", 1, 1, 0.0, 1, 0.0, 0.0, 1.0))
    got = [(r["path"], r["score"], r["tier"]) for r in risk.in_order(risk.scored(risk.normalised(df))).collect()]
    assert got == [("top", 100, "critical"), ("bottom", 0, "low")]
    same = risk.ranked(risk.scored(risk.normalised(rows(spark, ("b", 3, 3, 1.0, 1, 0.0, 0.0, 0.0), ("a", 3, 3, 1.0, 1, 0.0, 0.0, 0.0)))))
    assert [(r["path"], r["score"], r["rank"]) for r in same.orderBy("rank").collect()] == [("a", 0, 1), ("b", 0, 2)]
    one = spark.createDataFrame([(100,)], "s int")
    cut = lambda **t: one.select(fs.tier(F.col("s"), params.merged(params.THRESHOLDS, t))).first()[0]
    assert (cut(critical=101), cut(critical=101, high=101), cut(critical=101, high=101, medium=101)) == ("high", "medium", "low")


@pytest.mark.parametrize(("commits", "recent", "trend"), [(4, 3, "rising"), (3, 3, "rising"), (2, 2, "stable"), (10, 3, "stable"), (0, 0, "stable"), (20, 2, "cooling"), (10, 0, "cooling")])
def test_trend(spark, commits, recent, trend):
    assert spark.createDataFrame([(commits, recent)], "c long, r long").select(fs.trend(F.col("c"), F.col("r"))).first()[0] == trend


def test_explanation(spark):
    two = rows(spark, ("hot", 10, 0, 8.0, 0, 0.0, 0.0, 0.0), ("cold", 2, 0, 1.0, 0, 0.0, 0.0, 0.0))
    hot = explain.explained(risk.scored(risk.normalised(two))).where("path = 'hot'").first()
    assert (hot["dominant"], hot["core_pct"]) == ("freq", 42) and hot["line"].startswith("freq 52% · recency 48%") and "changes very frequently (52%) and was changed recently (48%)" in hot["sentence"]
    w = params.merged(params.WEIGHTS, {"recency": 0.9, "bogus": 1, "freq": "x"})
    assert explain.shares(risk.normalised(two), w).where("path = 'hot'").first()["dominant"] == "recency"
    tie = rows(spark, ("x", 1, 0, 0.0, 0, 0.9, 0.9, 0.0), ("y", 1, 0, 0.0, 0, 0.1, 0.1, 0.0))
    assert explain.shares(risk.normalised(tie)).where("path = 'x'").first()["dominant"] == "ownership"
    none = explain.explained(risk.scored(risk.normalised(rows(spark, ("x", 5, 5, 1.0, 1, 0.1, 0.1, 3.0))))).first()
    assert none["dominant"] is None and none["core_pct"] == 0 and set(none["shares"]) == {0.0} and none["sentence"].startswith("Not enough history")


NESTED = ["function f() {", "  a", "x"] + ["            deep"] * 2 + ["                        deeper"] * 26 + ["            deep"] * 2 + ["}"] * 3


def content(spark, *texts):
    return spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo string, path string, content string")


@pytest.mark.parametrize(
    ("text", "expected"),
    [("a\n    b\n        c\n    d\ne", (4, 0.8, 2, 5)), ("\t      x", (2, 2, 2, 1)), ("a\n\n    \n    b\n\t", (1, 0.5, 1, 2)), ("a\r\n    b\r\n", (1, 0.5, 1, 2)), ("", (0, 0, 0, 0)), (None, (0, 0, 0, 0))],
)
def test_complexity(spark, text, expected):
    r = code.complexity(content(spark, "" if text is None else text)).first()
    assert (r["total"], r["mean"], r["max"], r["lines"]) == expected


def test_regions(spark):
    d = "            "
    files = content(spark, "\n".join(NESTED), f"{d}a\n{d}b", f"x\nx\nx\n{d}a\n\n{d}b\n{d}c\n", f"{d}a\n{d}b\n{d}c\nx\n{d}a\n{d}b\n{d}c", "")
    for f in (code.regions, code.regions_by_window):
        got = [tuple(r) for r in f(files).select("path", "start_line", "end_line", "max_depth", "line_count", "score", "severity", F.size("reasons")).orderBy("path", "start_line").collect()]
        assert got == [("0", 3, 32, 6, 30, 57, "high", 2), ("2", 3, 6, 3, 4, 23, "low", 1), ("3", 0, 2, 3, 3, 22, "low", 1), ("3", 4, 6, 3, 3, 22, "low", 1)]
    r = code.regions(files)
    assert code.at_least(r, params.severity("nonsense")).count() == 1
    at = spark.createDataFrame([("r", "0", 3), ("r", "0", 2), ("r", "2", 4)], "repo string, path string, line int")
    assert [x["line"] for x in code.at_position(at, r).collect()] == [3]
    assert code.regions(files, min_depth=5).where("path = '0'").select("start_line", "line_count").first() == (5, 26)


def test_tree(spark):
    df = spark.createDataFrame([("r", "src/a.ts", 5, 10, "low"), ("r", "src/b.ts", 15, 80, "critical"), ("r", "a.ts", 0, 1, "low"), ("r", "src//b.ts", 15, 80, "critical")], "repo string, path string, churn long, score int, tier string")
    got = {(r["path"], r["is_file"]): r for r in tree.folder_tree(df).collect()}
    assert (got["src", False]["area"], got["src", False]["score"], got["src", False]["tier"]) == (20, 80, "critical")
    assert got["a.ts", True]["area"] == 1 and got["", False]["area"] == 21 and got["", False]["parent_path"] is None and got["src/b.ts", True]["sibling_rank"] == 1


def test_review(spark):
    ranks = spark.createDataFrame([("r", "a", 80, "critical"), ("r", "b", 30, "medium"), ("r", "c", 99, "critical")], "repo string, path string, score int, tier string")
    ch = spark.createDataFrame([("x", "r", p, i) for i, p in enumerate(["b", "a", "A", "brand-new"])], "change_id string, repo string, path string, pos int")
    s = review.working_set(ch)
    assert [r["path"] for r in review.with_score(s, ranks).orderBy("place").collect()] == ["a", "b"]
    assert [r["path"] for r in review.without_history(s, ranks).collect()] == ["brand-new"]
    p = lambda partner, strength: spark.createDataFrame([("r", "a", 1, partner, strength, 12)], "repo string, path string, partner_rank int, partner string, strength double, shared_commits long")
    assert review.hints(s, p("z", 0.8)).first()["partner"] == "z" and review.hints(s, p("B", 0.8)).isEmpty() and review.hints(s, p("z", 0.29)).isEmpty() and not review.hints(s, p("z", 0.3)).isEmpty()


def test_texts(spark):
    assert values(spark, ["src/a|b.ts"], ft.cell) == ["src/a\\|b.ts"]
    assert values(spark, ["critical", "low"], ft.tier_badge) == ["!!", ""] and values(spark, ["rising", "cooling"], ft.trend_arrow) == ["↑", "↓"]
    df = spark.createDataFrame([("r", f"f{i}", s) for i, s in enumerate([3] * 6)], "repo string, path string, score int")
    assert risk.confidence(df).first()["note"] and risk.confidence(df.limit(1)).first()["note"]
    assert risk.confidence(df.withColumn("score", F.lit(60))).first()["note"] is None


def test_report(spark):
    e = explain.explained(risk.ranked(risk.scored(risk.normalised(rows(spark, ("src/a|b.ts", 10, 3, 8.0, 1, 0.2, 0.1, 4.0), ("c", 2, 1, 1.0, 1, 0.1, 0.0, 1.0))))))
    lines = [r["line"] for r in report.markdown(e).orderBy("line_no").collect()]
    assert lines[2].startswith("2 scored files") and lines[6].startswith("| 1 | src/a\\|b.ts | ") and lines[-1] == "" and len(lines) == 9
    assert all(len(x.replace("\\|", "").split("|")) == 14 for x in lines[6:8])
    plain = [r["line"] for r in report.markdown(e, explain=False).orderBy("line_no").collect()]
    assert len(plain[6].replace("\\|", "").split("|")) == 13


def test_snapshot(spark, log, tmp_path):
    f, pairs = churn.file_churn(churn.file_author(log), arrays=True), coupling.co_change(log)
    path, heads = str(tmp_path / "s"), lambda sha: spark.createDataFrame([("r", sha)], "repo string, head_sha string")
    found = lambda sha, settings="": snapshot.hits(spark, path, heads(sha), settings)
    assert found("h1").isEmpty() and snapshot.load(spark, path, found("h1"))[0].isEmpty()
    snapshot.save(f, pairs, heads("h1"), path)
    snapshot.save(f.limit(2), pairs.limit(1), heads("h2"), path)
    snapshot.save(f, pairs, heads("h1"), path)
    snapshot.save(f, pairs, heads(None), path)
    assert [snapshot.load(spark, path, found(h))[0].count() for h in ("h1", "h2", "no")] == [6, 2, 0] and found("h1", "since=3").isEmpty()
    assert [snapshot.load(spark, path, found(h), "r")[1].count() for h in ("h1", "h2")] == [3, 1]
    columns = ["path", "commits", "authors", "first_seen", "n_authors", "top_share", "minor_contributors", "fragmentation", "bugfix_density"]
    a, b = (sorted(map(str, x.select(columns).collect())) for x in (f, churn.with_ownership(snapshot.load(spark, path, found("h1"))[0])))
    assert a == b


def test_readers(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "r.0.log").write_text(LOG)
    (tmp_path / "logs" / "r.1.log").write_text(LOG)
    t = tables.read_log_dumps(spark, str(tmp_path / "logs"))
    assert t.count() == 14 and t.select("walk_seq").distinct().count() == 8 and t.select("repo").distinct().first()[0] == "r"
    root = tmp_path / "src"
    (root / "r" / "lib").mkdir(parents=True)
    (root / "r" / "lib" / "a.ts").write_bytes(b"ok \xff")
    (root / "r" / "b.bin").write_bytes(b"a\0b")
    (root / "r" / "big.ts").write_bytes(b"x" * 2000)
    got = tables.read_files(spark, str(root), 1000).collect()
    assert [(x["repo"], x["path"], x["content"]) for x in got] == [("r", "lib/a.ts", "ok �")]
    lines = spark.createDataFrame([("c", "r", v) for v in (" ./a\\b.ts ", "a/b.ts", "  ", "c")], "change_id string, repo string, value string").withColumn("pos", F.monotonically_increasing_id())
    got = tables.changed_paths(lines).orderBy("pos").collect()
    assert [r["path"] for r in got] == ["a/b.ts", "c"] and got[0]["pos"] == 0


def test_walk(spark):
    c = spark.createDataFrame([("r", s, d, s == "b") for s, d in (("a", dt.datetime(2026, 1, 1)), ("b", dt.datetime(2026, 5, 1)), ("c", None))], "repo string, sha string, author_ts timestamp, is_merge boolean")
    w = history.with_walk_order(c)
    assert [r["sha"] for r in w.orderBy("walk_seq").collect()] == ["b", "a", "c"]
    as_of = F.lit("2026-06-01").cast("timestamp")
    assert [r["sha"] for r in history.since(c, 3, as_of).collect()] == ["b"] and history.since(c, 0, as_of).count() == 3
    assert {r["sha"] for r in history.without_merges(c).collect()} == {"a", "c"} and history.newest(w, 1).first()["sha"] == "b"


def test_params():
    p = params.Params.of(weights={"freq": -1, "churn": float("nan"), "recency": 0.5}, since_months=2.9, exclude="x", min_severity="?", spaces_per_indent=0, top_n=0)
    assert p.weights == params.WEIGHTS | {"recency": 0.5} and p.since_months == 2 and p.exclude == params.EXCLUDE and p.min_severity == "medium" and p.spaces_per_indent == 4 and p.top_n >= 1
    assert params.months("x") == params.months(-1) == 0 and params.globs([]) == ()
    assert fc.SEVERITIES[0] == "low"
