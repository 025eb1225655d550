"""The queries read all rows; sources, sinks and jobs on small tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from riskweave import testdata as td  # noqa: E402
from riskweave.functions import paths as fp  # noqa: E402
from riskweave.operators import code, coupling  # noqa: E402
from riskweave.params import Params  # noqa: E402
from riskweave.plans import scan  # noqa: E402
from riskweave.queries import QUERIES  # noqa: E402
from riskweave.sources import report  # noqa: E402
from riskweave.sources.tables import read_files, text_contents  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_every_document_is_analysed(spark):
    """More documents than the 750 keys of type and brand."""
    docs = td.table(spark, SF, "documents").count()
    assert docs > 750
    got = QUERIES["a14_complexity"](spark, SF)
    assert got.count() == got.select("repo", "path").distinct().count() == docs


def test_commits_are_not_sorted_in_one_task_a_repo(spark):
    plan = td.commits(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    rows = [x for x in plan.splitlines() if "row_number" in x and "Window" in x]
    assert rows and all("o_orderdate" in x.split("row_number")[1].split("[")[1] for x in rows)


def test_walk_is_whole(spark):
    for r in td.commits(spark, SF).groupBy("repo").agg({"walk_seq": "max", "*": "count"}).collect():
        assert r["max(walk_seq)"] == r["count(1)"]


def test_no_text_is_dropped(spark):
    """Neither long texts nor every seventh id."""
    assert QUERIES["s3_text_contents"](spark, SF).count() == td.table(spark, SF, "documents").count()


def test_text_rules(spark):
    rows = [(1, 1_500_000, b"abc"), (2, 1_500_001, b"abc"), (3, 20_001, b"x" * 20_001), (4, 9, b"abc\0defgh"), (5, 8_001, b"x" * 8_000 + b"\0")]
    df = spark.createDataFrame(rows, "id int, length long, content binary")
    assert sorted(r["id"] for r in text_contents(df).collect()) == [1, 3, 5]


def test_commit_limit(spark):
    sizes = {1: 1, 2: 8, 3: 9, 4: 50, 5: 51}
    t = spark.createDataFrame([("r", c, f"f{i}.ts") for c, n in sizes.items() for i in range(n)], "repo string, walk_seq long, path string")
    kept = {r["walk_seq"]: r["count"] for r in coupling.commit_paths(t).groupBy("walk_seq").count().collect()}
    assert kept == {2: 8, 3: 9, 4: 50}


def test_commits_over_eight_files_count(spark):
    sizes = QUERIES["u3_commit_paths"](spark, SF).groupBy("repo", "walk_seq").count()
    assert sizes.where("count > 8").count() > 0


def test_every_line_of_a_region_is_looked_up(spark):
    """Each line of each region from medium on, and the first lines of files once more."""
    regions = QUERIES["w3_regions"](spark, SF).where("severity <> 'low'")
    assert QUERIES["j7_position"](spark, SF).count() == regions.groupBy().sum("line_count").first()[0] + regions.where("start_line = 0").count()
    found = QUERIES["j7_position"](spark, SF).select("repo", "path", "start_line").distinct()
    assert regions.select("repo", "path", "start_line").subtract(found).isEmpty()


def test_every_commit_is_a_change_set(spark):
    """Not only the 20 newest of each repo."""
    touched = td.touches(spark, SF).select("sha").distinct().count()
    assert touched > 100
    got = QUERIES["u2_working_set"](spark, SF)
    assert got.select("change_id").distinct().count() == touched
    assert QUERIES["j5_changed_without_history"](spark, SF).where("path = 'src/new/file.ts'").count() == touched


def test_repeated_positions_stay(spark):
    at = spark.createDataFrame([("r", "a.ts", 4, "x"), ("r", "a.ts", 4, "x"), ("r", "a.ts", 9, "y"), ("r", "b.ts", 4, "z")], "repo string, path string, line int, score string")
    found = spark.createDataFrame([("r", "a.ts", 3, 6, 57, "high", ["nested"]), ("r", "a.ts", 4, 5, 80, "critical", ["nested"])], "repo string, path string, start_line int, end_line int, score int, severity string, reasons array<string>")
    got = code.at_position(at.drop("score"), found).collect()
    assert [(r["line"], r["score"]) for r in got] == [(4, 80), (4, 80)]


def test_history_window_without_commits(spark):
    t = td.touches(spark, "/root/testdata/sf0.001")
    runs = [scan.scan(t, None, Params(since_months=m, as_of="1998-08-02", explain=False)).agg({"freq": "sum"}).first()[0] for m in (0, 24, 1)]
    assert runs[0] > runs[1] > runs[2] > 0
    by_commits = scan.scan(t, None, Params(since_months=24, as_of="1998-08-02", explain=False), td.commits(spark, "/root/testdata/sf0.001")).agg({"freq": "sum"}).first()[0]
    assert by_commits == runs[1]
    with pytest.raises(ValueError, match="as_of"):
        scan.scan(t, None, Params(since_months=1))


@pytest.mark.parametrize("root", ["my+src", "src", "a b/src"])
def test_roots_of_any_name(spark, tmp_path, root):
    """A root whose name is a pattern, or occurs further up and inside."""
    top = tmp_path / "src" / root
    (top / "one" / "src").mkdir(parents=True)
    (top / "one" / "src" / "a.ts").write_text("x")
    (top / "two").mkdir()
    (top / "two" / "b.ts").write_text("y")
    got = {(r["repo"], r["path"], r["content"]) for r in read_files(spark, str(top)).collect()}
    assert got == {("one", "src/a.ts", "x"), ("two", "b.ts", "y")}


def test_markdown_files(spark, tmp_path):
    rows = [("r1", 1, "a|b.ts", 80), ("r1", 2, "c.ts", 10), ("r2", 1, "d.ts", 0)]
    df = spark.createDataFrame(rows, "repo string, rank int, path string, score int")
    df = df.selectExpr("*", "'low' tier", "'stable' trend", "1L freq", "2L churn", "1L authors", "0.5D ownership", "0.25D coupling", "3L complexity")
    report.write_markdown(report.markdown(df, explain=False), str(tmp_path / "md"))
    text = {f.parent.name: f.read_text().split("\n") for f in sorted((tmp_path / "md").glob("repo=*/part-*"))}
    assert set(text) == {"repo=r1", "repo=r2"}
    assert text["repo=r1"][0] == report.TITLE and text["repo=r1"][2].startswith("2 scored files, ") and text["repo=r1"][4:6] == [report.HEADS, report.RULE]
    assert text["repo=r1"][6] == "| 1 | a\\|b.ts | 80 | low | → stable | 1 | 2 | 1 | 50% | 25% | 3 |" and text["repo=r1"][8] == "" and text["repo=r2"][2].startswith("1 scored file, ")


def test_names(spark):
    df = spark.createDataFrame([("a/b/c.ts",), ("c.ts",), ("/a//b",)], "path string")
    assert [tuple(r) for r in df.select(fp.base_name(df["path"]), fp.segments(df["path"])).collect()] == [("c.ts", ["a", "b", "c.ts"]), ("c.ts", ["c.ts"]), ("b", ["a", "b"])]


@pytest.mark.parametrize("name", ["w2_ranking", "c7_explanation", "s7_markdown_report"])
def test_touches_are_derived_once(spark, name):
    """What is left to run reads stored tables: no table of lines or orders any more."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "orders" not in plan and "documents" not in plan
