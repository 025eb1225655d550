"""Every query with SQL against DuckDB on the smallest tables; plans that must push down."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from riskweave.oracles import ORACLES  # noqa: E402
from riskweave.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if hasattr(v, "is_finite") else v


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df, r = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    mine = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr)
    at = [r.columns.index(c) for c in cols]
    assert mine == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr) and mine


def test_repos_are_independent(spark):
    """Many repos at once give the union of single runs, whatever the partitioning."""
    from riskweave import testdata
    from riskweave.plans import scan

    t = testdata.touches(spark, SF).cache()
    key = lambda df: sorted((r["repo"], r["path"], r["score"], r["rank"]) for r in df.collect())
    repos = [r[0] for r in t.select("repo").distinct().limit(2).collect()]
    both = t.where(t["repo"].isin(repos))
    assert key(scan.scan(both.repartition(7))) == sorted(x for r in repos for x in key(scan.scan(t.where(t["repo"] == r))))


def test_columns_are_pruned(spark):
    plan = QUERIES["a2_author_commits"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "MapInArrow" not in plan
