"""The library's inputs derived from the shared order tables: orders are commits, order lines are file touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    subject = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "fix crash in importer")
        .when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "F"), F.concat(F.lit("closes #"), F.col("o_orderkey").cast("string")))
        .when(F.col("o_orderpriority") == "2-HIGH", "prefix the config keys")
        .when(F.col("o_orderpriority") == "3-MEDIUM", 'Revert "fix the parser bug"')
        .otherwise("add dark mode toggle")
    )
    j = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("repo")), "o_custkey")
    # a repo's days are counted and summed up first, so that only the commits of one day are sorted in one task
    days = j.groupBy("repo", "o_orderdate").agg(F.count(F.lit(1)).alias("_n")).withColumnsRenamed({"repo": "_repo", "o_orderdate": "_day"})
    newer = W.partitionBy("_repo").orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)
    days = days.select("_repo", "_day", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_newer"))
    j = j.join(days, (F.col("repo") == F.col("_repo")) & F.col("o_orderdate").eqNullSafe(F.col("_day")))
    w = W.partitionBy("repo", "o_orderdate").orderBy(F.desc("o_orderkey"))
    return j.select(
        "repo", (F.col("_newer") + F.row_number().over(w)).cast("long").alias("walk_seq"), F.col("o_orderkey").alias("sha"), F.concat(F.lit("dev_"), (F.col("o_custkey") % 12).cast("string")).alias("author"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("author_date"), F.col("o_orderdate").cast("timestamp").alias("author_ts"), subject.alias("subject"), (F.col("o_orderkey") % 10 == 0).alias("is_merge"),
    )


def part_path(n: Column) -> Column:
    return F.format_string("src/part_%d/file_%d.ts", n % 20, n)


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit's first line touches its part's own file, so that paths grow with the parts; the others touch a shared one."""
    from .functions.commits import is_bugfix

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    folder = F.when(F.col("p_type") == "PROMO", "dist/").when(F.col("p_type") == "LARGE", "lib/core/").otherwise(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/")))
    shared = F.concat(folder, F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit(".ts"))
    path = F.when(F.col("l_linenumber") == 1, part_path(F.col("l_partkey"))).otherwise(shared)
    m = commits(spark, sf_dir).drop("is_merge").withColumn("is_bugfix", is_bugfix(F.col("subject")))
    j = lines.join(m, lines["l_orderkey"] == m["sha"])
    return j.select("repo", "walk_seq", F.col("l_linenumber").alias("row_no"), "sha", "author", "author_date", "author_ts", "subject", "is_bugfix", path.alias("path"), F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("deleted"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a file: document n, indented by its lines' lengths, is part n's file in one of the repos."""
    content = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.repeat(F.lit("    "), F.length(x) % 7), x)), "\n")
    repo = F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(repo.alias("repo"), part_path(F.col("doc_id")).alias("path"), content.alias("content"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit is a change set: its files, and one that has no history."""
    own = touches(spark, sf_dir).select(F.col("sha").cast("string").alias("change_id"), "repo", F.explode(F.array("path", F.lit("src/new/file.ts"))).alias("path")).distinct()
    return own.withColumn("pos", F.length("path"))
