"""Snapshots of churn and co-change by (repo, head_sha, settings), and the JSON report sink.

A snapshot folder holds three tables, appended to and never rewritten: `churn` and `co_change`, in BUCKETS folders by a hash of
the repo, and `markers`, one row for each repo and save, written after the other two. Rows of a save count once its marker is
there; of several saves of one key the latest counts. So many repos make few files, a crash leaves nothing that is read, and
the snapshot of one repo is read from one bucket. Both tables hold what the walk gave, before any exclusion.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 2
BUCKETS = 256

FIELDS = "path string, commits bigint, bugfix_commits bigint, lines_added bigint, lines_deleted bigint, authors array<string>, author_commits array<struct<name:string,commits:bigint>>, first_seen string, last_seen string, first_ts timestamp, last_ts timestamp, recency_weight double, recent_commits bigint"
PAIR_FIELDS = "path_a string, path_b string, shared_commits bigint"
KEYS = "repo string, save_id string, bucket int"
MARKERS = "repo string, head_sha string, settings string, save_id string, saved_at timestamp, schema_version int"


def bucket_of(repo: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(repo), F.lit(buckets)).cast("int")


def names(schema: str) -> list[str]:
    return [f.name for f in T._parse_datatype_string(schema).fields]


def save(churn: DataFrame, pairs: DataFrame, heads: DataFrame, path: str, settings: str = "", buckets: int = BUCKETS) -> None:
    """Saves the repos of churn that heads (repo, head_sha) knows, with their pairs. churn: records with lists of authors."""
    save_id = uuid.uuid4().hex
    known = heads.where("head_sha IS NOT NULL").select("repo", "head_sha")
    for df, fields, table in ((churn, FIELDS, "churn"), (pairs, PAIR_FIELDS, "co_change")):
        rows = df.join(known.select("repo"), "repo", "left_semi").withColumns({"save_id": F.lit(save_id), "bucket": bucket_of(F.col("repo"), buckets)})
        # even files: a large bucket is split, small ones share a task
        rows.select(*names(fields), *names(KEYS)).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/{table}")
    done = known.join(churn.select("repo").distinct(), "repo", "left_semi")
    done = done.select("repo", "head_sha", F.lit(settings).alias("settings"), F.lit(save_id).alias("save_id"), F.current_timestamp().alias("saved_at"), F.lit(VERSION).alias("schema_version"))
    done.write.mode("append").parquet(f"{path}/markers")


def _table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{table}")


def hits(spark: SparkSession, path: str, heads: DataFrame, settings: str = "") -> DataFrame:
    """(repo, save_id) of the repos whose head has a snapshot of the current version under these settings."""
    markers = _table(spark, path, "markers", MARKERS).where((F.col("schema_version") == VERSION) & (F.col("settings") == settings))
    return markers.join(heads.select("repo", "head_sha"), ["repo", "head_sha"]).groupBy("repo").agg(F.max_by("save_id", F.struct("saved_at", "save_id")).alias("save_id"))


def load(spark: SparkSession, path: str, found: DataFrame, repo: str | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(churn, pairs) of the hits in `found`; of one repo only where it is named, from its bucket.

    Rows without a path go, pairs also without a count; missing numbers, lists and texts get their zero.
    """
    one = spark.range(1).select(bucket_of(F.lit(repo), buckets)).first()[0] if repo is not None else None
    # spread by bucket before the join, so that the buckets that the hits lie in are all that is read
    wanted = found.withColumn("bucket", bucket_of(F.col("repo"), buckets))
    wanted = wanted.where(F.col("repo") == repo) if repo is not None else wanted
    out = []
    for table, fields, needed in (("churn", FIELDS, ["path"]), ("co_change", PAIR_FIELDS, ["path_a", "path_b", "shared_commits"])):
        df = _table(spark, path, table, f"{fields}, {KEYS}")
        df = df.where(F.col("bucket") == one) if one is not None else df
        df = df.join(wanted, ["bucket", "repo", "save_id"], "left_semi").where(" AND ".join(f"{c} IS NOT NULL" for c in needed))
        out.append(df.select("repo", *(zero(f.name, f.dataType) for f in T._parse_datatype_string(fields).fields)))
    return out[0], out[1]


def zero(name: str, kind: T.DataType) -> Column:
    """The column with what stands for a missing value of its type; times stay null."""
    if isinstance(kind, T.TimestampType):
        return F.col(name)
    none = F.array().cast(kind) if isinstance(kind, T.ArrayType) else F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
    return F.coalesce(name, none).alias(name)


def write_json(report: DataFrame, path: str, explain: bool = True) -> None:
    """Ranked results, one object a line, with their explanation if there is one."""
    from ..params import SIGNALS

    cols = ["repo", "rank", "path", "score", "tier", "trend", F.struct(*SIGNALS, "complexity").alias("signals")]
    if explain:
        cols.append(F.struct("shares", "dominant", F.col("core_pct").alias("corePct"), F.col("sentence").alias("summary")).alias("explanation"))
    report.select(*cols).write.mode("overwrite").json(path)
