"""Sources: log dumps, commit tables, file contents and lists of changed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import repo_key
from ..operators.history import parse_log_lines, with_walk_order

COMMITS = "repo string, walk_seq bigint, sha string, author string, author_date string, author_ts timestamp, subject string, is_merge boolean"
MAX_BYTES, SNIFF_BYTES = 1_500_000, 8_000


def read_log_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Touches from a folder of dumps: <repo>.log, or <repo>.<segment>.log.

    A dump may have any size: it is read by lines, in as many blocks as the file has splits, see parse_log_lines().
    """
    name = F.col("_metadata.file_name")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.regexp_extract(name, r"^(.*?)(?:\.([0-9]+))?\.log$", 1).alias("repo"), F.coalesce(F.regexp_extract(name, r"\.([0-9]+)\.log$", 1).try_cast("bigint"), F.lit(0)).alias("segment"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return parse_log_lines(lines)


def read_commits(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A commit table of the fixed schema; numbered by time where it has no walk order."""
    df = spark.read.format(fmt).schema(COMMITS).load(path)
    fixed = df.withColumn("author_ts", F.coalesce("author_ts", F.try_to_timestamp("author_date")))
    ordered = fixed.where("walk_seq IS NOT NULL")
    return ordered.unionByName(with_walk_order(fixed.where("walk_seq IS NULL")).select(ordered.columns))


def text_contents(files: DataFrame, max_bytes: int = MAX_BYTES, sniff: int = SNIFF_BYTES) -> DataFrame:
    """files (…, length, content binary) that are text and small enough, with content decoded."""
    small = files.where(F.col("length") <= max_bytes)
    text = small.where(~F.contains(F.substring("content", 1, sniff), F.lit(bytes(1))))
    return text.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def read_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(repo, path, content) of root/<repo>/<path>; larger files are never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    inner = F.substr(F.col("path"), F.lit(len(whole.rstrip("/")) + 2))
    kept = text_contents(df, max_bytes)
    return kept.select(F.substring_index(inner, "/", 1).alias("repo"), F.regexp_replace(inner, "^[^/]*/", "").alias("path"), "content")


def changed_paths(lines: DataFrame) -> DataFrame:
    """Distinct normalised paths of (change_id, repo, value, pos) lines, each at its first place; blank lines go."""
    clean = lines.withColumn("path", repo_key(F.regexp_replace("value", r"^\s+|\s+$", ""))).where("path <> ''")
    return clean.groupBy("change_id", "repo", "path").agg(F.min(F.col("pos").cast("long")).alias("pos"))


def read_changed_paths(spark: SparkSession, root: str) -> DataFrame:
    """(change_id, repo, path, pos) of root/change_id=<id>/repo=<repo>/list=<n>/<any file>, a path a line: the list's number, then
    the line, make pos, so that the first list's spelling counts."""
    files = spark.read.schema("value string, change_id string, repo string, list int").text(root, wholetext=True)
    lines = files.select("change_id", "repo", "list", F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return changed_paths(lines.withColumn("pos", F.col("list").cast("long") * F.lit(1 << 32) + F.col("line")))
