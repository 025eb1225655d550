"""Helpers shared by the text operators: table access, shared-folder tables, Arrow stages, gapless numbering."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..sources.shared import drop_stored, stored  # noqa: F401  # the operators take both from here


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per application."""
    context = spark.sparkContext
    if getattr(context, "_riskweave_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="spark-riskweave-")) / "riskweave.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._riskweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def unused(df: DataFrame, name: str) -> str:
    """name, made longer until df has no column of it."""
    while name in df.columns:
        name += "_"
    return name


SLICE = 8 << 20


def sliced(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of `most` bytes on average, so that few whole texts are Python objects at once."""
    rows = max(1, batch.num_rows * most // max(most, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def add_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], f: Callable[..., Iterable[list]]) -> DataFrame:
    """df with new columns that f makes from lists of the inputs' values, batch by batch, in one Arrow pass.

    f gets one list per input and returns one list (or Arrow array) per field, for SLICE bytes of the batch at a time. A
    column of df with the name of a new one is replaced; all others pass through as they are.
    """
    names = [x.name for x in fields]
    kept = [c for c in df.columns if c not in names]
    out = T.StructType([df.schema[c] for c in kept] + fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole):
                made = f(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs))
                new = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, arrow.field(n).type) for x, n in zip(made, names, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *new], names=[*kept, *names])

    ship(df.sparkSession)
    needed = list(dict.fromkeys([*kept, *inputs]))
    return df.select(*(F.col(f"`{c}`") for c in needed)).mapInArrow(run, out)


def is_held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no learned operator trains on: crc32 of the id's text leaves 0 when divided by 5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: Column, limit: int, inputs: list[str]) -> DataFrame:
    """(doc_id, y, fold, inputs) of at most `limit` rows, one for each labelled doc_id outside the held-out fifth: those with the
    least hash of doc_id among the ids that docs has. label is an aggregate over a doc_id's labels, null where there are none.

    Repeated rows of a doc_id are reduced to one (that of the least hash) before anything is joined or collected. The ids
    and hashes, `limit` rows at most, are broadcast.
    """
    free = ~is_held_out() & F.col("doc_id").isNotNull()
    known = labels.where(free).groupBy("doc_id").agg(label.cast("int").alias("y")).where("y IS NOT NULL")
    mark = F.xxhash64(*(F.col(c).cast("string") for c in inputs))
    have = docs.where(free).groupBy("doc_id").agg(F.min(mark).alias("_mark"))
    few = known.join(have, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", *inputs, mark.alias("_mark")).join(F.broadcast(few), ["doc_id", "_mark"]).dropDuplicates(["doc_id"])
    return rows.select("doc_id", "y", (F.crc32(F.col("doc_id").cast("string")) % 5).cast("int").alias("fold"), *inputs)


def slots(df: DataFrame, group: str, spread: list[str], order: list[str], out: str, buckets: int = 512) -> DataFrame:
    """Gapless numbers from 0 within each group, though a group may hold any share of the rows.

    Rows of a group spread over buckets by a hash of `spread`; buckets are numbered locally and shifted by prefix
    sums of the bucket counts. The counts are at most groups x buckets rows. No task holds a whole group; the caller lets the
    number of buckets grow with the rows.
    """
    b = df.withColumn("_b", F.pmod(F.xxhash64(*(F.col(c) for c in spread)), F.lit(buckets)).cast("int"))
    counts = b.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), F.coalesce("_before", F.lit(0)).alias("_before"))
    local = b.withColumn("_rn", F.row_number().over(W.partitionBy(group, "_b").orderBy(*order)))
    joined = local.join(before, (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("_b") == F.col("_bb")), "left")
    return joined.withColumn(out, F.col("_before") + F.col("_rn") - 1).drop("_b", "_bb", "_g", "_rn", "_before")
