"""Packing: concatenate and cut. Documents' tokens, each ended by an end id, form one long row cut every 1024 tokens.

Pass one tokenises each document once and writes its ids with the number of ids before it in its partition. The
partition totals (one row per task of pass one) get prefix sums, in blocks of 1024 partitions and then over the blocks,
so that every document knows its global offset. Pass two cuts: each window that a document touches gives one boundary
record with the piece's start, length and checksum. Nothing but the partition totals is shuffled, no text or id moves
twice, and only the last window can hold padding.

The order is that of the written partitions, so a lost task of pass two reads the same offsets again.

Defined cases: a null text is empty and gives just the end id; repeated rows are packed again each time; a document
longer than a window spans several; an empty table gives no rows; other columns pass through, whatever their names, but for
those that are named like an output, which are replaced.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .base import ship, sliced, stored, table
from .bpe import byte_symbols

WINDOW = 1024
END = 0
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
BLOCK = 1024


#: Fixed value: the word pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """The ids of a byte-level tokenizer file.

    A vocabulary whose ids follow its merges is handed to the faster rank-based encoder. It merges the pair whose joined
    token has the least id; the file's rule is the pair that is listed first. That both give the same ids is tested, not
    proved, as a token may be reached by pairs that the list leaves out. Texts that spell out a special token, and files of
    another kind, go to the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.rules = Tokenizer.from_file(path)
        self.rules.no_truncation()
        self.rules.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        byte = {s: b for b, s in enumerate(byte_symbols())}
        ordered = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        self.fast = None
        if ordered == sorted(ordered) and spec["pre_tokenizer"] == BYTE_LEVEL and not spec["normalizer"] and not spec["model"]["ignore_merges"]:
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.fast is None or any(s in text for s in self.special):
            ids = self.rules.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@lru_cache(4)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


MOST_BROADCAST = 1_000_000
LAYOUT = "part int, before long, doc_tokens long, ids binary"


def tokenised(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(row, part, before, doc_tokens, ids): docs' other columns as a struct, ids ended by the end id, and the number of ids before
    them in their partition; a stored table."""
    others = [c for c in docs.columns if c != text]
    row = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(0)
    rows = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, e, end = TaskContext.get().partitionId(), 0, byte_encoder(path), END.to_bytes(4, "little")
        for whole in batches:
            for b in sliced(whole):
                ids = [e.encode(t) + end for t in b.column(1).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                before = total + np.cumsum(n) - n
                total += int(n.sum())
                made = [pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["row", "part", "before", "doc_tokens", "ids"])

    ship(docs.sparkSession)
    return stored(rows.mapInArrow(run, T.StructType([rows.schema["row"], *T._parse_datatype_string(LAYOUT).fields])), "tokens")


def offsets(tokens: DataFrame) -> DataFrame:
    """(part, shift): ids before each partition; a stored table with one row for each task of pass one."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).withColumn("block", F.floor(F.col("part") / BLOCK).cast("int"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", upto(W.orderBy("block")).alias("earlier"))
    inner = totals.withColumn("inner", upto(W.partitionBy("block").orderBy("part")))
    return stored(inner.join(blocks, "block").select("part", (F.col("earlier") + F.col("inner")).alias("shift")), "offsets")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, text: str = "text") -> DataFrame:
    """One row per piece: docs' other columns, doc_tokens, sequence_id, offset, start, length and piece_ids (these replace
    columns of docs with their names).

    The partition offsets are broadcast if there are MOST_BROADCAST of them at most (two numbers each), else joined by key.
    """
    tokens = tokenised(docs, path or default_path(), text)
    shifts = offsets(tokens)
    at = tokens.join(F.broadcast(shifts) if shifts.count() <= MOST_BROADCAST else shifts, "part")
    n, first = F.col("doc_tokens"), F.col("shift") + F.col("before")

    def piece(s):
        start = F.greatest(s * window - first, F.lit(0))
        end = F.least((s + 1) * window - first, n)
        ids = F.substring("ids", (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int"))
        return F.struct(s.alias("sequence_id"), (first + start - s * window).alias("offset"), start.alias("start"), (end - start).alias("length"), ids.alias("piece_ids"))

    touched = F.sequence(F.floor(first / window), F.floor((first + n - 1) / window))
    pieces = at.select("row", "doc_tokens", F.explode(F.transform(touched, piece)).alias("piece"))
    new = ("doc_tokens", "sequence_id", "offset", "start", "length", "piece_ids")
    others = [c for c in docs.columns if c != text and c not in new]
    return pieces.select(*(F.col(f"row.`{c}`").alias(c) for c in others), "doc_tokens", *(F.col(f"piece.{c}").alias(c) for c in new[1:]))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_of(table(spark, sf_dir, "documents", "doc_id", "text"))


def pieces_of(docs: DataFrame) -> DataFrame:
    p = pack(docs.select("doc_id", "text"))
    return p.select("doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
