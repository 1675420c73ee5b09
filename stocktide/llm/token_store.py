"""Token ids in ORC: integer run-length encoded ids, row indexes and a Bloom filter on the document id in every stripe.

Documents are dealt to ranges of doc_id and sorted within each (nulls first, ties by text), so file order is id order. A row
keeps its part (the range's number), its place in ids within the part and its ids; where a document starts in the whole
output is the ids of earlier parts, a sum over one row for each part, plus that place. Stripes are read in parallel, and a
search by id skips stripes by their statistics and Bloom filters.

Defined cases: a null or empty text is the end id alone; null ids come first; repeated rows are all written; an empty table
writes no row; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import as_batch, id_and_text, slices
from .tokens import Encoder

BROADCAST_PARTS = 100_000  # rows of the parts' totals, 16 bytes each, that are broadcast; more are joined by a shuffle
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def write_token_ids(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", row_stride: int = 10_000, stripe_bytes: int = 64 << 20) -> None:
    """Encodes each text, appends end_id and writes ORC in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = Encoder.at(tokenizer), TaskContext.get().partitionId(), 0
        for ids, texts in slices(batches, 256):
            end = np.array([end_id], np.uint32)
            encoded = [x for e in encoder.encode_many(texts) for x in (e, end)]
            lengths = np.array([len(e) + 1 for e in encoded[::2]], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            flat = np.concatenate(encoded).astype(np.int32) if encoded else np.empty(0, np.int32)
            yield as_batch(_ARROW, ids, pa.array(np.full(len(texts), part, np.int32)), pa.array(at + offsets[:-1]), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)))
            at += int(offsets[-1])

    dealt = id_and_text(df, id_col, text_col).repartitionByRange("doc_id", F.when(F.col("doc_id").isNull(), F.substring("text", 1, 64))).sortWithinPartitions("doc_id", "text")  # many null ids are several tasks'
    (
        dealt.mapInArrow(run, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids. doc_ids: only these, found by stripe statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each part
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if parts.count() <= BROADCAST_PARTS:
        before = F.broadcast(before)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def digest(read: DataFrame) -> DataFrame:
    """From what was read: each document's start, its count and the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            at, flat = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
            yield as_batch(_DIGEST, b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])

    return read.select("doc_id", "start", "ids").mapInArrow(run, DIGEST)
