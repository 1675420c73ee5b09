"""Packing by power-of-two decomposition.

A document of n ids is cut into floor(n / longest) pieces of the longest length and one piece for each set bit of the rest,
longest first. Each piece is a sequence of its own, so no sequence crosses documents and none is padded; sequences of equal
length form a bucket, from which batches of one shape are drawn.

Defined cases: a null or empty text is one piece, the end id; a null id stays null; repeated rows are packed each; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, id_and_text, slices
from .tokens import Encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of n ids' pieces: as many of the longest as fit, then one for each set bit of the rest."""
    whole, rest = divmod(n, longest)
    out = [(i * longest, longest) for i in range(whole)]
    at, size = whole * longest, longest >> 1
    while rest:
        if rest & size:
            out.append((at, size))
            at, rest = at + size, rest ^ size
        size >>= 1
    return out


def pack_documents(df: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, ids (little-endian uint32), sequence_id, offset, bucket.

    Tokenised and cut where the rows lie, so there is no shuffle; a sequence's number is its partition's number and its
    place there, which needs no pass over other partitions.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        for ids, texts in slices(batches, 256):
            docs, starts, lengths, totals, parts = [], [], [], [], []
            for d, enc in zip(ids.to_pylist(), encoder.encode_many(texts), strict=True):
                raw = enc.tobytes() + end_id.to_bytes(4, "little")
                n = len(raw) // 4
                for s, m in binary_pieces(n, longest):
                    docs.append(d)
                    starts.append(s)
                    lengths.append(m)
                    totals.append(n)
                    parts.append(raw[4 * s : 4 * (s + m)])
            yield as_batch(_ARROW, docs, starts, lengths, totals, parts)

    out = id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)
    return out.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.round(F.log2("length")).cast("int").alias("bucket"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Parquet with a folder for each length, so that a reader draws batches of equal shapes."""
    packed.write.partitionBy("bucket").parquet(path)


def piece_ids(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


def digest(packed: DataFrame) -> DataFrame:
    """The pieces without their ids, for which a checksum stands."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
