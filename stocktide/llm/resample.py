"""Importance resampling towards a target distribution, on hashed n-grams.

A block of texts has an integer dictionary of its distinct words; an n-gram is the tuple of its words' ids (as a pair: the id of its first
n - 1 words, and a word's), each distinct tuple's bytes are put together and hashed once a block, and the buckets are joined back
to all occurrences by the tuples' ids. Dictionaries are a block's own (BLOCK_BYTES of text, or one longer text), so they need no
shuffle and no bound on the corpus' vocabulary; only sums by bucket meet.

Texts are scored by the mean gain of their buckets, towards the target and away from the corpus, and drawn by Gumbel noise: the highest
scores of a given percentage, ranked by ranges of scores.

Defined cases: a null or empty text has no feature and weight 0; a null id is hashed as "7:null" and comes before others of equal score;
repeated rows are scored and drawn each; ties of score and id are settled by where the rows lie; an empty corpus gives no row and an
empty target counts 0 everywhere; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, id_and_text, slices, written
from .ordering import positions

BUCKETS = 10_000
BLOCK_BYTES = 8 << 20
_LETTERS = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Capital letters to small ones, all that is no word byte to a blank.
TABLE = bytes(b if b in _LETTERS else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def feature_buckets(texts: list[bytes], longest: int = 2, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, features of each text, buckets of all features in the order of texts)."""
    ids, split = _Ids(), [t.translate(TABLE).split() for t in texts]
    n_words = np.array([len(s) for s in split], np.int64)
    words = np.fromiter((ids[w] for s in split for w in s), np.int64, int(n_words.sum()))
    del split
    vocabulary = list(ids)
    grams, tuples, starts = vocabulary, words, np.arange(len(words))
    ends = np.repeat(np.cumsum(n_words), n_words)  # of the text of each word
    doc = np.repeat(np.arange(len(texts)), n_words)
    found, owner = [], []
    for n in range(1, longest + 1):
        if n > 1:
            keep = starts + n - 1 < ends[starts]
            starts, tuples = starts[keep], tuples[keep]
            pairs, tuples = np.unique(tuples * len(vocabulary) + words[starts + n - 1], return_inverse=True)
            grams = [grams[p] + b" " + vocabulary[w] for p, w in zip(*(x.tolist() for x in np.divmod(pairs, max(len(vocabulary), 1))), strict=True)]
        hashed = np.fromiter((zlib.crc32(g) % buckets for g in grams), np.int32, len(grams))
        found.append(hashed[tuples])
        owner.append(doc[starts])
    owner = np.concatenate(owner)
    return n_words, np.bincount(owner, minlength=len(texts)), np.concatenate(found)[np.argsort(owner, kind="stable")]


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bytes]]]:
    for ids, texts in slices(batches):
        names, block, size = [], [], 0
        for d, t in zip(ids.to_pylist(), texts, strict=True):
            raw = t.encode()
            if block and size + len(raw) > most:
                yield names, block
                names, block, size = [], [], 0
            names.append(d)
            block.append(raw)
            size += len(raw)
        if block:
            yield names, block


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])


def features(df: DataFrame, longest: int = 2, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A written table: doc_id, n_words, n_features and buckets (two bytes a feature, four beyond 65,536 buckets)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, block in _blocks(batches, block_bytes):
            n_words, n_features, flat = feature_buckets(block, longest, buckets)
            at = np.concatenate([[0], np.cumsum(n_features)])
            flat = flat.astype(kind)
            yield as_batch(_FEATURES, names, n_words, n_features, [flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)])

    return written(id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary"), "features")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: `buckets` sums a task, summed; the result is a vector of that length."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                sums += np.bincount(np.frombuffer(x.as_buffer() or b"", kind), minlength=buckets)
        hit = np.flatnonzero(sums)
        yield as_batch(schema, hit.astype(np.int32), sums[hit])

    out = np.zeros(buckets, np.int64)
    for bucket, n in features.where("n_features > 0").select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of smoothed frequencies in the target and the corpus, in thousandths, floored."""
    s_all, t_all, b = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + b)) / ((s + 1) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


_WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def weigh(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight. gain: a vector of a value for each bucket."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = [int(gain[np.frombuffer(x.as_buffer(), kind)].sum()) // n if n else 0 for x, n in zip(b.column(3), b.column(2).to_pylist(), strict=True)]
            yield as_batch(_WEIGHED, b.column(0), b.column(1), b.column(2), weight)

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(df: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = BUCKETS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn) of every document."""
    own = features(df, longest, buckets, id_col, text_col)
    wanted = features(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), longest, buckets, "id", "text")
    weighed = weigh(own, gains(bucket_counts(own, buckets), bucket_counts(wanted, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("able"))
    ranked = positions(written(scored, "scored"), ["able"], [F.col("score").desc(), F.col("doc_id").asc_nulls_first()])
    drawn = F.col("able") & (F.col("position") < F.floor(F.col("total") * percent / 100))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("position") + 1).alias("rank"))
