"""Quality rules: base rules on whole texts, then boosted trees over document statistics.

The trees are fitted to `quality` of at most TRAIN_ROWS labelled documents, those with the least hash of doc_id (a documented
bound; statistics and scores cover every document). A fifth of them is held back to set the threshold: the highest score
below which no more than KEEP_LOSS of the held-back good documents fall. The score never rises with the shares of symbols,
of repeated lines or of repeated words.

Defined cases: a null or empty text has no word and fails the base rules; without labels of both classes, or with fewer than
LEAST_LABELS labelled documents that pass the base rules, these decide alone; a document with labels of both kinds counts as bad; null labels are left out; repeated rows are judged each;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import FlatTrees, train
from .common import as_batch, id_and_text, slices

TRAIN_ROWS = 6000
KEEP_LOSS = 0.002
LEAST_LABELS = 50
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_distinct", "n_lines", "n_digits", "n_upper", "n_stops", "longest", "top", "n_short")
#: Features of a document, with the sign of each one's constraint.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "distinct": 0, "line_words": 0, "digits": 0, "upper": 0, "stops": 0, "log_longest": 0, "top": 0, "short": 0}


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words in windows of `window` words that are found twice or more in the text. ids: a number for each distinct word."""
    n = len(ids)
    if n <= window:
        return 0
    bits = max(1, int(distinct - 1).bit_length())
    if bits * window <= 63:
        key = np.zeros(n - window + 1, np.int64)
        for k in range(window):
            key = key << bits | ids[k : n - window + 1 + k]
    else:  # ranks of pairs: windows of k + 1 words from those of k words
        key = ids
        for k in range(1, window):
            key = np.unique(key[: n - k] << 32 | ids[k:], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[: len(key)] += again
    edge[window : window + len(key)] -= again
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str) -> list[int]:
    """COUNTS and further counts of a whole text."""
    raw = text.encode()
    words = raw.split()  # at the six ASCII white-space characters
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    lengths = np.fromiter(map(len, words), np.int64, n)
    most = int(np.bincount(ids).max()) if n else 0
    return [
        n, len(text) - without(SPACE), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids, len(number)),
        len(number), len(lines), without(b"0123456789"), without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), without(b".!?"), int(lengths.max()) if n else 0, most, int((lengths <= 2).sum()),
    ]


def features(s: np.ndarray) -> np.ndarray:
    """Columns as FEATURES, of rows of statistics()."""
    n, chars, symbols, dup, repeat, distinct, lines, digits, upper, stops, longest, top, short = s.astype(float).T
    w, c, k = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack([np.log1p(n), chars / w, symbols / c, dup / k, repeat / w, distinct / w, n / k, digits / c, upper / c, stops / w, np.log1p(longest), top / w, short / w], axis=1)


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < 10) | (100 * s[:, 4] > 20 * s[:, 0])


_STATS = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in (*COUNTS, *_MORE)])


def _stats_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            yield as_batch(_STATS, ids, *zip(*(statistics(t) for t in texts), strict=True))

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *_MORE)))


def fit(df: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[FlatTrees, float] | None:
    """Trees and the threshold, or None without labelled documents of both classes. Only the sample comes to the driver."""
    label = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("quality"))
    sample = label.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = id_and_text(df, id_col, text_col).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # at most `rows` rows
    texts = texts.groupBy("_id").agg(F.min("text").alias("text"))
    quality = {r["_id"]: r["quality"] for r in sample.collect()}
    found = _stats_of(texts, "_id", "text").toPandas().sort_values("doc_id")
    y = np.array([quality[i] for i in found["doc_id"]], float)
    s = found[list((*COUNTS, *_MORE))].to_numpy()
    use = ~base_failed(s)
    x, y, turn = features(s[use]), y[use], np.arange(use.sum()) % 5
    held = turn == 4
    if len(y) < LEAST_LABELS or len(set(y[~held])) < 2 or not (y[held] == 1).any():
        return None
    model = train(x[~held], y[~held], list(FEATURES.values()))
    good = np.sort(model.score(x[held & (y == 1)]))
    return model, float(min(good[int(KEEP_LOSS * len(good))], 0.0))


def _verdict(s: np.ndarray, model: tuple[FlatTrees, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = base_failed(s)
    score = model[0].score(features(s)) if model else np.zeros(len(s))
    return failed, score, ~failed & (score >= model[1] if model else True)


SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
_ARROW = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in COUNTS] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its counts, base_failed, kept and the trees' score. One scan, no shuffle."""
    model = fit(df, labels, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            s = np.array([statistics(t) for t in texts], np.int64)
            failed, score, kept = _verdict(s, model)
            yield as_batch(_ARROW, ids, *s.T[: len(COUNTS)], failed, kept, score)

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that judge() keeps."""
    model, at = fit(df, labels, id_col=id_col, text_col=text_col), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                s = np.array([statistics(t or "") for t in part.column(at).to_pylist()], np.int64)
                yield part.filter(pa.array(_verdict(s, model)[2]))

    return df.mapInArrow(run, df.schema)
