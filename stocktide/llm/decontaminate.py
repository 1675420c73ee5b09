"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and every run of characters that are neither letters nor digits becomes one space. A test item of m
characters may differ by e = floor(m * error_rate) edits; cut into e + 1 pieces, one piece at least survives e edits
unchanged. An Aho-Corasick automaton finds the pieces of all items in one pass over a whole text; around each hit, Myers'
bit-parallel algorithm gives the least edit distance of the item to any substring of the hit's surroundings.

Items come in blocks of at most BLOCK_CHARS characters (and the item that fills it), so an automaton is bounded; PASS_BLOCKS blocks are
one broadcast and one pass over the documents, in one Python worker a task. With a single block, texts stream through its automaton,
which a worker builds once for all its tasks; with several, a task gathers texts up to GATHER_CHARS and takes one block's automaton after the
other over them, so that only one is held (building one takes a tenth of the time of scanning that much). A benchmark beyond one pass is taken
in several: all but the last are written to the shared folder and their broadcasts destroyed, so driver and executors hold one
pass of it at a time.

Defined cases: null, blank or symbol-only items match nothing; items of equal normalised text are all reported; items shorter
than MIN_CHARS must occur exactly and as whole words; null and empty documents match nothing; a null id is returned as null;
repeated rows are reported each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, id_and_text, written

ERROR_RATE = 0.07
MIN_CHARS = 24
BLOCK_CHARS = 4 << 20
PASS_BLOCKS = 8
GATHER_CHARS = 32 << 20
_GAP = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least distance of the pattern to any substring of the text, where the first such substring ends)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    vp, vn, distance, best, end = full, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), vp & d0
        if hp & top:
            distance += 1
        elif hn & top:
            distance -= 1
        hp, hn = hp << 1, hn << 1
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0 & full
        if distance < best:
            best, end = distance, j + 1
    return best, end


class ItemIndex:
    """The automaton over the pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items: dict[str, list[int]] = {}
        for i, text in items:
            if t := normalised(text):
                self.items.setdefault(t, []).append(i)
        self.texts = list(self.items)
        self.budget = [int(len(t) * error_rate) if len(t) >= min_chars else 0 for t in self.texts]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (t, e) in enumerate(zip(self.texts, self.budget, strict=True)):
            if len(t) < min_chars:
                pieces.setdefault(f" {t} ", []).append((k, -1))
                continue
            cuts = [len(t) * j // (e + 1) for j in range(e + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((k, a))
        self.find = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.find.add_word(piece, (len(piece), where))
        if pieces:
            self.find.make_automaton()
        self.empty = not pieces

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, place in the normalised text where the match ends), the best for each item."""
        if self.empty:
            return []
        t = f" {normalised(text)} "
        best: dict[int, tuple[int, int]] = {}
        done: dict[int, tuple[int, int]] = {}  # where an item that begins there has been verified
        for end, (n, where) in self.find.iter(t):
            for k, a in where:
                item, e = self.texts[k], self.budget[k]
                begin = end - n + 1 - a  # where the item begins if nothing before the piece was edited
                if begin >= 0 and t.startswith(item, begin):
                    best[k] = min(best.get(k, (0, begin + len(item))), (0, begin + len(item)))
                    continue
                if not e or k in done and done[k][0] <= begin <= done[k][1]:
                    continue
                low = max(0, begin - 2 * e)
                distance, stop = myers(item, t[low : begin + len(item) + 2 * e])
                done[k] = (begin - e, begin + e)
                if distance <= e:
                    best[k] = min(best.get(k, (distance, low + stop)), (distance, low + stop))
        return [(i, d, stop) for k, (d, stop) in best.items() for i in self.items[self.texts[k]]]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, streamed to the driver."""
    block, size = [], 0
    for row in items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


_indexes: dict[tuple, ItemIndex] = {}


def _index(key: str, block: list[tuple[int, str]], error_rate: float) -> ItemIndex:
    """The block's automaton, kept by the worker process until another one is asked for."""
    if (key, error_rate) not in _indexes:
        _indexes.clear()
        _indexes[key, error_rate] = ItemIndex(block, error_rate)
    return _indexes[key, error_rate]


def _passes(df: DataFrame, items: DataFrame, block_chars: int, pass_blocks: int) -> Iterator[tuple[Broadcast, bool]]:
    """(the blocks of one pass with a digest each, whether it is the last), at most pass_blocks of block_chars characters in a broadcast."""
    send, group = df.sparkSession.sparkContext.broadcast, []
    for block in item_blocks(items, chars=block_chars):
        if len(group) == pass_blocks:
            yield send(group), False
            group = []
        group.append((hashlib.sha256(repr(block).encode("utf-8", "surrogatepass")).hexdigest(), block))
    if group:
        yield send(group), True


def _gathered(batches: Iterator[pa.RecordBatch], at: int, chars: int) -> Iterator[tuple[list[pa.RecordBatch], list[str]]]:
    """(slices of at most 512 rows, their texts in column `at` with null as empty): one slice, or as many as reach `chars` characters."""
    parts, texts, size = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            parts.append(batch.slice(start, 512))
            new = [t or "" for t in parts[-1].column(at).to_pylist()]
            texts += new
            size += sum(map(len, new))
            if size >= chars:
                yield parts, texts
                parts, texts, size = [], [], 0
    if parts:
        yield parts, texts


SCHEMA = "doc_id long, item_id long, distance int, end_char long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end_char", pa.int64())])


def contaminated(
    df: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text",
    block_chars: int = BLOCK_CHARS, pass_blocks: int = PASS_BLOCKS,
) -> DataFrame:
    """doc_id, item_id, distance, end_char for each document and item found in it, the best match of each."""
    docs, out = id_and_text(df, id_col, text_col), None
    for shared, last in _passes(df, items, block_chars, pass_blocks):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks = shared.value
            for parts, texts in _gathered(batches, 1, GATHER_CHARS if len(blocks) > 1 else 0):
                ids = [i for p in parts for i in p.column(0).to_pylist()]
                for key, block in blocks:
                    index = _index(key, block, error_rate)
                    rows = [(d, *m) for d, t in zip(ids, texts, strict=True) for m in index.matches(t)]
                    if rows:
                        yield as_batch(_ARROW, *zip(*rows, strict=True))

        found = docs.mapInArrow(run, SCHEMA)
        if not last:
            found = written(found, "contaminated")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def keep_clean(
    df: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, text_col: str = "text",
    block_chars: int = BLOCK_CHARS, pass_blocks: int = PASS_BLOCKS,
) -> DataFrame:
    """The rows of df, with all their columns, in which no item is found."""
    at = df.columns.index(text_col)
    for shared, last in _passes(df, items, block_chars, pass_blocks):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks = shared.value
            for parts, texts in _gathered(batches, at, GATHER_CHARS if len(blocks) > 1 else 0):
                clean = [True] * len(texts)
                for key, block in blocks:
                    index = _index(key, block, error_rate)
                    clean = [c and not index.matches(t) for c, t in zip(clean, texts, strict=True)]
                start = 0
                for part in parts:
                    yield part.filter(pa.array(clean[start : start + part.num_rows], pa.bool_()))
                    start += part.num_rows

        df = df.mapInArrow(run, df.schema)
        if not last:
            df = written(df, "clean")
            shared.destroy()
    return df
