"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Every 100-byte window has an anchor, the place in it whose first K bytes have the least hash; equal windows have equal
anchors at equal places, so only suffixes that begin at anchors are indexed (one for some 30 bytes). A suffix array here is sorted by
the fingerprint of a suffix's first K bytes, then by that of the whole stretch of windows with this anchor; fingerprints stand
for bytes because suffixes are compared far from their texts. Both are 64-bit polynomial hashes over random byte values, and
two strings count as equal if two such hashes of different bases are.

Documents are dealt to batches of some BATCH bytes by the hash of doc_id, suffixes to buckets by their first fingerprint. In a
bucket the batches' entries are put together to arrays of RUN entries, so that the work is that of the entries, however many batches
they come from. Each new array is merge-scanned against the levels of the family: suffixes that a level has only lower that
entry's least doc_id, the others become a level of their own, and levels of equal size merge, so that there are only
logarithmically many. The scan of the whole family then tells each batch, in one byte a suffix, whether the stretch occurs in
an earlier document, or the first fingerprint goes on differently elsewhere. Of the latter stretches every single window takes the same
way through a second family. A batch sends a value once, whatever number of its documents hold it, so a frequent passage costs one
entry a batch. Crowded anchors, those that go on in CROWD or more ways in a bounded sample of the documents (a licence line's), are dealt by
both fingerprints and count as going on differently: the sample decides where an entry is compared, never what is found. Which occurrence in one batch comes first, the batch knows itself: rows of one doc_id are in one batch.

Defined cases: a null text is empty; texts under 100 bytes lose nothing; a null id comes after all others (below 2**62),
in order of its text; rows of one id are separate documents in order of their text; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, id_and_text

LENGTH = 100
K = 40
BATCH = 4 << 20
SAMPLE = 64 << 20  # bytes of documents in which crowded anchors are looked for
CROWD = 16
RUN = 1 << 16  # entries that a family takes in at once
BUCKETS = 128  # up to so many there are as many buckets of stretches as batches, beyond that one for four
_CHUNK = 1 << 20
_NULLS = 1 << 62  # null ids come from here on
_U = np.uint64
NEW, EARLIER, FORKED = 0, 1, 2


class Rolling:
    """Hashes of all substrings of a buffer from prefix sums, modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __init__(self, buffer: np.ndarray, base: int):
        if base not in self._powers:
            inverse = pow(base, -1, 1 << 64)
            steps = (np.full(_CHUNK + 1024, b, _U) for b in (base, inverse))
            up, down = (np.cumprod(np.insert(s, 0, _U(1))) for s in steps)
            self._powers[base] = up, down, np.random.Generator(np.random.PCG64(base & 0xFFFF)).integers(0, 1 << 64, 256, _U)
        up, self.down, values = self._powers[base]
        self.sums = np.zeros(len(buffer) + 1, _U)
        np.cumsum(values[buffer] * up[: len(buffer)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


_BASE_A, _BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MIX = _U(0xBF58476D1CE4E5B9)


def _chunks(buffer: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(begin, bytes, window starts in them): all windows inside documents, in parts of bounded size. ends: of the documents."""
    starts = np.concatenate([[0], ends[:-1]])
    for begin in range(0, len(buffer), _CHUNK):
        part = buffer[begin : begin + _CHUNK + LENGTH - 1]
        inside = np.zeros(len(part) + 1, np.int32)
        low, high = np.clip(starts - begin, 0, len(part)), np.clip(ends - LENGTH + 1 - begin, 0, len(part))
        some = low < high
        np.add.at(inside, low[some], 1)
        np.add.at(inside, high[some], -1)
        valid = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        valid = valid[valid < min(_CHUNK, len(part) - LENGTH + 1)]
        if len(valid):
            yield begin, part, valid


def stretches(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """first, last (window starts with one anchor), key (fingerprint of the anchor's K bytes), span (that of the stretch)."""
    out = []
    for begin, part, valid in _chunks(buffer, ends):
        a, b = Rolling(part, _BASE_A), Rolling(part, _BASE_B)
        key = a.every(K)
        order = key * _MIX
        order ^= order >> _U(32)
        order *= _MIX
        least = (order & _U(0xFFFFFFFF00000000)) | np.arange(len(order), dtype=_U)
        width, have = LENGTH - K + 1, 1
        while have < width:  # the least of `have` places, doubled
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        anchor = (least[valid] & _U(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)]))
        first, last, at = valid[head], valid[np.concatenate([head[1:] - 1, [len(valid) - 1]])], anchor[head]
        span = b.at(first, last + LENGTH) * _MIX + (at - first).astype(_U) * _U(0x94D049BB133111EB) + (last - first).astype(_U)
        out.append((first + begin, last + begin, key[at], span))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U), np.empty(0, _U))


def windows(buffer: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each wanted window; wanted: sorted starts."""
    one, two = np.empty(len(wanted), _U), np.empty(len(wanted), _U)
    for begin in range(0, len(buffer), _CHUNK):
        i, j = np.searchsorted(wanted, [begin, begin + _CHUNK])
        if i < j:
            part, at = buffer[begin : begin + _CHUNK + LENGTH - 1], wanted[i:j] - begin
            one[i:j], two[i:j] = (Rolling(part, b).at(at, at + LENGTH) for b in (_BASE_A, _BASE_B))
    return one, two


def suffix_array(key: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): places sorted by key and span, earlier places first; first marks the earliest of equal ones."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    tied = np.flatnonzero(k[1:] == k[:-1])
    if len(tied):
        part = np.unique(np.concatenate([tied, tied + 1]))
        order[part] = order[part][np.lexsort((order[part], span[order[part]], k[part]))]
    s = span[order]
    return order, np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])[: len(order)]


class Family:
    """Levels of sorted (key, span, least doc), each more than twice the next in size."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _find(level, key: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the equal entry, whether there is one, entries with this key) by a scan of two sorted arrays."""
        low, high = np.searchsorted(level[0], key, "left"), np.searchsorted(level[0], key, "right")
        count, end = high - low, high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            less = level[1][mid] < span[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        place = np.minimum(low, len(level[0]) - 1)
        return place, (low < end) & (level[1][place] == span), count

    def add(self, key: np.ndarray, span: np.ndarray, doc: np.ndarray) -> None:
        """Takes in sorted distinct entries."""
        for level in self.levels:
            if not len(key):
                return
            place, there, _ = self._find(level, key, span)
            np.minimum.at(level[2], place[there], doc[there])
            key, span, doc = key[~there], span[~there], doc[~there]
        if len(key):
            self.levels.append((key, span, doc.copy()))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            both = [np.concatenate(x) for x in zip(self.levels.pop(-2), self.levels.pop(), strict=True)]
            order, _ = suffix_array(both[0], both[1])
            self.levels.append(tuple(x[order] for x in both))

    def scan(self, key: np.ndarray, span: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """NEW, EARLIER or FORKED for each entry, as uint8."""
        least, count = doc.copy(), np.zeros(len(key), np.int64)
        for level in self.levels:
            place, there, n = self._find(level, key, span)
            least[there] = np.minimum(least[there], level[2][place[there]])
            count += n
        return np.where(least < doc, EARLIER, np.where(count > 1, FORKED, NEW)).astype(np.uint8)


class Batch:
    """One batch's documents in order, as one buffer."""

    def __init__(self, table: pa.Table):
        given = table.column("doc_id").to_pylist()
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        ids = [_NULLS + int.from_bytes(t[:7].ljust(7, b"\0")) if i is None else i for i, t in zip(given, texts, strict=True)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.given = np.array([ids[i] for i in order], np.int64), [given[i] for i in order]
        self.buffer = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        self.ends = np.cumsum(np.array([len(texts[i]) for i in order], np.int64))

    def docs_at(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.ends, places, "right")]

    def index(self) -> None:
        self.first, self.last, self.key, self.span = stretches(self.buffer, self.ends)
        self.order, self.distinct = suffix_array(self.key, self.span)

    def settled(self, found: np.ndarray, order: np.ndarray, crowded: np.ndarray) -> np.ndarray:
        """Flags of entries(), from those found in the order of dealing: a crowded anchor that is nowhere earlier goes on differently."""
        flags = np.empty(len(found), np.uint8)
        flags[order] = found
        flags[(flags == NEW) & np.isin(self.key[self.order[self.distinct]], crowded)] = FORKED
        return flags

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = self.order[self.distinct]
        return self.key[own], self.span[own], self.docs_at(self.first[own])

    def apply(self, flags: np.ndarray) -> None:
        """flags: of entries(). Marks what is settled and lists the windows of the forked stretches."""
        of = np.full(len(self.key), EARLIER, np.uint8)  # later equal stretches of this batch
        of[self.order[self.distinct]] = flags
        self.cover = np.zeros(len(self.buffer) + 1, np.int32)
        gone, forked = of == EARLIER, np.sort(np.flatnonzero(of == FORKED))
        np.add.at(self.cover, self.first[gone], 1)
        np.add.at(self.cover, self.last[gone] + LENGTH, -1)
        n = self.last[forked] - self.first[forked] + 1
        self.wanted = np.repeat(self.first[forked], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.one, self.two = windows(self.buffer, self.ends, self.wanted)
        self.worder, self.wdistinct = suffix_array(self.one, self.two)

    def window_entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = self.worder[self.wdistinct]
        return self.one[own], self.two[own], self.docs_at(self.wanted[own])

    def finish(self, flags: np.ndarray) -> list[tuple]:
        """flags: of window_entries(). (doc_id, bytes, removed, spans, sha256 of the rest) of each document."""
        gone = np.ones(len(self.wanted), bool)
        gone[self.worder[self.wdistinct]] = flags == EARLIER
        np.add.at(self.cover, self.wanted[gone], 1)
        np.add.at(self.cover, self.wanted[gone] + LENGTH, -1)
        removed = np.cumsum(self.cover[:-1]) > 0
        out, at = [], 0
        for doc, end in zip(self.given, self.ends.tolist(), strict=True):
            r = removed[at:end]
            n = int(r.sum())
            spans = int(np.count_nonzero(r[1:] & ~r[:-1])) + int(r[0]) if n else 0
            rest = self.buffer[at:end][~r] if n else self.buffer[at:end]
            out.append((doc, end - at, n, spans, hashlib.sha256(rest.tobytes()).hexdigest()))
            at = end
        return out


_SENT = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("key", pa.binary()), ("span", pa.binary()), ("doc", pa.binary())])
_FLAGS = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("flags", pa.binary())])
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def bucket_counts(batches: int) -> tuple[int, int]:
    """Buckets of stretches and of windows: fewer than batches on large inputs, as each batch sends each bucket a row; windows can be as many as bytes."""
    few = max(min(batches, BUCKETS), -(-batches // 4))
    return few, min(batches, 2 * few)


def _buckets(key: np.ndarray, span: np.ndarray, buckets: int, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each entry's bucket: a range of keys, or for crowded ones of both fingerprints mixed; the order of dealing)."""
    mixed = np.where(np.isin(key, crowded), (key ^ span) * _MIX, key) if len(crowded) else key
    of = ((mixed >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    return of, np.argsort(of, kind="stable")


def _packed(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Binary values, one from each edge to the next."""
    ends = np.append(edge, len(values)).astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binary values, one after another, and the place in them at which each value begins."""
    whole = column.combine_chunks().cast(pa.binary())
    if not len(whole):
        return np.empty(0, kind), np.empty(0, np.int64)
    at = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    return np.frombuffer(whole.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind), (at[:-1] - at[0]) // np.dtype(kind).itemsize


def _deal(batch: int, entries: tuple[np.ndarray, ...], buckets: int, crowded: np.ndarray) -> pa.Table:
    """Entries, sorted by key, cut into buckets in which they stay sorted."""
    of, order = _buckets(*entries[:2], buckets, crowded)
    of = of[order]
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    return pa.Table.from_batches([as_batch(_SENT, of[edge], np.full(len(edge), batch), *(_packed(x[order], edge) for x in entries))])


def _joined(table: pa.Table, kind: int) -> np.ndarray:
    """A batch's flags of one kind, in the order in which its entries were dealt."""
    return _unpacked(table.filter(pc.equal(table.column("kind"), kind)).sort_by("bucket").column("flags"), np.uint8)[0]


def _scan_bucket(kind: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, edge = _unpacked(table.column("key"), _U)
        spans, docs = _unpacked(table.column("span"), _U)[0], _unpacked(table.column("doc"), np.int64)[0]
        family, orders, flags = Family(), [], np.empty(len(keys), np.uint8)
        for at in range(0, len(keys), RUN):
            order, first = suffix_array(keys[at : at + RUN], spans[at : at + RUN])
            orders.append(order + at)
            own = np.flatnonzero(first)
            family.add(keys[orders[-1][own]], spans[orders[-1][own]], np.minimum.reduceat(docs[orders[-1]], own))
        for order in orders:
            flags[order] = family.scan(keys[order], spans[order], docs[order])
        n = len(edge)
        return pa.Table.from_batches([as_batch(_FLAGS, table.column("batch").combine_chunks(), np.full(n, kind), np.full(n, key[0].as_py()), _packed(flags, edge))])

    return run


def crowded_keys(docs: DataFrame, total: int, sample: int, crowd: int) -> np.ndarray:
    """Sorted fingerprints of anchors that go on in `crowd` or more ways in a sample of the documents of some `sample` bytes: at most sample / (30 * crowd)."""
    few = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-total // sample)))) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode() for t in b.column(0).to_pylist()]
            _, _, key, span = stretches(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.array([len(t) for t in texts], np.int64)))
            once = np.unique(np.stack([key, span]), axis=1).view(np.int64) if len(key) else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1])], ["key", "span"])

    ways = few.mapInArrow(run, "key long, span long").distinct().groupBy("key").count().where(F.col("count") >= crowd)
    return np.sort(np.array([r.key for r in ways.select("key").collect()], np.int64).view(_U))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH, sample: int = SAMPLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; see the module's text.

    One plan: the dealt texts are one exchange, which the three steps that need texts read again.
    """
    docs = id_and_text(df, id_col, text_col)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // batch_bytes))
    for_stretches, for_windows = bucket_counts(n)
    # rows of one id are one batch's; rows without one are dealt by the bytes that order them
    prefix = F.rpad(F.substring(F.coalesce("text", F.lit("")).cast("binary"), 1, 7), 7, F.lit(b"\0"))
    dealt = docs.withColumn("batch", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(prefix)).otherwise(F.xxhash64("doc_id")), F.lit(n)))

    crowded, none = crowded_keys(docs, total, sample, crowd), np.empty(0, _U)

    def index(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        batch = Batch(table)
        batch.index()
        return _deal(key[0].as_py(), batch.entries(), for_stretches, crowded)

    def answered(table: pa.Table, answers: pa.Table) -> Batch:
        batch = Batch(table)
        batch.index()
        _, order = _buckets(*batch.entries()[:2], for_stretches, crowded)
        batch.apply(batch.settled(_joined(answers, 1), order, crowded))
        return batch

    def fork(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        return _deal(key[0].as_py(), answered(table, answers).window_entries(), for_windows, none)

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = answered(table, answers).finish(_joined(answers, 2))
        return pa.Table.from_batches([as_batch(_OUT, *(zip(*rows, strict=True) if rows else [[]] * 5))])

    sent, flags = "bucket long, batch long, key binary, span binary, doc binary", "batch long, kind int, bucket long, flags binary"
    by_batch = dealt.groupBy("batch")
    known = by_batch.applyInArrow(index, sent).groupBy("bucket").applyInArrow(_scan_bucket(1), flags)
    forks = by_batch.cogroup(known.groupBy("batch")).applyInArrow(fork, sent).groupBy("bucket").applyInArrow(_scan_bucket(2), flags)
    return by_batch.cogroup(known.unionByName(forks).groupBy("batch")).applyInArrow(finish, OUT)
