"""Repeated strings and near-duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest

from stocktide.llm import simhash, suffix
from stocktide.llm.graph import components

from .conftest import ODD


def brute_repeats(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def _key(rows):
    return sorted(((r[0] is None, r[0] or 0, *r[1:]) for r in rows))


def _passages(seed, n):
    r = random.Random(seed)
    common = ["".join(r.choice("abcdefg é") for _ in range(r.randint(80, 400))) for _ in range(9)]
    piece = lambda: r.choice([r.choice(common), r.choice(common)[: r.randint(1, 300)], "a" * r.randint(0, 300), "ab" * r.randint(0, 120), "".join(r.choice("abc") for _ in range(r.randint(0, 50)))])
    return [(i, "".join(piece() for _ in range(r.randint(0, 5)))) for i in range(n)]


@pytest.mark.parametrize("batch", [2_000, 1 << 20])
def test_repeats_equal_brute_force(docs, batch):
    rows = _passages(5, 80)
    got = suffix.remove_repeats(docs(rows), batch_bytes=batch).collect()
    assert _key(map(tuple, got)) == _key(brute_repeats(rows))


def test_repeats_of_odd_rows(odd, docs):
    assert _key(map(tuple, suffix.remove_repeats(odd, batch_bytes=500).collect())) == _key(brute_repeats(ODD))
    assert suffix.remove_repeats(docs([]).limit(0)).count() == 0


def test_a_line_of_every_document_is_dealt_to_many_buckets(docs):
    """An anchor with another continuation in each document leaves no bucket with all of them, and changes no result."""
    r = random.Random(3)
    line = "this text is released under the terms of a licence that is printed at the end of it, see there;"
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(300)) + line + "".join(r.choice("abcdefgh ") for _ in range(300))) for i in range(400)]
    rows += [(1000 + i, rows[i][1][150:600]) for i in range(40)]
    assert _key(map(tuple, suffix.remove_repeats(docs(rows), batch_bytes=20_000).collect())) == _key(brute_repeats(rows))
    assert _key(map(tuple, suffix.remove_repeats(docs(rows), batch_bytes=20_000, crowd=2).collect())) == _key(brute_repeats(rows))
    import pyarrow as pa

    batch = suffix.Batch(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    batch.index()
    crowded = suffix.crowded_keys(docs(rows).select("doc_id", "text"), 1, 1 << 20, suffix.CROWD)
    key, span, _ = batch.entries()
    assert 1 <= len(crowded) < 30 and max(np.bincount(suffix._buckets(key, span, 50, np.empty(0, np.uint64))[0])) > 400
    assert max(np.bincount(suffix._buckets(key, span, 50, crowded)[0])) < 2.5 * len(key) / 50


def test_repeats_of_many_rows_without_an_id(docs):
    """Rows without an id are several batches' and come in the order of their texts; the largest ids stay theirs."""
    rows = [(None if i % 2 else i, t) for i, t in _passages(6, 90)] + [((1 << 62) - 1, "x" * 150), ((1 << 63) - 1, "unlike anything else " * 9), (None, "x" * 120)]
    got = suffix.remove_repeats(docs(rows), batch_bytes=700).collect()
    last = (1 << 63) - 1
    assert _key(map(tuple, got)) == _key(brute_repeats(rows)) and [r.doc_id for r in got if r.doc_id == last] == [last]


def test_stretches_cut_at_chunks(monkeypatch):
    monkeypatch.setattr(suffix, "_CHUNK", 512)
    monkeypatch.setattr(suffix.Rolling, "_powers", {})
    import pyarrow as pa

    rows = _passages(8, 30)
    batch = suffix.Batch(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    batch.index()
    family = suffix.Family()
    family.add(*batch.entries())
    batch.apply(family.scan(*batch.entries()))
    windows = suffix.Family()
    windows.add(*batch.window_entries())
    assert _key(batch.finish(windows.scan(*batch.window_entries()))) == _key(brute_repeats(rows))
    monkeypatch.setattr(suffix.Rolling, "_powers", {})


def test_a_bucket_takes_in_its_entries_whatever_the_number_of_batches(monkeypatch):
    """Many batches with a few entries each: as many steps of the family as the entries fill runs, and the answers of a dictionary."""
    import pyarrow as pa

    r, rows, best, ways = np.random.default_rng(2), [], {}, {}
    for i in range(300):
        key, span = np.unique(r.integers(0, 2000, 20, np.uint64)), r.integers(0, 3, 20, np.uint64)
        entries = list(zip(key.tolist(), span.tolist(), r.integers(0, 1000, 20).tolist()))
        rows.append((i, entries))
        for k, s, d in entries:
            best[k, s] = min(best.get((k, s), 1 << 60), d)
            ways.setdefault(k, set()).add(s)
    steps, add, scan = [], suffix.Family.add, suffix.Family.scan
    monkeypatch.setattr(suffix, "RUN", 900, raising=False)
    monkeypatch.setattr(suffix.Family, "add", lambda self, *x: steps.append(len(x[0])) or add(self, *x))
    monkeypatch.setattr(suffix.Family, "scan", lambda self, *x: steps.append(len(x[0])) or scan(self, *x))
    column = lambda j, kind: [np.array([e[j] for e in entries], kind).tobytes() for _, entries in rows]
    table = pa.table({"bucket": [7] * 300, "batch": [i for i, _ in rows], "key": column(0, np.uint64), "span": column(1, np.uint64), "doc": column(2, np.int64)}, schema=suffix._SENT)
    got = suffix._scan_bucket(2)((pa.scalar(7),), table.take(r.permutation(300))).to_pylist()
    assert [(g["kind"], g["bucket"]) for g in got] == [(2, 7)] * 300
    flag = lambda k, s, d: suffix.EARLIER if best[k, s] < d else suffix.FORKED if len(ways[k]) > 1 else suffix.NEW
    assert {g["batch"]: list(g["flags"]) for g in got} == {i: [flag(*e) for e in entries] for i, entries in rows}
    assert len(steps) <= 2 * (1 + sum(len(e) for _, e in rows) // 900)


def test_repeats_with_fewer_buckets_than_batches(docs, monkeypatch):
    """Each batch sends at most a row to each bucket; their numbers do not both follow the input."""
    rows = _passages(5, 80)
    monkeypatch.setattr(suffix, "BUCKETS", 3, raising=False)
    got = suffix.remove_repeats(docs(rows), batch_bytes=1000).collect()
    assert _key(map(tuple, got)) == _key(brute_repeats(rows))
    n = -(-sum(len(t.encode()) for _, t in rows) // 1000)
    assert n > 12 and suffix.bucket_counts(n) == (-(-n // 4), 2 * -(-n // 4)) and suffix.bucket_counts(2) == (2, 2)


def test_family_levels_stay_geometric():
    r, family = np.random.default_rng(1), suffix.Family()
    best = {}
    for _ in range(60):
        key, span = np.sort(r.integers(0, 400, 50, np.uint64)), r.integers(0, 3, 50, np.uint64)
        order, first = suffix.suffix_array(key, span)
        own = order[first]
        doc = r.integers(0, 1000, len(own))
        for k, s, d in zip(key[own], span[own], doc):
            best[k, s] = min(best.get((k, s), 1 << 60), d)
        family.add(key[own], span[own], doc)
        sizes = [len(x[0]) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert sum(len(x[0]) for x in family.levels) == len(best)
    assert {(k, s): d for x in family.levels for k, s, d in zip(*x)} == best


def brute_fingerprint(text):
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    r = random.Random(3)
    for t in ["", " ", "One", "one TWO", "É É é a", *(" ".join(r.choice(["a", "B", "c\t", "é\x85x", "\n"]) for _ in range(r.randint(0, 40))) for _ in range(60))]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == brute_fingerprint("a b c")


def _ball(seed, n):
    r = np.random.default_rng(seed)
    a = r.integers(0, 2**64, n, np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << r.integers(0, 64, len(x)).astype(np.uint64))
    return np.unique(np.concatenate([a, flip(a[: n // 2]), flip(flip(a[: n // 3])), np.arange(n // 4, dtype=np.uint64)]))


def test_trie_pairs_equal_all_pairs():
    x, y = _ball(1, 600), _ball(2, 300)
    got = {(int(i), int(j)) for a, b in simhash.trie_pairs(x, None, 2, 0, most=64) for i, j in zip(a, b)}
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 2)) if i < j}
    got = {(int(i), int(j)) for a, b in simhash.trie_pairs(x, y, 2, 0) for i, j in zip(a, b)}
    assert got == set(zip(*np.nonzero(np.bitwise_count(x[:, None] ^ y[None]) <= 2)))


def brute_components(values, budget=2):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("node, heavy", [(4000, 100_000), (40, 100_000), (200, 100)])
def test_links_join_what_chains_join(spark, node, heavy):
    x = _ball(4, 300)
    signed = [int(v) for v in x.view(np.int64)]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    root = {r.node: r.root for r in components(simhash.links(df, 2, node, heavy)).collect()}
    want = brute_components([int(v) for v in x])
    groups, got = {}, {}
    for v, w in zip(signed, want):
        groups.setdefault(w, set()).add(v)
        got.setdefault(root.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501)], "a long, b long")
    root = {r.node: r.root for r in components(edges).collect()}
    assert all(root.get(i, i) == 0 for i in range(1, 201)) and root.get(501, 501) == 500


def test_near_duplicates_of_rows(docs):
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(60, 300))] for _ in range(25)]
    rows = list(ODD)
    for k in range(120):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((100 + r.randrange(200), " ".join(words)))
    got = simhash.near_duplicates(docs(rows)).collect()
    fps = [brute_fingerprint(t or "") for _, t in rows]
    group = brute_components(fps)
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = [(i is None, i or 0, f"{f:016x}", least.get(g) is None, least.get(g) or 0) for (i, _), f, g in zip(rows, fps, group)]
    assert sorted((x.doc_id is None, x.doc_id or 0, x.fingerprint, x.component_id is None, x.component_id or 0) for x in got) == sorted(want)


def test_near_duplicates_of_nothing(docs):
    assert simhash.near_duplicates(docs([]).limit(0)).count() == 0
