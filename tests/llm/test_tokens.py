"""Tokenising operators against their libraries."""

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stocktide.llm import packing, token_count, token_store
from stocktide.llm.common import fresh_path
from stocktide.llm.tokens import Encoder, tokenizer_path

from .conftest import ODD

BYTE, WORD, PIECE = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
_some = st.text(st.sampled_from("abé \n'strelTE1½²!?.,ÀŒ’—\t\x0b\x85\x1c—<|>İΣς日😀́ "), max_size=60)


@settings(max_examples=400, deadline=None)
@given(_some)
def test_encoder_equals_library(text):
    for path in (BYTE, WORD):
        e = Encoder.at(path)
        assert e.encode_many([text])[0].tolist() == e.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab é\n▁  .,日😀<>s/"), max_size=50))
def test_counter_equals_library(text):
    c = token_count.WholeTokenCounter.at(PIECE)
    assert c.count_many([text]) == [len(c.library.encode(text))]


def test_proved_strings_are_one_token():
    c = token_count.WholeTokenCounter.at(PIECE)
    assert c.separable and len(c.proved) > 10_000
    for u in random.Random(1).sample(sorted(c.proved), 500):
        assert len(c.library.encode(u[1:])) == 1 or u == " "


def test_cache_generations_change_nothing(monkeypatch):
    from stocktide.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 5)
    e = Encoder(WORD)
    texts = [" ".join(f"w{i}x{j % 3}," for j in range(9)) for i in range(30)] * 2
    for t in texts:
        assert e.encode_many([t])[0].tolist() == e.library.encode(t, add_special_tokens=False).ids


def test_every_character_that_counts_as_safe():
    """Alone, in words, before punctuation and digits; then random texts of all of them."""
    from stocktide.llm.tokens import _UNSAFE

    safe, r = [c for c in map(chr, range(0x2100)) if not _UNSAFE.search(c)], random.Random(5)
    texts = [t for c in safe for t in (c, f"a{c}", f"{c}a", f"a{c}a", f"{c},", f",{c}", f"{c}1", f" {c} ", c + c, f"{c}'s")] + ["Əli,", "ƁƆ ɏɎ"]
    texts += ["".join(r.choice(safe) if r.random() < 0.7 else r.choice("ab 's,.1 ") for _ in range(r.randint(1, 25))) for _ in range(20_000)]
    for path in (BYTE, WORD):
        e = Encoder.at(path)
        assert [x.tolist() for x in e.encode_many(texts)] == [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]


def test_long_units_are_not_kept():
    """Texts without spaces are counted right and leave nothing in the cache, nor do long words."""
    c, r = token_count.WholeTokenCounter(PIECE), random.Random(6)
    texts = ["".join(r.choice("日本語文字中国人山川") for _ in range(500)) + " a" for _ in range(40)]
    assert c.count_many(texts) == [len(c.library.encode(t)) for t in texts]
    assert max(map(len, c.new)) <= token_count.LONGEST or max(map(len, c.new)) == max(map(len, c.proved))
    e = Encoder(WORD)
    assert e.encode_many(["x" * 5000 + " y"])[0].tolist() == e.library.encode("x" * 5000 + " y", add_special_tokens=False).ids
    assert max(map(len, e.words)) <= 64


def test_token_counts_of_odd_rows(odd):
    rows = token_count.count_tokens(odd, PIECE, limit=100).collect()
    lib = token_count.WholeTokenCounter.at(PIECE).library
    want = sorted(((i is None, i or 0, len((t or "").encode()), len(lib.encode(t or ""))) for i, t in ODD))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)


def test_binary_pieces():
    assert packing.binary_pieces(0, 8) == []
    assert packing.binary_pieces(8, 8) == [(0, 8)]
    assert packing.binary_pieces(29, 8) == [(0, 8), (8, 8), (16, 8), (24, 4), (28, 1)]


def test_packing_round_trip(odd):
    rows = packing.pack_documents(odd, BYTE).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    lib, seen = Encoder.at(BYTE).library, []
    for doc in {r.doc_id for r in rows}:
        for total in {r.doc_tokens for r in rows if r.doc_id == doc}:
            mine = [r for r in rows if (r.doc_id, r.doc_tokens) == (doc, total)]
            n = max(sum(r.start == s.start for s in mine) for r in mine)
            ids = {r.start: bytes(r.ids) for r in mine}
            assert all(r.length in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024) and len(r.ids) == 4 * r.length and 1 << r.bucket == r.length for r in mine)
            seen += [(doc is None, doc or 0, tuple(np.frombuffer(b"".join(ids[s] for s in sorted(ids)), "<u4").tolist()))] * n
    want = [(i is None, i or 0, tuple(lib.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in ODD]
    assert sorted(set(seen)) == sorted(set(want)) and len(seen) == len(want)
    d = packing.digest(packing.pack_documents(odd, BYTE)).collect()
    assert {(r.start, r.length, r.ids_crc32) for r in d} == {(r.start, r.length, zlib.crc32(bytes(r.ids))) for r in rows}


def test_token_store_round_trip(spark, odd):
    path = fresh_path(spark, "store")
    token_store.write_token_ids(odd, path, WORD)
    rows = token_store.read_token_ids(spark, path).collect()
    lib = Encoder.at(WORD).library
    order = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    at, want = 0, []
    for i, t in order:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((at, i, ids))
        at += len(ids)
    assert sorted((r.start, r.doc_id, list(r.ids)) for r in rows if r.doc_id is not None) == sorted(w for w in want if w[1] is not None)
    assert sorted((r.start, list(r.ids)) for r in rows if r.doc_id is None) == sorted((a, x) for a, i, x in want if i is None)
    d = token_store.digest(token_store.read_token_ids(spark, path)).collect()
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in d) == sorted((a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for a, _, x in want)
    assert [r.doc_id for r in token_store.read_token_ids(spark, path, [5]).collect()] == [5]
    plan = token_store.read_token_ids(spark, path, [5])._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" in plan.split("PushedFilters")[1][:80]


def test_empty_tables(spark, docs):
    empty = docs([]).limit(0)
    path = fresh_path(spark, "store")
    token_store.write_token_ids(empty, path, WORD)
    assert token_store.read_token_ids(spark, path).count() == 0
    assert packing.pack_documents(empty, BYTE).count() == 0
    assert token_count.count_tokens(empty, PIECE).count() == 0


def test_rows_without_an_id_are_several_tasks(docs, spark):
    """They come first, in order of their texts, whatever the number of files."""
    texts = [f"t{i:03d} " + "word " * (i % 5) for i in range(60)]
    path = fresh_path(spark, "nulls")
    token_store.write_token_ids(docs([(None, t) for t in texts] + [(3, "a b")]).repartition(5), path, WORD)
    rows = sorted(token_store.read_token_ids(spark, path).collect(), key=lambda r: r.start)
    e = Encoder.at(WORD)
    assert [r.doc_id for r in rows] == [None] * 60 + [3]
    assert [list(r.ids) for r in rows[:60]] == [e.library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
