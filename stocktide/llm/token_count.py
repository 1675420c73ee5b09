"""Token counts of whole texts by whole-token lookup.

Offline, the vocabulary is gone through once: a string counts as proved if the library encodes it, alone, as exactly one
token. No vocabulary string has a space marker after another character (also proved offline), so no merge crosses from one
word to the next one's leading spaces, and a text's count is the sum over its units (leading spaces and a word). A unit that
is a proved string counts 1; all other units of a block of texts go through the library's merges, once for each distinct one.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows stay repeated; other
columns are not read; texts with the space marker itself are counted whole by the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_batch, id_and_text, slices

MARK = "▁"
CACHE = 300_000  # entries of one cache generation, some 80 MB at most
LONGEST = 32  # characters of a unit that is kept; longer ones (texts without spaces) are merged anew in each block
_UNITS = re.compile(r" *[^ ]+| +")


class WholeTokenCounter:
    _made: dict[str, "WholeTokenCounter"] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        strings = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size()) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        self.separable = not any(MARK in s.lstrip(MARK) for s in strings)
        words = [s[1:].replace(MARK, " ") for s in strings if s.startswith(MARK) and len(s) > 1]
        #: Proved offline: " word" -> 1 where the library gives one token for the word alone (it adds the leading mark itself).
        self.proved = {" " + w: 1 for w, ids in zip(words, self.library.encode(words, num_threads=1), strict=True) if len(ids) == 1}
        #: A lone space ends a text; alone it would be no text, so it is counted as what it adds.
        self.proved[" "] = len(self.library.encode("a ")) - len(self.library.encode("a"))
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    @classmethod
    def at(cls, path: str) -> "WholeTokenCounter":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def count_many(self, texts: list[str]) -> list[int]:
        if not self.separable:
            return [len(ids) for ids in self.library.encode(texts, num_threads=1)]
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        if not self.new:
            self.new.update(self.proved)
        units = [None if MARK in t else _UNITS.findall(" " + t) if t else [] for t in texts]
        unseen: set[str] = set()
        for u in units:
            unseen.update(u or ())
        unseen.difference_update(self.new)
        merge, here = [], {}
        for u in unseen:
            if (n := self.old.get(u)) is not None:
                self.new[u] = n
            else:
                merge.append(u)
        for u, ids in zip(merge, self.library.encode([u[1:] for u in merge], num_threads=1) if merge else (), strict=True):
            (self.new if len(u) <= LONGEST else here)[u] = len(ids)
        of = (lambda u: here[u] if u in here else self.new[u]) if here else self.new.__getitem__
        return [len(self.library.encode(t)) if u is None else sum(map(of, u)) for t, u in zip(texts, units, strict=True)]


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WholeTokenCounter.at(model_path)
        for ids, texts in slices(batches):
            n = counter.count_many(texts)
            yield as_batch(_ARROW, ids, [len(t.encode()) for t in texts], n, [x > limit for x in n])

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)
