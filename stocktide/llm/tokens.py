"""Exact, fast tokenisation: ids equal to Tokenizer.encode(text, add_special_tokens=False).ids for two kinds of vocabulary.

Byte-pair merges never cross a pre-token, so ids of a text are the ids of its pre-tokens in order.

* Byte-level vocabularies run on the tiktoken engine over the ranks of the same file.
* Vocabularies with word ends drop white space, so the ids of each distinct word between white space are kept; a new word is
  cut with a compiled `re` pattern and the same engine merges its pre-tokens, a word's end being the byte 0xFF, which no UTF-8
  text has. The cache has two generations, so it never exceeds 2 x CACHE and one block's words.

Both hold for letters and digits below U+0250 whose small letters are below it too and some punctuation; a text with any
other character, or with a special string, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE = 300_000  # entries of one cache generation, some 60 MB
LONGEST = 64  # characters of a word that is kept
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_END = b"\xff"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"  # fixed: the contractions that both vocabularies were built with
_WORDS = re.compile(rf"{_CONTRACTIONS}|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
_BYTE_LEVEL = rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+"
#: Characters whose classes differ between Unicode versions or regex libraries, or that normalisation could change.
_BEYOND = "".join(c for c in map(chr, range(0x250)) if max(map(ord, c.lower())) >= 0x250)  # capitals whose small letters are no `_L`
_UNSAFE = re.compile(f"[^\x00-\x1b\x20-įı-ɏ‐-―‘-‟…€]|[{_BEYOND}]|<\\|")


def _byte_of_char() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level vocabularies means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Ids of words between white space, as bytes; a word that is not there is cut into pre-tokens and merged."""

    def __init__(self, merge):
        self.merge, self.old = merge, {}

    def turn(self) -> None:
        """Begins a new generation when this one is full."""
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            pieces = [word] if word.isalpha() else _WORDS.findall(word)
            ids = array("I", self.merge(word.encode() + _END)).tobytes() if len(pieces) == 1 else b"".join(map(self.__getitem__, pieces))
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class Encoder:
    """encode_many(texts) -> one array of uint32 ids a text."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        import tiktoken

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, of = model.get("end_of_word_suffix"), _byte_of_char()
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = {}
        for t, i in model["vocab"].items():
            inner = t.removesuffix(end) if end else t
            if t not in special and all(c in of for c in inner):
                ranks[bytes(of[c] for c in inner) + (_END if inner != t else b"")] = i
        engine = tiktoken.Encoding("ranks", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.word_ends = bool(end)
        self.one_piece, self.one_text = engine._encode_single_piece, engine.encode_to_numpy
        self.words = _Words(self.one_piece)

    @classmethod
    def at(cls, path: str) -> "Encoder":
        """One encoder for each worker process and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if not self.word_ends:
            one = self.one_text
            return [self._whole(t) if _UNSAFE.search(t) else one(t, disallowed_special=()) if t else np.empty(0, np.uint32) for t in texts]
        self.words.turn()
        of = self.words.__getitem__
        return [self._whole(t) if _UNSAFE.search(t) else np.frombuffer(b"".join(map(of, t.lower().split())), np.uint32) for t in texts]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
