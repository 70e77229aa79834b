"""Token ids by the tokenizers library, each distinct pre-token encoded once per worker.

A byte-level BPE never merges across pre-tokens, so a text's ids are the
concatenation of its pre-tokens' ids.  Every space that stands before anything
but white space starts a pre-token, so texts are cut there, and ids of the
pieces are kept in a bounded two-generation cache, which a worker's later tasks find
again.  A piece that is not cached is split by
the tokenizer's own pattern and each pre-token goes to the library's BPE model;
a word with marks behind it, or with a line break before the next word, is split without it.
Texts with an added token's string in them go to ``Tokenizer.encode`` whole, and
so do all texts if the tokenizer is of another kind: with a normaliser, another
pre-tokenizer or pattern, or dropout.
"""

from __future__ import annotations

import array
import codecs
import functools
import os
import zlib

import numpy as np
import regex
from tokenizers import Tokenizer, models, pre_tokenizers

#: The pattern of the library's ByteLevel pre-tokenizer.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE uses for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


_LETTERS = "".join(_byte_letters()[b] for b in range(256))
#: Behind a word, a run of these is one pre-token; an apostrophe may be more.
_MARKS = ".,!?;:*#$%&"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class CachedEncoder:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    ``entries`` bounds each generation of the cache; it only trades memory for
    time and never changes a result.
    """

    def __init__(self, path: str | None = None, entries: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.model = self.tokenizer.model
        self.tokenize = self.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        split = self.tokenizer.pre_tokenizer
        #: whether ids of pre-tokens can be put together
        self.byte_level = isinstance(self.model, models.BPE) and not self.model.dropout and self.tokenizer.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel) and not split.add_prefix_space and split.use_regex and self.tokenizer.truncation is None and self.tokenizer.padding is None
        self.typecode = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.entries = entries
        #: ids of " " + key
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: ids of pre-tokens without a space before them
        self.bare: dict[str, bytes] = {}

    def _encode(self, pre_token: str) -> bytes:
        found = self.bare.get(pre_token)
        if found is None:
            found = self._model(pre_token)
            if len(pre_token) <= 16 and pre_token[0] != " ":
                if len(self.bare) >= self.entries // 4:
                    self.bare.clear()
                self.bare[pre_token] = found
        return found

    def _model(self, pre_token: str) -> bytes:
        letters = codecs.charmap_decode(pre_token.encode("utf-8", "surrogatepass"), "strict", _LETTERS)[0]
        return array.array(self.typecode, [t.id for t in self.tokenize(letters)]).tobytes()

    def _bare(self, s: str) -> bytes:
        """ids of s, with no space before it."""
        word = s.rstrip(_MARKS)
        if word.isalpha():
            return self._encode(word) + self._encode(s[len(word) :]) if len(word) < len(s) else self._encode(s)
        return b"".join([self._encode(p) for p in _PATTERN.findall(s)])

    def _piece(self, s: str) -> bytes | None:
        """ids of " " + s; None if no pre-token starts at that space."""
        found = self.old.get(s)
        if found is None:
            if s.isalpha():
                found = self._model(" " + s)
            elif not s or s[0].isspace():
                return None
            elif (word := s.rstrip(_MARKS)).isalpha():
                found = (self.young.get(word) or self._piece(word)) + self._encode(s[len(word) :])
            else:
                line, _, rest = s.partition("\n")
                if rest[:1].isalpha() and line.rstrip(_MARKS).isalpha():
                    found = (self.young.get(line) or self._piece(line)) + self._encode("\n") + self._bare(rest)
                else:
                    first, *others = _PATTERN.findall(" " + s)
                    word = first[1:]
                    found = ((self.young.get(word) or self._piece(word)) if word.isalpha() and others else self._model(first)) + b"".join([self._encode(p) for p in others])
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        if len(s) <= 64:
            self.young[s] = found
        return found

    def raw(self, text: str | None) -> bytes:
        """The ids as bytes of unsigned 16-bit (or 32-bit, for large vocabularies) numbers."""
        if not text:
            return b""
        for s in self.special if self.byte_level else ("",):
            if s in text:
                return array.array(self.typecode, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = text.split(" ")
        head = pieces[0]
        pieces[0] = "a"
        out = list(map(self.young.get, pieces))
        out[0] = self._bare(head)
        if None in out:
            piece = self._piece
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = ids = piece(pieces[i])
                    if ids is None:  # runs of white space
                        return b"".join([self._encode(p) for p in _PATTERN.findall(text)])
        return b"".join(out)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), dtype=np.uint16 if self.typecode == "H" else np.uint32)


@functools.lru_cache(maxsize=1)
def _kept(path: str, stamp: tuple[int, int]) -> CachedEncoder:
    return CachedEncoder(path)


def kept_encoder(path: str | None = None) -> CachedEncoder:
    """This process's encoder, with the cache its earlier tasks left; a file that has changed is read anew."""
    path = path or default_path()
    at = os.stat(path)
    return _kept(path, (at.st_mtime_ns, at.st_size))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
