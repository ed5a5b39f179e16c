"""Token ids by the tokenizers library, with each distinct piece of text between hard token boundaries encoded once."""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-tokenizers' patterns over UTF-8 bytes, right for texts whose letters are ASCII or U+00C0 to U+00FF.
_KEEPS_SPACE = re.compile(rb"'(?:[stmd]|re|ve|ll)| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^\sA-Za-z0-9\x80-\xff]+|\s+(?!\S)|\s+")
_DROPS_SPACE = re.compile(rb"'(?:[stmd]|re|ve|ll)|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")
#: Bytes that a text of such letters may hold: ASCII, and what encodes U+00C0 to U+00FF.
_SIMPLE = bytes([*range(128), *range(0x80, 0xC0), 0xC3])
#: Byte-level vocabularies write a byte as the character of its number where that is visible, the others as U+0100 and on, in order.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
_BYTE_CHARS = "".join(chr(b if b in _VISIBLE else 256 + _HIDDEN.index(b)) for b in range(256))
_LOADED: dict[str, CachedEncoder] = {}


class _Pieces(dict):
    """Ids (as bytes) of pieces that the pre-tokenizer's pattern would not cut: the library's BPE model takes a new one as it is. What the cache before this one holds moves over when it is met."""

    def __init__(self, tokenize, code: str, drops_space: bool, before: dict[bytes, bytes]) -> None:
        super().__init__()
        self.tokenize, self.code, self.drops_space, self.before = tokenize, code, drops_space, before

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            if piece.isalnum() and piece.isascii():
                text = piece.decode()
            else:
                text = charmap_decode(piece.decode().lower().encode() if self.drops_space else piece, "strict", _BYTE_CHARS)[0]
            ids = array(self.code, [t.id for t in self.tokenize(text)]).tobytes()
        self[piece] = ids
        return ids


class _Words(_Pieces):
    """The same of words between white space, which hold whole pieces: only pieces are kept."""

    def __missing__(self, word: bytes) -> bytes:
        if not word.isalpha():
            pieces = _DROPS_SPACE.findall(word)
            if pieces != [word]:
                return b"".join(map(self.__getitem__, pieces))
        return super().__missing__(word)


class CachedEncoder:
    """Encodes texts to unsigned ids, equal to tokenizer.encode(text, add_special_tokens=False).

    A text of simple letters is cut by the pre-tokenizer's own pattern, and each distinct piece goes through the tokenizer once per cache. Any other text is encoded whole, as is one that names a special token. drops_space: the vocabulary's normaliser drops white space and lower-cases; no piece reaches over white space then, so Arrow cuts the texts of a call into words, each distinct word is looked up once, and only those that aren't a known piece are cut by the pattern. The cache is bounded: over max_units entries a new one begins, which takes from the last one what is met again.
    """

    def __init__(self, path: str, drops_space: bool, max_units: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space, self.max_units = drops_space, max_units
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache = self._next({})

    def _next(self, before: dict[bytes, bytes]) -> _Pieces:
        return (_Words if self.drops_space else _Pieces)(self.tokenizer.model.tokenize, self.code, self.drops_space, before)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype)

    @staticmethod
    def _simple(text: bytes) -> bool:
        # the signs of multiplication and division are no letters
        letters = text.isascii() or not text.translate(None, _SIMPLE) and b"\xc3\x97" not in text and b"\xc3\xb7" not in text
        return letters and b"<|" not in text

    def _words(self, texts: list[bytes]) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        met = words.values.dictionary_encode()
        ids = pa.array(list(map(self.cache.__getitem__, met.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False))), pa.large_binary()).take(met.indices)
        _, ends, data = ids.buffers()
        at = (np.frombuffer(ends, np.int64)[words.offsets.to_numpy()] // self.dtype.itemsize).tolist()
        joined = np.frombuffer(data or b"", self.dtype)
        return [joined[a:b] for a, b in pairwise(at)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Equal texts of a call are encoded once."""
        if len(self.cache) > self.max_units:
            self.cache.before = {}
            self.cache = self._next(self.cache)
        found = dict.fromkeys(texts)
        simple = [t for t in found if self._simple(t)]
        if self.drops_space:
            found.update(zip(simple, self._words(simple), strict=True))
        else:
            found.update((t, np.frombuffer(b"".join(map(self.cache.__getitem__, _KEEPS_SPACE.findall(t))), self.dtype)) for t in simple)
        found.update((t, self._whole(t)) for t, ids in found.items() if ids is None)
        return [found[t] for t in texts]


def encoder(path: str, drops_space: bool) -> CachedEncoder:
    """The encoder of this Python process for a vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = CachedEncoder(path, drops_space)
    return _LOADED[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
