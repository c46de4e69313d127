"""Token ids of whole texts through a bounded word cache.

A byte-pair model cuts a text into pieces by a pattern and merges within each
piece only. Two kinds of place always end a piece: a space or a line feed
between characters that are not white space, and the change from a letter or
digit to ASCII punctuation at the end of a word. Words between such places are
therefore encoded once by the tokenizers library and looked up afterwards; any
text with other white space next to a separator is cut at the remaining safe
places alone. A text that holds the string of a special token goes to the
library whole, which gives the token's one id for it. The ids equal those of
the library's encode(text, add_special_tokens=False) for the whole text.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

#: ASCII punctuation that no contraction pattern begins with.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space other than a space or line feed.
_ODD = [*map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")

#: Byte-level models write a byte as one printable character: itself, or the next free one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = dict(zip(_PRINTABLE, _PRINTABLE, strict=True)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
_SPACE = chr(_BYTE_CHARS[32])


#: Words a table holds, some 150 bytes each. A word dropped too early costs an encoding, and an executor has a table in each of its Python workers.
MOST = 690_000


class _Odd(Exception):
    """White space next to white space."""


class _Cache(dict):
    """Word to little-endian ids, at most `most` words; when they are that many, the oldest quarter goes.

    What is cheap to put together from other words takes no place, or one when
    it comes again. latin: letters and digits up to U+00FF stay what they are,
    so that punctuation after them is a piece of its own.
    """

    def __init__(self, encode, prefix: str, tails: _Cache | None, most: int, latin: bool = False):
        super().__init__()
        self.encode, self.prefix, self.most = encode, prefix, most
        self.tails = self if tails is None else tails
        self.last = "\xff" if latin else "\x7f"

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            ids = self.encode(self.prefix + word)
        elif word[:1] == "\n" and self.prefix:
            if len(word) == 1:
                raise _Odd
            return self.tails["\n"] + self.tails[word[1:]]
        elif not word and self.prefix:
            raise _Odd
        else:
            core = word.rstrip(_TAIL)
            if core != word and core[-1:].isalnum() and core[-1:] <= self.last:  # lower-casing another letter may end it in a mark
                held = core in self
                ids = self[core] + self.tails[word[len(core) :]]
                if not held:
                    return ids
            else:
                ids = self.encode(self.prefix + word)
        if len(word) <= 64:
            if len(self) >= self.most:
                for old in list(islice(self, max(1, self.most // 4))):
                    del self[old]
            self[word] = ids
        return ids


class WordEncoder:
    """ids(text): little-endian unsigned 32-bit ids of a text, no special tokens added.

    spaces: True where a space belongs to the word after it and line feeds have
    ids (byte-level models); False where white space is dropped.
    """

    def __init__(self, path: str, spaces: bool, most: int = MOST):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        #: What all special strings begin with, to look for first; other letters' lower case never is ASCII punctuation.
        start = os.path.commonprefix(self.special)
        self.mark = start[: len(start) - len(start.lstrip(_TAIL))]
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.spaces = spaces
        #: Each id as it is written.
        self.written = [x.tobytes() for x in np.arange(max(self.tokenizer.get_vocab().values()) + 1, dtype="<u4")]
        latin = self.normalizer is None
        self.plain = _Cache(self._encode, "", None, most // 4 if spaces else most, latin)
        self.spaced = _Cache(self._encode, " ", self.plain, most, latin) if spaces else self.plain
        #: What a text may end in after its last word.
        self.ends = {x: self._encode(x or " ") for x in ("", "\n")} if spaces else {}

    def _encode(self, text: str) -> bytes:
        mapped = None
        if self.normalizer is None:
            mapped = _SPACE + text[1:] if text[:1] == " " else text
            if not mapped.isalpha():  # a letter stands for the space
                mapped = None
            elif not text.isascii():
                mapped = text.encode().decode("latin-1").translate(_BYTE_CHARS)
        elif text.isalpha():
            text = text.lower() if text.isascii() else self.normalizer.normalize_str(text)
            if text.isalpha():
                mapped = text.encode().decode("latin-1").translate(_BYTE_CHARS)
        if mapped is not None:  # one piece: straight to the model
            written = self.written
            return b"".join([written[t.id] for t in self.model.tokenize(mapped)])
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special and self.mark in text and any(t in text.lower() for t in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not self.spaces:
            return b"".join(map(self.plain.__getitem__, text.replace("\n", " ").split(" ")))
        if not any(x in text for x in _ODD):
            first, *rest = text.replace("\n", " \n").split(" ")  # a line feed goes with the word after it
            end = self.ends[rest.pop()] if rest and rest[-1] in self.ends else b""
            try:
                return (self.plain[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest)) + end
            except _Odd:
                pass
        first, *rest = _SAFE_SPACE.split(text)
        return (self.plain[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, spaces: bool) -> WordEncoder:
    """One encoder per Python worker: its cache outlives a task."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = WordEncoder(path, spaces)
    return _ENCODERS[path, spaces]
