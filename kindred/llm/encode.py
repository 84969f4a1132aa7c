"""Token ids of whole texts with a public tokenizer file.

The tokenizer splits at white space before anything else, so ids of a text are the ids of its
chunks in a row. Chunks repeat: each worker remembers their packed ids (little-endian unsigned
32-bit) in two generations of at most CACHE_BYTES each, over all tasks it runs. A new chunk that is
plain letters goes straight to the tokenizer's merge model; any other through the whole tokenizer.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: bytes of chunks, ids and their bookkeeping that one generation holds, about
CACHE_BYTES = 36_000_000
#: what an entry takes beside its own bytes
_ENTRY = 200
#: longer chunks hardly repeat and are not remembered
_LONGEST = 64

#: letters a-z or U+00C0..U+00FF, then maybe ASCII punctuation other than an apostrophe: the
#: tokenizer's own split falls between the two
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)?")


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Path of a public tokenizer file as this machine has it; a full path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    for U+0100 onwards in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """chunk -> packed ids; ``packed(text)`` gives those of a whole text (null: of an empty one).

    The dictionary itself is the young generation; once full it becomes the old one, from which
    chunks that are met again move back."""

    def __init__(self, name: str = DEFAULT_TOKENIZER):
        import json

        from tokenizers import Tokenizer

        path = str(tokenizer_path(name))
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # only the layout described above allows chunks on their own
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_chunk = kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"
        self.model, self.letters = self.tok.model, _byte_letters()
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.old.get(chunk)
        if out is None:
            out = self._encoded(chunk)
        if len(chunk) <= _LONGEST:
            if self.size > CACHE_BYTES:
                self.old = dict(self)
                self.clear()
                self.size = 0
            self[chunk] = out
            self.size += len(chunk) + len(out) + _ENTRY
        return out

    def _encoded(self, chunk: bytes) -> bytes:
        m = _PLAIN.fullmatch(chunk)
        if m is None:
            return array("I", self.tok.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        if m[2] is not None:
            return self[m[1]] + self[m[2]]
        word = chunk if chunk.isascii() else chunk.decode().lower().encode()
        word = word.decode("ascii") if word.isascii() else "".join(map(self.letters.__getitem__, word))
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk:
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        raw = text.encode("utf-8", "replace")
        # "<|" may begin a special token, whose letters must keep their case
        return b"".join(map(self.__getitem__, raw.split() if b"<|" in raw else raw.lower().split()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = DEFAULT_TOKENIZER) -> Encoder:
    """This worker's encoder; a reused worker keeps what it has learnt."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4")
