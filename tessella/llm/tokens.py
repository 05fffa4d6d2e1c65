"""Token ids of whole texts by the tokenizers library, with a cache of pieces."""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces in a generation of a worker's cache. When one is full, the last is forgotten, but for what was met again;
#: that costs time, not results.
CACHE_PIECES = 600_000

_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_MARKS = "[.,:;!?|]*"

class _Pieces(dict):
    """Ids by piece, in two generations; what both lack is computed."""

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute = compute
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.compute(piece)
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class PieceEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers, as encode() of the library does.

    Pre-tokens of the known kinds never cross some places, so that a text's ids are its pieces' ids in a row:

    * "leading" (byte level, spaces lead words): before a space that follows no white space. The pattern takes the
      space with the word, number or sign run behind it, and looks at nothing before it.
    * "dropped" (lower-cased words, white space dropped): at every space and line feed.

    A piece that the cache lacks, if it is Latin-1 letters with common signs and line feeds, falls apart into pre-tokens
    between those, and the library's model encodes each word. All other pieces go through the whole tokenizer, and any
    other kind of tokenizer encodes whole texts. Special tokens' strings are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = _kind(spec)
        self.pieces = _Pieces(self._piece if self.kind == "dropped" else lambda p: self._piece(" " + p))
        self.signs: dict[str, bytes] = {"": b""}
        lead = " ?" if self.kind == "leading" else ""
        self.simple = re.compile(f"({lead}{_LETTERS})({_MARKS})(?:(\n)({_LETTERS})({_MARKS}))?")
        self.model = self.tokenizer.model
        self.space = _byte_char(0x20)
        self.as_bytes = {ord(c): "".join(map(_byte_char, c.encode())) for c in [" ", *map(chr, range(0xC0, 0x100))]}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        if self.kind == "dropped":
            word = word.lower()
            if not word.isascii():
                word = word.translate(self.as_bytes)
        elif not word.isascii():
            word = word.translate(self.as_bytes)
        elif word[0] == " ":
            word = self.space + word[1:]
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _sign(self, sign: str) -> bytes:
        if (ids := self.signs.get(sign)) is None:
            if len(self.signs) > 10_000:
                self.signs = {"": b""}
            ids = self.signs[sign] = self._library([sign])[0]
        return ids

    def _piece(self, piece: str) -> bytes:
        if m := self.simple.fullmatch(piece):
            first, signs, feed, second, more = m.groups()
            ids = self._word(first)
            if signs:
                ids += self._sign(signs)
            return ids + self._sign(feed) + self._word(second) + self._sign(more) if feed else ids
        return self._library([piece])[0] if piece else b""

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        if self.kind == "whole":
            for text in texts:
                yield from self._library([text])
            return
        ids_of = self.pieces.__getitem__
        gc.disable()  # nothing here makes cycles, and the collector would walk the cache again and again
        try:
            for text in texts:
                if self.kind == "dropped":
                    yield b"".join(map(ids_of, _lowered(text).replace("\n", " ").split(" ")))
                    continue
                first, *rest = [x.removeprefix(" ") if k else x for k, x in enumerate(_CUT.split(text))] if _odd(text) else text.split(" ")
                yield self._piece(first) + b"".join(map(ids_of, rest))
        finally:
            gc.enable()


def _lowered(text: str) -> str:
    """Lower-cased if all of it is Latin-1, where that is the same as the tokenizer's own; it spares pieces."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _byte_char(b: int) -> str:
    """The letter that byte-level vocabularies write for a byte: printable Latin-1 stands for itself, others follow from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return chr(b if b in own else 0x100 + sum(x not in own for x in range(b)))


_ODD = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def _odd(text: str) -> bool:
    """Whether a space follows white space; in printable text, of which line feeds are no part, a space is the only other white space."""
    if text.replace("\n", "").isprintable():
        return "  " in text or "\n " in text
    return _ODD.search(text) is not None


def _kind(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "leading"
    names = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    steps = pre.get("pretokenizers", [])
    drops = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    if names == ["NFC", "Replace", "Lowercase"] and drops and steps[1].get("type") == "ByteLevel":
        return "dropped"
    return "whole"


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
