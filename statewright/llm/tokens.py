"""Token ids of whole texts, by the tokenizers library, a unit of text at a time.

A text is cut where both public vocabularies must start a new pre-token (before a space that a visible
character follows, around line feeds), the ids of each distinct unit are looked up, and only a unit
that was not seen lately is handed to the library. Texts with any other arrangement of white space go
to the library whole, in chunks that are cut at such places too. The caches have a fixed size.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import kept

#: Letters of Latin-1, for which the library's letter class and case folding need no second look.
LATIN = "À-ÖØ-öø-ÿ"
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Odd(Exception):
    """The text's white space is not single spaces and line feeds between words."""


class _Generations(dict):
    """A dictionary of bounded size: when it is full its entries become the older generation."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids as bytes of little-endian unsigned 32-bit integers; spaces: whether a pre-token may start with a space."""

    CHUNK = 200_000

    def __init__(self, path: str, *, spaces: bool, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A unit that holds one of the vocabulary's own markers gets the ids that the library gives it.
        marks = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marked = re.compile("|".join(marks) or "(?!)").search
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        lead = " ?" if spaces else ""
        case = "A-Za-z" if spaces else "a-z"
        self.spaces = spaces
        self.plain = re.compile(rf"{lead}[\x21-\x7e{LATIN}]+")
        digits = "[0-9]+" if spaces else "[0-9]"
        self.pieces = re.compile(rf"{SUFFIXES}|{lead}[{case}{LATIN}]+|{lead}{digits}|{lead}[^ {case}0-9{LATIN}]+")
        self.words = _Generations(self._word, limit)
        self.lettered = re.compile(rf"[A-Za-z{LATIN}]+").fullmatch
        # A single word after a space is kept here alone, so this cache may hold what two would. Without spaces it
        # also holds the pieces of its units, and `words` stays empty.
        self.after_space = _Generations(self._unit if spaces else self._bare, 2 * limit)
        self.at_start = _Generations(self._first, limit // 4)

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, piece: str) -> bytes:
        if piece.isascii():
            spelled = piece.replace(" ", "Ġ")
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def _whole(self, unit: str) -> bytes:
        if self.plain.fullmatch(unit) and not self.marked(unit):
            return b"".join(map(self.words.__getitem__, self.pieces.findall(unit)))
        return self._ids(unit)

    def _bare(self, unit: str) -> bytes:
        """Ids of what stands between two white spaces, where no pre-token begins with one."""
        if not unit:
            return b""
        if self.marked(unit):
            return self._ids(unit)
        if self.lettered(unit):
            word = unit.lower()
            return self._word(word) if word == unit else self.after_space[word]
        if not self.plain.fullmatch(unit):
            return self._ids(unit)
        pieces = self.pieces.findall(unit.lower())
        return self._word(pieces[0]) if len(pieces) == 1 else b"".join(map(self.after_space.__getitem__, pieces))

    def _unit(self, unit: str) -> bytes:
        spaced = " " + unit
        if not self.plain.fullmatch(spaced) or self.marked(unit):
            if not unit or unit[0].isspace():
                raise _Odd
            return self._ids(spaced)
        pieces = self.pieces.findall(spaced)
        if len(pieces) == 1:
            return self._word(spaced)
        return self.after_space[pieces[0][1:]] + b"".join(map(self.words.__getitem__, pieces[1:]))

    def _first(self, unit: str) -> bytes:
        if not unit or unit[0].isspace():
            raise _Odd
        return self._whole(unit)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.spaces:
            return b"".join(map(self.after_space.__getitem__, text.replace("\n", " ").split(" ")))
        try:
            feed = self.feed
        except AttributeError:
            feed = self.feed = self._ids("\n")
        try:
            parts = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                parts.append(self.at_start[first] + b"".join(map(self.after_space.__getitem__, rest)))
            return feed.join(parts)
        except _Odd:
            return b"".join(map(self._ids, self._chunks(text)))

    def _chunks(self, text: str):
        """Pieces of a long text, each but the first beginning with a space before a letter."""
        at = 0
        place = re.compile(r" (?=[A-Za-z])")
        while len(text) - at > self.CHUNK and (m := place.search(text, at + self.CHUNK)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]


def encoder(path: str, *, spaces: bool, limit: int = 250_000) -> Encoder:
    """One encoder for each Python worker, kept from task to task; limit is the entries of its caches."""
    return kept((path, spaces, limit), lambda: Encoder(path, spaces=spaces, limit=limit))
