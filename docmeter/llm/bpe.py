"""Exact encoding of texts by parts, for the two kinds of BPE vocabularies, with caches in each Python worker.

Neither tokenizer merges across its pre-tokens, and a pre-token's ids don't depend on its neighbours. So a text is split
into units cheaply, a unit's ids are looked up, and only what is missing goes to the library. Characters for which the
split here might differ from the library's (outside ASCII and the Latin letters) are left to the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

S = r" \t\n\r\x0b\x0c"
L = "A-Za-zÀ-ÖØ-öø-ɏ"
SAFE = re.compile(rf"[\x00-\x1b\x20-\x7e{L}]*")
LATIN = re.compile(f"[{L}]+")
#: A run of white space but its last character, or a white-space character (if any) and the non-space ones after it.
UNITS = re.compile(rf"[{S}]+(?![^{S}])|[{S}]?[^{S}]+")
#: White space to the tokenizers' patterns, but not to UNITS.
ODD_SPACE = re.compile("[\x85\xa0  -     　]")
# The two vocabularies' pre-token patterns, for texts of SAFE characters.
BYTE_PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{L}]+| ?[0-9]+| ?[^\s{L}0-9]+|\s+(?!\S)|\s+")
WORD_PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{L}]+|[0-9]|[^\s{L}0-9]+")
#: As split() has them where no other white space occurs.
ASCII_WORDS = re.compile(rf"[^{S}]+")
UNIT_CHARS = 64


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257 and so on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


def byte_level(part: str) -> str:
    return part.encode("utf-8", "surrogatepass").decode("latin-1").translate(LETTERS)


def load(vocabulary: str):
    """The tokenizer of a file of public_tokenizers, or of a path."""
    from tokenizers import Tokenizer

    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(str(vocabulary))


class Units(dict):
    """Unit -> value, for values that add up (numbers of tokens, or ids as bytes). At most `most` entries besides `frequent`."""

    def __init__(self, tokenizer, parts: re.Pattern, value: Callable[[list[int]], object], zero, frequent: dict, most: int):
        super().__init__(frequent)
        self.tokenizer, self.parts, self.value, self.zero, self.frequent = tokenizer, parts, value, zero, frequent
        self.most = most + len(frequent)
        self.tokens = tokenizer.model.tokenize

    def whole(self, text: str):
        return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def put(self, unit: str, value):
        if len(unit) <= UNIT_CHARS:
            if len(self) >= self.most:  # start anew
                self.clear()
                self.update(self.frequent)
            self[unit] = value
        return value

    def __missing__(self, unit: str):
        """A unit of one pre-token is encoded and kept; a longer one is put together from parts, and kept while there is much room."""
        body = unit[1:] if unit[0] == " " else unit
        if body.isalpha() and (ascii := body.isascii() or LATIN.fullmatch(body)):
            text = (unit if body is unit else f"{LETTERS[32]}{body}") if ascii is True else byte_level(unit)
            return self.put(unit, self.value([t.id for t in self.tokens(text)]))
        core = unit.rstrip(".,;:!?")
        if core and len(core) < len(unit) and core[-1].isalnum() and core[-1] != "İ":  # a pre-token ends there in either pattern
            total = self[core] + self[unit[len(core) :]]
        elif unit[0] in "\n\r\t" and len(unit) > 1 and unit[1].isalnum():
            total = self[unit[0]] + self[unit[1:]]
        elif "<|" in unit or not SAFE.fullmatch(unit):
            return self.put(unit, self.whole(unit))
        else:
            parts = self.parts.findall(unit)
            if len(parts) == 1 and parts[0] == unit:
                return self.put(unit, self.value([t.id for t in self.tokens(byte_level(unit))]))
            total = self.zero
            for p in parts:
                total += self[p] if p != unit else self.value([t.id for t in self.tokens(byte_level(p))])
        if 2 * len(self) < self.most and len(unit) <= UNIT_CHARS:
            self[unit] = total
        return total


def word_ids(text: str, units: Units) -> bytes:
    """Ids of a text by the vocabulary that drops white space and case, as little-endian unsigned 32-bit numbers."""
    if "<|" in text:
        return units.whole(text)
    if SAFE.fullmatch(text):
        return b"".join(map(units.__getitem__, text.lower().split()))
    return b"".join(units[u.lower() if SAFE.fullmatch(u) else u] for u in ASCII_WORDS.findall(text))


def word_units(tokenizer, most: int) -> Units:
    import numpy as np

    return Units(tokenizer, WORD_PARTS, lambda ids: np.array(ids, "<u4").tobytes(), b"", {}, most)
