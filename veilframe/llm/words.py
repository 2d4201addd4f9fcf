"""Words of UTF-8 texts by byte translation, for operators that count or compare them.

A table of 256 bytes lower-cases A-Z and turns every byte that belongs to no word into a
blank; bytes from 0x80 on belong to words, so no character is ever decoded. Splitting at
blanks then gives the matches of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in order.
"""

from __future__ import annotations

import re

_SEPARATORS = (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))
TABLE = bytes(
    0x20 if b in _SEPARATORS else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)
)
_RUN = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    """Lower-case words in order; none in a null or empty text."""
    return text.translate(TABLE).split() if text else []


def places(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of each word in the text as given, end exclusive."""
    return [found.span() for found in _RUN.finditer(text.translate(TABLE))]
