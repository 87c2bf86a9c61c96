"""Byte-level tokenizing with one translate table; small helpers that run inside tasks.

A table maps every byte: letters A-Z to lower case, separators to a blank, all others to themselves. As the bytes of characters
beyond ASCII are no separators, cutting at blanks never cuts a character.
"""

from __future__ import annotations

from collections.abc import Iterator

_PIECE = 1 << 24  # bytes split at once


def table(letters: bytes) -> bytes:
    """Translate table whose words are made of ``letters``, A-Z and all characters beyond ASCII."""
    keep = set(letters) | set(range(65, 91)) | set(range(128, 256))
    return bytes((b + 32 if 65 <= b <= 90 else b) if b in keep else 32 for b in range(256))


def words(data: bytes, by: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, a list for each piece of a long one."""
    data = data.translate(by)
    at = 0
    while len(data) - at > _PIECE:
        gap = data.find(b" ", at + _PIECE)
        if gap < 0:
            break
        yield data[at:gap].split()
        at = gap
    yield (data[at:] if at else data).split()
