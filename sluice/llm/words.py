"""Words of letters, digits and everything beyond ASCII, as UTF-8 bytes: the
rule ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Every byte
of a character beyond ASCII is at least 0x80, so bytes can be mapped singly."""

from __future__ import annotations

_LETTERS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: Maps a byte of UTF-8 to itself where it belongs to a word (A-Z in lower case), else to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _LETTERS else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    """The text as UTF-8 in which only blanks part the words; null is empty."""
    return (text or "").encode().translate(FOLD)
