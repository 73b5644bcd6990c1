"""Exact pre-token splitting for byte-level BPE vocabularies.

Every alternative of the public split pattern matches an optional space and then
non-space characters, or white space only.  A text may therefore be cut before a
single space that stands between two non-space characters: the pieces
(``" word"``) split on their own exactly as inside the text.  That allows a
bounded cache per piece instead of a pattern match over every character.
"""

from __future__ import annotations

import regex

# White_Space of the Unicode standard, as the tokenizer libraries read ``\s``
_SPACE = "\t-\r \x85\xa0  -     　"


def compile_pattern(pattern: str) -> regex.Pattern:
    """The split pattern with ``\\s`` and ``\\S`` spelled out.

    Python's own ``\\s`` also holds the control characters 1C-1F, which the
    tokenizer libraries do not count as white space.
    """
    spelled = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    return regex.compile(spelled)


def safe_piece(piece: str) -> bool:
    """True if a text may be cut at the single spaces around ``piece``."""
    return piece != "" and not piece[0].isspace() and not piece[-1].isspace()


def byte_letters() -> dict[int, str]:
    """Byte -> printable letter, as byte-level vocabularies write their tokens."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in keep}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


def byte_level_table() -> dict[int, str]:
    """For ``str.translate`` on a text's UTF-8 bytes read as Latin-1."""
    return dict(byte_letters())
