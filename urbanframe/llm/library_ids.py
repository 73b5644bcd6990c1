"""Ids of whole texts by the ``tokenizers`` library, with a bounded cache of pieces.

A text is cut at single spaces where the library would part it too, and the
library's model encodes each piece once per worker.  Anything unusual -- other
white space at a cut, other scripts, an unknown configuration -- goes through the
library whole.  Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import regex
from tokenizers import Tokenizer

from urbanframe.llm.batches import BoundedCache
from urbanframe.llm.pretokens import byte_letters, compile_pattern, safe_piece

# fixed value: the split pattern of byte-level vocabularies (ByteLevel, use_regex)
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# printable characters whose lower case, class and composition are plain in every Unicode version
_PLAIN = re.compile("[!-~\xa1-į]+")


# fixed value: the split pattern of the lower-case vocabulary
LOWER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _plain_pattern() -> re.Pattern:
    """``LOWER_PATTERN`` over plain characters, its classes spelt out: ``re`` matches twice as fast as ``regex``."""
    plain = [c for c in map(chr, range(0x130)) if _PLAIN.fullmatch(c)]
    spelt = {k: "".join(re.escape(c) for c in plain if regex.fullmatch(rf"\p{{{k}}}", c)) for k in "LN"}
    return re.compile(LOWER_PATTERN.replace(r"\p{L}", spelt["L"]).replace(r"\p{N}", spelt["N"]))


# of as many ids as nearly every word has
_SHORT = [struct.Struct(f"<{n}I") for n in range(16)]


def _pack(ids: list[int]) -> bytes:
    n = len(ids)
    return _SHORT[n].pack(*ids) if n < len(_SHORT) else struct.pack(f"<{n}I", *ids)


REMEMBERED = 1_000_000  # pieces a worker remembers, of about 200 bytes each


class LibraryEncoder:
    """``encode(text)`` -> packed little-endian 32-bit ids, equal to the library's.

    The ids of up to ``remembered`` pieces are kept; fewer take less memory and more time.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.model_tokenize = self.model.tokenize
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.encode: Callable[[str], bytes] = self._style(config)

    def _style(self, config: dict) -> Callable[[str], bytes]:
        normalizer, pre = config.get("normalizer"), config.get("pre_tokenizer") or {}
        if normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.pattern = compile_pattern(BYTE_LEVEL_PATTERN)
            self.cache = BoundedCache(self._spaced_piece, self.remembered)
            return self._encode_spaced
        steps = [s.get("type") for s in (normalizer or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in parts] == ["Split", "ByteLevel"]:
            split = parts[0]
            if split["invert"] and split["behavior"] == "Removed" and not parts[1]["use_regex"]:
                known = split["pattern"]["Regex"] == LOWER_PATTERN
                self.pattern = _plain_pattern() if known else regex.compile(split["pattern"]["Regex"])
                self.letters_whole = known
                self.cache = BoundedCache(self._lower_piece, self.remembered)
                return self._encode_lower
        return self._whole

    def _whole(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _tokens(self, pretokens: list[str]) -> bytes:
        """The model's ids of pre-tokens, each written in byte letters first."""
        ids: list[int] = []
        tokenize = self.model.tokenize
        for token in pretokens:
            # printable ASCII but the space is its own byte letters
            if token.isascii() and token.isprintable() and " " not in token:
                shown = token
            else:
                shown = token.encode().decode("latin-1").translate(self._table)
            ids += [t.id for t in tokenize(shown)]
        return _pack(ids)

    @property
    def _table(self) -> dict[int, str]:
        return byte_table()

    # byte-level vocabulary that keeps spaces
    def _spaced_piece(self, piece: str) -> bytes | None:
        return self._tokens(self.pattern.findall(" " + piece)) if safe_piece(piece) else None

    def _encode_spaced(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        if rest and not safe_piece(head):
            return self._whole(text)
        try:
            return self._tokens(self.pattern.findall(head)) + b"".join(map(self.cache.__getitem__, rest))
        except TypeError:  # a piece that must not be cut off
            return self._whole(text)

    # lower-case vocabulary that drops white space
    def _lower_piece(self, piece: str) -> bytes:
        if not _PLAIN.fullmatch(piece):
            return self._whole(piece)
        lower = piece.lower()
        tokens = [lower] if self.letters_whole and lower.isalpha() else self.pattern.findall(lower)
        if tokens == [piece]:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._table)
            return _pack([t.id for t in self.model_tokenize(shown)])
        # a plain pre-token is a piece of its own: "Word," shares the entries of "word" and ","
        return b"".join(map(self.cache.__getitem__, tokens))

    def _encode_lower(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=1)
def byte_table() -> dict[int, str]:
    return dict(byte_letters())


@lru_cache(maxsize=4)
def encoder(path: str, remembered: int = REMEMBERED) -> LibraryEncoder:
    """One encoder and cache per worker process."""
    return LibraryEncoder(path, remembered)
