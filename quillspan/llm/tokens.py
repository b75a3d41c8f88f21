"""Fast exact encoding with the ``tokenizers`` library inside tasks.

The vocabulary's normaliser and splitter cut a text into words that its merges never cross,
so each new word goes through the library's model once, and a repeated piece between white
space costs a lookup in a bounded dictionary. What does not fit this way is encoded by the
library as a whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

WORDS = 450_000  # entries kept per Python worker and kind by default, half of them in a dictionary that is dropped when the other is full
_encoders: dict[tuple[str, int], "Encoder"] = {}
#: Letters and numbers below U+0250; the splitter's classes for texts without higher characters.
_L, _N = r"a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9²³¹¼½¾"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_high = re.compile("[ɐ-\U0010ffff]").search
_control = re.compile("[\x1c-\x1f]").search  # white space for str.split(), not for the vocabulary


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)``. The word-wise way is taken for
    lower-casing vocabularies whose words end in ``</w>``; texts that hold a special token's
    string, and all texts of other vocabularies, take the library's own. Null counts as empty.
    """

    def __init__(self, path: str, keep: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        rules = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        pattern = _SHORT + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.fast = kinds == ["NFC", "Replace", "Lowercase"] and rules == [pattern, None] and spec["model"].get("end_of_word_suffix") == "</w>"
        self.split_any = regex.compile(pattern.replace(r"\s", r"\t-\r \x85\xa0\p{Z}")).findall
        self.split_low = re.compile(rf"{_SHORT}|[{_L}]+|[{_N}]|[^\t-\r \x85\xa0{_L}{_N}]+").findall
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_words, self.old_pieces = self.words, self.pieces

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, w: str) -> bytes:
        if out := self.old_words.get(w):
            self.words[w] = out
            return out
        ids = [t.id for t in self.tokenizer.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters))]
        self.words[w] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _piece(self, piece: str) -> bytes:
        if out := self.old_pieces.get(piece):
            self.pieces[piece] = out
            return out
        if piece.isascii() or not _high(piece):
            parts = self.split_low(piece.lower())
        else:
            parts = self.split_any(self.tokenizer.normalizer.normalize_str(piece))
        get = self.words.get
        self.pieces[piece] = out = b"".join([get(w) or self._word(w) for w in parts])
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.fast or _control(text) or any(s in text for s in self.special):
            return self.plain(text)
        if len(self.pieces) > self.keep // 2:  # what is still in use moves on from the old dictionary
            self.old_pieces, self.pieces = self.pieces, {}
        if len(self.words) > self.keep // 2:
            self.old_words, self.words = self.words, {}
        get, piece = self.pieces.get, self._piece
        return b"".join([get(p) or piece(p) for p in text.split()])


def encoder(path: str, keep: int = WORDS) -> Encoder:
    """One encoder per vocabulary, size of its dictionaries and Python worker."""
    if (path, keep) not in _encoders:
        _encoders[path, keep] = Encoder(path, keep)
    return _encoders[path, keep]
