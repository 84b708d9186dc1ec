"""Token ids of whole texts by a public tokenizer, with a bounded store of known words.

The tokenizer drops white space and never joins characters across it, so a text
is encoded word by word and each different word once.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

from forecourt.llm.common import words

#: Words, and as many word pieces, of which a Python worker keeps the ids; twice as many at most, some 150 bytes each.
KEPT = 125_000

# For these characters normal form is the identity and the classes of the splitting pattern are plain.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

_loaded: dict[tuple[str, int], Encoder] = {}


class _Known(dict):
    """Ids as little-endian 32-bit bytes by word; ``learn`` makes those that are missing.

    A full store becomes the old one, from which words still in use come back.
    """

    def __init__(self, learn: Callable[[str], bytes], most: int) -> None:
        self.learn, self.most, self.old = learn, most, {}

    def found(self, word: str) -> bytes | None:
        """The ids of ``word`` if they are here; nothing is learnt."""
        ids = self.get(word)
        return self.old.get(word) if ids is None else ids

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.learn(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Encodes words with the tokenizer of a file.

    Words of plain letters, digits and signs are split here and their pieces
    given to the tokenizer's model; all other words go through the whole
    tokenizer. Both ways give the tokenizer's ids. Most words are one piece:
    such a word isn't learnt again as a piece, nor a known piece as a word.
    """

    def __init__(self, path: str, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {
            c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7
        }
        self.words = _Known(self._word, kept)
        self.pieces = _Known(self._piece, kept)

    def _ids(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(spelled)])

    def _piece(self, piece: str) -> bytes:
        ids = self.words.found(piece)
        return self._ids(piece) if ids is None else ids

    def _word(self, word: str) -> bytes:
        # The alphabet's own methods are cheaper than patterns.
        if word.isascii():
            if word.isalpha():
                lower = word.lower()
                if lower != word:
                    return self.words[lower]
                ids = self.pieces.found(word)
                return self._ids(word) if ids is None else ids
            plain = word.isprintable()
        else:
            plain = _PLAIN.fullmatch(word)
        if plain and "<|" not in word:
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(word.lower())))
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, words(text)))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encode(path: str, text: str, kept: int = KEPT) -> bytes:
    """Little-endian 32-bit ids of ``text``; the encoder is kept in the worker."""
    if (path, kept) not in _loaded:
        _loaded[path, kept] = Encoder(path, kept)
    return _loaded[path, kept].encode(text)
