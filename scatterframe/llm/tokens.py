"""Token ids of whole texts, with the ids of repeated words kept."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
from tokenizers import Tokenizer

#: Ids fit two bytes up to this vocabulary size.
SHORT_IDS = 1 << 16
#: Separators that the vocabulary does not take for white space, or marks of special tokens.
_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Chunks that are cut into letter runs, digits and other runs; an apostrophe or a rarer character needs the tokenizer's own rules.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class Encoder(dict):
    """Packed ids by white-space-free chunk, for a vocabulary that drops white space and folds case.

    No token spans white space, so a text's ids are those of its chunks.  Chunks
    of plain Latin characters are cut into letter runs, digits and other runs,
    and only the vocabulary's merges run on them; all others go through the
    whole tokenizer.  Texts with special-token marks or odd separators go to the
    tokenizer in one piece.
    """

    LIMIT = 400_000

    def __init__(self, path: str):
        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._merge = self._tokenizer.model.tokenize
        wide = self._tokenizer.get_vocab_size() > SHORT_IDS
        self.dtype, self._code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        spell = self._tokenizer.pre_tokenizer.pre_tokenize_str
        self._spelt = {c: "".join(s for s, _ in spell(chr(c))) for c in range(0xC0, 0x100)}

    def _pack(self, text: str) -> bytes:
        return array(self._code, self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.translate(self._spelt)
        return array(self._code, [t.id for t in self._merge(piece)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.LIMIT:  # the older half goes
            for old in list(islice(self, self.LIMIT // 2)):
                del self[old]
        if chunk.isascii() and chunk.isalpha() or _LETTERS.fullmatch(chunk):
            low = chunk.lower()
            got = self._piece(chunk) if low == chunk else self[low]
        elif _PLAIN.fullmatch(chunk):
            pieces = _PIECE.findall(chunk)
            got = b"".join(map(self.__getitem__, pieces)) if len(pieces) > 1 else self._piece(chunk)
        else:
            got = self._pack(chunk)
        if len(chunk) <= 64:
            self[chunk] = got
        return got

    def packed(self, text: str | None) -> bytes:
        """The whole text's ids as little-endian bytes of ``dtype``."""
        if not text:
            return b""
        if any(map(text.__contains__, _WHOLE)):
            return self._pack(text)
        return b"".join(map(self.__getitem__, text.split()))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder of this process.  Spark reuses its Python workers, so what one task has looked up serves the next."""
    return Encoder(path)
