"""Token ids of whole texts by the tokenizers library, with a bounded cache of the pieces that the tokenizers never join."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa

#: Letters (Latin) end where white space or a stop follows, and so do stops before white space: both tokenizers split there.
#: U+0130 is not among them, since its lower case is two characters.
_LETTERS, _AFTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+", r"(?=[ \t-\r.,!?]|$)"
_STOPS = r"[.,!?]+(?=[ \t-\r]|$)"
#: Byte-level BPE splits at white space so that a single space joins the word after it.
_BYTE_PIECES = re.compile(f" ?{_LETTERS}{_AFTER}|{_STOPS}| ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]")
_WORD_PIECES = re.compile(f"{_LETTERS}{_AFTER}|{_STOPS}|[^ \t-\r]+")
#: White space beyond ASCII may join ASCII white space in one token, and special tokens may span spaces: such texts go whole to the library.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|")
#: How byte-level vocabularies write bytes: printable ones as themselves, the others as letters from 256 on, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Bytes of the pieces that a worker remembers (a piece counts its characters, its ids and what Python's objects take), and
#: texts taken from a batch together.
CACHE_BYTES, ENTRY_BYTES, TOGETHER = 112 << 20, 220, 256


class TokenIds(dict):
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes.

    ``path`` names a tokenizer file; ``byte_level`` tells which kind it is. The object is the cache of pieces: looking
    up a new one encodes it, and pieces are remembered until they take ``cache`` bytes.
    """

    def __init__(self, path: str, byte_level: bool, cache: int = CACHE_BYTES):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.byte_level, self.held, self.most = self.tokenizer.model, byte_level, 0, cache
        self.pieces = _BYTE_PIECES if byte_level else _WORD_PIECES
        self.letters = re.compile(f" ?{_LETTERS}" if byte_level else _LETTERS)

    def __missing__(self, piece: str) -> bytes:
        """A piece of letters is one word to both tokenizers: the library's model takes it without splitting it again."""
        if self.letters.fullmatch(piece):
            word = piece if self.byte_level else piece.lower()
            word = word.replace(" ", "\u0120") if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
            ids = [t.id for t in self.model.tokenize(word)]
        else:
            ids = self._whole(piece)
        out = pack(f"<{len(ids)}I", *ids)
        if self.held < self.most:
            self.held += ENTRY_BYTES + 2 * len(piece) + len(out)
            self[piece] = out
        return out

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self._whole(text), "<u4").tobytes()
        return b"".join(map(self.__getitem__, self.pieces.findall(text)))


@lru_cache(maxsize=4)
def token_ids(path: str, byte_level: bool, cache: int = CACHE_BYTES) -> TokenIds:
    """One encoder for each Python worker; its cache outlives the task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return TokenIds(path, byte_level, cache)


def encoded(batch: pa.RecordBatch, encoder: TokenIds) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of a batch's rows, some at a time; a null text is empty."""
    for at in range(0, batch.num_rows, TOGETHER):
        b = batch.slice(at, TOGETHER)
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield doc, encoder.encode(text or "")


def tokenizer_path(name: str) -> str:
    """The installed file's place; asked for where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)
