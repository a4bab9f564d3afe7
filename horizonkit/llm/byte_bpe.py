"""Exact ids of a byte-level BPE file, at native speed for whole texts."""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Longest unbroken run for the rank encoder, whose merge loop is quadratic in it.
LONG_RUN = 4096
_SPACES = (" " * 512, "\n" * 512)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """``ids(text)`` equals the tokenizers library's without special tokens added.

    Special-token strings inside a text are that token, as in the library.
    Texts with very long unbroken runs go to the library itself.
    """

    _made: dict[str, ByteBpe] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.plain_library = Tokenizer.from_file(path)
        self.plain_library.no_truncation()
        self.plain_library.no_padding()
        self.plain_library.encode_special_tokens = True
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        symbol = byte_symbols()
        ranks = {bytes(symbol[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        #: per id: does the token begin with a space
        self.after_space = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        self.after_space[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.ranked = tiktoken.Encoding(
            "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    @classmethod
    def shared(cls, path: str) -> ByteBpe:
        """One encoder per Python worker and vocabulary file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def ids(self, text: str) -> list[int]:
        if max(map(len, text.split(" "))) > LONG_RUN or any(s in text for s in _SPACES):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranked.encode(text, allowed_special="all")

    def plain_ids(self, text: str) -> list[int]:
        """As ``ids``, but special-token strings are ordinary text."""
        if max(map(len, text.split(" "))) > LONG_RUN or any(s in text for s in _SPACES):
            return self.plain_library.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        packed = array("I", self.ids(text))
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()
