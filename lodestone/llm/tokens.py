"""Byte-level BPE over whole texts."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import public_tokenizers

BYTE_BPE = "byte_bpe_50k"


#: The token that byte_bpe_50k.json adds to its vocabulary.
ADDED, ADDED_ID = "<|endoftext|>", 50256


class Encoder:
    """Ids of whole texts. The vocabulary is byte_bpe_50k, read as ranks; ids equal those of byte_bpe_50k.json with
    add_special_tokens=False, which has one id for its added token wherever it stands in a text."""

    def __init__(self, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={ADDED: ADDED_ID})

    def packed(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit numbers in the machine's order (little-endian where this runs)."""
        return array("I", self.ids(text)).tobytes()

    def ids(self, text: str) -> list[int]:
        return self.bpe.encode(text, allowed_special="all") if ADDED in text else self.bpe.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self.ids(text))


@lru_cache(maxsize=2)
def encoder(ranks_path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(ranks_path)


def default_path() -> str:
    return public_tokenizers.path(f"{BYTE_BPE}.tiktoken")
