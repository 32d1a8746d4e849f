"""Token ids of a word-final BPE vocabulary (lower-cased words, end-of-word suffix), fast and exact.

The vocabulary file is the one the ``tokenizers`` library reads. Texts of common Latin characters take a
fast path: words are separated by one space, the space plays the end-of-word suffix, and a byte-level BPE
with the same ranks does the merging. Merging by concatenated bytes equals merging by pairs because every
vocabulary entry is what the merges make of its own bytes (``tests/llm/test_packing.py`` checks this for the
whole vocabulary). Any other text is encoded by the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

END_OF_WORD = "</w>"
#: Characters for which lower-casing, composition and classes agree in all libraries involved.
UNCOMMON = re.compile("[^\n\t\r -~¡-¬®-įı-ňŊ-ž‐-‧‰-›€]")
SEPARATE = regex.compile(r"('s|'t|'re|'ve|'m|'ll|'d|[^\s\p{L}\p{N}]+|\p{N})")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: symbol to byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    """``ids(text)``: what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_symbols()
        self.ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            last = token.endswith(END_OF_WORD)
            body = token.removesuffix(END_OF_WORD) if last else token
            self.ranks[bytes(byte_of[c] for c in body) + b" " * last] = rank
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.size = max(*self.ranks.values(), *(x["id"] for x in spec["added_tokens"])) + 1
        self.merger = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=self.ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if UNCOMMON.search(text) or ("<|" in text and any(x in text for x in self.special)):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        words = SEPARATE.sub(r" \1 ", unicodedata.normalize("NFC", text).lower()).split()
        if not words:
            return np.empty(0, np.uint32)
        return self.merger.encode_to_numpy(" ".join(words) + " ")


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)
