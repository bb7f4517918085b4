"""Byte-level BPE ids, equal to those of the tokenizers library."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the pattern of byte-level pre-tokenizers with use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Character classes outside these ranges may differ between Unicode versions.
_RARE = re.compile("[^\x00-鿿가-힯＀-￯]")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """``encode(text)`` gives a text's ids as unsigned 32-bit integers.

    Where the file's ids are merge ranks, a rank encoder five times as fast as
    the tokenizers library does the work; the library itself encodes texts
    that hold special tokens (which become their ids, as by default) or rare
    characters, and everything under other files.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.by_rank = self._rank_encoder(spec, set(special))

    @staticmethod
    def _rank_encoder(spec: dict, special: set[str]) -> tiktoken.Encoding | None:
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        same = (
            spec["normalizer"] is None
            and pre.get("type") == "ByteLevel"
            and not pre["add_prefix_space"]
            and pre["use_regex"]
            and not model["ignore_merges"]
            and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
            and len(vocab) == 256 + len(pairs)
        )
        if not same:
            return None
        byte = byte_alphabet()
        ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.by_rank is None or (self.special and self.special.search(text)) or _RARE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.by_rank.encode_ordinary(text), np.uint32)


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each Python worker."""
    return ByteBpe(path)
