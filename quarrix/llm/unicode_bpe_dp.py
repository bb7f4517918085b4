"""BPE with word ends by per-prefix dynamic programming.

For every prefix of a word exactly one vocabulary token can be the last one of
the prefix's encoding.  An automaton over all tokens gives the tokens that end
at each position; the one whose predecessor (the last token of the prefix
before it) is compatible with it is stored, and following the stored tokens
back from the word's end gives the ids that merging would give.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import Lowercase
from tokenizers.pre_tokenizers import Split

from .byte_bpe import byte_alphabet

# Unicode's White_Space; Python's str.split() takes \x1c-\x1f besides.
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


@lru_cache(1)
def _odd_letters() -> tuple[frozenset[str], dict[int, str], dict[int, str]]:
    """Code points that the tokenizers library treats otherwise than the modules used here, which know another Unicode.

    Those of another class (as a set, which a pattern would search member by
    member), for each of them a letter of the library's class (a letter, a
    digit or neither), and the lower case of those that the library alone has
    one for.
    """
    every = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    kinds = {}
    for kind, stand_in in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        split = Split(Regex(f"[^{kind}]"), "removed")
        for low in range(0, len(every), 1 << 16):
            for piece, _ in split.pre_tokenize_str("".join(every[low : low + (1 << 16)])):
                kinds.update(dict.fromkeys(piece, stand_in))
    letter, digit = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    stand_ins = {}
    for c in every:
        theirs = kinds.get(c, "%")
        ours = "a" if letter.match(c) else "1" if digit.match(c) else "%"
        if theirs != ours or (theirs == "a") != c.isalpha():
            stand_ins[ord(c)] = theirs
    lowered = Lowercase().normalize_str("\n".join(every)).split("\n")
    lowers = {ord(c): low for c, low in zip(every, lowered, strict=True) if c.lower() != low and c != "Σ"}
    return frozenset(map(chr, stand_ins)), stand_ins, lowers


class PrefixBpe:
    """Encoder and decoder for a tokenizers file: NFC, lower case, words by pattern, byte alphabet, BPE with a word-end suffix.

    ``cache_words`` bounds the remembered blank-separated words; beyond it the
    cache starts anew.
    """

    def __init__(self, path: str, cache_words: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or split["behavior"] != "Removed" or spec["decoder"]:
            raise ValueError(f"{path} is not a lower-case byte-level BPE with word ends")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.odd, self.stand_ins, self.lowers = _odd_letters()
        self.odd_case = re.compile(f"[{''.join(map(chr, self.lowers))}]" if self.lowers else r"(?!)")
        self.suffix = model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_ids = special
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.strings = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in special.items()}
        self.byte_char = {b: c for c, b in byte_alphabet().items()}
        self.byte_letters = {b: c for b, c in self.byte_char.items()}
        # A symbol that ends a word is another letter than the same symbol inside it.
        self.ending = {c: chr(0xF0000 + ord(c)) for c in self.byte_char.values()}
        self.cache_words, self.known = cache_words, {}
        self._build(model["vocab"], [p.split(" ") if isinstance(p, str) else p for p in model["merges"]])

    def _letters(self, token: str) -> str:
        if token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return body[:-1] + self.ending[body[-1]]
        return token

    def _build(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        for r, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), r)
            self.parts.setdefault(whole, (left, right, r))
        self.pairs: dict[int, bool] = {}  # previous << 32 | token -> whether they may stand side by side
        self.spines: tuple[dict, dict] = ({}, {})
        self.sizes = {i: len(self._letters(token)) for token, i in vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            letters = self._letters(token)
            if len(letters) == 1 or i in self.parts and self._stands(i):
                self.automaton.add_word(letters, (i, len(letters)))
        self.automaton.make_automaton()

    def _stands(self, token: int) -> bool:
        """Whether merging the token's own letters gives the token."""
        left, right, r = self.parts[token]
        return all(x not in self.parts or self._stands(x) for x in (left, right)) and self._compatible(left, right, r)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one border of ``token``, each with the rank of the merge that uses it up."""
        if found := self.spines[side].get(token):
            return found
        out, used = [(token, float("inf"))], float("inf")
        self.spines[side][token] = out
        while token in self.parts:
            used, token = self.parts[token][2], self.parts[token][side]
            out.append((token, used))
        return out

    def _compatible(self, a: int, b: int, below: float = float("inf")) -> bool:
        """Whether no merge of rank under ``below`` joins tokens across the border of ``a`` and ``b``.

        A merge across comes about if it ranks before the merges that use up
        its left and right token; of equal merges the leftmost goes first.
        """
        for x, x_used in self._spine(a, 1):
            for y, y_used in self._spine(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < below and r < x_used and r <= y_used:
                    return False
        return True

    def encode_word(self, word: str) -> bytes:
        """Ids of one word (after the pattern), by the stored last token of every prefix."""
        letters = word.encode().decode("latin-1").translate(self.byte_letters)
        letters = letters[:-1] + self.ending[letters[-1]]
        last, done, pairs = [-1] * len(letters), -1, self.pairs
        if len(pairs) > 1_000_000:
            pairs.clear()
        for end, (token, size) in self.automaton.iter(letters):
            if end == done:
                continue
            if size <= end:
                if (previous := last[end - size]) < 0:
                    continue
                pair = previous << 32 | token
                if (fits := pairs.get(pair)) is None:
                    fits = pairs[pair] = self._compatible(previous, token)
                if not fits:
                    continue
            last[end], done = token, end
        ids, at, sizes = [], len(letters) - 1, self.sizes
        while at >= 0:
            ids.append(last[at])
            at -= sizes[last[at]]
        ids.reverse()
        return pack(f"<{len(ids)}I", *ids)

    def _encode_block(self, block: str) -> bytes:
        """Ids of text without blanks; remembers them unless the text is long."""
        known = self.known
        if len(known) > self.cache_words:
            known.clear()
        if not block.isascii() and not self.odd.isdisjoint(block):
            # Cut by stand-ins of the class that the library sees; the words keep their own letters.
            cut = self.words.finditer(block.translate(self.stand_ins))
            found = b"".join([self.encode_word(block[m.start() : m.end()]) for m in cut])
        elif block.isalpha() or len(block) == 1:
            found = self.encode_word(block)
        else:
            found = b"".join([known.get(w) or self._encode_block(w) if w.isalpha() else self.encode_word(w) for w in self.words.findall(block)])
        if len(block) < 64:
            known[block] = found
        return found

    def _encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.odd_case.search(text):
                text = text.translate(self.lowers)
        if _SEPARATORS.search(text):
            blocks = _SPACE.sub(" ", text).lower().split(" ")
        else:
            blocks = text.lower().split()
        known, found = self.known, self._encode_block
        return b"".join([known.get(x) or found(x) for x in blocks])

    def encode(self, text: str) -> np.ndarray:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            raw = b"".join(np.array([self.special_ids[p]], "<u4").tobytes() if k % 2 else self._encode_plain(p) for k, p in enumerate(parts))
        else:
            raw = self._encode_plain(text)
        return np.frombuffer(raw, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode without a decoder: token strings joined by blanks; unknown ids are left out."""
        return " ".join([s for s in map(self.strings.get, ids.tolist()) if s is not None])


@lru_cache(2)
def prefix_bpe(path: str) -> PrefixBpe:
    """One encoder, with its caches, for each Python worker."""
    return PrefixBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row; a null or empty text has no ids; repeated rows stay."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_bpe(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows = batch.slice(low, 500)
                ids = [encoder.encode(t or "") for t in rows.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                values = np.concatenate([np.empty(0, "<u4"), *ids]).view(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(encode, "doc_id long, ids array<int>")


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes each text, then decodes those ids.

    A null text counts as empty: no ids, the empty string's digests.  The ids
    stay in the worker that made them.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = prefix_bpe(tokenizer)
        for batch in batches:
            sizes, by_ids, by_text = [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text or "")
                sizes.append(len(ids))
                by_ids.append(hashlib.sha256(ids).hexdigest())
                by_text.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
