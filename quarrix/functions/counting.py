"""The tokens of ``text.tokenize`` counted in Arrow batches, without a row or an object of the engine for each of them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CAMEL, CJK, FOLDED

# Bytes of UTF-8: capital letters become small ones, all but letters and digits blanks.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_HAS_CAMEL = re.compile(rb"[A-Z](?:(?<=[a-z0-9][A-Z])|[A-Z][a-z])")
_CAMEL = re.compile(CAMEL.encode())
_LEADS = re.compile(rb"[\xe3-\xed\xef]")  # the first bytes of all CJK letters, and of others
_HELD = 200_000  # terms a task holds before it hands on their counts


def tokens(ngram: int = 2) -> Callable[[bytes | None], list[bytes]]:
    """The cut of ``text.tokenize`` for one text in UTF-8."""
    n = max(1, int(ngram))
    letters, folded = (re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), c) for c in (CJK, FOLDED))
    letter, inner = re.compile(f"[{letters}]"), re.compile(f"(?<=[{letters}])[{folded}]+(?=[{letters}])")
    short = f"|(?<![{letters}])[{letters}]{{1,{n - 1}}}(?![{letters}])" if n > 1 else ""
    grams = re.compile(f"(?=([{letters}]{{{n}}}{short}|[a-z0-9]+))(?:[{letters}]|[a-z0-9]+)")

    def cut(text: bytes | None) -> list[bytes]:
        if not text:
            return []
        if _HAS_CAMEL.search(text):
            text = _CAMEL.sub(b" ", text)
        if not text.isascii() and _LEADS.search(text):
            decoded = text.lower().decode("utf-8", "replace")
            if letter.search(decoded):
                return [t.encode() for t in grams.findall(inner.sub("", decoded))]
        return text.translate(_WORDS).split()

    return cut


def lengths(text: Column, ngram: int = 2, distinct: bool = False) -> Column:
    """How many tokens a text has, or how many different ones."""
    cut = tokens(ngram)

    def sizes(texts: pa.Array) -> pa.Array:
        return pa.array([len(set(cut(t)) if distinct else cut(t)) for t in texts.to_pylist()], pa.int64())

    # Not deterministic for the optimizer alone: it must not be copied into each place that uses it.
    return F.arrow_udf(sizes, "long").asNondeterministic()(text.cast("binary"))


def counts(text: Column, ngram: int = 2, only: list[str] | None = None) -> Column:
    """``struct<dl, terms: array<struct<term, tf>>>``: the length of a text and its terms, or those of them in ``only``."""
    cut = tokens(ngram)
    wanted = None if only is None else [t.encode() for t in dict.fromkeys(only)]

    def counted(texts: pa.Array) -> pa.Array:
        terms: list[bytes] = []
        times: list[int] = []
        ends, dl = [0], []
        for text in texts.to_pylist():
            found = cut(text)
            dl.append(len(found))
            held = Counter(found) if wanted is None else {t: n for t in wanted if (n := found.count(t))}
            terms.extend(held)
            times.extend(held.values())
            ends.append(len(terms))
        pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["term", "tf"])
        return pa.StructArray.from_arrays([pa.array(dl, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["dl", "terms"])

    return F.arrow_udf(counted, "struct<dl: long, terms: array<struct<term: string, tf: long>>>").asNondeterministic()(text.cast("binary"))


def holders(ngram: int = 2) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of one column of texts to ``term, df``: how many of the task's texts hold a term, in parts to be summed."""
    cut = tokens(ngram)

    def parts(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "df"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(set(cut(text)))
                if len(held) >= _HELD:
                    yield parts(held)
                    held = Counter()
        yield parts(held)

    return counted
