"""Quality rules of single documents and of lines that many documents of a host share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .scratch import drop, staged

WINDOW = 8
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text; null has no words.

    Words are runs without ``[\\x20\\x09-\\x0D]``.  A line counts as repeated if
    it has a word and equals an earlier one.  ``n_repeat_words`` counts words
    inside a window of 8 words that stands twice or more in the text.
    """
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[bytes] = set()
    repeated = 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip():
            seen.add(line)
    return len(words), chars, len(_SYMBOLS.findall(text)), repeated, _repeated_words(words)


def _repeated_words(words: list[bytes]) -> int:
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    windows = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        windows ^= hashes[k : k + n]
        windows *= _MIX
        windows ^= windows >> np.uint64(29)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def _line_hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key) - (1 << 63)


def without_lines(text: str | None, hashes: set[int]) -> tuple[str | None, int]:
    """The text without the lines whose hashes are given, and the number of lines left out."""
    if not text or not hashes:
        return text, 0
    lines = text.split("\n")
    kept = [x for x in lines if not (key := x.encode("utf-8", "surrogatepass").lower().strip()) or _line_hash(key) not in hashes]
    return "\n".join(kept), len(lines) - len(kept)


def quality(docs: DataFrame, host_col: str | None = "source", min_docs: int = 20, min_words: int = 20, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed, cleaned`` and the columns ``carry`` for every row.

    Base rules: ``n_words < 20`` or ``100 * n_repeat_words > 30 * n_words`` fails.
    Cross-document rule: a line (blanks at both ends gone, A-Z in lower case)
    is over the limit where it stands in at least ``min_docs`` documents of its
    host, however many the host has; equal texts count as one document.
    ``cleaned`` is the text without the ``n_removed`` lines over the limit.  A
    document that passed the base rules is rejected if it lost words and under
    ``min_words`` are left.  A null text has no words; a null host is a host of
    its own; rows of one id are judged each for itself.  ``host_col=None`` takes
    all documents as of one host; a column that is missing raises.
    """
    if host_col is not None and host_col not in docs.columns:
        raise ValueError(f"no column {host_col} that names a document's host")
    host = F.lit("") if host_col is None else F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    text = F.col("text").cast("string")
    key = ["host", "h1", "h2"]
    # 128 bits of hash name a text: all but the text itself depends on it and the host alone.
    hashes = [F.xxhash64(F.coalesce(text, F.lit(""))).alias("h1"), F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("h2")]
    carried = [F.struct(*carry).alias("carried")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), host.alias("host"), *hashes, *carried)
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    made = pa.schema([("host", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), *[(k, pa.int64()) for k in counted], ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                out: list[list] = [[] for _ in range(7)]
                for text in part.column(3).to_pylist():
                    found: dict[int, int] = {}
                    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
                        if key := line.strip():
                            h = _line_hash(key)
                            found[h] = found.get(h, 0) + len(key.split())
                    for column, value in zip(out, (*base_counts(text), list(found), list(found.values())), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *(pa.array(c, t) for c, t in zip(out, made.types[3:], strict=True))], schema=made)

    schema = "host string, h1 long, h2 long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"
    texts = staged(rows.select(*key, "text").mapInArrow(measure, schema).dropDuplicates(key), "quality")
    # Read from a table, both sides of a join come straight from an exchange, so adaptive skew handling can split a frequent line or text.
    over = staged(texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("host", "line"), "over")
    places = texts.select(*key, F.explode(F.arrays_zip("lines", "line_words")).alias("z")).select(*key, F.col("z.lines").alias("line"), F.col("z.line_words").alias("words"))
    lost = places.join(over.hint("merge"), ["host", "line"]).groupBy(*key).agg(F.sum("words").alias("lost"), F.collect_list("line").alias("drop"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = F.coalesce(F.col("n_words") - F.col("lost") < min_words, F.lit(False))
    judged = texts.select(*key, *counted, failed.alias("base_failed")).join(lost.hint("merge"), key, "left")
    verdicts = staged(judged.select(*key, *counted, "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), "drop"), "verdicts")
    drop(texts, over)
    joined = rows.join(verdicts.hint("merge"), key).select("doc_id", *counted, "base_failed", "kept", "drop", "text", *(["carried"] if carry else []))
    fields = {f.name: f for f in joined.schema.fields}
    made_clean = StructType([*[f for name, f in fields.items() if name not in ("drop", "text", "carried")], StructField("n_removed", LongType()), StructField("cleaned", StringType()), *([fields["carried"]] if carry else [])])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops, texts = (batch.column(batch.schema.get_field_index(name)) for name in ("drop", "text"))
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                done = [without_lines(t, set(d or ())) for t, d in zip(texts.slice(low, 500).to_pylist(), drops.slice(low, 500).to_pylist(), strict=True)]
                new = {"n_removed": pa.array([n for _, n in done], pa.int64()), "cleaned": pa.array([t for t, _ in done], pa.string())}
                yield pa.RecordBatch.from_arrays([new[name] if name in new else part.column(part.schema.get_field_index(name)) for name in names], names=names)

    names = made_clean.names
    cleaned = joined.mapInArrow(clean, made_clean)
    return cleaned.select(*(name for name in names if name != "carried"), *(F.col("carried").getField(name).alias(name) for name in carry or []))
