"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's distinct words and the beginnings of its words.  The model adds
a weight for each term and the product of two factor vectors for each pair of
terms, so that a pair such as an insult and the group it is aimed at can count
for more than its parts.
"""

from __future__ import annotations

import ctypes
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import drop, staged

_WORD = re.compile(r"[^\W\d_]+|[!?*@#$%&]+")
PREFIXES = (4, 5, 6)  # lengths of the beginnings that are terms besides the word
NEAR = 16  # words within which two words are looked at as a pair
_PAIR_BITS = 20


class _TermIds(dict):
    """Word -> buckets of its terms; starts anew when it has grown too large."""

    def __init__(self, bits: int):
        self.shift = 64 - bits

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 150_000:
            self.clear()
        terms = [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]
        found = self[word] = tuple(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> self.shift for t in terms)
        return found


def terms(text: str | None, ids: _TermIds) -> np.ndarray:
    """Sorted distinct buckets of a whole text's terms."""
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.fromiter((i for w in words for i in ids[w]), np.int64))


@dataclass
class FactorizationMachine:
    """Logistic factorization machine; ``weight`` has ``2 ** bits`` entries, ``factors`` as many rows."""

    bias: float
    weight: np.ndarray
    factors: np.ndarray
    scale: np.ndarray  # what a term counts for: 0 if the sample shows no association with the label

    @property
    def bits(self) -> int:
        return len(self.weight).bit_length() - 1

    def margins(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log odds of texts whose terms stand one after the other in ``rows``."""
        if not len(sizes):
            return np.empty(0)
        x = self._values(rows, sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        def summed(v):  # by text
            total = np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v, axis=0, dtype=np.float64)])
            return total[starts[1:]] - total[starts[:-1]]
        v = self.factors[rows] * x[:, None]
        pairs = 0.5 * ((summed(v) ** 2).sum(1) - summed((v * v).sum(1)))
        return self.bias + summed(self.weight[rows] * x) + pairs

    def _values(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.scale[rows]


def association(df: np.ndarray, df_positive: np.ndarray, n: int, positive: int) -> np.ndarray:
    """Log-likelihood ratio of each term's two-by-two table with the label."""
    a, b = df_positive, df - df_positive
    c, d = positive - a, (n - positive) - b

    def part(observed, row, column):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(observed > 0, observed * np.log(observed * n / np.maximum(row * column, 1e-9)), 0.0)

    return 2 * (part(a, df, positive) + part(b, df, n - positive) + part(c, n - df, positive) + part(d, n - df, n - positive))


def near_pairs(words: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of different words at most ``NEAR`` apart, of those marked in ``open_``: hash bucket and both words."""
    at = np.flatnonzero(open_[words])
    own, found = words[at], []
    for d in range(1, min(NEAR, len(own) - 1) + 1):
        # Open words only move closer to each other, so this misses none within the distance.
        near = at[d:] - at[:-d] <= NEAR
        found.append(np.stack([own[:-d][near], own[d:][near]], 1))
    if not found:
        return (np.empty(0, np.int64),) * 3
    both = np.sort(np.concatenate(found).astype(np.int64), 1)
    codes = np.unique((both[:, 0] << 32 | both[:, 1])[both[:, 0] != both[:, 1]])
    bucket = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PAIR_BITS)
    return bucket.astype(np.int64), codes >> 32, codes & 0xFFFFFFFF


def _association(df, df_positive, n: int, positive: int):
    """``association`` as a column."""

    def part(observed, row, column):
        return F.when(observed > 0, observed * F.log(observed * F.lit(float(n)) / (row * column))).otherwise(0.0)

    a, b = df_positive, df - df_positive
    c, d = F.lit(positive) - a, F.lit(n - positive) - b
    return 2 * (part(a, df, F.lit(float(positive))) + part(b, df, F.lit(float(n - positive))) + part(c, F.lit(float(n)) - df, F.lit(float(positive))) + part(d, F.lit(float(n)) - df, F.lit(float(n - positive))))


def _counts(rows: np.ndarray, width: int, share: int = 1 << 20) -> np.ndarray:
    """``bincount`` by shares: it widens what it counts to 64 bits."""
    total = np.zeros(width, np.int64)
    for low in range(0, len(rows), share):
        total += np.bincount(rows[low : low + share], minlength=width)
    return total


def fit(rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, bits: int = 18, rank: int = 8, epochs: int = 8, rate: float = 0.1, penalty: float = 2e-5, batch: int = 128, seed: int = 7, min_association: float = 12.0) -> FactorizationMachine:
    """Adaptive-gradient descent on the logistic loss, both labels weighing alike up to a factor of 5.

    Without rows of both labels, the model is a constant: the smoothed share of
    label 1, or a score under 0.5 without any row.
    """
    width = 1 << bits
    rng = np.random.default_rng(seed)
    n, positive = len(labels), int(labels.sum())
    df = _counts(rows, width)
    # Terms that tell nothing about the label would only let the model learn its rows by heart.
    text_of = np.repeat(np.arange(n, dtype=np.int32), sizes)
    told = (df > 0) & (association(df, _counts(rows[labels.astype(bool)[text_of]], width), n, positive) >= min_association)
    scale, kept = told.astype(np.float64), told[rows]
    rows, sizes = rows[kept], np.bincount(text_of[kept], minlength=n)
    del text_of, kept
    model = FactorizationMachine(float(np.log((positive + 0.5) / (n - positive + 1.5))), np.zeros(width), rng.normal(0, 0.01, (width, rank)), scale)
    if not 0 < positive < n:
        model.factors[:] = 0
        return model
    weigh = np.where(labels == 1, min(5.0, (n - positive) / positive), 1.0)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    seen_w, seen_v, seen_b = np.full(width, 1e-6), np.full((width, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for low in range(0, n, batch):
            chosen = order[low : low + batch]
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in chosen]) if len(chosen) else np.empty(0, np.int64)
            own_sizes = sizes[chosen]
            own = rows[at]
            text = np.repeat(np.arange(len(chosen)), own_sizes)
            x = scale[own]
            v = model.factors[own] * x[:, None]
            sums = np.zeros((len(chosen), rank))
            np.add.at(sums, text, v)
            linear = np.bincount(text, model.weight[own] * x, len(chosen))
            pairs = 0.5 * ((sums**2).sum(1) - np.bincount(text, (v * v).sum(1), len(chosen)))
            error = (1 / (1 + np.exp(-np.clip(model.bias + linear + pairs, -30, 30))) - labels[chosen]) * weigh[chosen] / len(chosen)
            used, where = np.unique(own, return_inverse=True)
            step_w = np.bincount(where, error[text] * x, len(used)) + penalty * model.weight[used]
            each = (error[text] * x)[:, None] * (sums[text] - v)
            step_v = np.zeros((len(used), rank))
            np.add.at(step_v, where, each)
            step_v += penalty * model.factors[used]
            seen_w[used] += step_w**2
            seen_v[used] += step_v**2
            seen_b += error.sum() ** 2
            model.weight[used] -= rate * step_w / np.sqrt(seen_w[used])
            model.factors[used] -= 0.2 * rate * step_v / np.sqrt(seen_v[used])
            model.bias -= rate * error.sum() / np.sqrt(seen_b)
    return model


def held_out(doc_id: int | None, folds: int = 5) -> bool:
    """Rows of this fold are never learned from: crc32 of the id as text, modulo ``folds``, is 0."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == 0


def labelled_terms(docs: DataFrame, labels: DataFrame, max_rows: int, bits: int, min_association: float = 12.0, min_pair_association: float = 40.0) -> pa.Table:
    """``label_id, toxic, terms`` of the documents to learn from, each id once, with the terms that tell something about the label.

    Those are the terms that are associated with it themselves, and words that
    are not, but form a pair within a few words of each other that is; pairs
    are hashed and counted on executors, and many are tested, so they must be
    the more plainly associated.

    Of labelled documents that are not held out, the ``max_rows // 2`` of the
    least hash of each label are taken: this bounds what the driver receives.
    A document whose label is null or neither 0 nor 1, or that has several
    labels that differ, is left out; of several rows of an id, one of the least
    text hash counts.
    """
    spark = docs.sparkSession
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    kept = marked.where("toxic IN (0, 1)").where(F.crc32(F.col("label_id").cast("string").cast("binary")) % 5 != 0)
    known = docs.select(F.col("doc_id").cast("long").alias("label_id")).where("label_id IS NOT NULL").distinct()
    kept = kept.join(known, "label_id", "left_semi")
    halves = [kept.where(F.col("toxic") == y).orderBy(F.xxhash64("label_id")).limit(max_rows // 2).select("label_id", "toxic") for y in (0, 1)]
    sample = halves[0].unionAll(halves[1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _TermIds(bits)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [terms(t, ids).astype(np.int32) for t in texts]
            words = [np.fromiter((ids[w][0] for w in _WORD.findall((t or "").lower())), np.int32) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))], names=["label_id", "toxic", "terms", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text"))
    # At most max_rows ids of 12 bytes go to every task.
    picked = texts.join(F.broadcast(sample), "label_id").groupBy("label_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"))
    made = "label_id long, toxic int, terms array<int>"
    rows = staged(picked.select("label_id", "toxic", "one.text").mapInArrow(encode, f"{made}, words array<int>"), "labelled")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    # At most 2 ** bits rows of counts, and then only the terms that the fit would use, reach the driver.
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("df_positive")).toArrow()
    term, df, df_positive = (counts.column(name).to_numpy() for name in ("term", "df", "df_positive"))
    told = np.zeros(1 << bits, bool)
    told[term] = association(df, df_positive, n, positive) >= min_association
    neutral = spark.sparkContext.broadcast(~told)  # 2 ** bits bytes, whatever the input

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << _PAIR_BITS), np.int64)
        for batch in batches:
            for toxic, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[toxic, near_pairs(words.values.to_numpy(), neutral.value)[0]] += 1
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[:, at].sum(0)), pa.array(total[1, at])], names=["pair", "df", "df_positive"])

    pairs = rows.select("toxic", "words").mapInArrow(count_pairs, "pair long, df long, df_positive long").groupBy("pair").agg(F.sum("df").alias("df"), F.sum("df_positive").alias("df_positive"))
    linked = pairs.where(_association(F.col("df"), F.col("df_positive"), n, positive) >= min_pair_association) if 0 < positive < n else pairs.where("false")
    hit = np.zeros(1 << _PAIR_BITS, bool)
    hit[linked.select("pair").toArrow().column("pair").to_numpy()] = True
    if hit.any():
        linked_pairs = spark.sparkContext.broadcast(hit)  # 2 ** 20 bytes, whatever the input

        def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: set[int] = set()
                for words in batch.column(0):
                    bucket, a, b = near_pairs(words.values.to_numpy(), neutral.value)
                    at = linked_pairs.value[bucket]
                    found.update(a[at].tolist(), b[at].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["term"])

        # At most 2 ** bits rows.
        told[rows.select("words").mapInArrow(words_of, "term int").distinct().toArrow().column("term").to_numpy()] = True
        linked_pairs.unpersist()
    neutral.unpersist()
    sent = spark.sparkContext.broadcast(told)  # 2 ** bits bytes, whatever the input

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            kept = sent.value[flat := lists.flatten().to_numpy()]
            ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[kept], pa.int32()))], names=["label_id", "toxic", "terms"])

    found = rows.select("label_id", "toxic", "terms").mapInArrow(keep, made).toArrow()
    sent.unpersist()
    drop(rows)
    return found


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, bits: int = 18, min_association: float = 12.0, **how) -> FactorizationMachine:
    """Fits the model on the driver, on ``labelled_terms``: at most ``max_rows`` documents, whatever the input."""
    table = labelled_terms(docs, labels, max_rows, bits, min_association)
    ids, toxic = table.column("label_id").to_numpy(), table.column("toxic").to_numpy()
    found = [x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in table.column("terms").chunks]
    sizes = np.concatenate([np.empty(0, np.int64), *(x.value_lengths().to_numpy() for x in table.column("terms").chunks)]).astype(np.int64)
    flat = np.concatenate([np.empty(0, np.int32), *found])
    del table, found
    # In the order of the ids, whatever the order of the tasks: the fit depends on it.
    order = np.argsort(ids, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([np.empty(0, np.int32), *(flat[starts[i] : starts[i + 1]] for i in order)])
    # The terms have been chosen: all that came count.
    model = fit(flat, sizes[order], toxic[order].astype(np.float64), bits, min_association=0.0, **how)
    del flat
    _give_back(docs.sparkSession)
    return model


def _give_back(spark: SparkSession) -> None:
    """What the sample took goes back to the machine: the driver may have little memory for what follows."""
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def score(docs: DataFrame, model: FactorizationMachine, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the columns ``carry`` for every row, from the text alone; null texts score as empty ones."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits * (rank + 2) numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        ids = _TermIds(machine.bits)
        for batch in batches:
            scores = []
            for low in range(0, batch.num_rows, 500):
                found = [terms(t, ids) for t in batch.column(1).slice(low, 500).to_pylist()]
                z = machine.margins(np.concatenate(found), np.array([len(x) for x in found], np.int64))
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            p = np.concatenate([np.empty(0), *scores])
            held = [held_out(d) for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), *batch.columns[2:]], names=["doc_id", "held_out", "score", "predicted", *batch.schema.names[2:]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), *([F.struct(*carry).alias("carried")] if carry else []))
    made = "doc_id long, held_out boolean, score double, predicted int" + (f", carried {rows.schema['carried'].dataType.simpleString()}" if carry else "")
    return rows.mapInArrow(run, made).select("doc_id", "held_out", "score", "predicted", *(F.col("carried").getField(name).alias(name) for name in carry or []))
