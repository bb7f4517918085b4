"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on ids.

A dataset is a folder with ``parts/``, ORC files of rows ``part int, doc_id
long, start long, n_tokens long, ids array<int>`` in ascending order of
document id within and across parts, and ``bases/``, one row per part with the
number of ids in all parts before it.  ``start`` counts from the part's
beginning, so that parts are written side by side; readers add the base.
Stripes are read in parallel, and a lookup by id reads only the row groups that
the column statistics and Bloom filters leave.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe

PARTS = "part int, doc_id long, start long, n_tokens long, ids array<int>"
_PARTS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
# A document is long, so a row group and a stripe hold few of them.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def _encode_sorted(tokenizer: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        encoder = byte_bpe(tokenizer).encode
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows = batch.slice(low, 500)
                ids = [np.append(encoder(t or ""), np.uint32(end_id)) for t in rows.column(1).to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), rows.column(0), pa.array(start + offsets[:-1]), pa.array(sizes), lists], schema=_PARTS)
                start += int(offsets[-1])

    return encode


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all documents and writes the dataset.

    A null text counts as empty (its only id is the end id).  Rows with equal
    ids stay, ordered by text; null ids come first.  An empty table gives a
    dataset without rows.
    """
    spark = docs.sparkSession
    # The text's hash as second key lets rows of one id spread over several parts.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ranged.mapInArrow(_encode_sorted(tokenizer, end_id), PARTS).write.options(**ORC_OPTIONS).orc(f"{path}/parts")
    sizes = spark.read.schema(PARTS).orc(f"{path}/parts").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each part, whatever the number of documents.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("base")).write.orc(f"{path}/bases")


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids`` with ``start`` counted from the dataset's beginning.

    With ``doc_ids``, only row groups that may hold one of these are read.
    """
    parts = spark.read.schema(PARTS).orc(f"{path}/parts")
    if doc_ids is not None:
        parts = parts.where(F.col("doc_id").isin(doc_ids))
    bases = spark.read.schema("part int, base long").orc(f"{path}/bases")
    # A row for each file: a broadcast bounded by the number of write tasks.
    return parts.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows that ``read_token_files`` gives."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4")
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            n = pa.array((ends[1:] - ends[:-1]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
