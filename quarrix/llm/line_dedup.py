"""Removes lines that many documents share; DataFrame operations only.

Lines are exploded with their position, reduced to a hash of their normalised
form, and counted by distinct document.  What is over the threshold goes back
to its documents as positions to leave out; texts themselves move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, staged

# The stripped characters, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(BLANKS))
    # lower() changes other letters too, so it serves only where there are none.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hashes(key: Column) -> list[Column]:
    """128 bits of hash as two longs: the second starts from another seed."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows ``doc_id, text, n_lines, n_dropped, kept`` and the columns ``carry`` for every row of ``docs``.

    Lines end at ``\\n``; a null or empty text is one empty line.  A key of at
    least ``min_chars`` code points in at least ``min_docs`` documents keeps its
    lines only in the document of the largest id that holds it.  Rows of one id
    count as one document, but each loses the lines of its own text alone; rows
    of a null id are never counted and stay whole.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(carry or []))
    # Rows of one id are told apart by a hash of the text.
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    lines = texts.where("doc_id IS NOT NULL").select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    places = staged(keyed.select(*key_hashes(F.col("key")), "doc_id", "text_hash", "pos"), "lines")
    common = places.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))
    # Read from a table, both sides come straight from an exchange, so adaptive skew handling can split a key of very many documents.
    common = staged(common.where(F.col("n_docs") >= min_docs).select("h1", "h2", "holder"), "common")
    out = staged(places.join(common.hint("merge"), ["h1", "h2"]).where("doc_id < holder").groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop")), "positions")
    drop(places, common)
    split = F.split("text", "\n")
    n = F.size(split)
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drop"))
    # The outer transform binds the split lines once for all positions.
    kept = F.element_at(F.transform(F.array(split), lambda all_lines: F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n")), 1)
    joined = texts.join(out, ["doc_id", "text_hash"], "left")
    return joined.select(
        "doc_id",
        "text",
        n.cast("long").alias("n_lines"),
        # Without ANSI mode the size of a null array is -1, so nulls are told apart first.
        F.when(F.col("drop").isNull(), F.lit(0)).otherwise(n - F.size(left)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        *(carry or []),
    )
