"""Corpus statistics as tables: term frequencies, lengths, document frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counting


def spread(units: DataFrame, id_col: str = "unit_id") -> DataFrame:
    """The same rows, dealt out by id before their texts are cut.

    A file of one row group is read by one task, however long it is; texts move
    once, and all tasks of a shuffle share the work on them.  What counts by
    unit afterwards needs no other exchange.
    """
    return units.repartition(id_col)


def _whole(units: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``unit_id, text`` with one row for each id: rows of one id are one unit, and no token reaches over a line's end."""
    dealt = spread(units.select(F.col(id_col).alias("unit_id"), F.col(text_col).cast("string").alias("text")))
    return dealt.groupBy("unit_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))


def postings(units: DataFrame, ngram: int = 2, id_col: str = "unit_id", text_col: str = "text", only: list[str] | None = None) -> DataFrame:
    """``unit_id, dl, terms``: a row for each unit with its length and an array of ``(term, tf)``, of the terms in ``only`` alone if given.

    Filters on units belong before this: texts are counted once, and no filter passes that.
    """
    held = _whole(units, id_col, text_col).select("unit_id", counting.counts(F.col("text"), ngram, only).alias("c"))
    return held.select("unit_id", "c.dl", "c.terms")


def term_frequencies(units: DataFrame, ngram: int = 2, id_col: str = "unit_id", text_col: str = "text") -> DataFrame:
    """``unit_id, term, tf``; units without tokens have no row."""
    return postings(units, ngram, id_col, text_col).select("unit_id", F.explode("terms").alias("t")).select("unit_id", "t.term", "t.tf")


def token_lengths(units: DataFrame, ngram: int = 2, id_col: str = "unit_id", text_col: str = "text") -> DataFrame:
    """``unit_id, dl`` as from ``doc_lengths`` of the term frequencies, without a row for each token."""
    return _whole(units, id_col, text_col).select("unit_id", counting.lengths(F.col("text"), ngram).alias("dl")).where("dl > 0")


def document_frequencies(units: DataFrame, ngram: int = 2, id_col: str = "unit_id", text_col: str = "text") -> DataFrame:
    """``term, df`` as counted from the term frequencies; tasks hand on one row for each term they meet."""
    parts = _whole(units, id_col, text_col).select(F.col("text").cast("binary")).mapInArrow(counting.holders(ngram), "term string, df long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def duplicate_units(units: DataFrame, id_col: str = "unit_id") -> DataFrame:
    """Ids that occur more than once; an index takes each id once."""
    return units.groupBy(F.col(id_col).alias("unit_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def doc_lengths(tf: DataFrame) -> DataFrame:
    return tf.groupBy("unit_id").agg(F.sum("tf").alias("dl"))


def corpus_row(units: DataFrame, tf: DataFrame) -> DataFrame:
    """One row ``n_docs, total_len, avg_len``; units without tokens count as documents."""
    return _corpus_row(units, tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total_len")))


def corpus_row_of_lengths(units: DataFrame, lengths: DataFrame) -> DataFrame:
    """As ``corpus_row``, from the lengths of the units."""
    return _corpus_row(units, lengths.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len")))


def _corpus_row(units: DataFrame, total: DataFrame) -> DataFrame:
    n = units.agg(F.count(F.lit(1)).alias("n_docs"))
    return n.crossJoin(total).select("n_docs", "total_len", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(0.0).alias("avg_len"))


def idf_weight(df: Column, n_docs: int) -> Column:
    return F.log(1 + (F.lit(n_docs) - df + 0.5) / (df + 0.5))


def idf(tf: DataFrame, n_docs: int) -> DataFrame:
    """``term, df, idf`` with ``ln(1 + (N - df + 0.5) / (df + 0.5))``."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", idf_weight(F.col("df"), n_docs).alias("idf"))


def idf_of_units(units: DataFrame, n_docs: int) -> DataFrame:
    """As ``idf`` of the term frequencies of the units, without a row for each posting."""
    return document_frequencies(units).select("term", "df", idf_weight(F.col("df"), n_docs).alias("idf"))


def idf_or_max(terms: DataFrame, idf_table: DataFrame, n_docs: int) -> DataFrame:
    return terms.join(idf_table.select("term", "idf"), "term", "left").select("term", F.coalesce("idf", F.log(F.lit(1.0 + n_docs))).alias("idf"))


def vocabulary_size(tf: DataFrame) -> DataFrame:
    return tf.agg(F.countDistinct("term").alias("terms"))
