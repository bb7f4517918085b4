"""Caps over ordered files, change detection and its counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, order: str, value: str, name: str = "total", share: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row, in the order of the long column ``order``.

    Rows are summed by stretches of the order first, so no task sees them all:
    one small window over the stretches, one window inside each stretch.
    """
    cut = rows.withColumn("__stretch", F.floor(F.col(order) / share))
    sums = cut.groupBy("__stretch").agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("__stretch", F.coalesce(before, F.lit(0)).alias("__base"))
    inside = F.sum(value).over(Window.partitionBy("__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(bases, "__stretch").withColumn(name, F.col("__base") + inside).drop("__stretch", "__base")


def within_bytes(files: DataFrame, max_bytes: int, order: str = "file_ord", size: str = "bytes") -> DataFrame:
    """The files before the first one whose bytes would exceed the cap."""
    return running_total(files, order, size).where(F.col("total") <= max_bytes).drop("total")


def within_chunks(files: DataFrame, max_chunks: int, strict: bool, order: str = "file_ord", count: str = "n_chunks") -> DataFrame:
    """A full build starts a file while the cap is not reached; a refresh (``strict``) never exceeds it."""
    total = running_total(files, order, count)
    kept = F.col("total") <= max_chunks if strict else F.col("total") - F.col(count) < max_chunks
    return total.where(kept).drop("total")


def within_budget(files: DataFrame, base: int, cap: int, order: str, new: str, old: str) -> DataFrame:
    """The files before the first one whose replacement would take the whole over ``cap``.

    ``base`` is what the index holds; each file in order replaces ``old`` of it by ``new``.
    """
    total = running_total(files.withColumn("__delta", F.col(new) - F.col(old)), order, "__delta", "__total")
    first = total.where(F.col("__total") > cap - base).agg(F.min(order)).first()[0]
    kept = total if first is None else total.where(F.col(order) < first)
    return kept.drop("__delta", "__total")


def changes(indexed: DataFrame, scanned: DataFrame, complete: bool = True) -> DataFrame:
    """``rel, change`` (added, updated, unchanged, removed, kept) by size, time and language.

    Files that an incomplete scan did not see are kept, not removed.
    """
    facts = ["size", "mtime_ms", "language"]
    old = indexed.select("rel", F.struct(*facts).alias("old"))
    new = scanned.select("rel", F.struct(*facts).alias("new"))
    gone = "removed" if complete else "kept"
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), gone).when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return old.join(new, "rel", "full").select("rel", change.alias("change"))


def counters(changed: DataFrame) -> DataFrame:
    one = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
    return changed.agg(*[one(c) for c in ("added", "updated", "removed", "unchanged")])


def without_files(table: DataFrame, gone: DataFrame, key: str = "rel") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def only_files(table: DataFrame, wanted: DataFrame, key: str = "rel") -> DataFrame:
    return table.join(wanted.select(key), key, "left_semi")
