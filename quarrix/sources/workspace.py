"""Source: the files under a directory.

The driver lists names and sizes only (their number is capped); tasks measure
and read contents.  Order, filters and caps are those that ids and ties depend on.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..chunking.languages import language_of
from ..config import EngineConfig

LISTED = "file_ord long, rel string, path string, size long, mtime_ms double, language string"
BINARY_HEAD = 8192


@dataclass
class Listing:
    rows: list[tuple] = field(default_factory=list)
    skipped: dict[str, int] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    truncated: bool = False

    def skip(self, reason: str) -> None:
        self.skipped[reason] = self.skipped.get(reason, 0) + 1


def _matcher(config: EngineConfig):
    """``(ignored(rel), included(name))`` as plain predicates for the walk."""
    import re

    from ..functions.text import glob_regex

    names = {r for r in config.ignore if r and "*" not in r}
    globs = [re.compile(glob_regex(r)) for r in config.ignore if "*" in r]
    wanted = [re.compile(glob_regex(g)) for g in config.include]
    ignored = lambda rel: not names.isdisjoint(rel.split("/")) or any(g.match(rel) for g in globs)
    return ignored, lambda name: any(g.match(name) for g in wanted)


def list_files(config: EngineConfig) -> Listing:
    """A directory's files by name, then its sub-directories from the last name to the first."""
    out, stack = Listing(), [""]
    ignored, included = _matcher(config)
    while stack:
        folder = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(config.root, folder)), key=lambda e: e.name.encode("utf-16-be", "surrogatepass"))
        except OSError as e:
            out.errors.append(f"{folder or '.'}: {e.strerror}")
            continue
        for entry in entries:
            rel = f"{folder}/{entry.name}" if folder else entry.name
            if ignored(rel):
                continue
            if entry.is_dir(follow_symlinks=False):
                stack.append(rel)
                continue
            if not entry.is_file(follow_symlinks=False):
                out.skip("non-file")
                continue
            if len(out.rows) >= config.max_files:
                out.truncated = True
                return out
            try:
                stat = entry.stat(follow_symlinks=False)
            except OSError as e:
                out.errors.append(f"{rel}: {e.strerror}")
                continue
            if stat.st_size == 0:
                out.skip("empty")
            elif not included(entry.name):
                out.skip("not-included")
            elif stat.st_size > config.max_file_bytes:
                out.skip("too-large")
            else:
                language = language_of(rel)
                out.rows.append((len(out.rows), rel, entry.path, stat.st_size, stat.st_mtime_ns / 1e6, language.name if language else "text"))
    return out


def _opened(paths: DataFrame, columns: str, made: Callable[[str], tuple]) -> DataFrame:
    """``file_ord`` and what ``made(path)`` gives for each path, computed where the task runs; a file at a time."""
    schema = paths.sparkSession.createDataFrame([], f"file_ord long, {columns}").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for order, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((order, *made(path)))
                held += sum(len(x) for x in rows[-1] if isinstance(x, str)) + 64
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types, strict=True)], schema=arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types, strict=True)], schema=arrow)

    return paths.select("file_ord", "path").mapInArrow(run, schema)


def _text(path: str) -> str:
    """Malformed bytes become U+FFFD."""
    with open(path, "rb") as f:
        return f.read().decode("utf-8", "replace")


def scan(spark: SparkSession, config: EngineConfig) -> tuple[DataFrame, Listing]:
    """Text files ``LISTED`` and their ``bytes`` (of the text, with U+FFFD for malformed bytes) within the byte cap; no contents.

    Tasks open the listed paths, whatever their names, and no others.  Files
    with a NUL near their beginning are binary: skipped and named in the
    listing.  An unreadable file is an error of the listing.  The first file
    that would exceed the byte cap ends the scan, which is then truncated.
    """
    listing = list_files(config)
    listed = spark.createDataFrame(listing.rows, LISTED)
    if not listing.rows:
        return listed.selectExpr("*", "cast(null AS long) AS bytes"), listing

    def measure(path: str) -> tuple:
        try:
            text = _text(path)
        except OSError as e:
            return 0, False, e.strerror or str(e)
        return len(text.encode()), "\0" in text[:BINARY_HEAD], None

    # As many rows as the driver has listed already: at most max_files.
    found = {r.file_ord: r for r in _opened(listed, "bytes long, is_binary boolean, error string", measure).collect()}
    rows, total = [], 0
    for row in listing.rows:
        one = found[row[0]]
        if one.error:
            listing.errors.append(f"cannot read {row[1]}: {one.error}")
        elif one.is_binary:
            listing.skip("binary")
            listing.binary.append(row[1])
        elif total + one.bytes > config.max_total_bytes:
            listing.truncated = True
            break
        else:
            total += one.bytes
            rows.append((*row, one.bytes))
    return spark.createDataFrame(rows, f"{LISTED}, bytes long"), listing


def with_contents(files: DataFrame) -> DataFrame:
    """Adds ``content``, read by path in tasks; files that cannot be read any more are left out."""

    def read(path: str) -> tuple:
        try:
            return (_text(path),)
        except OSError:
            return (None,)

    return files.join(_opened(files, "content string", read).where("content IS NOT NULL"), "file_ord")


def skip_reasons(files: DataFrame, config: EngineConfig) -> DataFrame:
    """``reason, n`` over a table ``rel, size, is_binary`` of candidate files."""
    from ..functions.text import is_included

    reason = F.when(F.col("size") == 0, "empty").when(~is_included(F.col("rel"), config.include), "not-included").when(F.col("size") > config.max_file_bytes, "too-large").when(F.col("is_binary"), "binary")
    return files.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
