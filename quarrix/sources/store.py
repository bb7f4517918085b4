"""Sink and source: snapshots of an index over immutable segments of Parquet tables, in a folder of any file system Hadoop knows.

A segment holds what one build or refresh read anew and never changes.  A
snapshot names its segments and the files of theirs that are gone, and has the
statistics of the whole corpus; weights that depend on these are applied when
reading.  A refresh thus writes its own files and statistics.  Beyond a number
of segments, all live rows go to a new one.

A snapshot is published by a numbered commit, a small file that is created only
if there is none of its number, so of two writers that began at the same commit
one wins and the other gets ``Conflict``.  Readers take the commit of the
highest number that names a snapshot; one that its writer did not finish names
none.  The file system must create files exclusively: local ones and HDFS do,
an object store only with conditional writes.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 6
SEGMENT_TABLES = ("files", "chunks", "tf", "lengths", "sparse", "vectors")
SNAPSHOT_TABLES = ("df", "norms")
TABLES = (*SEGMENT_TABLES, *SNAPSHOT_TABLES)
# Sorted by what a search filters on, so that statistics of row groups let it skip the rest; by unit too, so that a frequent term or bucket spreads over files.
SORTED = {"tf": ("term", "unit_id"), "sparse": ("bucket", "unit_id"), "df": ("term",)}
MAX_SEGMENTS = 8


@dataclass(frozen=True)
class Meta:
    provider_id: str
    provider_kind: str
    dimension: int
    root: str
    built_at: int
    truncated: bool
    n_chunks: int
    total_len: int = 0
    last_id: int = 0
    segments: tuple[str, ...] = ()
    gone: tuple[int, ...] = field(default=(), repr=False)  # files of the segments that no longer count, at most as many as the scan lists
    rows: dict[str, dict[str, int]] = field(default_factory=dict, repr=False)  # of each segment's tables, as counted while they were written
    version: int = FORMAT_VERSION

    @property
    def avg_len(self) -> float:
        return self.total_len / self.n_chunks if self.n_chunks else 0.0


@dataclass
class Loaded:
    status: str  # loaded, empty or stale
    meta: Meta | None = None
    tables: dict[str, DataFrame] | None = None
    reason: str | None = None
    base: Commit | None = None


@dataclass(frozen=True)
class Commit:
    """The highest number given away, and the snapshot of the highest finished commit."""

    number: int = 0
    snapshot: str | None = None


class Conflict(RuntimeError):
    """Another writer has published since this one began."""


class Folder:
    """Small files and listings of a folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, uri: str):
        self.uri, self._jvm = uri, spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._local = self._fs.getScheme() == "file"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def names(self, name: str = "") -> list[str]:
        path = self._path(name)
        return [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        try:
            stream = self._fs.open(self._path(name))
            try:
                return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Py4JJavaError as e:
            raise OSError(str(e.java_exception)) from e

    def create(self, name: str, text: str) -> bool:
        """Whether the file was created; False if there is one already."""
        path = self._path(name)
        self._fs.mkdirs(path.getParent())
        if self._local:  # Hadoop's local file system looks first and creates then
            try:
                with open(path.toUri().getPath(), "xb") as f:
                    f.write(text.encode())
            except FileExistsError:
                return False
            return True
        try:
            stream = self._fs.create(path, False)
        except Py4JJavaError as e:
            if self._fs.exists(path):
                return False
            raise OSError(str(e.java_exception)) from e
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def size(self) -> int:
        path = self._path("")
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0


def _ordered(rows: DataFrame, table: str) -> DataFrame:
    key = SORTED.get(table)
    return rows.repartitionByRange(*key).sortWithinPartitions(*key) if key else rows


def _ids(column: str) -> list[Column]:
    """Aggregates by which a set of ids is compared with another one: equal sets agree, and others do not but for a collision of 64-bit hashes."""
    return [F.min(column).alias("low"), F.max(column).alias("high"), F.bit_xor(F.xxhash64(F.col(column).cast("long"))).alias("ids")]


class Segment:
    """Tables that no snapshot names yet; ``rows`` and ``ids`` are observed by the jobs that write them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.name = spark, folder, f"seg-{uuid.uuid4().hex}"
        self.rows: dict[str, int] = {}
        self.ids: dict[str, tuple] = {}

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Adds a table and reads it back."""
        path = f"{self.folder}/{self.name}/{table}"
        column = {"chunks": "chunk_id", "vectors": "unit_id"}.get(table)
        seen = Observation()
        _ordered(rows, table).observe(seen, F.count(F.lit(1)).alias("n"), *(_ids(column) if column else [])).write.parquet(path)
        found = seen.get
        self.rows[table] = found.get("n", 0)
        self.ids[table] = (found.get("low"), found.get("high"), found.get("ids"))
        return self.spark.read.schema(rows.schema).parquet(path)

    def check(self, first: int, last: int, dense: bool) -> None:
        """Raises unless the chunks' ids are first to last, each once, and with dense vectors theirs as well."""
        wanted = self.spark.range(first, last + 1).agg(*_ids("id")).first()
        for table in ("chunks", *(["vectors"] if dense else [])):
            if self.rows[table] != last - first + 1 or self.ids[table] != tuple(wanted):
                raise ValueError(f"{table}: repeated or missing ids among {self.rows[table]} rows of {first} to {last}")

    def discard(self) -> None:
        """Removes it; what a task that is still ending writes after that goes with the next save."""
        Folder(self.spark, self.folder).delete(self.name)


def save(spark: SparkSession, folder: str, statistics: dict[str, DataFrame], meta: Meta, base: Commit) -> tuple[str, Commit]:
    """Writes the statistics, publishes the snapshot as the commit after ``base``, then removes what neither it nor its predecessor names.

    Removed are only things that were there before the commit: those of writers
    that began before it, which can no longer win.
    """
    if meta.n_chunks and meta.dimension <= 0:
        raise ValueError("an index with chunks needs a known dimension")
    place, name, number = Folder(spark, folder), f"v-{uuid.uuid4().hex}", base.number + 1
    there = [x for x in place.names() if x.startswith(("v-", "seg-"))]
    try:
        for table in SNAPSHOT_TABLES:
            _ordered(statistics[table], table).write.parquet(f"{folder}/{name}/{table}")
        place.create(f"{name}/meta.json", json.dumps(asdict(meta)))
        if not place.create(_commit(number), name):
            raise Conflict(f"commit {number} is another writer's")
        # Whoever went on from here meanwhile, or finished a commit that seemed abandoned, is seen now, or sees this one.
        if max(_numbers(place)) > number or _latest(place, number - 1).snapshot != base.snapshot:
            place.delete(_commit(number))
            raise Conflict(f"another writer has published since commit {base.number}")
    except BaseException:
        place.delete(name)
        raise
    kept = {name, base.snapshot, *meta.segments}
    try:
        kept.update(_read_meta(place, base.snapshot).segments if base.snapshot else ())
    except (OSError, ValueError, TypeError):
        pass  # an unreadable predecessor keeps nothing
    for old in there:
        if old not in kept:
            place.delete(old)
    for old in _numbers(place):
        if old < base.number:
            place.delete(_commit(old))
    return f"{folder}/{name}", Commit(number, name)


def _commit(number: int) -> str:
    return f"commits/{number:012d}"


def _numbers(place: Folder) -> list[int]:
    return sorted(int(x) for x in place.names("commits") if x.isdigit())


def _latest(place: Folder, up_to: int | None = None) -> Commit:
    numbers = [n for n in _numbers(place) if up_to is None or n <= up_to]
    for n in reversed(numbers):
        try:
            name = place.read(_commit(n))
        except OSError:
            continue  # removed meanwhile
        if re.fullmatch("v-[0-9a-f]{32}", name):
            return Commit(numbers[-1], name)
    return Commit(numbers[-1] if numbers else 0)


def _read_meta(place: Folder, snapshot: str) -> Meta:
    found = json.loads(place.read(f"{snapshot}/meta.json"))
    return Meta(**found | {k: tuple(found.get(k, ())) for k in ("segments", "gone")})


def open_tables(spark: SparkSession, folder: str, home: str, meta: Meta, statistics: bool = True) -> dict[str, DataFrame]:
    """The tables of a snapshot: rows of its segments whose file still counts, and its statistics if it has any yet."""
    tables = {t: spark.read.parquet(*[f"{folder}/{s}/{t}" for s in meta.segments]) for t in SEGMENT_TABLES}
    if meta.gone:
        gone = F.broadcast(spark.createDataFrame([(x,) for x in meta.gone], "file_id long"))
        tables = {t: rows.join(gone, "file_id", "left_anti") for t, rows in tables.items()}
    return tables | ({t: spark.read.parquet(f"{home}/{t}") for t in SNAPSHOT_TABLES} if statistics else {})


def current(spark: SparkSession, folder: str) -> Commit:
    return _latest(Folder(spark, folder))


def load(spark: SparkSession, folder: str, provider_id: str, dimension: int = 0) -> Loaded:
    place = Folder(spark, folder)
    base = _latest(place)
    if base.snapshot is None:
        return Loaded("empty", base=base)
    try:
        meta = _read_meta(place, base.snapshot)
    except (OSError, ValueError, TypeError) as e:
        return Loaded("stale", reason=f"unreadable: {e}", base=base)
    reason = None
    if meta.version != FORMAT_VERSION:
        reason = f"format {meta.version}"
    elif meta.provider_id != provider_id:
        reason = f"provider {meta.provider_id}"
    elif dimension > 0 and meta.dimension != dimension or meta.dimension < 0 or meta.dimension == 0 and meta.n_chunks:
        reason = f"dimension {meta.dimension}"
    if reason:
        return Loaded("stale", meta, reason=reason, base=base)
    try:
        tables = open_tables(spark, folder, f"{folder}/{base.snapshot}", meta)
        if reason := _incomplete(spark, folder, meta):
            return Loaded("stale", meta, reason=reason, base=base)
    except Exception as e:  # a table is missing or broken: whatever the reader raises, the index is rebuilt
        return Loaded("stale", meta, reason=f"unreadable: {str(e)[:200]}", base=base)
    return Loaded("loaded", meta, tables, base=base)


def _incomplete(spark: SparkSession, folder: str, meta: Meta) -> str | None:
    """The first table whose segments have not the rows that were written; one job, over the footers of their files."""
    wanted = {t: sum(meta.rows[s][t] for s in meta.segments) for t in SEGMENT_TABLES}
    counts = [spark.read.parquet(*[f"{folder}/{s}/{t}" for s in meta.segments]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n") for t in SEGMENT_TABLES]
    found = {r.t: r.n for r in reduce(DataFrame.union, counts).collect()}
    return next((f"{found[t]} {t} of {n}" for t, n in wanted.items() if found[t] != n), None)


def clear(spark: SparkSession, folder: str) -> None:
    place = Folder(spark, folder)
    for name in place.names():
        if name == "commits" or name.startswith(("v-", "seg-")):
            place.delete(name)


def size_bytes(spark: SparkSession, folder: str) -> int:
    return Folder(spark, folder).size()


def exists(spark: SparkSession, folder: str) -> bool:
    return current(spark, folder).snapshot is not None
