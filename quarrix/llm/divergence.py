"""Audit of how far the sources of a language diverge in their use of words, by systolic rotation.

Each source of a language is a vector of counts over the language's kept terms,
cut into blocks of terms.  The sources are seated in teams; a team's vectors of
one block stay in their partition, and the compressed vectors of the other
teams come by in the rounds of a round-robin tournament, so that any two teams
meet exactly once.  A meeting evaluates all its pairs of sources for both
sides.  Before that, the language's own vector visits every team, and local
heaps keep each source's most over-used terms of the block.

A meeting holds two teams of one block, whatever the size of a source, a
language or its vocabulary.  All arithmetic is in integers.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, staged

_HELD = 2_000_000  # tokens that a task holds before it hands on their counts
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df``: occurrences and documents of each term; null text, lang and source are ''.

    A term is a run of letters: ASCII ones in lower case, and everything beyond
    ASCII as it is.  In UTF-8 that is a run of the bytes a-z and 80-FF.  Counts
    are taken before the shuffle, in each task and again by the aggregation.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[tuple[str, str], list[bytes]] = {}
        types: dict[tuple[str, str], list[bytes]] = {}
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for group, found in tokens.items():
                n, df = Counter(found), Counter(types[group])
                columns = [pa.array([x] * len(n)) for x in group]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())], names=[*_GROUP, "term", "n", "df"])
            tokens.clear()
            types.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _TERM.findall(text.lower())
                if found:
                    tokens.setdefault((lang, source), []).extend(found)
                    types.setdefault((lang, source), []).extend(set(found))
                    held += len(found)
                if held > _HELD:
                    yield from counted()
                    held = 0
        yield from counted()

    parts = docs.select(*_GROUP, F.col("text").cast("binary")).mapInArrow(count, "lang string, source string, term binary, n long, df long")
    return parts.groupBy(*_GROUP, F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def packed_vector(positions: np.ndarray, counts: np.ndarray) -> bytes:
    """Positions as differences and counts, each in as few bytes as its greatest needs, compressed."""
    steps = np.diff(positions, prepend=0)
    widths = [next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w)) for x in (steps, counts)]
    raw = bytes(widths) + b"".join(x.astype(f"<u{w}").tobytes() for x, w in zip((steps, counts), widths, strict=True))
    return zstandard.compress(raw, 1)


def unpacked_vector(packed: bytes | None, width: int) -> np.ndarray:
    """The vector of ``width`` counts; none at all stands for zeros."""
    out = np.zeros(width, np.int64)
    if packed:
        raw = zstandard.decompress(packed)
        n = (len(raw) - 2) // (raw[0] + raw[1])
        steps = np.frombuffer(raw, f"<u{raw[0]}", n, 2).astype(np.int64)
        out[np.cumsum(steps)] = np.frombuffer(raw, f"<u{raw[1]}", n, 2 + n * raw[0])
    return out


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``1 + floor(10**9 * (count + 2) / (total + 2 * terms))``, by long division in three steps.

    Exact while the denominator is under 9 * 10**15.
    """
    whole, rest = np.zeros(len(counts), np.int64), counts + 2
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total + 2 * terms)
        whole = whole * 1000 + more
    return 1 + whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def opponent(team, teams, step):
    """Whom a team meets in a round of the circle method; itself when it has no game.

    Works on numbers and on columns.  ``teams`` is even: the last seat stays, the
    others move by one each round, so that those whose numbers add up to twice
    the round (modulo the moving seats) meet.
    """
    moving = teams - 1 if isinstance(team, int) else F.greatest(teams - 1, F.lit(1))
    across = (2 * step - team + moving * 2) % moving
    if isinstance(team, int):
        return step % moving if team == moving else moving if across == team else across
    return F.when(team == moving, F.lit(step) % moving).when(across == team, moving).otherwise(across)


def _seats(groups: DataFrame, per_team: int) -> DataFrame:
    """``team`` of each source in its language, and the even number ``teams`` of them (1 if there is one)."""
    order = Window.partitionBy("lang").orderBy("source")
    team = F.floor((F.row_number().over(order) - 1) / per_team).cast("int")
    n = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / per_team).cast("int")
    return groups.withColumn("team", team).withColumn("teams", F.when(n > 1, n + n % 2).otherwise(n))


_SLOT = ["lang", "block", "team"]
_MEET = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def _rows(table: pa.Table) -> list[tuple]:
    """``source, p`` of each row of a slot, by source."""
    columns = ("source", "total", "terms", "width", "vector")
    rows = sorted(zip(*(table.column(c).to_pylist() for c in columns), strict=True), key=lambda r: r[0])
    return [(source, shares(unpacked_vector(vector, width), total, terms) if width else np.empty(0, np.int64)) for source, total, terms, width, vector in rows]


def _meeting(lang: str, pairs) -> pa.Table:
    """Both directions of each pair, evaluated once."""
    found = [(a, b, int(divergence(p, q).sum())) for (a, p), (b, q) in pairs]
    both = [(lang, *x) for a, b, v in found for x in ((a, b, v), (b, a, v))]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*both) if both else [[]] * 4, _MEET.types, strict=True)], schema=_MEET)


def _at_home(key: tuple, slot: pa.Table) -> pa.Table:
    rows = _rows(slot)
    return _meeting(key[0].as_py(), ((x, y) for i, x in enumerate(rows) for y in rows[:i]))


def _visited(key: tuple, slot: pa.Table, visitors: pa.Table) -> pa.Table:
    if not visitors.num_rows:
        return _meeting("", [])
    guests = _rows(visitors)
    return _meeting(key[0].as_py(), ((x, y) for x in _rows(slot) for y in guests))


def _by_language(top: int):
    """The language's vector visits a team: of each source, the ``top`` terms of the block that it uses more."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("block", pa.int32()), ("pos", pa.int32()), ("value", pa.int64())])

    def run(key: tuple, slot: pa.Table, visitor: pa.Table) -> pa.Table:
        lang, block = key[0].as_py(), key[1].as_py()
        out = []
        if visitor.num_rows and slot.num_rows:
            ((_, q),) = _rows(visitor)
            vectors = dict(zip(slot.column("source").to_pylist(), slot.column("vector").to_pylist(), strict=True))
            for source, p in _rows(slot):
                over = np.flatnonzero((unpacked_vector(vectors[source], len(p)) > 0) & (p > q))
                values = divergence(p[over], q[over])
                # Positions follow the order of the terms, so they decide ties.
                best = heapq.nsmallest(top, zip((-values).tolist(), over.tolist(), strict=True))
                out += [(lang, source, block, pos, -value) for value, pos in best]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, schema.types, strict=True)], schema=schema)

    return run, "lang string, source string, block int, pos int, value long"


def _packed(postings: DataFrame, keys: list[str]) -> DataFrame:
    """One compressed vector and its sum for each of ``keys`` with ``pos, n``; at most a block's terms meet in a row."""
    keys = [*keys, "sum"]
    lists = postings.groupBy(*keys[:-1]).agg(F.sum("n").alias("sum"), F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("x")).select(*keys, "x.pos", "x.n")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lists.schema.fields[: len(keys)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed_vector(np.asarray(p, np.int64), np.asarray(n, np.int64)) for p, n in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, pa.binary())], names=[*keys, "vector"])

    return lists.mapInArrow(pack, f"{fields}, vector binary")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, per_team: int = 8, block_terms: int = 1 << 15) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source against the others of its language, and its over-used terms.

    A language keeps the terms in at least ``min_docs`` of its documents.  Part
    ``pair`` has a row for each other source, with the divergence summed over
    all kept terms (0 without any); part ``term`` has the ``top`` kept terms
    that the source uses, and more than its language.  Ranks start at 1, by
    value, then by the UTF-8 of the item.  Null text, language and source are
    '', repeated rows are documents of their own, sources without any term take
    part, and other columns are not read.  Without documents there are no rows.
    """
    spark = docs.sparkSession
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = staged(term_counts(named), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).where(F.col("df") >= min_docs)
    kept = staged(kept.select("lang", "term", "n"), "kept")
    # As many blocks for all languages, so that no term meets the others of its language.
    blocks = max(1, -(-kept.count() // block_terms))
    spread = kept.select("lang", "term", "n", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))
    placed = staged(spread.withColumn("pos", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1), "terms")
    drop(kept)
    langs = staged(placed.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total")), "languages")
    used = counts.select(*_GROUP, "term", "n").join(placed.select("lang", "term", "block", "pos").hint("merge"), ["lang", "term"])
    vectors = staged(_packed(used.drop("term"), [*_GROUP, "block"]), "vectors")
    totals = vectors.groupBy(*_GROUP).agg(F.sum("sum").alias("total"))

    groups = _seats(named.select(*_GROUP).distinct(), per_team)
    widths = placed.groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("width"))
    # A language without kept terms has one empty block, in which its sources meet all the same.
    shapes = groups.select("lang").distinct().join(langs.select("lang", "terms", F.col("total").alias("all")), "lang", "left").join(widths, "lang", "left").fillna(0, ["terms", "all", "block", "width"])
    seated = groups.join(totals.hint("merge"), _GROUP, "left").fillna(0, ["total"]).join(shapes.hint("merge"), "lang")
    home = staged(seated.join(vectors.hint("merge"), [*_GROUP, "block"], "left"), "home")
    drop(counts, vectors)

    # Stays where it is for all rounds; what circulates comes to its partitions.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    resident = home.select(*_SLOT, "source", "total", "terms", "width", "vector").repartition(parts, *_SLOT).persist()
    own = _packed(placed.select("lang", "block", "pos", "n"), ["lang", "block"]).join(shapes.hint("merge"), ["lang", "block"])
    seats = home.select(*_SLOT).distinct()
    visitor = own.join(seats.hint("merge"), ["lang", "block"]).withColumn("source", F.lit("")).withColumn("total", F.col("all"))
    # Names of their own: what comes by derives from the tables of what stays.
    fresh = [F.col(c).alias(c) for c in (*_SLOT, "source", "total", "terms", "width", "vector")]
    visitor = visitor.select(*fresh)
    heaps, heap_schema = _by_language(top)
    try:
        best = staged(resident.groupBy(*_SLOT).cogroup(visitor.groupBy(*_SLOT)).applyInArrow(heaps, heap_schema), "heaps")
        meet = "lang string, a string, b string, value long"
        met = [staged(resident.groupBy(*_SLOT).applyInArrow(_at_home, meet), "round")]
        most = groups.agg(F.max("teams")).first()[0] or 0
        for step in range(most - 1):
            other = opponent(F.col("team"), F.col("teams"), step)
            # The higher number travels; both sides are evaluated where the lower one sits.
            travels = home.where(F.col("teams") - 1 > step).withColumn("team", F.when(other < F.col("team"), other)).where("team IS NOT NULL")
            guests = travels.select(*fresh).repartition(parts, *_SLOT)
            met.append(staged(resident.groupBy(*_SLOT).cogroup(guests.groupBy(*_SLOT)).applyInArrow(_visited, meet), "round"))
    finally:
        resident.unpersist()
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionAll(more)
    pairs = pairs.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    # At most ``top`` rows of each source and block meet here.
    terms = best.join(placed.select("lang", "block", "pos", F.col("term").alias("item")).hint("merge"), ["lang", "block", "pos"]).withColumn("part", F.lit("term"))
    columns = [*_GROUP, "part", "item", "value"]
    ranked = pairs.select(*columns).unionAll(terms.select(*columns)).withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP, "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
