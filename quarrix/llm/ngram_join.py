"""N-gram Jaccard join by grouped prefixes, with connected components.

Every document is a set of word shingles in one global order: shingles that
many documents share last, otherwise by hash.  Two similar sets share a number
of shingles of their prefixes.  Documents of equal prefix and size form a group
that is indexed once.  Group pairs that share prefix shingles are counted and
filtered; what remains is expanded to its members and verified on whole texts.

Copies never turn into all pairs.  Equal sets are one node.  In each block of
groups that share a shingle, all are first verified against one leader; then
only pairs of groups are taken that do not lie in one component yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import drop, staged

_BLOCK = 1 << 12  # counters in a row of the sketch
_PART = 2048  # groups of a block that one task compares with as many others
_DENSE = 4_000_000  # cells of a block's table of groups and shingles
_FIRST = 3  # blocks that may hand on a pair
_LONG = 3000  # shingles; the prefixes of larger sets are not sent along
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Word -> 64-bit hash, computed once; starts anew when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``n``-word shingles.

    Words are runs without ``[\\x20\\x09-\\x0D]``, A-Z in lower case.  Fewer than
    ``n`` words count as one shingle; without words there is none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    count = len(words) - n + 1
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out ^= hashes[k : k + count]
        out *= _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _hash128(values: np.ndarray) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(values.tobytes())
    return tuple(np.frombuffer(both, np.int64).tolist())


def odd_sketch(s: np.ndarray) -> bytes:
    """For each of at least 64 and twice as many buckets as there are shingles whether an odd number of them falls into it.

    Where two sketches differ, a shingle is in one set alone.  The number of
    buckets is a power of two: a sketch is halved by ``xor`` of its halves.
    """
    buckets = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


class _Sketches:
    """Sketches of a block's groups, as rows of tables by width; wider ones also stand halved in the table below."""

    def __init__(self, sketches: list[bytes | None]):
        self.width = np.array([len(x) if x else 0 for x in sketches])
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in {x // k for x in self.width.tolist() for k in (1, 2)} - {0}:
            table, at = [], np.full(len(sketches), -1)
            for k in np.flatnonzero((self.width == w) | (self.width == 2 * w)).tolist():
                at[k] = len(table)
                row = np.frombuffer(sketches[k], np.uint8)
                table.append(row if len(row) == w else row[:w] ^ row[w:])
            self.tables[w] = np.array(table), at

    def differ(self, sketch: bytes | None, rows: np.ndarray) -> np.ndarray:
        """At least how many shingles are in one of the two sets alone, for each of ``rows``; 0 where that is not known."""
        least = np.zeros(len(rows), np.int64)
        if not sketch:
            return least
        own = np.frombuffer(sketch, np.uint8)
        width = self.width[rows]
        for w, mine, which in ((len(own), own, width >= len(own)), (len(own) // 2, own[: len(own) // 2] ^ own[len(own) // 2 :], (width > 0) & (width < len(own)))):
            if w in self.tables and which.any():
                table, at = self.tables[w]
                found = at[rows[which]]
                least[which] = np.where(found < 0, 0, np.bitwise_count(table[found] ^ mine).sum(1, dtype=np.int64))
        return least


def shingle_classes(texts: DataFrame, n: int, bits: int) -> np.ndarray:
    """For each bucket of shingle hash 0 if it is rare, else the binary order of magnitude of its documents beyond "common".

    Counted over all documents in ``2 ** bits`` counters, whatever the input.
    The counters stay on executors; the driver gets a byte for each.
    """
    step = min(_BLOCK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counters that are not all 0, by blocks, in as few bytes each as the block's largest needs."""
        total = np.zeros(1 << bits, np.uint32)
        sets, held = [], 0

        def add_held():
            at = (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64)
            total[:] += np.bincount(at, minlength=1 << bits).astype(np.uint32)
            sets.clear()

        for batch in batches:
            for text in batch.column(0):
                sets.append(shingles(text.as_py(), n))
                held += len(sets[-1])
                if held > 1 << 20 or len(sets) > 1 << 16:
                    add_held()
                    held = 0
        if sets:
            add_held()
        compressor = zstandard.ZstdCompressor(level=1)
        for low in range(0, len(total), step * 32):
            found = {}
            for b in range(low // step, min(len(total), low + step * 32) // step):
                if most := int((own := total[b * step : (b + 1) * step]).max()):
                    found[b] = compressor.compress(own.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(block, total):
            held = np.minimum(total, np.iinfo(np.uint32).max).astype("<u4")
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([held.tobytes()], pa.binary()), pa.array([int(held.sum())], pa.int64())], names=["block", "counts", "total"])

        now, total = None, None
        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), map(decompressor.decompress, batch.column(1).to_pylist()), strict=True):
                if block != now:
                    if now is not None:
                        yield row(now, total)
                    now, total = block, np.zeros(step, np.int64)
                total += np.frombuffer(raw, f"<u{len(raw) // step}")
        if now is not None:
            yield row(now, total)

    parts = texts.select("text").mapInArrow(count, "block int, counts binary").repartition("block").sortWithinPartitions("block")
    summed = staged(parts.mapInArrow(add, "block int, counts binary, total long"), "counters")
    mean = (summed.agg(F.sum("total")).first()[0] or 0) / (1 << bits)
    # Beyond what chance puts into a counter, whatever the number of documents.
    common = int(mean + 6 * mean**0.5) + 4

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column(1).to_pylist():
                counts = np.frombuffer(raw, "<u4")
                found.append(np.where(counts > common, np.log2(np.maximum(counts, common) / common) + 1, 0).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["block", "classes"])

    classes = np.zeros(1 << bits, np.uint8)
    for block, raw in summed.select("block", "counts").mapInArrow(classify, "block int, classes binary").collect():
        classes[block * step : (block + 1) * step] = np.frombuffer(raw, np.uint8)
    drop(summed)
    return classes


def _signed(texts: DataFrame, n: int, num: int, den: int, bits: int) -> DataFrame:
    """For each row: set size, share of rare shingles in thousandths, hashes of set and prefix, sketch of a set that is not long, and the prefix."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(shingle_classes(texts, n, bits))  # 2 ** bits bytes, whatever the input

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                ids = batch.column(0).slice(low, 1000)
                rows, prefixes, sketches = [], [], []
                for text in batch.column(1).slice(low, 1000).to_pylist():
                    s = shingles(text, n)
                    size = len(s)
                    kinds = of[(s >> np.uint64(64 - bits)).astype(np.int64)]
                    prefix = s[np.argsort(kinds, kind="stable")][: size - -(-num * size // den) + 1] if size else s
                    rows.append((size, 1000 * int((kinds == 0).sum()) // max(1, size), *_hash128(s), *_hash128(prefix)))
                    prefixes.append(prefix.view(np.int64))
                    sketches.append(odd_sketch(s) if size <= _LONG * den // num else None)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(prefixes)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array(sketches, pa.binary()), lists], names=["doc_id", "n", "rare", "s1", "s2", "p1", "p2", "sketch", "prefix"])

    signed = staged(texts.mapInArrow(sign, "doc_id long, n long, rare long, s1 long, s2 long, p1 long, p2 long, sketch binary, prefix array<long>"), "signed")
    sent.unpersist()
    return signed


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of distinct ``pairs(a, b)`` of nodes those whose sets are similar enough.

    The texts of all ``a`` stream past the one set of their ``b``; a ``b`` with
    many partners is dealt to several groups.
    """
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m"))
    salted = pairs.join(many.hint("merge"), "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / 256)).alias("salt"))
    hubs = salted.select(F.lit(None).cast("long").alias("a"), "b", "salt").distinct()
    asked = salted.unionAll(hubs).withColumn("doc_id", F.coalesce("a", "b"))
    held = texts.join(nodes.select(F.col("rep").alias("doc_id"), "s1"), "doc_id")
    rows = asked.join(held.hint("merge"), "doc_id").select("b", "salt", "a", "s1", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                for b, salt, a, s1, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    s = shingles(text, n)
                    if _hash128(s)[0] != s1:
                        continue  # another text under the same id
                    if a is None:
                        hub, hub_set = (b, salt), s
                    elif hub == (b, salt):
                        both = len(np.intersect1d(s, hub_set, assume_unique=True))
                        if den * both >= num * (len(s) + len(hub_set) - both):
                            found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))], names=["a", "b"])

    dealt = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(check, "a long, b long")


def _likely(met: DataFrame, num: int, den: int) -> DataFrame:
    """Group pairs ``(x, nx, y, ny)``, one row for each common prefix shingle, that can still be similar.

    Of one of the two all common shingles in its prefix were counted, so the
    overlap is at most the count plus what lies behind the prefix.
    """
    counted = met.groupBy("x", "nx", "y", "ny").agg(F.count(F.lit(1)).alias("c"))
    behind = [F.ceil(F.lit(num) * F.col(k) / F.lit(den)) - 1 for k in ("nx", "ny")]
    return counted.where((F.col("c") + F.greatest(*behind)) * (num + den) >= num * (F.col("nx") + F.col("ny"))).select("x", "y")


def _early(n, num: int, den: int):
    """How many of a set's first shingles hold the first one that it shares with a similar set that is not smaller.

    The two share at least ``num * (n + m) / (num + den)`` shingles with ``m``
    at least ``n``, and the first of these cannot stand further back.
    """
    return n - -(-2 * num * n // (num + den)) + 1


def _met_in_blocks(still: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Group pairs ``(x, y)`` of unlike labels, at most one in the leader's, that can still be similar.

    A block's rows come with their prefixes, so pairs are counted in place and
    only likely ones leave the task, each from the block of the first shingle
    that its two prefixes share.  Prefixes travel as the lower 32 bits of their
    shingles: that can only raise a count, and a pair leaves from its first
    ``_FIRST`` blocks in case shingles are alike in these bits alone.  Of groups
    of one set each, sketches of the whole sets tell more than the prefixes.  A
    block of many groups is dealt to pairs of parts of bounded size.
    """
    sizes = still.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / _PART).alias("parts"), F.max(F.col("outside").cast("int")).alias("any")).where("any = 1").drop("any")
    rows = still.join(sizes.hint("merge"), "token").withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts")))
    rows = rows.join(prefixes.dropDuplicates(["gid"]).hint("merge"), "gid").withColumn("sketch", F.when(F.col("sole"), F.col("sketch")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    # A row asks all parts and is asked by all; in its own part, one copy serves both.
    columns = ["gid", "n", "label", "outside", "early", "sketch", "prefix"]
    left = rows.where("outside AND parts > 1").select("token", F.col("part").alias("a"), every.alias("b"), F.lit(True).alias("asks"), F.lit(False).alias("is_asked"), *columns).where("a <> b")
    right = rows.select("token", every.alias("a"), F.col("part").alias("b"), F.lit(True).alias("is_asked"), *columns).select("token", "a", "b", F.expr("outside AND a = b").alias("asks"), "is_asked", *columns)

    def pairs(key: tuple, block: list[tuple]) -> list[tuple[int, int]]:
        """``block`` has (asks, is_asked, gid, n, label, outside, early, sketch, prefix)."""
        asking, asked = [r[2:] for r in block if r[0]], [r[2:] for r in block if r[1]]
        if not asking or not asked:
            return []
        this = ((key[0] & 0xFFFFFFFF) ^ 0x80000000) - 0x80000000
        tokens, inverse = np.unique(np.concatenate([r[6] for r in asked]), return_inverse=True)
        owner = np.repeat(np.arange(len(asked)), [len(r[6]) for r in asked])
        asks = [np.searchsorted(tokens, r[6]) for r in asking]
        asks = [at[tokens[np.minimum(at, len(tokens) - 1)] == r[6]] for at, r in zip(asks, asking, strict=True)]
        table = None
        if (len(asking) + len(asked)) * len(tokens) <= _DENSE:
            has, wants = np.zeros((len(asked), len(tokens)), np.float32), np.zeros((len(asking), len(tokens)), np.float32)
            np.add.at(has, (owner, inverse), 1)
            np.add.at(wants, (np.repeat(np.arange(len(asking)), [len(at) for at in asks]), np.concatenate(asks)), 1)
            table = (wants @ has.T).astype(np.int64)
        owner = owner[np.argsort(inverse, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(tokens)))])
        gids = np.array([r[0] for r in asked])
        n = np.array([r[1] for r in asked])
        labels = np.array([-1 if r[2] is None else 1 for r in asked])
        label = np.array([r[2] or 0 for r in asked])
        outside = np.array([r[3] for r in asked])
        early = np.array([r[4] for r in asked])
        sketches = _Sketches([r[5] for r in asked])
        held: dict[int, set[int]] = {}
        found = []
        for row, (at, (x, nx, lx, _, early_x, sketch, prefix)) in enumerate(zip(asks, asking, strict=True)):
            common = table[row] if table is not None else np.bincount(np.concatenate([owner[ends[i] : ends[i + 1]] for i in at.tolist()]), minlength=len(asked)) if len(at) else np.zeros(len(asked), np.int64)
            behind = np.maximum(-(-num * nx // den), -(-num * n // den)) - 1
            fits = (common + behind) * (num + den) >= num * (nx + n)
            fits &= (den * np.minimum(nx, n) >= num * np.maximum(nx, n)) & (np.minimum(nx, n) <= _LONG) & (gids != x) & ((x > gids) | ~outside)
            # The shingle stands early in the smaller set.
            fits &= np.where(n < nx, early, early_x | ((n == nx) & early))
            if lx is not None:
                fits &= (labels < 0) | (label != lx)
            near = np.flatnonzero(fits)
            sizes = nx + n[near]
            near = near[(sizes - sketches.differ(sketch, near)) // 2 * (num + den) >= num * sizes]
            for k in near.tolist():
                if k not in held:
                    held[k] = set(asked[k][6].tolist())
                if nx <= n[k]:
                    both = (t for t in prefix[: _early(nx, num, den)].tolist() if t in held[k])
                else:
                    mine = set(prefix.tolist())
                    both = (t for t in asked[k][6][: _early(int(n[k]), num, den)].tolist() if t in mine)
                if this in islice(both, _FIRST):
                    found.append((x, int(gids[k])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))], names=["x", "y"])

        now, block = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            lists = batch.column("prefix")
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
            for k, (token, a, b, *rest) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)):
                if (token, a, b) != now:
                    if now is not None:
                        found += pairs(now, block)
                    now, block = (token, a, b), []
                block.append((*rest, flat[ends[k] : ends[k + 1]]))
            yield out(found)
        if now is not None:
            yield out(pairs(now, block))

    dealt = left.unionAll(right).repartition("token", "a", "b").sortWithinPartitions("token", "a", "b")
    return dealt.mapInArrow(run, "x long, y long")


def similar_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, bits: int = 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Documents link when ``den * intersection >= num * union`` of their shingle
    sets; ``component_id`` is the smallest id that links reach.  Null and empty
    texts have no shingles and no links.  Rows of one id are one document; of
    several texts under it, the set of the least hash is compared.  A null id
    stays null and has a null component.  ``bits`` sets the size of the sketch
    that orders the shingles; results do not depend on it.  Tables on the way
    are deleted after their last use; the result is one of ``staged``.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = _signed(texts, n, num, den, bits)
    keys = ["n", "s1", "s2", "p1", "p2"]
    sets = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n", "p1", "p2")).alias("k")).select("doc_id", "k.*")
    nodes = staged(sets.groupBy(*keys).agg(F.min("doc_id").alias("rep")), "nodes")
    groups = nodes.groupBy("n", "p1", "p2").agg(F.min("rep").alias("gid"))
    members = staged(nodes.join(groups.hint("merge"), ["n", "p1", "p2"]).select("rep", "gid", "n", "s1"), "members")
    index = members.where("rep = gid").select(F.col("gid").alias("doc_id"), "s1", "n")
    postings = signed.select("doc_id", "s1", "n", "rare", "prefix").join(index.hint("merge"), ["doc_id", "s1", "n"]).select(F.col("doc_id").alias("gid"), "n", "rare", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.withColumn("early", F.expr(f"pos <= n - ceil(2L * {num} * n / {num + den})")).drop("pos")
    # The least share of rare shingles leads: edits add rare ones, so an original has fewer than its copies.
    leaders = postings.groupBy("token").agg(F.min(F.struct("rare", "gid", "n")).alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", F.col("lead.gid").alias("y"), F.col("lead.n").alias("ny"))
    blocks = staged(postings.drop("rare").join(leaders.hint("merge"), "token"), "blocks")

    near_size = F.expr(f"{den} * least(nx, ny) >= {num} * greatest(nx, ny)")
    star = _likely(blocks.where("gid <> y").select(F.col("gid").alias("x"), F.col("n").alias("nx"), "y", "ny").where(near_size), num, den)
    inside = members.where("rep <> gid").select(F.col("rep").alias("a"), F.col("gid").alias("b"))
    first = staged(star.select(F.col("x").alias("a"), F.col("y").alias("b")).unionAll(inside), "pairs")
    links = staged(_verified(first, nodes, texts, n, num, den), "links")
    drop(first)
    found = components(links)
    drop(links)

    # Groups whose members lie in one component have its label, others none.
    labelled = staged(members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component"), "labelled")
    drop(members)
    labels = labelled.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("nodes"))
    labels = labels.select("gid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("label"), (F.col("nodes") == 1).alias("sole"))
    rows = blocks.select("token", "gid", "n", "early").join(labels.hint("merge"), "gid")
    mixed = rows.groupBy("token").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.col("label").isNull()).alias("open"),
        F.min_by("label", "gid").alias("lead"), F.min(F.when(F.col("early"), F.col("n"))).alias("least"),
    ).where("open OR lo <> hi").select("token", "lead", "least")
    # A pair leaves from the first shingle it shares, which stands early in the smaller set: others wait for a smaller one there.
    open_blocks = rows.join(mixed.hint("merge"), "token").where(f"n > {_LONG} OR early OR n > least").drop("least")
    open_blocks = staged(open_blocks, "mixed")
    drop(blocks)
    # Of two groups in different components, at least one is not in the block leader's.
    still = open_blocks.withColumn("outside", F.expr("label IS NULL OR lead IS NULL OR label <> lead"))
    long = still.where(F.col("n") > _LONG)
    others = long.where("outside").select("token", F.col("gid").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"))
    met = others.join(long.select("token", F.col("gid").alias("y"), F.col("n").alias("ny"), F.col("label").alias("ly"), F.col("outside").alias("oy")).hint("merge"), "token")
    # Pairs of two such groups meet twice in a block; the one with x > y stays.
    met = met.where(near_size).where("x <> y AND (lx IS NULL OR ly IS NULL OR lx <> ly) AND (x > y OR NOT oy)")
    # Which of the two is outside depends on the block: the counts of all blocks go to one order of the pair.
    met = met.selectExpr("greatest(x, y) AS x", "if(x > y, nx, ny) AS nx", "least(x, y) AS y", "if(x > y, ny, nx) AS ny")
    # Joined by the id alone, so that what follows by id needs no further exchange of prefixes.
    same = F.expr("(s1 ^ k1) = 0 AND (n ^ kn) = 0")
    named = labelled.where("rep = gid").select(F.col("gid").alias("doc_id"), F.col("s1").alias("k1"), F.col("n").alias("kn"))
    low = F.transform("prefix", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")).alias("prefix")
    prefixes = signed.where(F.col("n") <= _LONG * den // num).select("doc_id", "s1", "n", "sketch", low).join(named.hint("merge"), "doc_id").where(same).select(F.col("doc_id").alias("gid"), "sketch", "prefix")
    pairs = _likely(met, num, den).unionAll(_met_in_blocks(still.where(F.col("n") <= _LONG * den // num), prefixes, num, den))
    pairs = pairs.unionAll(labels.where("label IS NULL").select(F.col("gid").alias("x"), F.col("gid").alias("y")))
    own = labelled.select(F.col("gid").alias("x"), F.col("rep").alias("a"), F.col("label").alias("la"))
    theirs = labelled.select(F.col("gid").alias("y"), F.col("rep").alias("b"), F.col("label").alias("lb"))
    rest = pairs.join(own, "x").join(theirs, "y").where("la <> lb").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = staged(rest, "rest")
    drop(open_blocks, labelled)
    if not rest.isEmpty():
        # Each node's edge to its component stands for the links found so far.
        before, found = found, components(found.toDF("a", "b").unionAll(_verified(rest, nodes, texts, n, num, den)))
        drop(before)
    drop(rest)

    classes = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("c"))
    by_doc = sets.select("doc_id", "s1", "s2", "n").join(classes.hint("merge"), ["s1", "s2", "n"]).select("doc_id", "c")
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(by_doc.hint("merge"), "doc_id", "left")
    result = staged(out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id")), "components")
    drop(signed, nodes, found)
    return result
