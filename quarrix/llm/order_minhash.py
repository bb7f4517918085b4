"""Order MinHash fingerprints; DataFrame operations only.

Every ``k`` consecutive code points of a text are a k-mer, blanks included; a
shorter text that is not empty is one itself.  Occurrences of a k-mer are
numbered in the order of the text, and the pair of k-mer and number is hashed;
the k-mer's own hash tells in which of the equal ranges of the hash space all
its occurrences lie.  In each range the two pairs of least hash are selected,
put into the order of the text, and hashed as a tuple.  Two texts are alike in
the share of the ranges in which their tuples agree, which needs the same
k-mers in the same order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PLACE_BITS = 25  # the rest of a long is hash; what stands behind the 33 millionth k-mer counts as standing there
_PLACE = (1 << _PLACE_BITS) - 1
_HASH_BITS = 63 - _PLACE_BITS


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not in each step of an inner lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hash(v: Column) -> Column:
    return F.shiftright(v, _PLACE_BITS)


def _sorted(text: Column, k: int) -> Column:
    """Hashes of the k-mers with their places, ascending: occurrences of one k-mer stand in their order."""
    # Looks ahead from each code point and passes that one alone.
    kmers = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{k}}}|\A.{{1,{k}}}\z))."), F.lit(1))

    def packed(kmer: Column, place: Column) -> Column:
        return F.shiftleft(F.xxhash64(kmer).bitwiseAND(F.lit((1 << _HASH_BITS) - 1)), _PLACE_BITS).bitwiseOR(place.cast("long"))

    def of_ascii(raw: Column) -> Column:
        # A code point is a byte: no k-mer becomes a string.
        return F.transform(F.sequence(F.lit(0), F.length(raw) - k), lambda i: packed(F.substring(raw, i + 1, F.lit(k)), i))

    n = F.char_length(text)
    plain = (n == F.octet_length(text)) & (n >= k) & (n <= _PLACE)
    hashed = F.when(plain, _once(text.cast("binary"), of_ascii)).when(n <= _PLACE, F.transform(kmers, packed))
    return F.sort_array(hashed.otherwise(F.transform(kmers, lambda x, i: packed(x, F.least(i, F.lit(_PLACE))))))


def _steps(text: Column, k: int, range_bits: int) -> list[tuple[str, Callable[[Callable[[str], Column]], Column]]]:
    """Names and columns, each made of those before it; the last one is the signature."""
    low, enough = 63 - range_bits, 20 << range_bits
    mask, place = (1 << low) - 1 - _PLACE, F.lit(_PLACE)

    def number(v: Column) -> Column:
        return F.shiftright(v, low)

    def before(s: Column) -> Column:
        # What stands before each hash; before the first one, something unlike it.
        return F.concat(F.transform(F.slice(s, 1, 1), lambda v: v.bitwiseXOR(F.lit(1 << 62))), s)

    def repeat(s: Column, v: Column, i: Column) -> Column:
        return F.get(s, i).bitwiseXOR(v) <= place

    def is_low(c, v: Column) -> Column:
        return v.bitwiseAND(F.lit((1 << low) - 1)) < c("limit")

    def least(s: Column) -> Column:
        return F.filter(s, lambda v, i: (i < 2) | (F.get(s, i - 2).bitwiseXOR(v) >= F.lit(1 << low)))

    def limit(c) -> Column:
        n = F.size(c("hashes"))
        return F.when(n <= enough, F.lit(1 << low)).otherwise(F.floor(F.lit(1 << low) / n) * enough)

    def kept(c) -> Column:
        return F.when(F.size(c("hashes")) <= enough, c("hashes")).otherwise(F.filter(c("hashes"), lambda v, i: is_low(c, v) | repeat(c("before"), v, i)))

    def few(c) -> Column:
        return F.when(F.size(c("later")) == 0, c("kept")).otherwise(F.filter(c("kept"), lambda v, i: is_low(c, v) & ~repeat(c("kept_before"), v, i)))

    def firsts(c) -> Column:
        whole = (F.size(c("hashes")) <= enough) | (F.size(c("least")) == 2 << range_bits)
        return F.when(whole, c("least")).otherwise(F.filter(c("hashes"), lambda v, i: ~repeat(c("before"), v, i)))

    def begins(c) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(c("later")) - 1), lambda i: (i == 0) | (F.get(c("later"), i - 1).bitwiseXOR(F.get(c("later"), i)) > place))
        return F.when(F.size(c("later")) > 0, at).otherwise(F.array().cast("array<int>"))

    def pairs(c) -> Column:
        # The k-mer's range, a hash of k-mer and number, the place; by what came before, the second occurrence has the number 1.
        def key(v: Column, i: Column) -> Column:
            return v.bitwiseAND(F.lit((1 << 63) - 1 - mask)).bitwiseOR(F.shiftleft(F.xxhash64(_hash(v), (i + 1).cast("long")), _PLACE_BITS).bitwiseAND(F.lit(mask)))

        later, at = c("later"), c("begins")
        keys = F.flatten(F.transform(at, lambda i, j: F.transform(F.slice(later, i + 1, F.coalesce(F.get(at, j + 1), F.size(later)) - i), key)))
        return F.sort_array(F.concat(c("found"), keys))

    def tuples(c) -> Column:
        s = c("best")

        def one(v: Column, i: Column) -> Column:
            w = F.get(s, i + 1)
            a, b = _hash(v), _hash(w)
            pair = F.when(v.bitwiseAND(place) <= w.bitwiseAND(place), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
            hashed = F.when(w.isNull() | (number(w) != number(v)), F.xxhash64(a)).otherwise(pair)
            first = (i == 0) | (number(F.get(s, i - 1)) != number(v))
            return F.when(first, F.shiftleft(number(v), 32).bitwiseOR(hashed.bitwiseAND(F.lit(0xFFFFFFFF))))

        return F.filter(F.transform(s, one), lambda x: x.isNotNull())

    return [
        ("hashes", lambda c: _sorted(text, k)),
        # Of a long text only first occurrences whose hashes are low in their range are looked at; where that leaves a range under two, all are.
        # A first occurrence has the hash of its k-mer, so the repeats of a low one stand beside it in what is kept.
        ("before", lambda c: before(c("hashes"))),
        ("limit", limit),
        ("kept", kept),
        ("kept_before", lambda c: before(c("kept"))),
        ("later", lambda c: F.filter(c("kept"), lambda v, i: ~is_low(c, v) | repeat(c("kept_before"), v, i))),
        ("few", few),
        ("least", lambda c: least(c("few"))),
        ("firsts", firsts),
        ("found", lambda c: least(c("firsts"))),
        ("begins", begins),
        ("pairs", pairs),
        ("best", lambda c: least(c("pairs"))),
        ("tuples", tuples),
    ]


def signatures(text: Column, k: int = 12, range_bits: int = 5) -> Column:
    """``array<long>``: for each range that holds a k-mer its number (upper 32 bits) and the tuple's hash (lower 32 bits)."""
    (first, _), *steps = _steps(text, k, range_bits)
    state, names = F.struct(_sorted(text, k).alias(first)), [first]

    def add(name: str, step) -> Column:
        return _once(state, lambda s: F.struct(*[s[n].alias(n) for n in names], step(lambda n: s[n]).alias(name)))

    for name, step in steps:
        # A step is an argument of the next one, not a part of its lambda: the plan stays flat.
        state, names = add(name, step), [*names, name]
    return state["tuples"]


def with_signatures(rows: DataFrame, text_col: str, name: str, k: int = 12, range_bits: int = 5) -> DataFrame:
    """The rows and a column ``name`` as from ``signatures``; each step is a column, so that hashes are sorted as numbers, not as objects of a lambda."""
    steps = _steps(F.col(text_col), k, range_bits)
    for own, step in steps:
        rows = rows.withColumn(f"__{own}", step(lambda n: F.col(f"__{n}")))
    return rows.withColumnRenamed("__tuples", name).drop(*(f"__{own}" for own, _ in steps))


def likeness(a: Column, b: Column) -> Column:
    """Agreeing tuples by ranges that either text has a tuple in; 1 for two texts without any."""
    ranges = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(ranges == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / ranges).cast("double")


def to_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.hex(x))), "-")


def with_next(docs: DataFrame, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", extra: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``doc_id, text, next_text`` and the columns that ``extra`` adds, for both texts (``next_`` before the name).

    The next text is the one that follows in descending order of id; the first
    follows the last.  Ids are cut into buckets at quantiles; each bucket is
    sorted alone, and its last row takes the first row of the next bucket that
    has any.  Ties go by text, null ids come last, null texts count as empty.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = texts.select("doc_id").stat.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    marks = sorted({int(m) for m in marks})
    bounds = F.array(*[F.lit(m).cast("long") for m in marks]) if marks else F.array().cast("array<long>")
    # Number of bounds at or above the id: 0 holds the greatest ids; null ids follow all.
    bucket = F.coalesce(F.size(F.filter(bounds, lambda m: F.col("doc_id") <= m)), F.lit(0))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(marks) + 1)).otherwise(bucket).alias("bucket")
    bare = texts.select("doc_id", "text", bucket)
    extra = extra or (lambda rows: rows)
    placed = extra(bare)
    names = ["text", *placed.columns[3:]]
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text"))
    inside = placed.select("*", F.lead(F.struct(*names)).over(w).alias("lead"))
    # A row for each bucket from here on: as many as there are bounds and two.
    firsts = bare.groupBy("bucket").agg(F.max("doc_id").alias("first_id"))
    ahead = firsts.select("bucket", "first_id", F.row_number().over(Window.orderBy("bucket")).alias("at"), F.count(F.lit(1)).over(Window.partitionBy()).alias("of"))
    heads = ahead.select(F.col("bucket").alias("head"), "first_id", F.when(F.col("at") == 1, F.col("of")).otherwise(F.col("at") - 1).alias("at"))
    wanted = F.broadcast(heads.join(ahead.select(F.col("bucket").alias("for_bucket"), "at"), "at").drop("at"))
    begins = bare.join(wanted, (F.col("bucket") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    # The extra columns of these few rows are computed after they are found.
    begins = extra(begins.groupBy("for_bucket").agg(F.min("text").alias("text"))).select("for_bucket", F.struct(*names).alias("begin"))
    # The least row of each bucket has no lead and takes the beginning of the next bucket.
    joined = inside.join(begins, (F.col("bucket") == F.col("for_bucket")) & F.col("lead").isNull(), "left")
    chosen = joined.select("doc_id", *names, F.coalesce("lead", "begin").alias("next"))
    return chosen.select("doc_id", *names, *[F.col(f"next.{name}").alias(f"next_{name}") for name in names])


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points gives way to as many first ones of the following text."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame, k: int = 12, range_bits: int = 5, **how) -> DataFrame:
    """One row for each document; see ``with_next`` for the order and for nulls, ``likeness`` for empty texts."""
    pairs = with_next(docs, extra=lambda rows: with_signatures(rows, "text", "own", k, range_bits), **how)
    edits = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "own", "next_own", edited(F.col("text"), F.col("next_text")).alias("edit"))
    signed = with_signatures(edits, "edit", "edit_sig", k, range_bits)
    return signed.select(
        "doc_id", "n_chars", F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), to_string(F.col("own")).alias("fingerprint"), to_string(F.col("edit_sig")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit_sig")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
