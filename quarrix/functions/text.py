"""Scalar functions on text as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..chunking.languages import BY_EXTENSION

# The letters that make n-grams, the punctuation folded into their runs, and the hash's constants.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
FOLDED = r"\x{3000}-\x{303F}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF5E}"
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
FNV_BASIS, FNV_PRIME, MASK32 = 0x811C9DC5, 16777619, 0xFFFFFFFF
SPACE = r"[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SNIPPET_CHARS, HEADER_CHARS = 500, 200


def contains_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def tokenize(text: Column, ngram: int = 2) -> Column:
    """Tokens in order, with repetitions: identifier parts in lower case, n-grams of CJK runs.

    Everything but CJK letters and ``[A-Za-z0-9]`` is a boundary; a null text has no tokens.
    """
    text = F.coalesce(text, F.lit(""))
    # Only texts with such letters pay for their n-grams; the others are cut once as a whole.  ASCII texts are not searched for them.
    mixed = (F.octet_length(text) != F.char_length(text)) & contains_cjk(text)
    return F.when(mixed, _mixed_tokens(text, ngram)).otherwise(_identifier_parts(text))


def _cased(text: Column) -> Column:
    """The text in lower case, its identifiers cut by blanks."""
    # The two letters that are not ASCII but have ASCII in their lower-case form.
    foreign = text.contains("\u0130") | text.contains("\u212a")
    text = F.when(foreign, F.regexp_replace(text, "[\u0130\u212a]", " ")).otherwise(text)
    # Looks around capital letters alone.
    return F.lower(F.when(text.rlike("[A-Z](?:(?<=[a-z0-9][A-Z])|[A-Z][a-z])"), F.regexp_replace(text, CAMEL, " ")).otherwise(text))


def _identifier_parts(text: Column) -> Column:
    """Lower-case parts of identifiers in a text without CJK letters."""
    # Empty parts go in the array: a condition on the lowered text would make it twice.
    return F.array_remove(F.split(_cased(text), "[^a-z0-9]+"), "")


def _mixed_tokens(text: Column, ngram: int) -> Column:
    """As ``_identifier_parts``, and of each CJK run its n-grams, or the run itself where it has none."""
    n = max(1, int(ngram))
    # Punctuation between two letters of a run is no part of it; anywhere else it is a boundary like others.
    joined = F.regexp_replace(_cased(text), f"(?<=[{CJK}])[{FOLDED}]+(?=[{CJK}])", "")
    short = f"|(?<![{CJK}])[{CJK}]{{1,{n - 1}}}(?![{CJK}])" if n > 1 else ""
    # Looks ahead for the gram that begins at a letter and passes that letter alone.
    return F.regexp_extract_all(joined, F.lit(f"(?=([{CJK}]{{{n}}}{short}|[a-z0-9]+))(?:[{CJK}]|[a-z0-9]+)"), F.lit(1))


def token_types(text: Column, ngram: int = 2) -> Column:
    return F.array_distinct(tokenize(text, ngram))


def fnv1a(text: Column, seed: int = 0) -> Column:
    """32-bit FNV-1a over the text's UTF-16 units of the basic plane, as a long."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32))
    return F.aggregate(F.split(text, ""), F.lit((FNV_BASIS ^ seed) & MASK32).cast("long"), lambda h, c: F.when(c == "", h).otherwise(step(h, c)))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(text: Column, limit: int = HEADER_CHARS) -> Column:
    flat = trim_space(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.when(F.char_length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def language_for_path(path: Column) -> Column:
    """Null without a known extension: the text after the last dot of the whole path, in lower case."""
    pairs = F.create_map(*[F.lit(x) for e, lang in BY_EXTENSION.items() for x in (e, lang.name)])
    return F.when(F.instr(path, ".") > 0, pairs[F.lower(F.substring_index(path, ".", -1))])


def summary(content: Column, symbol: Column, comments: tuple[str, ...] = ()) -> Column:
    """The symbol, else the first line that is neither blank nor a comment, else the empty string."""
    lines = F.transform(F.split(content, "\n"), lambda x: collapse_space(x))
    code = F.filter(lines, lambda x: (x != "") & ~reduce(lambda a, c: a | x.startswith(c), comments, F.lit(False)))
    return F.coalesce(F.nullif(symbol, F.lit("")), F.try_element_at(code, F.lit(1)), F.lit(""))


def snippet(content: Column, limit: int = SNIPPET_CHARS) -> Column:
    """Trimmed non-blank lines while they fit; a first line that is too long is cut and marked."""
    lines = F.filter(F.transform(F.split(content, "\n"), trim_space), lambda x: x != "")
    empty = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def add(acc: Column, line: Column) -> Column:
        longer = F.when(acc["out"] == "", line).otherwise(F.concat(acc["out"], F.lit("\n"), line))
        stop = acc["full"] | ((acc["out"] != "") & (F.char_length(longer) > limit))
        return F.struct(F.when(stop, acc["out"]).otherwise(longer).alias("out"), stop.alias("full"))

    out = F.aggregate(lines, empty, add)["out"]
    return F.when(F.char_length(out) > limit, F.concat(F.regexp_replace(F.substring(out, 1, limit), f"{SPACE}+$", ""), F.lit("…"))).otherwise(out)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob; ``?`` stays the quantifier it is there."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("\\" + pattern[i] if pattern[i] in ".+^${}()|[]\\" else pattern[i]), i + 1
    return f"^{out}$"


def is_included(path: Column, globs: tuple[str, ...]) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return reduce(lambda a, g: a | name.rlike(glob_regex(g)), globs, F.lit(False))


def is_ignored(path: Column, rules: tuple[str, ...]) -> Column:
    """A rule without ``*`` names a segment anywhere; one with ``*`` is a glob on the whole path or an ancestor's."""
    rules = tuple(r for r in rules if r)
    names = [r for r in rules if "*" not in r]
    segments = F.split(path, "/")
    hit = F.arrays_overlap(segments, F.array(*[F.lit(n) for n in names])) if names else F.lit(False)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))
    globs = "|".join(glob_regex(r) for r in rules if "*" in r)
    return hit | F.exists(prefixes, lambda p: p.rlike(globs)) if globs else hit
