import pytest
from pyspark.sql import functions as F

from quarrix.chunking.languages import language_of
from quarrix.functions import text as T
from quarrix.functions.vectors import dot, normalized

TOKENS = [
    ("getTotalAmount", 2, ["get", "total", "amount"]),
    ("XMLHttpRequest", 2, ["xml", "http", "request"]),
    ("parseURL", 2, ["parse", "url"]),
    ("max_retry_count file-name", 2, ["max", "retry", "count", "file", "name"]),
    ("Foo.Bar(); ->", 2, ["foo", "bar"]),
    ("timeout500ms", 2, ["timeout500ms"]),
    ("语义搜索", 2, ["语义", "义搜", "搜索"]),
    ("语义，搜索", 2, ["语义", "义搜", "搜索"]),
    ("配置", 2, ["配置"]),
    ("语义", 1, ["语", "义"]),
    ("语义搜索", 3, ["语义搜", "义搜索"]),
    ("连接database", 2, ["连接", "database"]),
    ("。。", 2, []),
    ("café naïve", 2, ["caf", "na", "ve"]),
    ("", 2, []),
    (" \n\t ", 2, []),
    (None, 2, []),
    ("foo foo", 2, ["foo", "foo"]),
]


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(("text", "n", "want"), TOKENS)
def test_tokens(spark, text, n, want):
    assert one(spark, T.tokenize(F.col("t"), n), t=text) == want


def fnv(text, seed):
    h = (0x811C9DC5 ^ seed) & 0xFFFFFFFF
    for c in text:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


@pytest.mark.parametrize("text", ["", "a", "hello", "语义", "é1"])
def test_fnv(spark, text):
    for seed in (0, 0x9E3779B1, 0x85EBCA6B):
        assert one(spark, T.fnv1a(F.col("t"), seed), t=text) == fnv(text, seed)


def test_language(spark):
    for path, want in (("a/b.ts", "typescript"), ("x.h", "cpp"), ("x.C", "c"), ("Makefile", None), ("a.tar.GO", "go"), ("a.b/c", None)):
        assert one(spark, T.language_for_path(F.col("p")), p=path) == want
        assert (lambda x: x and x.name)(language_of(path)) == want


def test_snippet_and_summary(spark):
    snip = lambda t: one(spark, T.snippet(F.col("t")), t=t)
    assert snip("  a \n\n b\n") == "a\nb"
    assert snip("x" * 600) == "x" * 500 + "…"
    assert snip("a" * 400 + "\n" + "b" * 200 + "\nc") == "a" * 400
    assert one(spark, T.summary(F.col("t"), F.lit(""), ("//",)), t="\n// no\n  int  x;\n") == "int x;"
    assert one(spark, T.summary(F.col("t"), F.lit("f()")), t="y") == "f()"
    assert one(spark, T.collapse_space(F.col("t")), t="a" * 300) == "a" * 199 + "…"


def test_filters(spark):
    paths = ["a.log", "x/a.log", "node_modules/b.ts", "src/node_modules/c.ts", "src/d.ts", "gen/x/e.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    kept = [r.p for r in df.where(~T.is_ignored(F.col("p"), ("node_modules", "*.log", "gen*", ""))).collect()]
    assert kept == ["x/a.log", "src/d.ts"]
    assert [r.p for r in df.where(T.is_included(F.col("p"), ("**/*.ts",))).collect()] == paths[2:]


def test_vectors(spark):
    assert one(spark, dot(F.col("a"), F.col("b")), a=[1.0, 2.0, 9.0], b=[3.0, 4.0]) == 11.0
    assert one(spark, normalized(F.col("a")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, normalized(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
