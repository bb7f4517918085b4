"""Texts with CJK letters are cut by expressions, not by a lambda for each run."""

from pyspark.sql import functions as F

from quarrix.functions import text as T


def test_runs_of_all_kinds_without_lambdas(spark):
    cases = [
        ("a。b", 2, ["a", "b"]),
        ("。语、！义。getHTTPUrl2x", 2, ["语义", "get", "http", "url2x"]),
        ("语 \u0130索引擎\u212ax", 3, ["语", "索引擎", "x"]),
        ("语义 한 x_y", 3, ["语义", "한", "x", "y"]),
    ]
    for text, n, want in cases:
        df = spark.createDataFrame([(text,)], "t string").select(T.tokenize(F.col("t"), n).alias("x"))
        assert df.first().x == want
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
