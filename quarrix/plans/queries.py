"""One query for each retrieval operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chunking.chunker import chunk_files
from ..config import RANGES
from ..functions import counting
from ..functions import text as T
from ..functions.vectors import fitted, normalized
from ..operators import batch, blockmax, deltas, maintenance, ranking, scratch, stats
from ..streaming.watch import debounced, relevant

# The documents are of invented words: a query must use words of theirs.
QUERY = "estion ntble queque outre"
DIM, TOP, CHANNEL, RRF = 256, 20, 300, 60
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RUNS = "regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9]+')"
PARTS = r"regexp_replace(regexp_replace(run, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
TOK = f"tok AS (SELECT unit_id, pos, lower(unnest(string_split({PARTS}, ' '))) AS term FROM (SELECT doc_id AS unit_id, unnest({RUNS.format(c='text')}) AS run, unnest(range(len({RUNS.format(c='text')}))) AS pos FROM documents))"
TF = f"{TOK}, tf AS (SELECT unit_id, term, count(*)::BIGINT AS tf FROM tok WHERE term <> '' GROUP BY unit_id, term)"
IDF = f"{TF}, n AS (SELECT count(*) AS n FROM documents), idf AS (SELECT term, count(*)::BIGINT AS df, ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term)"
DL = f"{IDF}, dl AS (SELECT unit_id, sum(tf)::BIGINT AS dl FROM tf GROUP BY unit_id), avgl AS (SELECT sum(tf) / (SELECT n FROM n) AS a FROM tf)"
Q = "q AS (SELECT unnest(['estion', 'ntble', 'queque', 'outre']) AS term)"
BM25 = f"{DL}, {Q}, lex AS (SELECT unit_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT a FROM avgl)))), 9) AS score FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN dl USING (unit_id) WHERE dl > 0 GROUP BY unit_id ORDER BY score DESC, unit_id LIMIT {CHANNEL})"
FNV = "list_reduce(list_transform(string_split({t}, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, {b}::BIGINT)"
BUCKET, SIGN = (FNV.format(t="term", b=T.FNV_BASIS ^ s) for s in (ranking.BUCKET_SEED, ranking.SIGN_SEED))
VEC = f"{BM25}, w AS (SELECT unit_id, ({BUCKET} % {DIM})::INT AS bucket, CASE WHEN {SIGN} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END * (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)), raw AS (SELECT unit_id, bucket, sum(w)::FLOAT AS w FROM w GROUP BY unit_id, bucket), norm AS (SELECT unit_id, sqrt(sum(w::DOUBLE * w::DOUBLE)) AS norm FROM raw GROUP BY unit_id), vec AS (SELECT unit_id, bucket, CASE WHEN norm = 0 THEN w ELSE (w::DOUBLE / norm)::FLOAT END AS w FROM raw JOIN norm USING (unit_id))"
QVEC = f"{VEC}, qw AS (SELECT ({BUCKET} % {DIM})::INT AS bucket, CASE WHEN {SIGN} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END * coalesce(idf, ln(2.0)) AS w FROM q LEFT JOIN idf USING (term)), qr AS (SELECT bucket, sum(w)::FLOAT AS w FROM qw GROUP BY bucket), qv AS (SELECT bucket, (w::DOUBLE / (SELECT sqrt(sum(w::DOUBLE * w::DOUBLE)) FROM qr))::FLOAT AS w FROM qr), cos AS (SELECT doc_id AS unit_id, round(coalesce(s, 0.0), 9) AS score FROM documents LEFT JOIN (SELECT unit_id, sum(vec.w::DOUBLE * qv.w::DOUBLE) AS s FROM vec JOIN qv USING (bucket) GROUP BY unit_id) x ON doc_id = unit_id ORDER BY score DESC, unit_id LIMIT {CHANNEL})"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` of the documents, dealt out before texts are cut."""
    return stats.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "text")


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.term_frequencies(_units(spark, sf_dir))


@query(f"WITH {TOK} SELECT doc_id, (count(term) FILTER (term <> ''))::BIGINT AS n_tokens FROM documents LEFT JOIN tok ON doc_id = unit_id GROUP BY doc_id")
def token_counts(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", counting.lengths(F.col("text")).alias("n_tokens"))


@query(f"WITH {TF} SELECT * FROM tf")
def tf_by_doc(spark, sf_dir):
    return _tf(spark, sf_dir)


@query(f"WITH {TOK} SELECT doc_id, (count(DISTINCT term) FILTER (term <> ''))::BIGINT AS n_types FROM documents LEFT JOIN tok ON doc_id = unit_id GROUP BY doc_id")
def token_types(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", counting.lengths(F.col("text"), distinct=True).alias("n_types"))


# No document of the tables has such letters: vowels become some, in all texts or in those of one language.
VOWELS, SIGNS = "aeiouAEIOU", "語义搜索引擎ひカ한。"
MIXED = f"""m AS (SELECT doc_id, translate(text, '{VOWELS}', '{SIGNS}') AS text FROM documents),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[{SIGNS}]+|[A-Za-z0-9]+')) AS raw FROM m),
k AS (SELECT doc_id, replace(raw, '。', '') AS run, raw ~ '[A-Za-z0-9]' AS plain FROM r),
tok AS (SELECT doc_id, unnest(CASE WHEN plain THEN list_transform(string_split({PARTS}, ' '), lambda x: lower(x)) WHEN length(run) <= 2 THEN [run] ELSE list_transform(range(1, length(run)), lambda i: run[i:i + 1]) END) AS term FROM k WHERE run <> '')"""


@query(f"SELECT doc_id, regexp_matches(CASE WHEN lang = 'fr' THEN translate(text, '{VOWELS}', '{SIGNS}') ELSE text END, '[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]') AS cjk FROM documents")
def contains_cjk(spark, sf_dir):
    text = F.when(F.col("lang") == "fr", F.translate("text", VOWELS, SIGNS)).otherwise(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", T.contains_cjk(text).alias("cjk"))


@query(f"WITH {MIXED} SELECT doc_id, term, count(*)::BIGINT AS tf FROM tok GROUP BY doc_id, term")
def cjk_frequencies(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.translate("text", VOWELS, SIGNS).alias("text"))
    return stats.term_frequencies(docs, id_col="doc_id").withColumnRenamed("unit_id", "doc_id")


@query(f"WITH {TF} SELECT term, {BUCKET} AS h1, {SIGN} AS h2 FROM (SELECT DISTINCT term FROM tf)")
def fnv_hash(spark, sf_dir):
    return stats.document_frequencies(_units(spark, sf_dir)).select("term", T.fnv1a(F.col("term"), ranking.BUCKET_SEED).alias("h1"), T.fnv1a(F.col("term"), ranking.SIGN_SEED).alias("h2"))


@query(f"WITH {DL} SELECT * FROM dl")
def doc_lengths(spark, sf_dir):
    return stats.token_lengths(_units(spark, sf_dir))


@query(f"WITH {IDF} SELECT term, df, round(idf, 9) AS idf FROM idf")
def df_idf(spark, sf_dir):
    units = _units(spark, sf_dir)
    return stats.idf_of_units(units, units.count()).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {DL} SELECT (SELECT n FROM n)::BIGINT AS n_docs, (SELECT sum(tf) FROM tf)::BIGINT AS total_len, round((SELECT a FROM avgl), 9) AS avg_len")
def corpus_row(spark, sf_dir):
    units = _units(spark, sf_dir)
    return stats.corpus_row_of_lengths(units, stats.token_lengths(units)).select("n_docs", "total_len", F.round("avg_len", 9).alias("avg_len"))


@query(f"WITH {TF} SELECT count(DISTINCT term)::BIGINT AS terms FROM tf")
def vocabulary_size(spark, sf_dir):
    return stats.document_frequencies(_units(spark, sf_dir)).agg(F.count(F.lit(1)).alias("terms"))


@query(f"WITH {IDF}, t AS (SELECT DISTINCT lower(p_brand) AS term FROM part UNION VALUES ('estion'), ('ntble'), ('the')) SELECT term, round(coalesce(idf, ln(1.0 + (SELECT n FROM n))), 9) AS idf FROM t LEFT JOIN idf USING (term)")
def idf_or_max(spark, sf_dir):
    units = _units(spark, sf_dir)
    # Brands are no words of the documents; the other three are.
    terms = _table(spark, sf_dir, "part").select(F.lower("p_brand").alias("term")).distinct().unionAll(spark.createDataFrame([("estion",), ("ntble",), ("the",)], "term string"))
    n = units.count()
    return stats.idf_or_max(terms, stats.idf_of_units(units, n), n).select("term", F.round("idf", 9).alias("idf"))


def _lexical(spark, units, n, limit):
    terms = spark.createDataFrame([(QUERY,)], "q string").select(F.explode(T.token_types(F.col("q"))).alias("term"))
    # Only the query's words are counted: a handful of strings.
    words = [r.term for r in terms.collect()]
    held = stats.postings(units, only=words)
    row = held.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.array(*[F.count_if(F.array_contains("terms.term", w)) for w in words]).alias("df")).first()
    asked = spark.createDataFrame([(w, df) for w, df in zip(words, row.df, strict=True) if df], "term string, df long")
    posts = held.select("unit_id", "dl", F.explode("terms").alias("t")).select("unit_id", "dl", "t.term", "t.tf")
    return ranking.top(ranking.bm25_of_postings(posts, deltas.idf_of(asked, n), row.total / max(1, n), terms), limit)


# Terms whose weights are sent to every executor; more of them meet the postings in a shuffle.
FEW_TERMS = 500_000


def _weighted(spark, units, n):
    """``term, df, idf`` of the corpus, computed once, and whether they are few."""
    idf = stats.idf_of_units(units, n).localCheckpoint()
    return idf, idf.count() <= FEW_TERMS


def _vector(spark, units, n, limit):
    asked = stats.term_frequencies(spark.createDataFrame([(0, QUERY)], "unit_id long, text string"))
    idf, few = _weighted(spark, units, n)
    q = ranking.hashed_vectors(asked, idf, DIM).select("bucket", "w")
    return ranking.top(ranking.cosine_sparse(units, ranking.hashed_vectors(stats.term_frequencies(units), idf, DIM, few), q), limit)


@query(f"WITH {BM25} SELECT unit_id, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, unit_id LIMIT {TOP}")
def bm25_topk(spark, sf_dir):
    units = _units(spark, sf_dir)
    return _lexical(spark, units, units.count(), TOP).select("unit_id", F.round("score", 6).alias("score"))


@query(f"WITH {VEC} SELECT unit_id, count(*)::BIGINT AS n, round(sum(w::DOUBLE * w::DOUBLE), 5) AS norm, round(sum(w::DOUBLE * bucket), 4) AS moment FROM vec GROUP BY unit_id")
def hashed_tfidf(spark, sf_dir):
    units = _units(spark, sf_dir)
    idf, few = _weighted(spark, units, units.count())
    v = ranking.hashed_vectors(stats.term_frequencies(units), idf, DIM, few)
    w = F.col("w").cast("double")
    return v.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(w * w), 5).alias("norm"), F.round(F.sum(w * F.col("bucket")), 4).alias("moment"))


@query(f"WITH {QVEC} SELECT unit_id, round(score, 6) AS score FROM cos ORDER BY cos.score DESC, unit_id LIMIT {TOP}")
def cosine_topk_hashed(spark, sf_dir):
    units = _units(spark, sf_dir)
    return _vector(spark, units, units.count(), TOP).select("unit_id", F.round("score", 6).alias("score"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id AS unit_id, round(list_dot_product(embedding::DOUBLE[], (SELECT v FROM q)), 6) AS score FROM embeddings ORDER BY round(list_dot_product(embedding::DOUBLE[], (SELECT v FROM q)), 9) DESC, vec_id LIMIT 20")
def cosine_topk_dense(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("v"))
    q = vectors.where("unit_id = 0").first().v
    return ranking.top(ranking.cosine_dense(vectors, q), TOP).select("unit_id", F.round("score", 6).alias("score"))


@query("""WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: (3 * x::DOUBLE) * (3 * x::DOUBLE)))) AS norm FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: i * (3 * x::DOUBLE / norm)::FLOAT::DOUBLE)), 4) AS moment, round((3 * embedding[1]::DOUBLE / norm)::FLOAT::DOUBLE, 5) AS first FROM n""")
def normalized_rows(spark, sf_dir):
    """Vectors of three times their length, normalized: one sum that depends on every place."""
    v = normalized(F.transform("embedding", lambda x: 3 * x.cast("double")))
    moment = F.aggregate(F.transform("v", lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return _table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(moment, 4).alias("moment"), F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"))


@query("""SELECT vec_id, round(list_sum(list_transform(list_resize(embedding, 48, 0), lambda x, i: i * x::DOUBLE)), 4) AS cut_moment,
round(list_sum(list_transform(list_resize(embedding, 80, 0), lambda x, i: i * x::DOUBLE)), 4) AS padded_moment, len(list_resize(embedding, 80, 0)) AS n_padded FROM embeddings""")
def fitted_vectors(spark, sf_dir):
    """Vectors cut to 48 and padded to 80 components, each as one sum that depends on every place."""
    def moment(v):
        return F.round(F.aggregate(F.transform(v, lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4)

    v = _table(spark, sf_dir, "embeddings").select("vec_id", fitted(F.col("embedding"), 48).alias("cut"), fitted(F.col("embedding"), 80).alias("padded"))
    return v.select("vec_id", moment(F.col("cut")).alias("cut_moment"), moment(F.col("padded")).alias("padded_moment"), F.size("padded").cast("long").alias("n_padded"))


HYBRID = f"""WITH {QVEC}, a AS (SELECT *, row_number() OVER (ORDER BY score DESC, unit_id) AS r FROM cos), b AS (SELECT *, row_number() OVER (ORDER BY score DESC, unit_id) AS r FROM lex)
SELECT coalesce(a.unit_id, b.unit_id) AS unit_id, round(coalesce(1.0::DOUBLE / ({RRF} + a.r), 0) + coalesce(1.0::DOUBLE / ({RRF} + b.r), 0), 9) AS score, round(a.score, 6) AS vector_score, round(b.score, 6) AS lexical_score
FROM a FULL JOIN b ON a.unit_id = b.unit_id ORDER BY score DESC, 1 LIMIT {TOP}"""


@query(HYBRID)
def hybrid_search(spark, sf_dir):
    units = _units(spark, sf_dir)
    n = units.count()
    found = ranking.fuse(_vector(spark, units, n, CHANNEL), _lexical(spark, units, n, CHANNEL), RRF, TOP)
    return found.select("unit_id", F.round("score", 9).alias("score"), F.round("vector_score", 6).alias("vector_score"), F.round("lexical_score", 6).alias("lexical_score"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'typescript' WHEN 'fr' THEN 'kotlin' END AS language FROM documents")
def language_for_path(spark, sf_dir):
    """Paths with an extension for each language of the documents; ``log`` is none that is known."""
    extension = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "de", "d.TS").when(F.col("lang") == "fr", "kts").otherwise("log")
    return _table(spark, sf_dir, "documents").select("doc_id", T.language_for_path(F.concat(F.lit("v1.2/"), "source", F.lit("."), extension)).alias("language"))


@query("SELECT page_id FROM pages WHERE regexp_full_match(split_part(url, '/', -1), '[^/]*\\.html')")
def include_filter(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where(T.is_included(F.col("url"), ("*.html",))).select("page_id")


@query("SELECT page_id FROM pages WHERE NOT list_contains(string_split(url, '/'), 'en') AND NOT regexp_full_match(url, '[^/]*//[^/]*/de')  AND NOT regexp_matches(url, '^[^/]*//[^/]*/de(/|$)')")
def ignore_filter(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where(~T.is_ignored(F.col("url"), ("en", "*//*/de"))).select("page_id")


MAX_BYTES, MAX_CHUNKS = RANGES["max_total_bytes"][0], RANGES["max_chunks"][0]
BYTES = "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes FROM documents"
LINES = "SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_chunks FROM documents"


def _n_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_chunks"))


@query(f"SELECT doc_id, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY doc_id) AS total FROM ({BYTES})) WHERE total <= {MAX_BYTES}")
def byte_cap(spark, sf_dir):
    files = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return maintenance.within_bytes(files, MAX_BYTES, "doc_id", "bytes")


@query(f"SELECT doc_id FROM (SELECT *, sum(n_chunks) OVER (ORDER BY doc_id) AS total FROM ({LINES})) WHERE total - n_chunks < {MAX_CHUNKS}")
def chunk_cap(spark, sf_dir):
    return maintenance.within_chunks(_n_lines(spark, sf_dir), MAX_CHUNKS, strict=False, order="doc_id").select("doc_id")


def _listings(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel"), F.col("n_chars").alias("size"), F.lit(0.0).alias("mtime_ms"), F.col("lang").alias("language"), "doc_id")
    return docs.where("doc_id % 7 <> 0"), docs.where("doc_id % 11 <> 0").withColumn("size", F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))


CHANGES = """SELECT doc_id::VARCHAR AS rel, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS change
FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 11 <> 0"""


@query(CHANGES)
def refresh_changes(spark, sf_dir):
    return maintenance.changes(*_listings(spark, sf_dir))


@query("SELECT " + ", ".join(f"(count(*) FILTER (change = '{c}'))::BIGINT AS {c}" for c in ("added", "updated", "removed", "unchanged")) + f" FROM ({CHANGES})")
def build_counters(spark, sf_dir):
    return maintenance.counters(refresh_changes(spark, sf_dir))


@query("SELECT doc_id::VARCHAR AS rel FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 = 0")
def deleted_files(spark, sf_dir):
    old, new = _listings(spark, sf_dir)
    return maintenance.without_files(old, new).select("rel")


@query(f"SELECT doc_id FROM documents WHERE doc_id::VARCHAR IN (SELECT rel FROM ({CHANGES}) WHERE change = 'updated')")
def changed_files(spark, sf_dir):
    old, _ = _listings(spark, sf_dir)
    return maintenance.only_files(old, refresh_changes(spark, sf_dir).where("change = 'updated'")).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT *, sum(n_chunks) OVER (ORDER BY doc_id) AS total FROM ({LINES})) WHERE total <= {MAX_CHUNKS}")
def chunk_cap_strict(spark, sf_dir):
    return maintenance.within_chunks(_n_lines(spark, sf_dir), MAX_CHUNKS, strict=True, order="doc_id").select("doc_id")


PLAIN = """WITH RECURSIVE d AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS lines FROM documents WHERE text <> ''),
b AS (SELECT doc_id, lines, list_filter(range(len(lines)), lambda j: list_contains(['', '{', '}', ';'], trim(regexp_replace(lines[j + 1], '\\s+', ' ', 'g')))) AS cuts FROM d),
c AS (SELECT doc_id, lines, cuts, 0::BIGINT AS s, CASE WHEN len(lines) > 20 THEN coalesce(list_max(list_filter(cuts, lambda j: j BETWEEN 10 AND 19)) + 1, 20) ELSE len(lines) END AS e FROM b
  UNION ALL SELECT doc_id, lines, cuts, e, CASE WHEN len(lines) - e > 20 THEN coalesce(list_max(list_filter(cuts, lambda j: j BETWEEN e + 10 AND e + 19)) + 1, e + 20) ELSE len(lines) END FROM c WHERE e < len(lines)),
o AS (SELECT *, list_filter(list_transform(lines[s + 1:e], lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')[1] AS head FROM c)
SELECT doc_id AS file_id, 'a.txt' AS rel, (s + 1)::INT AS start_line, e::INT AS end_line, '' AS symbol, array_to_string(lines[s + 1:e], chr(10)) AS content,
  coalesce(CASE WHEN length(head) > 200 THEN head[1:199] || '…' ELSE head END, '') AS summary FROM o"""


@query(PLAIN)
def plain_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.lit("a.txt").alias("rel"), F.col("text").alias("content"))
    return chunk_files(docs, 20)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), c AS (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM l)
SELECT doc_id, coalesce(first(CASE WHEN length(line) > 200 THEN line[1:199] || '…' ELSE line END ORDER BY pos) FILTER (line <> ''), '') AS summary FROM c GROUP BY doc_id""")
def summaries(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.summary(F.col("text"), F.lit("")).alias("summary"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), c AS (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t, trim(line) AS line FROM l),
k AS (SELECT doc_id, line, row_number() OVER w AS n, sum(length(line) + 1) OVER w - 1 AS total, pos FROM c WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS out FROM k WHERE n = 1 OR total <= 500 GROUP BY doc_id)
SELECT doc_id, CASE WHEN out IS NULL THEN '' WHEN length(out) > 500 THEN rtrim(out[1:500]) || '…' ELSE out END AS snippet FROM documents LEFT JOIN j USING (doc_id)""")
def snippets(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    return debounced(_table(spark, sf_dir, "events"), "30 minutes", keys=("user_id",))


@query("SELECT page_id FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages) WHERE NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), 'fr')")
def watch_filter(spark, sf_dir):
    return relevant(_table(spark, sf_dir, "pages").withColumn("path", F.regexp_replace("url", "^https?://", "")), ("fr",)).select("page_id")


# Searches: every row whose id is divisible by 100 asks, all rows answer.
DENSE_MANY = """WITH s AS (SELECT q.vec_id AS query_id, u.vec_id AS unit_id, round(list_dot_product(q.embedding::DOUBLE[], u.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings u WHERE q.vec_id % 100 = 0)
SELECT query_id, unit_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id))::INT AS rank FROM s QUALIFY rank <= 20"""
LEX_MANY = "lex AS (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM (SELECT q.unit_id AS query_id, tf.unit_id, round(sum(idf * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl / (SELECT a FROM avgl)))), 9) AS score FROM tf q JOIN tf ON q.term = tf.term JOIN idf ON idf.term = tf.term JOIN dl ON dl.unit_id = tf.unit_id WHERE q.unit_id % 100 = 0 GROUP BY ALL) QUALIFY r <= {n})"
COS_MANY = "cos AS (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM (SELECT q.doc_id AS query_id, u.doc_id AS unit_id, round(coalesce(s, 0.0), 9) AS score FROM (SELECT doc_id FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT unit_id FROM tf)) q CROSS JOIN documents u LEFT JOIN (SELECT a.unit_id AS query_id, b.unit_id, sum(a.w::DOUBLE * b.w::DOUBLE) AS s FROM vec a JOIN vec b USING (bucket) WHERE a.unit_id % 100 = 0 GROUP BY ALL) x ON x.query_id = q.doc_id AND x.unit_id = u.doc_id) QUALIFY r <= {n})"


@query(DENSE_MANY)
def cosine_many(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("v"))
    asked = vectors.where("unit_id % 100 = 0").withColumnRenamed("unit_id", "query_id")
    return batch.dense_top(vectors, asked, TOP).withColumn("score", F.round("score", 6))


def _asking(units):
    """The rows that ask, taken before texts are counted."""
    return units.where("unit_id % 100 = 0")


def _counted(units):
    """The units' lengths and terms, counted once and stored: all that searches need of their texts."""
    return scratch.kept(stats.postings(units), "postings")


def _df(counted):
    return batch.tasks(counted).select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _mean(counted, n):
    return (counted.agg(F.sum("dl")).first()[0] or 0) / max(1, n)


def _lexical_many(counted, idf, mean, limit):
    # The queries, a hundredth of the postings, bring the weights of the terms.
    words = _asking(counted).select(F.col("unit_id").alias("query_id"), F.explode("terms.term").alias("term"))
    asked = words.join(idf, "term").select("query_id", F.col("term").alias("key"), F.col("idf").alias("w"))
    return batch.packed_top(batch.bm25_rows(counted, mean), batch.packed(asked, "query_id", "w"), limit)


@query(f"WITH {DL}, {LEX_MANY.format(n=TOP)} SELECT query_id, unit_id, round(score, 6) AS score, r::INT AS rank FROM lex")
def bm25_many(spark, sf_dir):
    units = _units(spark, sf_dir)
    counted, n = _counted(units), units.count()
    return _lexical_many(counted, deltas.idf_of(_df(counted), n), _mean(counted, n), TOP).withColumn("score", F.round("score", 6))


@query(f"""WITH {DL}, p AS (SELECT term, unit_id // {blockmax.RANGE} AS block, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT a FROM avgl))) AS part FROM tf JOIN dl USING (unit_id) WHERE dl > 0)
SELECT term, block::BIGINT AS block, count(*)::BIGINT AS n_posts, round(max(part), 6) AS most FROM p GROUP BY term, block""")
def posting_blocks(spark, sf_dir):
    units = _units(spark, sf_dir)
    blocks = blockmax.blocks_of_units(units, stats.corpus_row_of_lengths(units, stats.token_lengths(units)).first().avg_len)
    return blocks.select("term", "block", F.size("posts").cast("long").alias("n_posts"), F.round("most", 6).alias("most"))


@query(f"WITH {DL}, {LEX_MANY.format(n=TOP)} SELECT query_id, unit_id, round(score, 6) AS score, r::INT AS rank FROM lex")
def bm25_block_max(spark, sf_dir):
    units = _units(spark, sf_dir)
    counted, n = scratch.kept(blockmax.ranged_postings(units), "postings"), units.count()
    asked = _asking(counted).select(F.col("unit_id").alias("query_id"), F.explode("terms.term").alias("term"))
    found = blockmax.search_ranged(counted, deltas.idf_of(_df(counted), n), asked, _mean(counted, n), TOP)
    return found.withColumn("score", F.round("score", 6))


@query(f"""WITH {VEC}, {LEX_MANY.format(n=CHANNEL).replace('lex AS', 'lexm AS')}, {COS_MANY.format(n=CHANNEL)},
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.unit_id, b.unit_id) AS unit_id, coalesce(1.0::DOUBLE / ({RRF} + a.r), 0) + coalesce(1.0::DOUBLE / ({RRF} + b.r), 0) AS score, a.score AS vector_score, b.score AS lexical_score FROM cos a FULL JOIN lexm b ON a.query_id = b.query_id AND a.unit_id = b.unit_id)
SELECT query_id, unit_id, round(score, 9) AS score, round(vector_score, 6) AS vector_score, round(lexical_score, 6) AS lexical_score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id))::INT AS rank FROM f QUALIFY rank <= {TOP}""")
def hybrid_many(spark, sf_dir):
    units = _units(spark, sf_dir)
    counted, n = _counted(units), units.count()
    idf = scratch.kept(deltas.idf_of(_df(counted), n), "idf")
    vectors = scratch.kept(ranking.hashed_rows(counted, idf, DIM, FEW_TERMS), "vectors")
    asked = _asking(vectors).where("dl > 0").select(F.col("unit_id").alias("query_id"), "keys", F.col("ws").cast("array<double>").alias("ws"))
    close = batch.packed_top(vectors.withColumn("ws", F.col("ws").cast("array<double>")), asked, CHANNEL, every=True)
    found = batch.fuse_many(close, _lexical_many(counted, idf, _mean(counted, n), CHANNEL), RRF, TOP)
    return found.withColumn("score", F.round("score", 9)).withColumn("vector_score", F.round("vector_score", 6)).withColumn("lexical_score", F.round("lexical_score", 6))


@query(f"WITH {TF}, k AS (SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 <> 0), n AS (SELECT count(*) AS n FROM k), t AS (SELECT term, count(*)::BIGINT AS df FROM tf WHERE unit_id IN (SELECT doc_id FROM k) GROUP BY term) SELECT term, df, round(ln(1 + ((SELECT n FROM n) - df + 0.5) / (df + 0.5)), 9) AS idf FROM t")
def statistics_after_changes(spark, sf_dir):
    """Frequencies of the documents before, changed by those that came and went, as a recount gives them."""
    units = _units(spark, sf_dir)
    before = stats.document_frequencies(units.where("unit_id % 7 <> 0"))
    came, went = (stats.term_frequencies(units.where(c)) for c in ("unit_id % 7 = 0", "unit_id % 7 <> 0 AND unit_id % 11 = 0"))
    signed = deltas.signed_postings(came, went)
    n = units.where("unit_id % 7 = 0 OR unit_id % 11 <> 0").count()
    return deltas.idf_of(deltas.merged_df(before, deltas.term_changes(signed)), n).withColumn("idf", F.round("idf", 9))
