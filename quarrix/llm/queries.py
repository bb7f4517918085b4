"""The operators of this subpackage applied to the synthetic tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, hamerly, line_dedup, ngram_join, order_minhash, packing, pii, quality, scratch, token_file, toxicity, unicode_bpe_dp, warc

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
END_ID = 2
PROBE = "</s>[INST] ok [/INST]"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), END_ID, 1024)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unicode_bpe_dp.round_trip_digests(_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    segments = scratch.staged(chat.format_turns(rows.unionByName(probe)), "chat")
    return chat.read_conversations(segments)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_documents(spark, sf_dir), 40, 5)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_documents(spark, sf_dir), 4, 85, 100)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(_documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch.new_path(spark, "archives")
    warc.write_archives(warc.with_revisits(pages, 100), path, warc.sample_dictionary(pages))
    return warc.read_archives(spark, path)


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "tokens")
    token_file.write_token_files(_documents(spark, sf_dir), path, public_tokenizers.path(BYTE_BPE), END_ID)
    return token_file.token_digests(token_file.read_token_files(spark, path))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.quality(_documents(spark, sf_dir))
    return done.select(*(c for c in done.columns if c != "cleaned"), F.sha2(F.col("cleaned").cast("binary"), 256).alias("cleaned_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir), min_docs=10, top=10)


def op12_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = hamerly.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, seed=3, width=64)
    return done.drop("full_scans")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return pii.span_digests(pii.find_spans(docs, pii.train(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_bpe_round_trip, op3_chat_formatting, op4_line_dedup, op5_ngram_jaccard_join,
        op6_order_minhash, op7_warc, op8_token_file, op9_toxicity, op10_quality_rules,
        op11_source_divergence, op12_hamerly_clusters, op13_personal_data,
    )
}

_CONTROL, _ESCAPED = r"([<\[])(\\*)(\||/?s>|/?INST\]|/?<?/?SYS>)", r"\1\\\2\3"

def _rounds_of_clusters(rounds: int) -> str:
    """SQL of Lloyd's rounds, one after the other; ``a<r>`` assigns and ``c<r>`` has the centroids of round ``r``."""
    near = "arg_min(c.k, (list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.k))"
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x FROM v QUALIFY k < 8)"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT i, {near} AS k FROM v, c{r} c GROUP BY i)")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (SELECT k, list(q ORDER BY pos) AS x FROM (SELECT k, pos, (s - ((s % n + n) % n)) // n AS q FROM (
              SELECT k, pos, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, unnest(range(64)) AS pos FROM a{r} JOIN v USING (i)) GROUP BY k, pos)) GROUP BY k)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (k))")
    return f"""WITH {", ".join(parts)},
        d AS (SELECT vec_id, k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance, sha256(array_to_string(c.x, ',')) AS centroid_sha256
          FROM v JOIN a{rounds} USING (i) JOIN c{rounds} c USING (k))
        SELECT vec_id, k::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM d"""


ORACLE_SQL: dict[str, str] = {
    "op3_chat_formatting": rf"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))
        SELECT conv_id, count(*)::BIGINT AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(24 + length(regexp_replace(role, '{_CONTROL}', '{_ESCAPED}', 'g')) + length(regexp_replace(text, '{_CONTROL}', '{_ESCAPED}', 'g')))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op4_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
        k AS (SELECT doc_id, pos, line,
                translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.*, c.holder IS NOT NULL AND k.doc_id < c.holder AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op7_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
                min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM d""",
    "op10_quality_rules": r"""
        WITH d AS (SELECT doc_id, text, coalesce(source, '') AS host, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        b AS (SELECT doc_id, text, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols FROM d),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times
              FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d))),
        r AS (SELECT doc_id, count(DISTINCT spot)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS spot FROM g WHERE times > 1) GROUP BY doc_id),
        t AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
        l AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM t),
        o AS (SELECT host, key FROM (SELECT DISTINCT host, text, key FROM l WHERE key <> '') GROUP BY host, key HAVING count(*) >= 20),
        m AS (SELECT l.*, o.key IS NOT NULL AS gone, len(regexp_extract_all(l.key, '[^\x20\x09-\x0D]+')) AS words FROM l LEFT JOIN o ON l.host = o.host AND l.key = o.key),
        c AS (SELECT doc_id, (count(*) FILTER (key <> '') - count(DISTINCT line) FILTER (key <> ''))::BIGINT AS n_dup_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
                sum(words) FILTER (gone) AS lost, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS cleaned FROM m GROUP BY doc_id),
        v AS (SELECT b.*, coalesce(c.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(c.n_removed, 0) AS n_removed, c.lost, c.cleaned,
                b.n_words < 20 OR 100 * coalesce(r.n, 0) > 30 * b.n_words AS base_failed
              FROM b LEFT JOIN r ON b.doc_id = r.doc_id LEFT JOIN c ON b.doc_id = c.doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND NOT coalesce(n_words - lost < 20, false) AS kept, n_removed, sha256(cleaned) AS cleaned_sha256
        FROM v""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        t AS (SELECT lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS df FROM t GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 10),
        l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN (c JOIN k USING (lang, term)) ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
        p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * l.v))::BIGINT AS p,
            (1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v))::BIGINT AS q
          FROM s JOIN k ON s.lang = k.lang JOIN l ON l.lang = k.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM o
        QUALIFY part = 'pair' OR rank <= 10""",
    "op12_hamerly_clusters": _rounds_of_clusters(10),
}
