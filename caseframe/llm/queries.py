"""The operators bound to the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.llm import (credentials, exact, languages, licenses, mixing, neardup, packing,
                           private, quality, spelling, tokenfiles, warc, whitening)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_secrets(_table(spark, sf_dir, "documents"))
    return credentials.listed(found, credentials.KINDS, credentials.STRONG)


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(_table(spark, sf_dir, "documents"))
    return credentials.listed(found, private.KINDS, private.KINDS)


def op6_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by a hash of their ids, count as history."""
    history = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"), history).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(_table(spark, sf_dir, "labels"))
    return quality.judged(_table(spark, sf_dir, "documents"), trusted)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identified(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licenses.document_paths(_table(spark, sf_dir, "documents"))
    return licenses.licences(files).select(
        F.expr("try_cast(element_at(split(path, '/'), -1) as bigint)").alias("doc_id"), "path",
        "licence", "origin", "score", "holder")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whitening(_table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op4_secret_scan": op4_secret_scan,
    "op5_private_data": op5_private_data,
    "op6_exact_duplicates": op6_exact_duplicates,
    "op7_source_mixing": op7_source_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
    "op11_token_files": op11_token_files,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op1_near_duplicates": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, list_filter(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3),
                      lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
        one AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        pairs AS (
          SELECT a.doc_id AS u, b.doc_id AS v FROM one a JOIN one b USING (shingle)
          WHERE a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n
          HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach(u, v) AS (
          SELECT doc_id, doc_id FROM sets UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id,
               s.doc_id = m.c AS kept
        FROM sets s JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) m ON m.u = s.doc_id
    """,
    "op3_warc_round_trip": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x,
                     max(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda i:
                 array_to_string(list_transform(range(0, 4), lambda k:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, (1 + 5 * i)::INT, 5))::BIGINT
                          >> (15 - 5 * k)) & 31)::INT, 1)), '')), '') AS payload_digest,
               CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < first THEN first END AS refers_to
        FROM d
    """,
    "op6_exact_duplicates": r"""
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))
                   AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op7_source_mixing": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, '')) AS own,
                 CAST(len(regexp_extract_all(coalesce(text, ''),
                 '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (
          SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
                 [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w
          FROM d GROUP BY source),
        fill(step, source, target, fixed) AS (
          SELECT 0, source, w::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
                   / (SELECT sum(w) FROM s)::DOUBLE, false FROM s
          UNION ALL
          SELECT step + 1, source,
                 CASE WHEN now THEN 3.0 * source_size ELSE w::DOUBLE
                   * (sum(source_size) OVER () - sum(CASE WHEN now THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE
                   / (sum(CASE WHEN now THEN 0 ELSE w END) OVER ())::DOUBLE END, now
          FROM (SELECT f.step, s.*, f.fixed OR f.target > 3 * s.source_size AS now
                FROM fill f JOIN s ON f.source IS NOT DISTINCT FROM s.source)
          WHERE step < 40),
        t AS (SELECT s.*, f.target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size::DOUBLE END AS e
              FROM s JOIN fill f ON f.step = 40 AND f.source IS NOT DISTINCT FROM s.source),
        b AS (
          SELECT d.doc_id, d.size, d.own, t.*,
                 CAST(floor(('0x' || substr(md5('17:bucket:' || d.own), 1, 8))::BIGINT
                   / 4294967296.0::DOUBLE * (1 + (t.n - 1) // 4000)) AS BIGINT) AS bucket
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (
          SELECT *, row_number() OVER (PARTITION BY source, bucket
                   ORDER BY size, md5('17:order:' || own), own) AS k,
                 ('0x' || substr(md5('17:start:' || coalesce(source, '') || ':' || bucket), 1, 8))::BIGINT
                   / 4294967296.0::DOUBLE AS u
          FROM b)
        SELECT doc_id, size, source_size, target,
               CAST(size * least(3, floor(e) + floor(k * (e - floor(e)) + u)
                                    - floor((k - 1) * (e - floor(e)) + u)) AS BIGINT) AS taken
        FROM p
    """,
    "op13_spelling_variants": r"""
        WITH RECURSIVE steps(i, k, v) AS (
          SELECT i, 0, i::BIGINT FROM range(256) r(i)
          UNION ALL
          SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END
          FROM steps WHERE k < 8),
        tab AS (SELECT list(v ORDER BY i) AS l FROM steps WHERE k = 8),
        runs AS (
          SELECT doc_id, unnest(regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY doc_id, run),
        hashed AS (
          SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                   regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'),
                   lambda b: ('0x' || b)::BIGINT)),
                   lambda s, b: xor(s >> 8, l[1 + (xor(s, b) & 255)])), 4294967295::BIGINT) AS h
          FROM counted, tab),
        spelt AS (
          SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT)
                   || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
        w AS (
          SELECT word, sum(c)::BIGINT AS n, length(word) AS size, translate(word,
                   'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ',
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~') AS bytes
          FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
        near AS (
          SELECT a.word, a.n, b.word AS other, b.n AS other_n
          FROM w a JOIN w b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> b.word
          WHERE levenshtein(a.bytes, b.bytes) = 1),
        best AS (
          SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS form_n FROM near GROUP BY word),
        forms AS (
          SELECT b.word, b.form_n, min(near.other) AS form
          FROM best b JOIN near ON near.word = b.word AND near.other_n = b.form_n
          WHERE b.form_n >= 5 * b.n GROUP BY b.word, b.form_n),
        chain(word, root, step) AS (
          SELECT word, word, 0 FROM w
          UNION ALL
          SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root)
        SELECT w.word, f.form, r.root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
        FROM w LEFT JOIN best b ON b.word = w.word LEFT JOIN forms f ON f.word = w.word
        JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) r ON r.word = w.word
    """,
}
