"""The registered query of each operator, and the DuckDB statement where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import collocations, exactdup, fst, langid, licenses, mixing, ranked, simhash, spm, suffix, tokenfiles, topk, warc, warcfiles
from vigil.llm.common import documents, read_table, ship_package
from vigil.llm.pieces import default_model
from vigil.session import checkpoint_subdir


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(documents(spark, sf_dir)))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.near_groups(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spm.digests(documents(spark, sf_dir), default_model())


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return suffix.report(documents(spark, sf_dir))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    folder = checkpoint_subdir(spark, f"warc-{uuid.uuid4().hex}")
    warc.write_warc(warc.response_records(warc.responses(read_table(spark, sf_dir, "pages"))), folder)
    records = warc.derivatives(warcfiles.read_responses(spark, folder))
    return records.select("page_id", "type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_length", F.sha2("header", 256).alias("header_sha256"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.permutations(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return langid.identify(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return fst.token_counts(documents(spark, sf_dir), default_model())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ranked.search(read_table(spark, sf_dir, "benchmark"), documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return collocations.mine(documents(spark, sf_dir))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    folder = checkpoint_subdir(spark, f"token-files-{uuid.uuid4().hex}")
    tokenfiles.write(documents(spark, sf_dir), folder)
    return tokenfiles.report(spark, folder)


REGISTRY = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_license_scan": op2_license_scan,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_source_mixing": op7_source_mixing,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_collocations": op12_collocations,
    "op13_token_files": op13_token_files,
}

ORACLE = {
    "op1_exact_top_k": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    # The halvings of the exponent's bracket are a recursive query here.
    "op7_source_mixing": r"""
        WITH RECURSIVE r AS MATERIALIZED (
            SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS lot,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
        t AS MATERIALIZED (SELECT source, count(*) AS n_rows, sum(tokens)::BIGINT AS tokens FROM r GROUP BY source),
        sh AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM t)::DOUBLE AS share FROM t),
        edge AS (SELECT max(share) / min(share) AS spread FROM sh WHERE share > 0),
        bi AS (
            SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
            UNION ALL
            SELECT k + 1,
                   CASE WHEN pow((SELECT spread FROM edge), 1 - (lo + hi) / 2) <= 2.0 THEN lo ELSE (lo + hi) / 2 END,
                   CASE WHEN pow((SELECT spread FROM edge), 1 - (lo + hi) / 2) <= 2.0 THEN (lo + hi) / 2 ELSE hi END
            FROM bi WHERE k < 42),
        ex AS (SELECT CASE WHEN (SELECT spread FROM edge) <= 2.0 THEN 0.0 ELSE round(hi, 9) END AS x FROM bi WHERE k = 42),
        li AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN pow(share, (SELECT x FROM ex)) ELSE 0.0 END AS lift FROM sh),
        sz AS (SELECT max(CASE WHEN tokens > 0 THEN tokens / lift END) AS most FROM li),
        bu AS (
            SELECT source, n_rows, tokens, greatest(tokens, round(lift * (SELECT coalesce(most, 0.0) FROM sz))::BIGINT) AS budget FROM li),
        pl AS MATERIALIZED (
            SELECT source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS passes,
                   CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest,
                   ceil(n_rows / 1024.0)::BIGINT AS blocks FROM bu),
        u AS (
            SELECT r.doc_id, r.source, r.lot, r.tokens, p.passes, p.rest,
                   ('0x' || md5(r.lot)[1:8])::BIGINT % p.blocks AS block,
                   unnest(range(0, p.passes + CASE WHEN p.rest > 0 THEN 1 ELSE 0 END)) AS pass
            FROM r JOIN pl p ON r.source IS NOT DISTINCT FROM p.source),
        o AS (
            SELECT *, coalesce(sum(tokens) OVER (
                       PARTITION BY source, pass
                       ORDER BY md5('mix|' || pass || '|' || coalesce(source, '') || '|' || block), block,
                                md5('mix|' || pass || '|' || lot), tokens
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS token_start
            FROM u)
        SELECT doc_id, source, pass::INTEGER AS pass, block, token_start, tokens FROM o
        WHERE pass < passes OR token_start + tokens <= rest
    """,
    "op10_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_cp,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        r AS (
            SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
    """,
    "op11_ranked_search": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS row_no,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        i AS (
            SELECT item_id, row_number() OVER () AS item_no,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        c AS (SELECT count(*) AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
        u AS (SELECT row_no, doc_id, len(t) AS n, unnest(t) AS term FROM d),
        tf AS MATERIALIZED (SELECT row_no, doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM i) GROUP BY ALL),
        w AS (
            SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, nn),
        q AS (SELECT item_no, item_id, term, count(*) AS uses FROM i GROUP BY ALL),
        s AS (
            SELECT item_no, item_id, row_no, doc_id,
                   sum(uses * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN w USING (term), c GROUP BY ALL),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
    """,
    "op12_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row_no,
                   string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
            FROM documents),
        g AS (SELECT lang, row_no, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM p),
        h AS (SELECT lang, row_no, k, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM g),
        o AS MATERIALIZED (
            SELECT lang, unnest(ws) AS w1, unnest(list_append(ws[2:], NULL)) AS w2,
                   unnest(list_append(list_append(ws[3:], NULL), NULL)[1:len(ws)]) AS w3 FROM h WHERE len(ws) > 0),
        f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM o GROUP BY ALL),
        f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM o WHERE w2 IS NOT NULL GROUP BY ALL),
        f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM o WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
        two AS (
            SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k
            FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
            WHERE f2.f >= 10
              AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
              AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= 50 * f2.f)),
        three AS (
            SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x.f AS l, y.f AS r, 1 AS k
            FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
            UNION ALL
            SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 2
            FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
        c AS (
            SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score
            FROM (SELECT * FROM two UNION ALL SELECT * FROM three)),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM c),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE cut = 1)
        SELECT r.lang, rank, phrase, a, l, r.r, n.n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
    """,
}
