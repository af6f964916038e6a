"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import fingerprints, langid, lines, mixing, ngram_join, packing, repeats, resampling, vectors, warc


SQL = {
    "op1_line_dedup": """
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
             w AS (SELECT *, len(regexp_extract_all(line, '[^ \\t-\\r]+')) AS words FROM l),
             u AS (SELECT doc_id, pos, line, unnest(range(least(4, ((words + 15) // 16))::BIGINT)) AS i FROM w WHERE words > 0),
             k AS (SELECT doc_id, pos, md5(line) || i AS key, row_number() OVER d AS n, lead(pos, 3) OVER d AS last FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY pos, i)),
             s AS (SELECT doc_id, pos, n, last, concat_ws('/', key, lead(key, 1) OVER d, lead(key, 2) OVER d, lead(key, 3) OVER d) AS four FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
             f AS (SELECT *, row_number() OVER (PARTITION BY four ORDER BY doc_id, n) AS nth FROM s WHERE last IS NOT NULL),
             r AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM f WHERE nth > 1),
             m AS (SELECT l.*, r.pos IS NOT NULL AS gone FROM l LEFT JOIN r USING (doc_id, pos)),
             g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM m)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(x.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs
        FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text, count(*) AS n_lines,
                                           count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs FROM g GROUP BY doc_id) x USING (doc_id)""",
    "op2_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> low THEN low END AS refers_to
        FROM f""",
    "op3_source_mixing": """
        WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS n_tokens FROM documents),
             z AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS docs FROM d GROUP BY source),
             p AS (SELECT source, tokens, tokens::DOUBLE / sum(tokens) OVER () AS p FROM z WHERE tokens > 0),
             h(step, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
                SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
                    ln(list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2)))) - (lo + hi) / 2 * list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2) * ln(x))) / list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))) >= 0.97 * ln(len(ps)) AS ok
                    FROM h, (SELECT list(p) AS ps FROM p)) WHERE step < 40),
             o(step, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
                SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid, pow(a / b, 1 - (lo + hi) / 2) > 4 AS ok FROM o, (SELECT max(p) AS a, min(p) AS b FROM p)) WHERE step < 40),
             m AS (SELECT CASE WHEN (SELECT count(*) FROM p) <= 1 THEN 1.0 ELSE greatest((SELECT round(hi, 6) FROM h WHERE step = 40), (SELECT round(hi, 6) FROM o WHERE step = 40)) END AS alpha),
             w AS (SELECT z.source, z.tokens, z.docs, alpha, coalesce(pow(p.p, alpha) / sum(pow(p.p, alpha)) OVER (), 0) AS weight, (SELECT sum(tokens) * max(p) FROM p) / (pow((SELECT max(p) FROM p), alpha) / sum(pow(p.p, alpha)) OVER ()) AS budget FROM z LEFT JOIN p USING (source), m),
             g AS (SELECT *, floor(round(weight * budget, 3))::BIGINT AS part FROM w),
             e AS (SELECT d.*, g.tokens, g.part, (SELECT greatest(1, ceil(sum(part) / 1048576.0))::BIGINT FROM g) AS blocks, greatest(1, ceil(g.docs / 256.0))::BIGINT AS buckets,
                          unnest(range(CASE WHEN g.tokens > 0 THEN greatest(1, (g.part + g.tokens - 1) // g.tokens) ELSE 1 END))::INT AS epoch FROM d JOIN g USING (source)),
             k AS (SELECT *, ('0x' || substr(md5('mix:' || doc_id || ':' || n_tokens || ':' || epoch), 1, 15))::BIGINT AS key FROM e),
             s AS (SELECT *, epoch * tokens + sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key % buckets, key, doc_id)::BIGINT - n_tokens AS spent FROM k)
        SELECT doc_id, source, n_tokens, epoch, greatest(0, least(floor(spent / greatest(part, 1)::DOUBLE * blocks), blocks - 1))::BIGINT AS block,
               ('0x' || substr(md5('mix/place:' || doc_id || ':' || epoch), 1, 15))::BIGINT AS place
        FROM s WHERE spent < part OR (n_tokens = 0 AND epoch = 0)""",
    "op7_ngram_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
             r(id, here) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.here = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(here) FROM r WHERE id = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)""",
    "op10_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
             l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
             r(id, here) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.here = l.a),
             c AS (SELECT id, min(here) AS component_id FROM r GROUP BY id)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN c ON vec_id = id""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, sf_dir, "documents"), "doc_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"), entropy=0.97, repeats=4.0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def tokenizer_file() -> str:
    """The public vocabulary that op5 counts tokens with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=4096, end=1)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), length=100).drop("kept")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op8_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return resampling.resampled(table(spark, sf_dir, "documents"), good)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f) and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
