"""Queries that apply the operators to their whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import byte_bpe, line_dedup, metric_join, mixing, ngram_join, quality, token_counts, token_files, toxicity, url_rules
from tidelake.llm.shared import ship

#: The rules of the URL query.
URL_RULES = [
    url_rules.Rule("block", "com", "/en/"),
    url_rules.Rule("allow", "example.com", "/en/7"),
    url_rules.Rule("allow", "net", "/de/"),
    url_rules.Rule("block", "example.net", "/de/8"),
    url_rules.Rule("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encodes and decodes whole documents, and digests both."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path, pattern), path, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.link_vectors(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).withColumn("quality_probability", F.round("quality_probability", 6))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that never reads labels of fold 2."""
    return toxicity.score_toxicity(docs, toxicity.learn(docs, labels))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "removed_lines", "removed_words", "text")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_mixing,
        op3_byte_bpe,
        op4_metric_join,
        op5_quality_rules,
        op6_toxicity,
        op7_url_rules,
        op8_line_dedup,
        op9_token_files,
        op10_token_counts,
    )
}

ORACLES = {
    "op1_ngram_join": r"""
        WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        classed AS (
            SELECT doc_id, len(w) AS n_words, w, CASE WHEN len(w) > 0 THEN min(doc_id) OVER c ELSE doc_id END AS class_id, CASE WHEN len(w) > 0 THEN count(*) OVER c ELSE 1 END AS class_size
            FROM cut WINDOW c AS (PARTITION BY array_to_string(w, ' '))),
        reps AS (SELECT class_id, class_size, w FROM classed WHERE doc_id = class_id AND n_words > 0),
        shingles AS (
            SELECT DISTINCT class_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in generate_series(1, len(w) - 4)] END) AS x FROM reps),
        sizes AS (SELECT class_id, count(*) AS n FROM shingles GROUP BY 1),
        shared AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN sizes p ON p.class_id = a JOIN sizes q ON q.class_id = b WHERE 5 * k >= 4 * (p.n + q.n - k)),
        degree AS (SELECT a, sum(class_size) AS d FROM links JOIN reps ON b = class_id GROUP BY 1),
        reach(n, r) AS (SELECT class_id, class_id FROM reps UNION SELECT b, r FROM reach JOIN links ON a = n),
        roots AS (SELECT n, min(r) AS root FROM reach GROUP BY 1)
        SELECT doc_id, class_id, CAST(class_size AS BIGINT) AS class_size, CAST(class_size - 1 + coalesce(d, 0) AS BIGINT) AS n_links, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
        FROM classed LEFT JOIN degree ON a = class_id LEFT JOIN roots ON n = class_id""",
    "op4_metric_join": r"""
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (
            SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.93),
        reach(n, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT b, r FROM reach JOIN links ON a = n),
        roots AS (SELECT n, min(r) AS root FROM reach GROUP BY 1)
        SELECT vec_id, coalesce((SELECT count(*) FROM links WHERE a = vec_id), 0) AS n_links, root AS component_id, vec_id = root AS kept FROM v JOIN roots ON n = vec_id""",
    "op2_mixing": r"""
        WITH sizes AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        ranked AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sizes GROUP BY source),
        weighed AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM ranked),
        levels AS (
            SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                   / CAST(sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
        targets AS (SELECT *, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM levels),
        blocks AS (SELECT *, CAST(4 AS BIGINT) AS block FROM targets),
        asked AS (SELECT *, count(*) OVER () AS n, sum(target) OVER () AS v, CAST(floor(CAST(sum(source_size) OVER () AS DOUBLE) / block + 0.5) AS BIGINT) AS s FROM blocks),
        bounds AS (
            SELECT *, CAST(CASE WHEN v > 0 THEN greatest(0, floor(target * (s - n / 2) / v + 0.5) - 1) ELSE 0 END AS BIGINT) AS lo,
                   CAST(CASE WHEN v > 0 THEN floor(target * (s + n / 2) / v + 0.5) + 1 ELSE 1 END AS BIGINT) AS hi FROM asked),
        bids AS (SELECT r, target, lo, unnest(generate_series(lo, hi)) AS k FROM bounds),
        won AS (SELECT r, lo, target > 0 AND row_number() OVER (ORDER BY target / (2 * k + 1) DESC, r, k) <= (SELECT max(s) - sum(lo) FROM bounds) AS w FROM bids),
        quotas AS (SELECT r, CAST(max(lo) + count(*) FILTER (w) AS BIGINT) AS seats FROM won GROUP BY r),
        dealt AS (
            SELECT z.doc_id, z.size, z.h, b.r, b.source_size, b.target, b.block, q.seats,
                   CAST(ceil(b.n_docs / 1024) AS BIGINT) AS n_shards, coalesce('s' || z.source, 'n') AS skey
            FROM sizes z JOIN blocks b ON z.source IS NOT DISTINCT FROM b.source JOIN quotas q ON q.r = b.r),
        sharded AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % n_shards AS shard FROM dealt),
        shards AS (SELECT r, skey, shard, max(seats) AS s, max(block) AS block, CAST(sum(size) AS BIGINT) AS z FROM sharded GROUP BY ALL),
        asked2 AS (SELECT *, count(*) OVER (PARTITION BY r) AS n, CAST(sum(z) OVER (PARTITION BY r) AS DOUBLE) AS v FROM shards),
        bounds2 AS (
            SELECT *, CAST(CASE WHEN v > 0 THEN greatest(0, floor(z * (s - n / 2) / v + 0.5) - 1) ELSE 0 END AS BIGINT) AS lo,
                   CAST(CASE WHEN v > 0 THEN floor(z * (s + n / 2) / v + 0.5) + 1 ELSE 1 END AS BIGINT) AS hi FROM asked2),
        bids2 AS (SELECT r, skey, shard, z, block, lo, unnest(generate_series(lo, hi)) AS k FROM bounds2),
        rest2 AS (SELECT r, max(s) - sum(lo) AS rest FROM bounds2 GROUP BY r),
        won2 AS (
            SELECT b.r, skey, shard, z, block, lo, z > 0 AND row_number() OVER (PARTITION BY b.r ORDER BY z / (2 * k + 1) DESC, skey, shard, k) <= rest2.rest AS w FROM bids2 b JOIN rest2 ON b.r = rest2.r),
        quotas2 AS (SELECT r, skey, shard, z, block, least((max(lo) + count(*) FILTER (w)) * block, 3 * z) AS words FROM won2 GROUP BY r, skey, shard, z, block),
        rings AS (
            SELECT r, shard, z, CASE WHEN z > 0 THEN words // z ELSE 0 END AS whole, words - CASE WHEN z > 0 THEN words // z ELSE 0 END * z AS rest,
                   CAST('0x' || substr(md5('7|' || skey || '|' || shard), 1, 8) AS BIGINT) % greatest(1, CAST(ceil(z / block) AS BIGINT)) * block AS first FROM quotas2),
        placed AS (
            SELECT d.*, g.z, g.whole, g.rest, g.first, CAST(sum(d.size) OVER (PARTITION BY d.r, d.shard ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
            FROM sharded d JOIN rings g ON d.r = g.r AND d.shard = g.shard)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(whole * size + greatest(0, least(stop, first + rest) - greatest(stop - size, first)) + greatest(0, least(stop, first + rest - z) - (stop - size)) AS BIGINT) AS taken
        FROM placed""",
    "op5_quality_rules": quality.oracle_sql(),
    "op8_line_dedup": r"""
        WITH cut AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split_regex(text, '[^\x20\x09-\x0D]+') AS g FROM documents WHERE text IS NOT NULL),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS run FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM cut)),
        later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, generate_series(0, 49) AS s(k)),
        placed AS (SELECT doc_id, unnest(generate_series(1, len(w) + 1)) AS i, unnest(list_append(w, '')) AS word, unnest(g) AS gap, len(w) AS n FROM cut WHERE len(w) > 0),
        marked AS (
            SELECT p.*, gone.i IS NOT NULL AS out, sum(length(gap) - length(replace(gap, chr(10), ''))) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS line
            FROM placed p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i),
        firsts AS (SELECT *, lag(i, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM marked WHERE NOT out),
        glued AS (
            SELECT f.doc_id, f.i, f.word, f.n, CASE WHEN before = f.i - 1 OR contains(m.gap, chr(10)) OR NOT contains(f.gap, chr(10)) THEN m.gap ELSE f.gap END AS gap
            FROM firsts f JOIN marked m ON m.doc_id = f.doc_id AND m.i = f.before + 1),
        texts AS (SELECT doc_id, CASE WHEN count(*) = 1 THEN '' ELSE string_agg(gap || word, '' ORDER BY i) END AS text FROM glued GROUP BY doc_id),
        counted AS (SELECT doc_id, count(*) FILTER (out) AS removed_words FROM marked GROUP BY doc_id),
        emptied AS (SELECT doc_id, count(*) AS removed_lines FROM (SELECT doc_id, line FROM marked WHERE i <= n GROUP BY doc_id, line HAVING bool_and(out)) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(removed_lines, 0) AS removed_lines, coalesce(removed_words, 0) AS removed_words, coalesce(t.text, d.text) AS text
        FROM documents d LEFT JOIN texts t USING (doc_id) LEFT JOIN counted USING (doc_id) LEFT JOIN emptied USING (doc_id)""",
    "op7_url_rules": r"""
        WITH cut AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages),
        rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        fits AS (
            SELECT c.page_id, c.host, c.path, r.h || r.p AS rule, r.verdict,
                   row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
            FROM cut c LEFT JOIN rules r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1""",
}
