"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, importance, license_scan, lm_score, mixing, neighbours, prefix_trie, quality_rules, secret_scan, simhash, substring_dedup, token_output, url_filter

URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_scan.BASE_RULES + secret_scan.EXTRA_RULES
    found = secret_scan.scan(table(spark, sf_dir, "documents"), rules)
    base = F.filter("found", lambda x: x["rank"] < len(secret_scan.BASE_RULES))
    # a second parameter of the function would be the element's place in the array
    of_rank = lambda n: F.filter("found", lambda x: x["rank"] == n)
    counts = [F.size(of_rank(n)).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(secret_scan.BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base, rules), 256).alias("base_sha256"), secret_scan.listed(F.col("found"), rules).alias("spans"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_passages(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_lm_score": op3_lm_score,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_output": op9_token_output,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_importance": op12_importance,
    "op13_neighbours": op13_neighbours,
}

#: CRC-32 in SQL: `crc` holds the table of bytes, and CRC32 stands for an expression over the bytes of a BLOB `b`.
CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_concat([i], range(1, 9)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) r(i)))"""
CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, octet_length(b) + 1), lambda k: CAST('0x' || substr(hex(b), 2 * k - 1, 2) AS BIGINT))), lambda a, x: xor(a >> 8, tbl[(xor(a, x) & 255) + 1])), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op6_mixing": r"""
    WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7') AS k FROM documents),
    s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS ss, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source),
    l AS (SELECT *, 2 * ss AS cap, (1.5::DOUBLE * sum(ss) OVER () - coalesce(sum(2 * ss) OVER (ORDER BY 2 * ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY 2 * ss / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM s),
    t AS (SELECT source, ss, coalesce(least((SELECT arg_min(lam, cap / w) FROM l WHERE lam * w <= cap) * w, cap), cap) AS target FROM l),
    e AS (SELECT d.*, t.ss, t.target, CASE WHEN t.ss > 0 THEN floor(t.target / t.ss) ELSE 0 END AS whole,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ss AS BIGINT) AS source_size, target,
        CAST(whole * size + greatest(0, least(size, floor(target - whole * ss + 0.5) - before)) AS BIGINT) AS taken FROM e""",
    "op11_prefix_trie": f"""
    WITH {CRC_TABLE},
    t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    p AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos FROM t),
    c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id, encode(CAST(conv_id AS VARCHAR)) AS b FROM t), crc),
    r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN p ON p.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN p ON p.conv_id = c.conv_id AND pos > h),
    s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM r),
    k AS (SELECT conv_id, depth, length(text) AS len, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM s),
    m AS (SELECT c.conv_id, 0 AS depth, 0 AS len, NULL AS key FROM c UNION ALL SELECT * FROM k),
    n AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, key) AS node, max(depth) OVER (PARTITION BY conv_id) AS ends FROM m),
    g AS (SELECT node AS conv_id, depth, count(*) AS n_convs, max(len) * (count(*) - 1) AS own, string_agg(CASE WHEN depth = ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS said FROM n GROUP BY ALL),
    up AS (SELECT g.*, a.node AS parent FROM g LEFT JOIN n a ON a.conv_id = g.conv_id AND a.depth = g.depth - 1),
    leaf AS (SELECT up.*, (SELECT count(*) FROM up u WHERE u.parent = up.conv_id AND u.depth = up.depth + 1) AS n_children FROM up),
    sub AS (SELECT a.node AS conv_id, a.depth, sum(own) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM leaf l JOIN n a ON a.conv_id = l.conv_id AND a.depth <= l.depth GROUP BY ALL)
    SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(said, '')) AS ends_sha256 FROM leaf JOIN sub USING (conv_id, depth)""",
    "op12_importance": rf"""
    WITH {CRC_TABLE},
    w AS (SELECT 0 AS goal, row_number() OVER () AS id, doc_id, text FROM documents UNION ALL SELECT 1, 0, NULL, text FROM benchmark),
    d AS (SELECT goal, id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM w),
    f AS (SELECT goal, id, unnest(words) AS word FROM d),
    h AS (SELECT word, {CRC32} % 10000 AS bucket FROM (SELECT DISTINCT word, encode(word) AS b FROM f), crc),
    n AS (SELECT bucket, CAST(count(*) FILTER (goal = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (goal = 1) AS DOUBLE) AS t FROM f JOIN h USING (word) GROUP BY bucket),
    g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM n),
    u AS (SELECT id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN h USING (word) JOIN g USING (bucket) WHERE goal = 0 GROUP BY id),
    e AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN u USING (id) WHERE goal = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_features >= 20) OVER () AS cans FROM e)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * cans // 100 THEN place END AS rank FROM r""",
}
