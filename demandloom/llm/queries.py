"""Named queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm import (
    bpe,
    decontamination,
    exact_dedup,
    filter_audit,
    html_text,
    line_dedup,
    mixing,
    near_dedup,
    negatives,
    quality,
    simhash,
    substring_dedup,
    token_files,
)
from demandloom.llm.common import table
from demandloom.session import scratch_path


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_neighbours(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.digest_of_ids(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_line_dedup_ten_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of ten words or more only."""
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 10)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    found = token_files.read(spark, path, with_ids=False)
    return found.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.whole_numbers(table(spark, sf_dir, "embeddings"))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_bpe": op5_bpe,
    "op6_html_text": op6_html_text,
    "op7_line_dedup": op7_line_dedup,
    "op7_line_dedup_ten_words": op7_line_dedup_ten_words,
    "op8_mix": op8_mix,
    "op9_token_files": op9_token_files,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_decontamination": op13_decontamination,
}

ORACLE_SQL = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] END)) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""",
    "op2_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d
), r AS (
  SELECT doc_id, i, word, string_agg(word, ' ') OVER f AS run, count(*) OVER f AS n FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), m AS (SELECT doc_id, i, word, n = 50 AND min(CASE WHEN n = 50 THEN doc_id END) OVER (PARTITION BY md5(run)) < doc_id AS again FROM r
), c AS (
  SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m
), k AS (
  SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM c GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
    "op3_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d)
), c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM l
), p AS (SELECT a.doc_id, a.i AS i, b.i AS j, a.c - a.w AS e, b.c AS c FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.i <= b.i
         WHERE b.c - a.c + a.w >= 1
), r AS (
  SELECT doc_id, i, min(j) AS j FROM p GROUP BY doc_id, i UNION SELECT doc_id, max(i) AS i, j FROM p GROUP BY doc_id, j
), k AS (
  SELECT r.doc_id, r.i, r.j, md5(array_to_string(d.lines[r.i + 1:r.j + 1], chr(10))) AS run, r.j - r.i AS n
  FROM r JOIN d USING (doc_id)
), f AS (SELECT *, min({'d': doc_id, 'i': i}) OVER (PARTITION BY run, n) AS first FROM k
), g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE {'d': doc_id, 'i': i} > first
), s AS (
  SELECT x.doc_id, x.line, x.i, g.i IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d) x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i
)
SELECT s.doc_id, CASE WHEN d.text = '' THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM s JOIN d USING (doc_id) GROUP BY s.doc_id, d.text
""",
    "op8_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || doc_id) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source
), c AS (SELECT *, 2.0 * source_size::DOUBLE AS cap, 2.0 * source_size::DOUBLE / w AS stop FROM s
), l AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () * 1.5 - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM c WINDOW o AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (SELECT arg_min(level, stop) AS level FROM l WHERE cap >= w * level
), t AS (SELECT c.*, least(w * v.level, cap) AS target FROM c, v
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS reached
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - (reached - size))) AS BIGINT) AS taken
FROM r
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
""",
    "op12_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), f AS (
  SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
         min(doc_id) OVER (PARTITION BY text) < doc_id] AS fails FROM d
), m AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM f LEFT JOIN labels USING (doc_id) GROUP BY part, fails
), i AS (SELECT unnest(range(1, 6)) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS ids FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT array_to_string(list_transform(ids, lambda x: chr(CAST(64 + x AS INTEGER))), '') AS filter_order, CAST(step AS INTEGER) AS step,
         ids[step] AS mine, ids[1:step - 1] AS earlier
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, mine,
         CAST(sum(n) FILTER (WHERE NOT hit AND NOT fails[mine]) AS BIGINT) AS kept, CAST(sum(n) FILTER (WHERE NOT hit AND fails[mine]) AS BIGINT) AS removed,
         CAST(sum(n) FILTER (WHERE hit AND fails[mine]) AS BIGINT) AS redundant,
         CAST(sum(n) FILTER (WHERE fails[mine] AND len(list_filter(fails, lambda x: x)) = 1) AS BIGINT) AS unique_fails,
         CAST(sum(good) FILTER (WHERE NOT hit AND fails[mine]) AS BIGINT) AS good_lost,
         CAST(sum(toxic) FILTER (WHERE NOT hit AND fails[mine]) AS BIGINT) AS toxic_lost
  FROM (SELECT m.*, s.*, len(list_filter(earlier, lambda x: fails[x])) > 0 AS hit FROM m, s) GROUP BY part, filter_order, step, mine
)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley
FROM r
""",
    "op13_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL
), t AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, unnest([array_to_string(words[i:i + least(10, len(words)) - 1], ' ')
         for i in range(1, len(words) - least(10, len(words)) + 2)]) AS run FROM b WHERE len(words) > 0
), r AS (
  SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS i, unnest([array_to_string(words[i:i + n - 1], ' ') for i in range(1, len(words) - n + 2)]) AS run
  FROM d, (SELECT DISTINCT n FROM t) WHERE len(words) >= n
), h AS (SELECT r.doc_id, r.i, r.n, t.item_id FROM r JOIN t ON r.run = t.run AND r.n = t.n
), n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), k AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
""",
}

#: Repeated runs of ten words or more, by the same statement.
ORACLE_SQL["op7_line_dedup_ten_words"] = ORACLE_SQL["op7_line_dedup"].replace("a.w >= 1\n", "a.w >= 10\n")
