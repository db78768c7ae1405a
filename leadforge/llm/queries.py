"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from leadforge.llm.chat import formatted
from leadforge.llm.clusters import clustered
from leadforge.llm.common import table
from leadforge.llm.exact import exact_groups
from leadforge.llm.fingerprints import fingerprints
from leadforge.llm.mixing import assign, in_order, readings
from leadforge.llm.ngrams import similar_groups
from leadforge.llm.pages import main_text
from leadforge.llm.phrases import collocations
from leadforge.llm.pieces import encoded
from leadforge.llm.quality import quality_verdicts
from leadforge.llm.tokens import token_counts
from leadforge.llm.toxicity import toxicity
from leadforge.llm.warc import round_trip


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, range-sorted by the training position of its first reading; positions are in billionths of the training time."""
    out = assign(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    positions = [F.floor(1e9 * F.get("mix_positions", F.lit(k))).alias(name) for k, name in enumerate(("first_position", "second_position"))]
    out = out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), *positions)
    return in_order(out, "doc_id", [F.col("first_position").asc_nulls_last()], ["size"])


def op2_mixing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every reading of the mix with its training position, range-sorted by it."""
    out = readings(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_reading").alias("reading"), F.col("mix_position").alias("position"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar_groups(table(spark, sf_dir, "documents"), n=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), outputs=())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations")).withColumnRenamed("id", "conv_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("url")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).drop("n_lines")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).withColumnsRenamed({"id": "doc_id", "edited_digest": "edited_sha256"})


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustered(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _rounds(n: int = 5) -> str:
    """SQL of the clustering: n rounds, then a last assignment."""
    parts = [r"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), x AS (SELECT row, unnest(range(1, 65)) AS i, unnest(v) AS x FROM kept),
c0 AS (
  SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM (
    SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept ORDER BY c LIMIT 40))"""]
    for r in range(n + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, c, d FROM (SELECT row, c, d, row_number() OVER (PARTITION BY row ORDER BY d, c) AS p FROM (
    SELECT row, c, sum((x.x - m.x) * (x.x - m.x))::BIGINT AS d FROM x JOIN c{r} m USING (i) GROUP BY row, c)) WHERE p = 1)""")
        if r < n:
            parts.append(f"""
m{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN x USING (row) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{r} LEFT JOIN m{r} USING (c, i))""")
    return ",".join(parts) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{n} JOIN kept USING (row) JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{n} GROUP BY c) USING (c)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op2_mixing_order": op2_mixing_order,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_html_extraction": op6_html_extraction,
    "op7_warc": op7_warc,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE_SQL: dict[str, str] = {
    "op12_phrase_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, w[i:i + m - 1] AS ws, m, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 6) t(m)
  WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), own AS (
  SELECT * FROM g WHERE m >= 2 AND NOT EXISTS (SELECT 1 FROM g o WHERE o.lang = g.lang AND o.m = g.m + 1 AND o.f >= g.f AND (o.ws[1:g.m] = g.ws OR o.ws[2:] = g.ws))
), cuts AS (
  SELECT own.lang, own.ws, own.f AS a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * own.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM own, range(1, 5) t(k), total, g l, g r
  WHERE k < own.m AND total.lang = own.lang AND l.lang = own.lang AND l.ws = own.ws[1:k] AND r.lang = own.lang AND r.ws = own.ws[k + 1:]
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS c FROM cuts)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, n, score
FROM best WHERE c = 1 QUALIFY rank <= 2000""",
    "op13_centroid_clustering": _rounds(),
    "op5_chat_formatting": r"""
WITH r AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, count(*) OVER (PARTITION BY conv_id) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), h AS (
  SELECT *, string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY i) AS p FROM r
), ends AS (SELECT min(conv_id) AS conv_id, p FROM h WHERE i = n GROUP BY p),
keep AS (SELECT conv_id FROM ends WHERE p NOT IN (SELECT p FROM h WHERE i < n))
SELECT conv_id, (i - 1) // 256 AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY i) AS text
FROM h SEMI JOIN keep USING (conv_id) GROUP BY conv_id, part""",
    "op2_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, (sum(source_size) OVER () * 150)::DOUBLE / 100 - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS open,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER o AS i
  FROM s WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST)
), level AS (
  SELECT open, rest FROM r WHERE open * weight / rest <= 2 * source_size ORDER BY i LIMIT 1
), t AS (
  SELECT source, source_size, weight, coalesce(least(2 * source_size::DOUBLE, (SELECT open FROM level) * weight / (SELECT rest FROM level)), 2 * source_size::DOUBLE) AS target FROM r
), p AS (
  SELECT doc_id, size, source_size, target, weight, floor(target + 0.5)::BIGINT AS room,
         (sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, greatest(0, least(room - start, size)) AS taken0, greatest(0, least(room - source_size - start, size)) AS taken1,
         least(1.0::DOUBLE, (start + size::DOUBLE / 2) / target) AS y0, least(1.0::DOUBLE, (start + size::DOUBLE / 2 + source_size) / target) AS y1
  FROM p
)
SELECT doc_id, size, source_size, target, (taken0 + taken1)::BIGINT AS taken,
       CASE WHEN taken0 > 0 AND 2 * taken0 >= size THEN floor(1e9::DOUBLE * CASE weight
         WHEN 5 THEN (sqrt(2.25::DOUBLE - 2.0::DOUBLE * y0) - 1.5::DOUBLE) / -1.0::DOUBLE WHEN 2 THEN y0
         ELSE (sqrt(0.25::DOUBLE + 2.0::DOUBLE * y0) - 0.5::DOUBLE) / 1.0::DOUBLE END)::BIGINT END AS first_position,
       CASE WHEN taken1 > 0 AND 2 * taken1 >= size THEN floor(1e9::DOUBLE * CASE weight
         WHEN 5 THEN (sqrt(2.25::DOUBLE - 2.0::DOUBLE * y1) - 1.5::DOUBLE) / -1.0::DOUBLE WHEN 2 THEN y1
         ELSE (sqrt(0.25::DOUBLE + 2.0::DOUBLE * y1) - 0.5::DOUBLE) / 1.0::DOUBLE END)::BIGINT END AS second_position
FROM k""",
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)""",
    "op8_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '\p{L}[^\x20\x09-\x0D]*')) AS n_letter_words,
         len(regexp_extract_all(t, '(^|\n)[\x20\x09]*[-*•]')) AS n_bullets,
         len(regexp_extract_all(t, '(\.\.\.|…)[\x20\x09\x0D]*(\n|\z)')) AS n_ellipses
  FROM d LEFT JOIN rep USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words)
       AND NOT 2 * n_symbols > n_words AND NOT 2 * n_dup_lines > n_lines
       AND NOT 2 * n_letter_words < n_words AND NOT 10 * n_bullets > 9 * n_lines AND NOT 2 * n_ellipses > n_lines AS kept
FROM b""",
}
