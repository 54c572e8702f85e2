"""Queries of the corpus operators over whole tables, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import decontaminate
from .filter_audit import audit_filters
from .language_id import identify_languages, train_language_id
from .license_scan import scan_licenses
from .license_texts import DIGESTS, IDENTIFIERS, LICENSES, NOTICES, SPELLINGS, TITLES
from .lm_scoring import score_documents
from .minhash import near_duplicates
from .mixing import mix_sources
from .quality_rules import apply_rules
from .sharding import shard_by_bytes
from .simhash import simhash_duplicates
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .token_counts import token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir), min_words=13)
    return out.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), firsts AS (
  SELECT s, min(doc_id) AS m FROM win GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (s) WHERE m < doc_id)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(documents(spark, sf_dir), benchmark).drop("row_key")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(documents(spark, sf_dir), ~held_out(10, 0))
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, passes=2)
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, ([3.0, 1.0, 2.0])[place % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
    (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT *, coalesce(least(cap, (SELECT arg_min(level, (ratio, place)) FROM l WHERE level <= ratio) * weight), cap) AS target FROM l
), c AS (
  SELECT doc_id, size, h, place, budget, source_size, target,
    sum(size) OVER (PARTITION BY place ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT doc_id, size, budget, sum(size) OVER (ORDER BY CASE WHEN target > 0 THEN (pass * source_size + upto) / target ELSE 2.0 END, place, pass, h, doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM c, (VALUES (0), (1)) p(pass) WHERE size > 0
), k AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM q WHERE run <= budget GROUP BY doc_id
)
SELECT c.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN k ON k.doc_id = c.doc_id
"""


def held_out(modulus: int, rest: int):
    """True for the documents whose crc32(doc_id as text) leaves this rest."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == rest


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_language_id(docs.where(~held_out(4, 2)))
    out = identify_languages(docs, model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "accepted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = apply_rules(documents(spark, sf_dir), labels)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken"
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _spelled_sql(x: str) -> str:
    x = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    x = rf"regexp_replace({x}, '(^|\n)[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[\[<{{]|[12][0-9]{{3}})|\(c\)[ \t]*[12][0-9]{{3}}|©)(?:[^\n]*(?:,| and|&)[ \t\r]*\n[ \t]*[a-z])*[^\n]*', '\1', 'g')"
    x = rf"regexp_replace({x}, '^([^\n]{{0,60}}licen[sc]e[^\n]{{0,60}}\n)?[ \t-\r]*copyright[ \t][^\n]*\n', '\1')"
    return x


def _digest_sql(x: str) -> str:
    x = rf"regexp_replace(' ' || {x} || ' ', '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')"
    for other, word in SPELLINGS:
        x = f"replace({x}, {_sql_text(other)}, {_sql_text(word)})"
    return rf"sha256(regexp_replace(trim(replace({x}, ' all rights reserved ', ' ')), {_sql_text('^(?:(?:the )?(?:' + '|'.join((*TITLES, *('spdx license identifier ' + i for i in IDENTIFIERS))) + ') )+([a-z0-9])')}, '\1'))"


def op8_sql() -> str:
    known = ", ".join(f"({_sql_text(n)}, '{k}', {_sql_text(t)})" for k, rows in (("text", LICENSES), ("line", NOTICES)) for n, t in rows)
    long = ", ".join(f"({_sql_text(n)}, '{d}')" for n, d in DIGESTS)
    return f"""
WITH known AS (
  SELECT kind, {_digest_sql(_spelled_sql("x"))} AS digest, min(license_id) AS license_id
  FROM (VALUES {known}) v(license_id, kind, x) GROUP BY ALL
  UNION ALL SELECT 'text', digest, license_id FROM (VALUES {long}) v(license_id, digest)
), whole AS (
  SELECT digest, min(license_id) AS license_id FROM known GROUP BY digest
), d AS (
  SELECT doc_id, {_spelled_sql("coalesce(text, '')")} AS s FROM documents
), hits AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT doc_id, {_digest_sql("line")} AS digest FROM (SELECT doc_id, unnest(string_split(s, chr(10))) AS line FROM d))
  JOIN known USING (digest) WHERE kind = 'line' GROUP BY doc_id
)
SELECT d.doc_id, {_digest_sql("s")} AS text_digest, whole.license_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN whole ON whole.digest = {_digest_sql("s")} LEFT JOIN hits ON hits.doc_id = d.doc_id
"""


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), shingle_words=5, percent=75)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 75 * (nu.n + nv.n - c)
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
)
SELECT reach.u AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(v) AS component_id, reach.u = min(v) AS kept
FROM reach LEFT JOIN n ON n.doc_id = reach.u GROUP BY reach.u
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(documents(spark, sf_dir), shards=24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), seen AS (
  SELECT x, min(doc_id) AS first FROM t GROUP BY x
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
    'C': 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x),
    'D': regexp_matches(x, '[#$%&*|]'), 'E': coalesce(t.doc_id > first, first IS NOT NULL)} AS fails
  FROM t JOIN seen USING (x) LEFT JOIN said ON said.doc_id = t.doc_id
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS earlier
  FROM o, range(1, 6) r(step)
), k AS (
  SELECT doc_id, part, good, toxic, map_values(m) AS v, m FROM (
    SELECT *, MAP {'A': fails.A, 'B': fails.B, 'C': fails.C, 'D': fails.D, 'E': fails.E} AS m FROM f)
), r AS (
  SELECT k.part, s.filter_order, s.step, s.own, good, toxic, m[s.own] AS now,
         len(list_filter(s.earlier, lambda c: c <> '' AND m[c])) > 0 AS gone, len(list_filter(v, lambda y: y)) AS n
  FROM k, s
), a AS (
  SELECT part, filter_order, step, any_value(own) AS own,
    count(*) FILTER (NOT gone AND NOT now) AS kept, count(*) FILTER (NOT gone AND now) AS removed,
    count(*) FILTER (gone AND now) AS redundant, count(*) FILTER (now AND n = 1) AS unique_fails,
    count(*) FILTER (NOT gone AND now AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND now AND toxic = 1) AS toxic_lost
  FROM r GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_decontamination": op3_decontamination,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_mixing": op5_mixing,
        "op6_language_id": op6_language_id,
        "op7_quality_rules": op7_quality_rules,
        "op8_license_scan": op8_license_scan,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_sharding": op10_sharding,
        "op11_filter_audit": op11_filter_audit,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_simhash_near_dedup": op13_simhash_near_dedup,
    }


def oracle_sql() -> dict:
    return {
        "op1_substring_dedup": OP1_SQL,
        "op5_mixing": OP5_SQL,
        "op8_license_scan": op8_sql(),
        "op9_minhash_near_dedup": OP9_SQL,
        "op11_filter_audit": OP11_SQL,
    }
