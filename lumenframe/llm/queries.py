"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import decontamination, exact_dedup, html_text, language, near_dedup, periodic_runs, quality, sentencepieces, sharding, token_counts, top_inner, toxicity, vector_codes
from lumenframe.llm.text import crc_fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.fit(docs, labels), ["doc_id"])
    predicted = (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", (crc_fold(scored, quality.FOLDS) == 0).alias("held_out"), F.col("quality_score").alias("score"), predicted)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"])
    predicted = (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", (crc_fold(scored, toxicity.FOLDS) == 0).alias("held_out"), F.col("toxic_score").alias("score"), predicted)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", crc_fold(docs, 4) == 2)
    trees = language.fit(docs.where(~F.col("held_out")))
    return language.predict(docs, trees, keep=("doc_id", "held_out"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=2)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    told = vector_codes.with_label_errors(coded)
    return told.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(periodic_runs.repeated_from_within(table(spark, sf_dir, "documents")))
    best, line = periodic_runs.longest(F.col("runs")), lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(F.transform("runs", line), "").alias("lines"), "collapsed")
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_top_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner.search(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END) AS g FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b.y FROM reached r JOIN both_ways b ON b.x = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

#: The pages of the given table have one article each, with headings, paragraphs, breaks and bold text.
OP7_SQL = """
WITH bodies AS (
  SELECT page_id, url, regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g') AS body FROM pages
), blocks AS (
  SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1|br)>'), lambda x:
    trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) AS b FROM bodies
), texts AS (
  SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM blocks
)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP10_SQL = """
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), digits AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), sums AS (
  SELECT doc_id, length(h) // 2 + 1 AS size,
         xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
             lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM digits, tab
), scores AS (
  SELECT doc_id, s AS shard, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT AS u
  FROM documents, range(17) r(s)
), dealt AS (
  SELECT doc_id, max_by(shard, u) FILTER (shard < 16) AS shard, max_by(shard, u) AS grown_shard FROM scores GROUP BY doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM sums JOIN dealt USING (doc_id)
"""

PARTS, ENTRIES, ROUNDS = 8, 16, 6
OP11_START = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v, len(embedding) // {PARTS} AS d
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS MATERIALIZED (
  SELECT vec_id, (i - 1) // d AS p, (i - 1) % d AS i, v[i] AS x FROM kept, unnest(range(1, len(v) + 1)) r(i)
), first_ones AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM kept QUALIFY j < {ENTRIES}
), book0 AS MATERIALIZED (SELECT p, j, i, x AS c FROM cells JOIN first_ones USING (vec_id))
"""
#: Of squared distance times ENTRIES plus the entry's index the least is taken, so ties go to the lower index.
OP11_NEAREST = """, near{n} AS MATERIALIZED (
  SELECT vec_id, p, min(w) % {e} AS j, min(w) // {e} AS error
  FROM (SELECT vec_id, p, j, sum((x - c) * (x - c))::BIGINT * {e} + j AS w FROM cells JOIN book{n} USING (p, i) GROUP BY vec_id, p, j) GROUP BY vec_id, p
)
"""
OP11_MOVE = """, sums{n} AS (SELECT p, j, i, sum(x)::BIGINT AS s, count(*) AS n FROM near{n} JOIN cells USING (vec_id, p) GROUP BY p, j, i),
book{m} AS MATERIALIZED (SELECT p, j, i, coalesce((s - (s % n + n) % n) // n, c) AS c FROM book{n} LEFT JOIN sums{n} USING (p, j, i))
"""
OP11_SQL = (
    OP11_START
    + "".join(OP11_NEAREST.format(n=n, e=ENTRIES) + OP11_MOVE.format(n=n, m=n + 1) for n in range(ROUNDS))
    + OP11_NEAREST.format(n=ROUNDS, e=ENTRIES)
    + f"""
, coded AS (
  SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(error)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, j, i)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
)

OP12_SQL = """
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         xor(list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT),
             lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM documents, tab
), ruled AS (
  SELECT doc_id, w, h, (h // 10) % len(w) AS a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p FROM split
), docs AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM ruled
), words AS MATERIALIZED (
  SELECT doc_id, len(w) AS n, i - 1 AS i, w[i] AS word FROM docs, unnest(range(1, len(w) + 1)) r(i)
), equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), told AS (
  SELECT doc_id, count(*) AS n_runs, first({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scores QUALIFY rank <= 5
"""

QUERIES = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_decontamination": op4_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_near_dedup": op6_near_dedup,
    "op7_html_text": op7_html_text,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_top_inner": op13_top_inner,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op6_near_dedup": OP6_SQL, "op7_html_text": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op10_sharding": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_top_inner": OP13_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
