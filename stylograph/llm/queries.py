"""One query per operator, over the driver's tables, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograph.llm import (
    bpe, clustering, exact_dedup, merkle, near_dedup, packing, passages, quality, speculative_bpe, token_files, topk, url_filter, warc,
)
from stylograph.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf, "pages"), url_filter.rule_table(spark, RULES))


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(table(spark, sf, "documents"))
    return rows.withColumnRenamed("digest", "text_sha256").drop("n_chars")


def op3_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents")).drop("version")


def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), TOKENIZER)


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return passages.dedup_passages(table(spark, sf, "documents")).select("doc_id", "text", "lines_removed")


def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf, "pages")).drop("url", "payload")


def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = token_files.token_files(table(spark, sf, "documents"), TOKENIZER)
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_byte_level_bpe(spark: SparkSession, sf: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, sf, "documents"), RANKS, public_tokenizers.PATTERN)
    return rows.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = merkle.build(
        table(spark, sf, "documents"), "doc_id", "source", merkle.leaf_of(*fields, F.col("text")), {"found": merkle.leaf_of(*fields, changed)}
    )
    root = F.lit(manifest.root).cast("string")
    return merkle.proofs(manifest).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
        merkle.folded(F.col("keep_found"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    rows = clustering.clusters(table(spark, sf, "embeddings"))
    return rows.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def op13_speculative_bpe(spark: SparkSession, sf: str) -> DataFrame:
    rows = speculative_bpe.round_trip(table(spark, sf, "documents"), WORD_TOKENIZER)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


OP1_SQL = """
WITH rules(verdict, host, path) AS (VALUES {rules}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
judged AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE place = 1
""".format(rules=", ".join(str(r) for r in RULES))

OP2_SQL = """
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS content, length(coalesce(text, '')) AS n
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY content) AS group_size FROM texts)
"""

OP6_SQL = """
WITH digests AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, unhex(sha1(encode(coalesce(html, ''))))::BIT::VARCHAR AS bits FROM pages),
rows AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS original,
         array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, 1 + 5 * i, 5))::INTEGER, 1)), '') AS payload_digest
  FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM rows
"""

OP8_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""

OP11_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
OP11_LEAF = "sha256(" + " || ".join(OP11_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
OP11_EVEN = """
list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(length(doc_id::VARCHAR)), lambda i:
  list_transform(range(8), lambda b: ((ascii(substr(doc_id::VARCHAR, i + 1, 1)) >> b::INTEGER) & 1)::BIGINT)))),
  lambda s, bit: xor(s >> 1, 3988292384 * (xor(s, bit) & 1))) % 2 = 1
"""  # the last step of the crc turns every bit round
OP11_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, 'n') AS grp, {OP11_LEAF.format(text="text")} AS leaf,
         CASE WHEN {OP11_EVEN} THEN {OP11_LEAF.format(text="replace(text, chr(10), '')")} ELSE {OP11_LEAF.format(text="text")} END AS found
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
nodes AS (
  SELECT grp, 0 AS level, pos, leaf AS hash, n FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), any_value((n + 2) // 3) FROM nodes WHERE n > 1 GROUP BY grp, level, pos // 3),
subroots AS MATERIALIZED (SELECT grp, hash, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, pos, hash, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), any_value((n + 2) // 3) FROM upper WHERE n > 1 GROUP BY level, pos // 3),
paths AS (
  SELECT p.rid, v.level, x.pos AS spot, p.pos // (3 ** v.level)::BIGINT AS own, x.hash
  FROM placed p JOIN (SELECT DISTINCT grp, level FROM nodes WHERE n > 1) v ON v.grp = p.grp
  JOIN nodes x ON x.grp = p.grp AND x.level = v.level AND x.pos // 3 = p.pos // (3 ** (v.level + 1))::BIGINT
  UNION ALL
  SELECT p.rid, 1000 + v.level, x.pos, s.pos // (3 ** v.level)::BIGINT, x.hash
  FROM placed p JOIN subroots s ON s.grp = p.grp CROSS JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) v
  JOIN upper x ON x.level = v.level AND x.pos // 3 = s.pos // (3 ** (v.level + 1))::BIGINT),
steps AS MATERIALIZED (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY level) AS step,
         coalesce(string_agg(hash, '' ORDER BY spot) FILTER (WHERE spot < own), '') AS before, coalesce(string_agg(hash, '' ORDER BY spot) FILTER (WHERE spot > own), '') AS after
  FROM paths GROUP BY rid, level),
folds AS (
  SELECT rid, 0 AS step, found AS hash FROM placed
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(s.before || f.hash || s.after) FROM folds f JOIN steps s ON s.rid = f.rid AND s.step = f.step + 1),
proofs AS (SELECT rid, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY rid)
SELECT p.doc_id, p.leaf, s.hash AS subroot, u.hash AS root, coalesce(r.proof_sha256, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = u.hash AS verified
FROM placed p JOIN subroots s USING (grp) JOIN upper u ON u.n = 1 LEFT JOIN proofs r USING (rid)
JOIN (SELECT rid, arg_max(hash, step) AS hash FROM folds GROUP BY rid) f USING (rid)
"""


def _op12_sql(k: int = 8, width: int = 64, rounds: int = 10) -> str:
    """Every round written out: assignments a0, a1, ... and centroids c0, c1, ..."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), v) - 1)::INTEGER AS cluster, v AS c FROM kept QUALIFY cluster < {k})"""]
    for step in range(rounds + 1):
        steps.append(f"""
a{step} AS MATERIALIZED (
  SELECT vec_id, v, cluster, distance FROM (
    SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance, row
    FROM (SELECT *, row_number() OVER () AS row FROM kept) CROSS JOIN c{step})
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if step < rounds:
            steps.append(f"""
c{step + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, o.c) AS c FROM c{step} o LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS c
    FROM (SELECT cluster, d, sum(v[d]) AS s, count(*) AS n FROM a{step} CROSS JOIN range(1, {width + 1}) t(d) GROUP BY cluster, d) GROUP BY cluster) m USING (cluster))""")
    last = f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
    return "WITH" + ",".join(steps) + last


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_exact_dedup, op3_minhash_near_dedup, op4_best_fit_packing, op5_line_dedup, op6_warc, op7_token_files, op8_exact_top_k, op9_byte_level_bpe, op10_quality_classifier, op11_merkle_manifest, op12_centroid_clustering, op13_speculative_bpe)}
ORACLES = {"op1_url_filter": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op6_warc": OP6_SQL, "op8_exact_top_k": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_centroid_clustering": _op12_sql()}
