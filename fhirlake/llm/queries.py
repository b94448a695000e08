"""The operators on the driver's tables: one query each, with its DuckDB statement where SQL has one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fhirlake.llm import (
    decontamination,
    importance,
    merkle,
    near_duplicates,
    neighbours,
    packing,
    quality,
    repeats,
    secret_scan,
    shards,
    token_counts,
    topk,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), with_kept=False)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), _vocabulary()))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"))
    records = warc.read_archives(spark, manifest, payloads=False)
    page, refers = F.col("page_id").cast("long"), F.col("refers_to").cast("long")
    return records.select(
        page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _vocabulary())


def op8_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word", "rule", F.sha2("value", 256).alias("value_sha256"), "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "words", "similarity")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered=tampered)


QUERIES = {
    "op1_permutation_search": op1_permutation_search,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_repeats": op3_repeats,
    "op4_pack": op4_pack,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_secrets": op7_secrets,
    "op8_shard_by_bytes": op8_shard_by_bytes,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_importance": op11_importance,
    "op12_topk": op12_topk,
    "op13_merkle": op13_merkle,
}

# Of equal payloads of at least 100 bytes the smallest page is stored; equal digests stand for equal payloads.
_OP5 = """
WITH body AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM body),
ranked AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM ranked
"""

# CRC-32, bit by bit over the bytes of a text: {0} is an expression of bytes in hexadecimal form.
_CRC = """
xor(4294967295, list_reduce(
  list_prepend(4294967295, list_transform(range(1, length({0}), 2), lambda i: CAST('0x' || substr({0}, i, 2) AS BIGINT))),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))
))
"""

_OP11 = f"""
WITH RECURSIVE words AS (
  SELECT 's' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
),
features AS (
  SELECT side, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM words
),
counted AS (SELECT side, doc_id, feature, count(*) AS n FROM features GROUP BY ALL),
coded AS (
  SELECT feature, {_CRC.format("h")} % 10000 AS bucket
  FROM (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM counted))
),
placed AS (SELECT side, doc_id, bucket, n FROM counted JOIN coded USING (feature)),
buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM placed GROUP BY bucket
),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM buckets),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1.0::DOUBLE) * (all_s + 10000.0::DOUBLE)) / ((s + 1.0::DOUBLE) * (all_t + 10000.0::DOUBLE)))) AS gain
  FROM buckets, totals
),
weights AS (
  SELECT doc_id, sum(n) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 's' GROUP BY doc_id
),
scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE side = 's'
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM ranked
"""

_OP12 = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _digest(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return f"sha256({' || '.join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in fields)})"


# Level by level: both trees are made from the foot up, then every leaf climbs them with its run of digests.
_OP13 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_digest("text")} AS leaf,
    CASE WHEN {_CRC.format("hex(encode(CAST(doc_id AS VARCHAR)))")} % 5 = 0 THEN {_digest(_LOWER)} END AS altered
  FROM documents
),
numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS total
  FROM leaves
),
nodes(tree, level, idx, total, digest) AS (
  SELECT tree, 0, idx, total, leaf FROM numbered
  UNION ALL
  SELECT tree, level + 1, idx // 16, (any_value(total) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE total > 1 GROUP BY tree, level, idx // 16
),
subroots AS (SELECT tree AS idx, digest FROM nodes WHERE total = 1),
tops(level, idx, total, digest) AS (
  SELECT 0, idx, (SELECT count(*) FROM subroots), digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (any_value(total) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE total > 1 GROUP BY level, idx // 16
),
runs AS (
  SELECT tree, level, idx // 16 AS run, list(digest ORDER BY idx) AS kids FROM nodes WHERE total > 1 GROUP BY tree, level, idx // 16
  UNION ALL
  SELECT -1, level, idx // 16, list(digest ORDER BY idx) FROM tops WHERE total > 1 GROUP BY level, idx // 16
),
heights AS (SELECT tree, max(level) + 1 AS height FROM runs GROUP BY tree),
climb AS (
  SELECT doc_id, leaf, tree AS own, tree, 0 AS level, idx, coalesce(altered, leaf) AS digest, '' AS siblings FROM numbered
  UNION ALL
  SELECT doc_id, leaf, own,
    CASE WHEN done THEN -1 ELSE tree END, CASE WHEN done THEN 0 ELSE level + 1 END, CASE WHEN done THEN own ELSE idx // 16 END,
    CASE WHEN done THEN digest ELSE sha256(array_to_string(kids[:idx % 16] || [digest] || kids[idx % 16 + 2:], '')) END,
    CASE WHEN done THEN siblings ELSE siblings || array_to_string(kids[:idx % 16] || kids[idx % 16 + 2:], '') END
  FROM (
    SELECT c.*, r.kids, c.level >= coalesce(h.height, 0) AS done FROM climb c
    LEFT JOIN heights h ON h.tree = c.tree LEFT JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.idx // 16
    WHERE NOT (c.tree = -1 AND c.level >= coalesce(h.height, 0))
  )
)
SELECT doc_id, leaf, s.digest AS subroot, (SELECT digest FROM tops WHERE total = 1) AS root, sha256(siblings) AS proof_sha256,
  c.digest AS folded_root, c.digest = (SELECT digest FROM tops WHERE total = 1) AS verified
FROM climb c JOIN subroots s ON s.idx = c.own
WHERE c.tree = -1 AND c.level = coalesce((SELECT height FROM heights WHERE tree = -1), 0)
"""

ORACLES: dict[str, str] = {
    "op5_warc": _OP5,
    "op11_importance": _OP11,
    "op12_topk": _OP12,
    "op13_merkle": _OP13,
}
