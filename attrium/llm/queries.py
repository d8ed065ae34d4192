"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from .compression import calibrate, quality_rules
from .exact import exact_duplicates
from .importance import importance_resample
from .knn import voronoi_top_k
from .langid import identify
from .line_dedup import dedup_lines
from .mixing import form, mix
from .negatives import hard_negatives
from .pagediff import extract_pages
from .pieces import encode_pieces
from .simhash import simhash_components
from .store import discard
from .urlfilter import judge_urls
from .warc import archived


__all__ = ["ORACLES", "QUERIES", "discard"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    found = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT keyed.*, coalesce(often.last_doc <> keyed.doc_id, false) AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op2_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, zstd_ratio,
    bad_chunks, reason. The bands come from documents that labels calls good."""
    docs = _table(spark, sf_dir, "documents")
    return quality_rules(docs, bands=calibrate(docs, _table(spark, sf_dir, "labels").filter("quality = 1")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, the selected languages and their proportions."""
    return identify(_table(spark, sf_dir, "documents"))


def op5_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return voronoi_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, s.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(s.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ok q JOIN ok s ON q.vec_id % 50 = 0 AND q.vec_id <> s.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked ratio, probability, weight, whether it is kept, and copies."""
    found = mix(_table(spark, sf_dir, "documents"), form(F.col("text")))
    return found.drop("settled").withColumns({c: F.round(c, 9) for c in ("ratio", "probability", "weight")})


def _op6_sql(rounds: int = 40, share: float = 0.8) -> str:
    powers = {"source": 0.5, "lang": 0.7, "topic": 1.0}
    steps, last = [], {d: f"t_{d}" for d in powers}
    for d, power in powers.items():
        steps.append(
            f"t_{d} AS MATERIALIZED (SELECT {d}, pow(had, {power}) / sum(pow(had, {power})) OVER () * sum(had) OVER () AS target, CAST(1 AS DOUBLE) AS f "
            f"FROM (SELECT {d}, CAST(sum(tokens) AS DOUBLE) AS had FROM cells GROUP BY {d}))"
        )
    for i in range(rounds):
        for d in powers:
            x, y = (last[o] for o in powers if o != d)
            m, n = (o for o in powers if o != d)
            steps.append(
                f"r{i}_{d} AS MATERIALIZED (SELECT t.{d}, CASE WHEN had > 0 THEN target / had ELSE 1 END AS f FROM t_{d} t JOIN "
                f"(SELECT c.{d}, sum(c.tokens * x.f * y.f) AS had FROM cells c JOIN {x} x ON x.{m} = c.{m} JOIN {y} y ON y.{n} = c.{n} GROUP BY c.{d}) h ON h.{d} = t.{d})"
            )
            last[d] = f"r{i}_{d}"
    joins = " ".join(f"JOIN {last[d]} f_{d} ON f_{d}.{d} = c.{d}" for d in powers)
    return f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN text IS NULL THEN '(none)'
         WHEN len(regexp_extract_all(text, ' \\| ')) / greatest(length(text), 1) > 0.02 THEN 'table'
         WHEN len(regexp_extract_all(text, '[#*$%&<>]')) / greatest(length(text), 1) > 0.1 THEN 'symbols'
         WHEN len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1) > 0.1 THEN 'digits'
         WHEN length(text) < 400 THEN 'short' ELSE 'prose' END AS topic,
    CAST(coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS BIGINT) AS tokens
  FROM documents
), cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM docs GROUP BY ALL),
{", ".join(steps)},
fitted AS MATERIALIZED (SELECT c.source, c.lang, c.topic, CASE WHEN c.tokens > 0 THEN f_source.f * f_lang.f * f_topic.f ELSE 1 END AS ratio FROM cells c {joins}),
drawn AS (
  SELECT d.*, ratio, least(1.0, ratio * {share}) AS p, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM docs d JOIN fitted USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, tokens, round(ratio, 9) AS ratio, round(p, 9) AS probability, round(ratio * {share} / p, 9) AS weight, u < p AS kept,
  CAST(floor(ratio * {share}) + CASE WHEN u < ratio * {share} - floor(ratio * {share}) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM drawn
"""


def op7_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract_pages(_table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score."""
    return judge_urls(_table(spark, sf_dir, "pages"))


def op9_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return archived(_table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


def model_path() -> str:
    """The SentencePiece model: PIECE_MODEL, else where the public tokenizers are installed."""
    return os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, score, n_best (scores and changes), round_trip."""
    return encode_pieces(_table(spark, sf_dir, "documents"), model_path())


def op11_exact_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    found = exact_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "keep_id", "group_size", "kept", F.sha2(F.coalesce("doc.text", F.lit("")), 256).alias("text_sha256"))


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank: documents towards the distribution of benchmark."""
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# CRC32 bit by bit gives the table of bytes, and that the CRC of each feature
OP12_SQL = """
WITH steps AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS crc_of
), words AS MATERIALIZED (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), features AS MATERIALIZED (
  SELECT kind, id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM words
), coded AS MATERIALIZED (
  SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM features)
), hashed AS MATERIALIZED (
  SELECT f, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM coded, steps
), counted AS MATERIALIZED (
  SELECT kind, id, bucket, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY ALL
), buckets AS (
  SELECT range AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000)
  LEFT JOIN (SELECT bucket, sum(n) FILTER (WHERE kind = 'd') AS s, sum(n) FILTER (WHERE kind = 'b') AS t FROM counted GROUP BY bucket) ON bucket = range
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM buckets
), weighed AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM counted JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed ON id = doc_id
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS total FROM scored WHERE n_features >= 39
)
SELECT scored.*, CASE WHEN r <= 25 * total // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


OP13_SQL = """
WITH ok AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, s.vec_id, a.label = s.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(s.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ok a JOIN ok s ON a.vec_id % 50 = 0 AND a.vec_id <> s.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_compression_rules,
        op3_simhash,
        op4_language_mixture,
        op5_voronoi_topk,
        op6_mix_sources,
        op7_page_difference,
        op8_url_filter,
        op9_warc_chain,
        op10_pieces,
        op11_exact_fingerprints,
        op12_importance_resample,
        op13_hard_negatives,
    )
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op5_voronoi_topk": OP5_SQL, "op6_mix_sources": _op6_sql(), "op9_warc_chain": OP9_SQL, "op11_exact_fingerprints": OP11_SQL, "op12_importance_resample": OP12_SQL, "op13_hard_negatives": OP13_SQL}
