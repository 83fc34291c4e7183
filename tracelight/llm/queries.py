"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelight.llm.bpe_duckdb import bpe_round_trip
from tracelight.llm.common import table
from tracelight.llm.embedding_dedup import embedding_links
from tracelight.llm.langid import identify
from tracelight.llm.ngram_jaccard import ngram_jaccard
from tracelight.llm.packing import pack
from tracelight.llm.pii import find_pii
from tracelight.llm.quality import quality_model, quality_scores
from tracelight.llm.sharding import label_propagation_shards
from tracelight.llm.suffix_dedup import suffix_dedup
from tracelight.llm.tiff_media import tiff_media


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_propagation_shards(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_media(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, quality_model(docs, table(spark, sf_dir, "labels")))


_ALL = (op1_suffix_dedup, op2_sharding, op3_ngram_jaccard, op4_tiff_media, op5_packing, op6_language_id, op7_byte_bpe, op8_pii, op9_embedding_dedup, op10_quality)
QUERIES = {f.__name__: f for f in _ALL}

_COMPONENTS = """
reach(node, root) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
answer AS (
  SELECT n.id, (SELECT count(*) FROM links l WHERE l.a = n.id)::BIGINT AS n_links, c.root
  FROM nodes n JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) c ON c.node = n.id)"""

#: SQL for the rows, on tables whose ids are unique and not null.  What a model decides has none.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes s ON s.doc_id = c.a JOIN sizes t ON t.doc_id = c.b WHERE 10 * c.n >= 8 * (s.n + t.n - c.n)),
nodes AS (SELECT doc_id AS id FROM documents),{_COMPONENTS}
SELECT id AS doc_id, n_links, root AS class_id, root = id AS kept FROM answer""",
    "op9_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
nodes AS (SELECT vec_id AS id FROM embeddings),{_COMPONENTS}
SELECT id AS vec_id, n_links, root AS component_id, root = id AS kept FROM answer""",
}
