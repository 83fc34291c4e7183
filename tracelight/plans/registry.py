"""Where queries and the SQL that defines them are put down side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function ``(spark, sf_dir)``, and the SQL for its rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A tree of files made from the documents: paths of several kinds, some of them odd.
FILES_SQL = """files AS (
  SELECT doc_id, lang, source, text, octet_length(encode(text)) AS bytes,
    CASE WHEN doc_id % 13 = 0 THEN './' WHEN doc_id % 13 = 1 THEN 'lib\\' WHEN doc_id % 13 = 2 THEN 'node_modules/' WHEN doc_id % 13 = 3 THEN 'src//' WHEN doc_id % 13 = 4 THEN 'a/../b/' ELSE 'src/' END
    || lang || '/' || source || '/doc' || doc_id ||
    CASE WHEN doc_id % 7 = 0 THEN '.js' WHEN doc_id % 7 = 1 THEN '.py' WHEN doc_id % 7 = 2 THEN '.ts' WHEN doc_id % 7 = 3 THEN '.min.js' WHEN doc_id % 7 = 4 THEN '.ZIP' WHEN doc_id % 7 = 5 THEN '.TXT' ELSE '' END AS path
  FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    top = F.when(k % 13 == 0, "./").when(k % 13 == 1, "lib\\").when(k % 13 == 2, "node_modules/").when(k % 13 == 3, "src//").when(k % 13 == 4, "a/../b/").otherwise("src/")
    end = F.when(k % 7 == 0, ".js").when(k % 7 == 1, ".py").when(k % 7 == 2, ".ts").when(k % 7 == 3, ".min.js").when(k % 7 == 4, ".ZIP").when(k % 7 == 5, ".TXT").otherwise("")
    path = F.concat(top, "lang", F.lit("/"), "source", F.lit("/doc"), k.cast("string"), end)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", F.octet_length("text").alias("bytes"), path.alias("path"))
