"""Views of the driver tables in the shapes that the linking operators read, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ours: separates the parts of a disambiguation; must not occur in names.
CONNECTOR = "\x1f"
SYMBOL, NON_SYMBOL = 0, 1


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def kb(spark: SparkSession, d: str) -> DataFrame:
    """uid, identifier, string_identifier, name, description, foreign_identifier, disambiguation"""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("uid"),
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("identifier"),
        F.col("p_brand").alias("string_identifier"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"),
        F.when(F.col("p_size") % 2 == 0, SYMBOL).otherwise(NON_SYMBOL).alias("description"),
        (F.col("p_partkey") % 5).alias("foreign_identifier"),
        F.lit("").alias("disambiguation"),
    )


KB_SQL = """kb AS (SELECT p_partkey AS uid, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS identifier, p_brand AS string_identifier,
  p_name || ' ' || p_size AS name, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS description, p_partkey % 5 AS foreign_identifier, '' AS disambiguation FROM part)"""


def foreign(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("foreign_identifier"), F.col("r_name").alias("foreign_name"))


FOREIGN_SQL = "fi AS (SELECT CAST(r_regionkey AS BIGINT) AS foreign_identifier, r_name AS foreign_name FROM region)"


def kb_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All vectors: the index side."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("uid"), "embedding", F.col("label").cast("long").alias("identifier"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """mention, embedding, gold: every vector whose id is divisible by 50, with its label, and for every other one the next label too."""
    label = F.col("label").cast("long")
    gold = F.when(F.col("vec_id") % 100 == 0, F.array(label, (label + 1) % 10)).otherwise(F.array(label))
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("mention"), "embedding", gold.alias("gold"))


VECTORS_SQL = """kv AS (SELECT vec_id AS uid, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS BIGINT) AS identifier FROM embeddings),
qv AS (SELECT vec_id AS mention, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS BIGINT) AS label,
  CASE WHEN vec_id % 100 = 0 THEN [CAST(label AS BIGINT), CAST((label + 1) % 10 AS BIGINT)] ELSE [CAST(label AS BIGINT)] END AS gold FROM embeddings WHERE vec_id % 50 = 0)"""


def passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("eid"), F.col("turn").alias("passage_id"), "role", "text")


PASSAGES_SQL = "pa AS (SELECT conv_id AS eid, turn AS passage_id, role, text FROM conversations)"


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, sentence_id (from 0), passage_id (a new one every third sentence), text"""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("sentence_id", "text"))
    return lines.withColumn("passage_id", F.floor(F.col("sentence_id") / 3).cast("int"))


SENTENCES_SQL = """se AS (SELECT doc_id, i - 1 AS sentence_id, ls[i] AS text, CAST(floor((i - 1) / 3) AS INT) AS passage_id
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.max("l_suppkey").alias("supplier"), F.min("l_linestatus").alias("status"), F.max("l_returnflag").alias("flag")
    )


def hexdigest(doc: Column, start: Column) -> Column:
    """A mention's digest from its place: made again after joins, it needn't be shuffled."""
    return F.sha2(F.concat_ws("-", doc, (start / 10).cast("int")), 256)


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """doc, start, end, hexdigest, identifier, supplier, status, flag, is_foreign: one mention per order and line number."""
    s = _spans(spark, d)
    return s.select(
        F.col("l_orderkey").alias("doc"),
        (F.col("l_linenumber") * 10).cast("long").alias("start"),
        (F.col("l_linenumber") * 10 + 5).cast("long").alias("end"),
        F.sha2(F.concat_ws("-", "l_orderkey", "l_linenumber"), 256).alias("hexdigest"),
        F.col("part").alias("identifier"),
        "supplier", "status", "flag", (F.col("part") % 7 == 0).alias("is_foreign"),
    )


ANNOTATIONS_SQL = """an AS (SELECT l_orderkey AS doc, CAST(l_linenumber * 10 AS BIGINT) AS start, CAST(l_linenumber * 10 + 5 AS BIGINT) AS "end", sha256(l_orderkey || '-' || l_linenumber) AS hexdigest,
  min(l_partkey) AS identifier, max(l_suppkey) AS supplier, min(l_linestatus) AS status, max(l_returnflag) AS flag, min(l_partkey) % 7 = 0 AS is_foreign FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def metric_log(spark: SparkSession, d: str) -> DataFrame:
    """run, ts, event_id, metric"""
    return table(spark, d, "events").select(F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("metric"))


def typed_annotations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("type"), F.col("event_id").alias("id"))


