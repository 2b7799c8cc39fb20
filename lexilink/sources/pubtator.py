"""PubTator and related line formats: readers and writers as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_texts(lines: DataFrame) -> DataFrame:
    """(pmid, kind, text) of the title (`t`) and abstract (`a`) lines of (value)."""
    parts = F.split("value", r"\|", 3)
    found = lines.where(F.col("value").rlike(r"^\d+\|[ta]\|"))
    return found.select(F.get(parts, F.lit(0)).cast("long").alias("pmid"), F.get(parts, F.lit(1)).alias("kind"), F.get(parts, F.lit(2)).alias("text"))


def parse_annotations(lines: DataFrame) -> DataFrame:
    """(pmid, start, end, text, type, ids) of the six-column lines; relations, with five, are left out. Ids are split at , ; and |, and Tax:, MESH: and * prefixes go."""
    parts = F.split("value", "\t", -1)
    rows = lines.withColumn("p", parts).where((F.size("p") >= 5) & F.get("p", F.lit(1)).rlike(r"^\d+$") & F.get("p", F.lit(2)).rlike(r"^\d+$"))
    return rows.select(
        F.get("p", F.lit(0)).cast("long").alias("pmid"), F.get("p", F.lit(1)).cast("int").alias("start"), F.get("p", F.lit(2)).cast("int").alias("end"),
        F.get("p", F.lit(3)).alias("text"), F.get("p", F.lit(4)).alias("type"), normalise_ids(F.coalesce(F.get("p", F.lit(5)), F.lit(""))).alias("ids"),
    )


def normalise_ids(ids: Column) -> Column:
    """Array of single ids without prefixes, empty ones and `-`."""
    bare = F.transform(F.split(ids, r"[|,;]", -1), lambda i: F.regexp_replace(F.trim(i), r"^\*|^(Tax|MESH):", ""))
    return F.filter(bare, lambda i: ~i.isin("", "-"))


def read_pubtator(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path)
    return parse_texts(lines), parse_annotations(lines)


def format_documents(passages: DataFrame) -> DataFrame:
    """(eid, title, abstract): lines `eid|t|...` and `eid|a|...`; the first passage is the title, the rest, joined by spaces, the abstract."""
    g = passages.groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("passage_id", "text"))), lambda s: s["text"]).alias("texts"))
    rest = F.array_join(F.slice("texts", F.lit(2), F.size("texts")), " ")
    return g.select("eid", F.concat_ws("|", "eid", F.lit("t"), F.get("texts", F.lit(0))).alias("title"), F.concat_ws("|", F.col("eid"), F.lit("a"), rest).alias("abstract"))


def append_annotations(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """(doc, place, type, id): each document's new annotations before its old ones."""
    both = new.withColumn("source", F.lit(0)).unionByName(old.withColumn("source", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("source", order))).select("doc", "place", "type", "id")


def concept_line(doc: Column, start: Column, end: Column, kind: Column, text: Column, ids: Column) -> Column:
    """doc||start|end||type||text||id|id"""
    return F.concat_ws("||", doc.cast("string"), F.concat_ws("|", start.cast("string"), end.cast("string")), kind, text, F.array_join(ids, "|"))
