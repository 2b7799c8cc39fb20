"""Dictionaries over the knowledge base: by name, by identifier, synonym sets, codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilink.operators.sharding import global_row_number
from lexilink.sources.fixtures import NON_SYMBOL, SYMBOL


def subset(kb: DataFrame, foreign_ids: list[int]) -> DataFrame:
    return kb.where(F.col("foreign_identifier").isin(foreign_ids))


def name_dictionary(kb: DataFrame, subset: list[int] | None = None) -> DataFrame:
    """One row per name: its least uid, and all identifiers with repeats, ascending."""
    rows = kb if subset is None else kb.where(F.col("foreign_identifier").isin(subset))
    return rows.groupBy("name").agg(F.min("uid").alias("uid"), F.array_sort(F.collect_list("identifier")).alias("identifiers"))


def id_to_names(kb: DataFrame) -> DataFrame:
    return kb.groupBy("identifier").agg(F.array_sort(F.collect_set("name")).alias("names"))


def pipe_dictionary(kb: DataFrame) -> DataFrame:
    """Lines `id||name|name`, without empty names."""
    names = kb.where("name <> ''").groupBy("string_identifier").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return names.select(F.concat(F.col("string_identifier"), F.lit("||"), F.array_join("names", "|")).alias("line"))


def synsets(kb: DataFrame) -> DataFrame:
    """identifier, title (the first symbol, or else the first other name) and text; kb has foreign_name."""
    g = kb.groupBy("identifier").agg(
        F.min_by(F.when(F.col("description") == SYMBOL, F.col("name")), F.when(F.col("description") == SYMBOL, F.col("uid"))).alias("symbol"),
        F.array_sort(F.collect_set(F.when(F.col("description") == NON_SYMBOL, F.col("name")))).alias("others"),
        F.min_by("foreign_name", "uid").alias("species"),
    )
    title = F.coalesce("symbol", F.get("others", F.lit(0)))
    text = F.concat(title, F.lit(" ( ["), F.col("species"), F.lit("] "), F.array_join("others", " ; "), F.lit(" )"))
    return g.select("identifier", title.alias("title"), F.when(F.size("others") > 0, text).otherwise("").alias("text"))


def last_wins(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the value of each key's last row."""
    return df.groupBy(F.col(key).alias("key")).agg(F.max_by(value, F.struct(*order)).alias("value"))


def ordinal(df: DataFrame, by: str, name: str, first: int = 0) -> DataFrame:
    """Rows numbered in the order of `by`."""
    return global_row_number(df, [by], name, first)


def assign_codes(names: DataFrame, known: DataFrame, key: str, code: str) -> DataFrame:
    """Known codes, and for new keys the next ones in key order."""
    top = known.agg(F.coalesce(F.max(code), F.lit(-1)).alias("top"))
    fresh = ordinal(names.join(known, key, "left_anti"), key, "n", first=1)
    return known.select(key, code).unionByName(fresh.join(F.broadcast(top)).select(key, (F.col("n") + F.col("top")).alias(code)))


def inverted(df: DataFrame, key: str, value: str) -> DataFrame:
    """(value, key) of a map without repeated values; a value that several keys have is an error."""
    unique = F.when(F.min(key) == F.max(key), F.min(key)).otherwise(F.raise_error(F.concat(F.lit("several keys have "), F.col(value).cast("string"))).cast(df.schema[key].dataType))
    return df.groupBy(value).agg(unique.alias(key))
