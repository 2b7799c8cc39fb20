"""Homonym disambiguation: names shared by several concepts get a part that tells them apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilink.sources.fixtures import CONNECTOR, SYMBOL


def shared_names(kb: DataFrame, keys: list[str], what: str) -> DataFrame:
    """keys that occur with more than one value of `what`. Minimum and maximum suffice and combine before the shuffle."""
    spread = kb.groupBy(*keys).agg(F.min(what).alias("lo"), F.max(what).alias("hi"))
    return spread.where("lo < hi").select(*keys)


def foreign_homonyms(kb: DataFrame) -> DataFrame:
    """Rows whose name occurs with several foreign identifiers."""
    rows = kb.where(F.col("foreign_identifier").isNotNull())
    return rows.join(shared_names(rows, ["name"], "foreign_identifier"), "name", "left_semi").select("uid", "foreign_identifier")


def name_homonyms(kb: DataFrame) -> DataFrame:
    """Rows whose name, within one foreign identifier, occurs with several identifiers."""
    keyed = kb.withColumn("fk", F.coalesce("foreign_identifier", F.lit(-1)))
    return keyed.join(shared_names(keyed, ["name", "fk"], "identifier"), ["name", "fk"], "left_semi").select("uid", "identifier", "name", "foreign_identifier")


def choose_names(kb: DataFrame, homonyms: DataFrame) -> DataFrame:
    """(identifier, disambiguation_name): the shortest name of an identifier that is no homonym anywhere, a symbol before any other; ties by binary order."""
    free = kb.join(homonyms.select("name").distinct(), "name", "left_anti")
    shortest = F.struct(F.length("name").alias("n"), F.col("name"))
    best = free.groupBy("identifier").agg(
        F.min(F.when(F.col("description") == SYMBOL, shortest)).alias("symbol"), F.min(F.when(F.col("description") != SYMBOL, shortest)).alias("other")
    )
    return best.select("identifier", F.coalesce("symbol.name", "other.name").alias("disambiguation_name"))


def with_part(disambiguation: Column, key: str, value: Column, connector: str = CONNECTOR) -> Column:
    """disambiguation with `key:value` appended, unless value is null."""
    return F.when(value.isNull(), disambiguation).otherwise(F.concat(disambiguation, F.lit(f"{key}:"), value, F.lit(connector)))


def disambiguate(kb: DataFrame, foreign: DataFrame | None, connector: str = CONNECTOR) -> DataFrame:
    """kb with its disambiguation filled in: F parts for foreign homonyms, D parts for name homonyms with a free name."""
    out = kb
    if foreign is not None:
        marked = foreign_homonyms(kb).join(F.broadcast(foreign), "foreign_identifier").select("uid", F.coalesce("foreign_name", F.lit("")).alias("f_part"))
        out = out.join(marked, "uid", "left")
    else:
        out = out.withColumn("f_part", F.lit(None).cast("string"))
    homonyms = name_homonyms(kb)
    chosen = homonyms.select("uid", "identifier", "name").join(choose_names(kb, homonyms), "identifier").select("uid", F.col("disambiguation_name").alias("d_part"))
    out = out.join(chosen, "uid", "left")
    return out.withColumn("disambiguation", with_part(with_part(F.col("disambiguation"), "F", F.col("f_part"), connector), "D", F.col("d_part"), connector)).drop("f_part", "d_part")


def unique_name(name: Column, disambiguation: Column, connector: str = CONNECTOR) -> Column:
    """name (D, A, F): the last value of each key, an empty one included; just the name without any."""
    parts = F.filter(F.split(disambiguation, connector, -1), lambda p: p != "")

    def last(key: str) -> Column:
        own = F.filter(parts, lambda p: F.startswith(p, F.lit(f"{key}:")))
        return F.when(F.size(own) > 0, F.substring(F.element_at(own, -1), 3, 1 << 30))

    values = F.filter(F.array(last("D"), last("A"), last("F")), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.concat(name, F.lit(" ("), F.array_join(values, ","), F.lit(")"))).otherwise(name)


def unique_violations(kb: DataFrame) -> DataFrame:
    """(name, disambiguation) pairs with more than one row."""
    return kb.groupBy("name", "disambiguation").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
