"""Identifier mappings: mandatory, optional, one to many, and through the history of obsolete ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOREIGN, NIL = -1, "NIL"
#: Lists of ids that a task hands out, in bytes.
LIST_BYTES = 32_000_000


def map_mandatory(rows: DataFrame, key: str, ids: str, mapping: DataFrame) -> DataFrame:
    """(key, int_id) of every id; an id that the mapping (id, int_id) lacks is an error."""
    each = rows.select(key, F.explode(ids).alias("id")).join(mapping, "id", "left")
    return each.select(key, F.when(F.col("int_id").isNull(), F.raise_error(F.concat(F.lit("unknown identifier "), F.col("id")))).otherwise(F.col("int_id")).alias("int_id"))


def canonical(rows: DataFrame, column: str, history: DataFrame) -> DataFrame:
    """rows with ids replaced by their new ones where the history (id, new_id) has any."""
    joined = rows.join(history.select(F.col("id").alias(column), "new_id"), column, "left")
    return joined.withColumn(column, F.coalesce("new_id", column)).drop("new_id")


def or_nil(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    joined = rows.join(mapping.select(F.col("id").alias(column), "new_id"), column, "left")
    return joined.withColumn(column, F.coalesce(F.col("new_id").cast("string"), F.lit(NIL))).drop("new_id")


def reverse(rows: DataFrame, key: str, mapping: DataFrame, shown: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """(key, ids): all string ids of a key's ints, in the form that `shown` gives a list.

    Lists are made and shown once for each set of ints that occurs, and then copied for as many keys as fill LIST_BYTES, which is about what a task hands out: writers of files hold pages of a hundred rows. Both joins are merges with the short rows on the left: those are taken one at a time, while a broadcast of them would hold all the rows of a list at once."""
    sets = rows.join(mapping.select("int_id").distinct(), "int_id", "left_semi").groupBy(key).agg(F.array_sort(F.collect_set("int_id")).alias("ints"))
    each = sets.groupBy("ints").agg(F.count("*").alias("keys")).withColumn("int_id", F.explode("ints"))
    lengths = mapping.select("int_id", "id").distinct().groupBy("int_id").agg(F.sum(F.coalesce(F.octet_length("id"), F.lit(0)) + 1).alias("bytes"))
    sizes = each.join(lengths, "int_id").groupBy("ints", "keys").agg((F.col("keys") * F.sum("bytes")).alias("bytes"))
    tasks = sizes.agg(F.ceil(F.sum("bytes") / LIST_BYTES)).first()[0] or 1
    parts = sizes.select("ints", F.greatest(F.lit(1), F.least("keys", F.ceil(F.col("bytes") / LIST_BYTES))).alias("parts"))
    lists = each.join(mapping, "int_id").groupBy("ints").agg(shown(F.array_sort(F.collect_set("id"))).alias("ids"))
    copies = parts.select("ints", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(lists.hint("merge"), "ints")
    dealt = sets.join(parts, "ints").select(key, "ints", F.pmod(F.xxhash64(key), "parts").alias("part"))
    return dealt.repartition(tasks, "ints", "part").join(copies.repartition(tasks, "ints", "part").hint("merge"), ["ints", "part"]).select(key, "ids")


def normalise(annotations: DataFrame, history: DataFrame) -> DataFrame:
    """Foreign annotations get -1, the others their canonical id."""
    done = canonical(annotations, "identifier", history)
    return done.withColumn("identifier", F.when(F.col("is_foreign"), F.lit(FOREIGN)).otherwise(F.col("identifier")))


def with_history(rows: DataFrame, key: str, ids: str, history: DataFrame) -> DataFrame:
    """(key, ids, updated): ids as given, and what the history makes of them (null: obsolete)."""
    each = rows.select(key, F.posexplode(ids).alias("pos", "id")).join(history, "id", "left")
    return each.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("ids"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "new_id"))), lambda s: s["new_id"]).alias("updated"),
    )


def obsolete_counts(updated: DataFrame) -> DataFrame:
    """Mentions, and those of which every id is obsolete."""
    gone = F.forall("updated", lambda i: i.isNull())
    return updated.agg(F.count("*").alias("n_mentions"), F.count_if(gone).alias("n_obsolete"))
