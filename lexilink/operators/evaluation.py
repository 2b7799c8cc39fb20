"""Scores of rankings and of document-level predictions, and the reconciliation of predictions with gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NIL = -1


def recall_at(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """n and hits at each k: a mention counts if any of its first k identifiers is a gold one. All ks in one pass."""
    hit = ranked.join(gold.select("mention", "gold"), "mention").where(F.array_contains("gold", F.col("identifier")))
    first = hit.groupBy("mention").agg(F.min("rank").alias("first"))
    return gold.select("mention").join(first, "mention", "left").agg(F.count("*").alias("n"), *[F.count_if(F.col("first") <= k).alias(f"hits_{k}") for k in ks])


def rank_member(ids: Column, mode: str) -> Column:
    """What a rank, a set of ids, stands for: strict: NIL if it holds several; std: one member, by hash; lenient: all."""
    if mode == "strict":
        return F.when(F.size(F.array_distinct(ids)) > 1, F.array(F.lit(NIL).cast("long"))).otherwise(ids)
    if mode == "std":
        return F.array(F.array_min(F.transform(ids, lambda i: F.struct(((i * 2654435761) % 1000003).alias("h"), i.alias("id"))))["id"])
    if mode == "lenient":
        return ids
    raise ValueError(f"mode {mode}")


def multi_label_recall(predictions: DataFrame, gold: DataFrame, k: int, mode: str) -> DataFrame:
    """n, hits, recall (percent, 2 decimals): predictions are (mention, rank, ids), gold (mention, gold). A gold mention without prediction is an error."""
    kept = predictions.where(F.col("rank") <= k).join(gold, "mention").select("mention", F.arrays_overlap(rank_member(F.col("ids"), mode), "gold").alias("hit"))
    by_mention = kept.groupBy("mention").agg(F.max("hit").alias("hit"))
    joined = gold.join(by_mention, "mention", "left")
    hit = F.when(F.col("hit").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col("mention").cast("string")))).otherwise(F.col("hit"))
    return joined.select(hit.cast("boolean").alias("hit")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).withColumn("recall", F.round(100 * F.col("hits") / F.col("n"), 2))


def document_prf(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Macro precision, recall and F1 (of the two means) in percent over gold documents; (doc, id) rows."""
    g, p = gold.distinct(), predicted.distinct()
    both = g.join(p, ["doc", "id"]).groupBy("doc").agg(F.count("*").alias("tp"))
    per = g.groupBy("doc").agg(F.count("*").alias("n_gold")).join(p.groupBy("doc").agg(F.count("*").alias("n_pred")), "doc", "left").join(both, "doc", "left")
    tp = F.coalesce("tp", F.lit(0))
    means = per.agg(F.avg(F.when(F.col("n_pred") > 0, tp / F.col("n_pred")).otherwise(0.0)).alias("p"), F.avg(tp / F.col("n_gold")).alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return means.select(F.round(100 * F.col("p"), 6).alias("precision"), F.round(100 * F.col("r"), 6).alias("recall"), F.round(100 * f1, 6).alias("f1"))


def species_filtered(candidates: DataFrame, species: DataFrame, assigned: DataFrame) -> DataFrame:
    """(mention, rank, ids): of each rank the ids of the mention's assigned species, or all if there are none."""
    each = candidates.select("mention", "rank", F.explode("ids").alias("identifier")).join(species, "identifier", "left").join(assigned, "mention", "left")
    own = F.array_sort(F.collect_set(F.when(F.col("species").cast("string") == F.col("assigned"), F.col("identifier"))))
    every = F.array_sort(F.collect_set("identifier"))
    return each.groupBy("mention", "rank").agg(own.alias("own"), every.alias("every")).select("mention", "rank", F.when(F.size("own") == 0, F.col("every")).otherwise(F.col("own")).alias("ids"))


def common_mentions(predictions: DataFrame, models: int) -> DataFrame:
    """Mentions that every one of `models` models has predictions for."""
    # Dealt by mention first, rows need no second shuffle for the distinct count.
    return predictions.select("hexdigest", "model").repartition("hexdigest").groupBy("hexdigest").agg(F.count_distinct("model").alias("n")).where(F.col("n") == models).select("hexdigest")


def reconcile(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with the gold hexdigest of their span (doc, start, end), `-` where gold has no such span."""
    joined = predicted.join(gold.select("doc", "start", "end", "hexdigest"), ["doc", "start", "end"], "left")
    return joined.withColumn("hexdigest", F.coalesce("hexdigest", F.lit("-")))


def ner_recall(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Spans found, gold spans, and their ratio in percent."""
    found = gold.join(predicted.select("doc", "start", "end").distinct().withColumn("found", F.lit(1)), ["doc", "start", "end"], "left")
    return found.agg(F.count("found").alias("tp"), F.count("*").alias("n")).withColumn("recall", F.round(100 * F.col("tp") / F.col("n"), 2))


def pivot_results(results: DataFrame, rows: str, columns: str, value: str, names: list[str]) -> DataFrame:
    """One row per `rows`, one column per name; missing cells are `-`."""
    wide = results.groupBy(rows).pivot(columns, names).agg(F.first(value))
    return wide.select(rows, *[F.coalesce(F.col(n).cast("string"), F.lit("-")).alias(n) for n in names])


def reconcile_predictions(predicted: DataFrame, gold: DataFrame, history: DataFrame, mapping: DataFrame) -> DataFrame:
    """(hexdigest, ids): what predictions (doc, start, end, ids in rank order) say of gold spans.

    Ids go through the history of replaced ones (id, new_id), then through the mapping to the dictionary's (id, new_id), NIL where it has none; predictions at spans that gold lacks go."""
    from lexilink.operators import identifiers as I

    each = predicted.select("doc", "start", "end", F.posexplode("ids").alias("pos", "id"))
    named = I.or_nil(I.canonical(each, "id", history), "id", mapping)
    rows = named.groupBy("doc", "start", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("ids"))
    return rows.join(gold.select("doc", "start", "end", "hexdigest"), ["doc", "start", "end"]).select("hexdigest", "ids")
