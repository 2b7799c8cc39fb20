"""Candidates of mentions: resolution, labels, in-document candidates, loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexilink.functions.arrays import pad_batches

MISSING = -100


def resolve(ranked: DataFrame, kb: DataFrame) -> DataFrame:
    """ranked with the identifier of each uid, MISSING where the knowledge base lacks it."""
    return ranked.join(kb.select("uid", "identifier"), "uid", "left").withColumn("identifier", F.coalesce("identifier", F.lit(MISSING).cast("long")))


def orphans(ranked: DataFrame, kb: DataFrame) -> DataFrame:
    """uids that the index returned and the knowledge base lacks."""
    return ranked.select("uid").distinct().join(kb.select("uid"), "uid", "left_anti")


def labelled(resolved: DataFrame, gold: DataFrame) -> DataFrame:
    """resolved (mention, identifier) with label: is the identifier a gold one of its mention."""
    return resolved.join(gold.select("mention", "gold"), "mention").withColumn("label", F.array_contains("gold", F.col("identifier")).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def global_candidates(local: DataFrame, vectors: DataFrame, most: int = 16) -> DataFrame:
    """(doc, mention, rank, uid) of the other candidates of each document's mentions.

    local: (doc, mention, rank, uid), vectors: (uid, embedding). For a mention with local candidates at positions p, all of its document's candidates that aren't its own are ranked by
    similarity to each of them (i = 0, 1, ...; ties by uid). Taken in order of (i, p), first occurrences count; lists end at `most` and at the shortest list of the document. Work is
    quadratic in a document's candidates, which are bounded by its mentions, and never crosses documents.
    """
    pool = local.select("doc", "uid").distinct().join(vectors.select("uid", "embedding"), "uid")
    near = pool.alias("a").join(pool.alias("b"), F.col("a.doc") == F.col("b.doc")).select(
        F.col("a.doc").alias("doc"), F.col("a.uid").alias("of"), F.col("b.uid").alias("uid"), F.round(dot(F.col("a.embedding"), F.col("b.embedding")), 9).alias("score")
    )
    pairs = local.select("doc", "mention", "rank", F.col("uid").alias("of")).join(near, ["doc", "of"])
    foreign = pairs.join(local.select("doc", "mention", "uid"), ["doc", "mention", "uid"], "left_anti")
    by_local = Window.partitionBy("doc", "mention", "rank").orderBy(F.desc("score"), "uid")
    placed = foreign.withColumn("i", F.row_number().over(by_local))
    first = placed.groupBy("doc", "mention", "uid").agg(F.min(F.struct("i", "rank")).alias("key"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("doc", "mention").orderBy("key"))).where(F.col("place") <= most)
    counts = local.select("doc", "mention").distinct().join(ranked.groupBy("doc", "mention").agg(F.count("*").alias("n")), ["doc", "mention"], "left")
    shortest = counts.groupBy("doc").agg(F.min(F.coalesce("n", F.lit(0))).alias("shortest"))
    return ranked.join(shortest, "doc").where(F.col("place") <= F.col("shortest")).select("doc", "mention", F.col("place").alias("rank"), "uid")


def marginal_nll(scored: DataFrame) -> DataFrame:
    """(mention, nll) from (mention, score, label): -ln of the softmax mass on gold candidates; mentions without any are left out. The mean is a plain avg()."""
    w = Window.partitionBy("mention")
    weight = F.exp(F.col("score") - F.max("score").over(w))
    mass = scored.withColumn("e", weight).groupBy("mention").agg((F.sum(F.col("e") * F.col("label")) / F.sum("e")).alias("mass"))
    return mass.where("mass > 0").select("mention", (-F.log(F.least(F.greatest("mass", F.lit(1e-9)), F.lit(1.0)))).alias("nll"))


def l2_norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def joined_scores(local: DataFrame, other: DataFrame) -> DataFrame:
    """(mention, score, label) of local candidates and of those from the rest of the document or batch, for one loss over both."""
    return local.select("mention", "score", "label").unionByName(other.select("mention", "score", "label"))


def by_address(ranked: DataFrame, addresses: DataFrame, store, cls: int, sep: int, most: int = 64, pad_id: int = 0) -> DataFrame:
    """What a scorer needs of each batch's candidates: (batch, mention, rank, uid, identifier, position, name, encoded).

    ranked: batch, mention, rank, uid; addresses: uid, row; store: a ShardStore of identifier, name and tokens by row number. Each candidate of a batch is fetched once by its address, its tokens get marks and are padded to the longest of the batch, and `position` is
    its place among the batch's candidates by uid, from 0. A uid without an address has the identifier MISSING, an empty name, marks only, and no position."""
    own = ranked.select("batch", "uid").distinct().join(addresses.select("uid", "row"), "uid", "left")
    found = store.gather(own, "row", ["identifier", "name", "tokens"])
    known = F.col("row").isNotNull()
    place = F.when(known, F.row_number().over(Window.partitionBy("batch", known).orderBy("uid")) - 1)
    marked = F.concat(F.array(F.lit(cls)), F.slice(F.coalesce("tokens", F.array().cast("array<int>")), 1, most - 2), F.array(F.lit(sep)))
    encoded = found.select("batch", "uid", F.coalesce("identifier", F.lit(MISSING)).cast("long").alias("identifier"), F.coalesce("name", F.lit("")).alias("name"), place.cast("long").alias("position"), marked.alias("encoded"))
    padded = pad_batches(encoded, ["batch"], "encoded", pad_id)
    return ranked.select("batch", "mention", "rank", "uid").join(padded, ["batch", "uid"]).select("batch", "mention", "rank", "uid", "identifier", "position", "name", "encoded")


def all_identifiers(ranked: DataFrame, names: DataFrame) -> DataFrame:
    """ranked with `identifiers`, every identifier that a candidate's name stands for, ascending; [MISSING] where there is none. names: uid, identifier, one row each."""
    held = names.groupBy("uid").agg(F.array_sort(F.collect_set("identifier")).alias("identifiers"))
    return ranked.join(held, "uid", "left").withColumn("identifiers", F.coalesce("identifiers", F.array(F.lit(MISSING).cast("long"))))


def any_labels(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked (mention, identifiers) with label: is any of a candidate's identifiers a gold one of its mention."""
    return ranked.join(gold.select("mention", "gold"), "mention").withColumn("label", F.arrays_overlap("identifiers", "gold").cast("int"))
