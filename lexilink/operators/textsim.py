"""Similarity of names: character-trigram TF-IDF, the Indel ratio, prefix tries."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """All three-character substrings; none for shorter texts."""
    return F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def inverse_frequencies(names: DataFrame) -> DataFrame:
    """(gram, idf) over the distinct names (name): ln((1 + n) / (1 + df)) + 1."""
    distinct = names.select(F.lower("name").alias("name")).distinct()
    df = distinct.select(F.explode(F.array_distinct(trigrams(F.col("name")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    n = distinct.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("gram", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def unit_vectors(rows: DataFrame, key: list[str], text: str, idf: DataFrame) -> DataFrame:
    """(key, gram, weight) with length 1; grams without an idf are left out."""
    tf = rows.select(*key, F.explode(trigrams(F.lower(text))).alias("gram")).groupBy(*key, "gram").agg(F.count("*").alias("tf"))
    weighted = tf.join(idf, "gram").withColumn("raw", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy(*key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighted.join(norms, key).select(*key, "gram", (F.col("raw") / F.col("norm")).alias("weight"))


def best_names(mentions: DataFrame, choices: DataFrame, idf: DataFrame, digits: int = 6) -> DataFrame:
    """(mention, ord, name, score): the most similar of the choices (key, ord, name) under each mention's own key (mention, key, text), the first of equals.

    Vectors are made of each distinct text and name of a key once, however many mentions and choices have it, and only those of one key that share a trigram meet."""
    texts = mentions.select("key", F.lower("text").alias("text")).distinct()
    named = choices.select("key", "ord", "name", F.lower("name").alias("lower")).groupBy("key", "lower").agg(F.min(F.struct("ord", "name")).alias("first"))
    names = named.select("key", "lower", "first.ord", "first.name")
    of_text = unit_vectors(texts.select("text").distinct(), ["text"], "text", idf)
    of_name = unit_vectors(names.select("lower").distinct(), ["lower"], "lower", idf).withColumnRenamed("weight", "other")
    left, right = texts.join(of_text, "text"), names.select("key", "lower").join(of_name, "lower")
    scores = left.join(right, ["key", "gram"]).groupBy("key", "text", "lower").agg(F.sum(F.col("weight") * F.col("other")).alias("score"))
    place = F.struct(F.round("score", digits).alias("score"), (-F.col("ord")).alias("back"), "name")
    shared = scores.join(names, ["key", "lower"]).groupBy("key", "text").agg(F.max(place).alias("best"))
    # Where no name shares a trigram all have score 0, and the first of the key stands.
    first = names.groupBy("key").agg(F.min(F.struct("ord", "name")).alias("first"))
    found = texts.join(first, "key").join(shared, ["key", "text"], "left")
    best = found.select("key", "text", F.coalesce(F.when(F.col("best.score") > 0, F.col("best")), F.struct(F.lit(0.0).alias("score"), (-F.col("first.ord")).alias("back"), F.col("first.name").alias("name"))).alias("best"))
    each = mentions.select("mention", "key", F.lower("text").alias("text")).join(best, ["key", "text"])
    return each.select("mention", (-F.col("best.back")).alias("ord"), F.col("best.name").alias("name"), F.col("best.score").alias("score"))


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (|a| + |b|), by the bit-parallel LCS over a's characters; 100 for two empty texts."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & masks.get(ch, 0)
        row = (row + u | row - u) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def with_indel_ratio(df: DataFrame, a: str, b: str, name: str = "ratio") -> DataFrame:
    """df with the Indel ratio of two string columns; each distinct pair of a batch is compared once."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(iterator):
        memo: dict = {}
        for batch in iterator:
            x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b))
            if len(memo) > 200_000:
                memo.clear()
            out = []
            for pair in zip(x, y, strict=True):
                if pair not in memo:
                    memo[pair] = None if None in pair else indel_ratio(*pair)
                out.append(memo[pair])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def trie_children(sequences: DataFrame, column: str) -> DataFrame:
    """(prefix, next): every prefix of every sequence with each token that follows it."""
    at = F.explode(F.sequence(F.lit(0), F.size(column) - 1)).alias("n")
    return sequences.where(F.size(column) > 0).select(F.col(column).alias("tokens"), at).select(F.slice("tokens", F.lit(1), F.col("n")).alias("prefix"), F.get("tokens", F.col("n")).alias("next")).distinct()


def trie_leaves(sequences: DataFrame, column: str) -> DataFrame:
    """Sequences that no other one continues."""
    s = sequences.select(F.col(column).alias("tokens")).distinct()
    return s.join(trie_children(sequences, column).select(F.col("prefix").alias("tokens")).distinct(), "tokens", "left_anti")


def trie_with_fallback(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """(prefix, next, source): children in the first trie (source 0), and in the second (1) those of prefixes that the first lacks."""
    own = trie_children(first, column)
    rest = trie_children(second, column).join(own.select("prefix").distinct(), "prefix", "left_anti")
    return own.withColumn("source", F.lit(0)).unionByName(rest.withColumn("source", F.lit(1)))


def letter_counts(text: Column, classes: int = 32) -> Column:
    """How many characters of each of a few classes a text has: two texts share at most the sum of the lesser counts."""
    code = F.transform(F.split(text, ""), lambda c: F.ascii(c) % classes)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.size(F.filter(code, lambda c: c == k)))


def length_classes(length: Column, least: float) -> tuple[Column, list[int]]:
    """(a class of a length, how far apart the classes of two lengths may be): texts whose lengths let an Indel ratio reach `least` are in classes that near."""
    share = least / (200 - least)  # of the longer one the shorter one has at least
    if share >= 1:
        return length.cast("int"), [0]
    if share <= 0:
        return F.lit(0), [0]
    step = -math.log(share) * (1 + 1e-9)
    return F.when(length == 0, -1000).otherwise(F.floor(F.log(length.cast("double")) / step)).cast("int"), [-1, 0, 1]


def ambiguous_counts(mentions: DataFrame, choices: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """at_<t> for each threshold: how many mentions (mention, identifier, text) have a choice (identifier, choice) with an Indel ratio of at least t.

    Texts that are choices themselves have 100 and need no comparison. The others meet the choices of their identifier in classes of near lengths only, and of these pairs only those go to Python whose lengths and letters allow the least
    threshold, for the common subsequence is at most the shorter length, and at most the letters that both have."""
    least = min(thresholds)
    texts = mentions.select("identifier", "text").distinct()
    own = choices.select("identifier", F.col("choice").alias("text")).distinct()
    rest = texts.join(own, ["identifier", "text"], "left_anti").withColumn("of_text", letter_counts(F.col("text")))
    own_class, apart = length_classes(F.length("text"), least)
    rest = rest.withColumn("class", F.explode(F.array(*[own_class + k for k in apart])))
    named = choices.select("identifier", "choice").distinct().withColumns({"of_choice": letter_counts(F.col("choice")), "class": length_classes(F.length("choice"), least)[0]})
    total = F.length("text") + F.length("choice")
    lengths = 200 * F.least(F.length("text"), F.length("choice")) >= least * total
    both = F.aggregate(F.zip_with("of_text", "of_choice", lambda a, b: F.least(a, b)), F.lit(0), lambda n, x: n + x)
    pairs = rest.join(named, ["identifier", "class"]).where(lengths).where(200 * both >= least * total)
    pairs = pairs.select("identifier", "text", "choice")
    scored = with_indel_ratio(pairs.select("text", "choice").distinct(), "text", "choice").where(F.col("ratio") >= least)
    near = pairs.join(scored, ["text", "choice"]).groupBy("identifier", "text").agg(F.max("ratio").alias("ratio"))
    best = texts.join(own, ["identifier", "text"], "left_semi").withColumn("ratio", F.lit(100.0)).unionByName(near)
    return mentions.join(best, ["identifier", "text"]).agg(*[F.count_if(F.col("ratio") >= t).alias(f"at_{t}") for t in thresholds])
