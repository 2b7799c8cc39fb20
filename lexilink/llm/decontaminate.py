"""Benchmark decontamination by n-gram windows. Native: DataFrame operations only.

Words are runs of characters other than the ASCII ones that are no digits or letters, A-Z lower-cased. The windows of a benchmark item
are its n-word sequences, or its whole sequence if it is shorter. A window that occurs in a document holds the k-word sequence at
each of its places, and one of those places is a multiple of n - k + 1 in the document. So the one scan of all texts looks up the hashes of
its k-word sequences at these places in the set of all k-word sequences of windows, and only around a hit the hashes of whole
windows are looked up in the set of windows; equal words confirm them. No window is missed. Each set is broadcast while it
has at most `broadcast_windows` rows and `broadcast_bytes` bytes; beyond that the same join shuffles hashes instead.

Edge cases: a null text and a text without words have no windows and no hits; items without words match nothing; items with
equal windows all count as found; items with a null id hit like others, and all of them count as one in n_items and are one null in items; rows that repeat an id with another text are judged apart;
rows that repeat both get equal verdicts; tables without rows give
tables without rows; only the id, the text and the item's columns are read, so further columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexilink.llm.common import ALNUM_WORD, Scratch, alnum_words, beside, free_name, written

#: In the case it has, a word holds capitals too.
_ANY_CASE_WORD = ALNUM_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
_ANY_CASE_GAP = "[" + _ANY_CASE_WORD[2:-1]
_ANCHOR_WORDS = 4


def _distinct(column: str) -> Column:
    """The distinct values of a group, null among them, which collect_set alone drops."""
    return F.transform(F.collect_set(F.struct(F.col(column).alias("value"))), lambda s: s["value"])


def windows_of_items(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """hash, gram (array of words), size, items: one row per distinct window."""
    words = benchmark.select(F.col(item_col).alias("item"), alnum_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
    grams = words.select("item", F.explode(starts).alias("at"), "words").select("item", F.slice("words", F.col("at"), n).alias("gram"))
    return grams.groupBy("gram").agg(_distinct("item").alias("items")).select(F.xxhash64("gram").alias("hash"), "gram", F.size("gram").alias("size"), "items")


def _mark(text: Column) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _small(table: DataFrame, width: Column, rows: int, size: int) -> bool:
    """Whether a table has at most so many rows and bytes."""
    found = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return found["n"] <= rows and found["size"] <= size


def _anchor_steps(size: int) -> tuple[int, int]:
    """(words of an anchor, distance of the places looked at) for windows of `size` words."""
    k = min(_ANCHOR_WORDS, size)
    return k, size - k + 1


def scan(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, broadcast_windows: int, broadcast_bytes: int) -> DataFrame:
    """doc, mark, n_words, size, at, around: a row of size 0 for each row of docs, and one for each anchor found: its place and the words that windows over it can hold, in their order."""
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    words = docs.select(F.col(id_col).alias("doc"), _mark(F.col(text_col)).alias("mark"), alnum_words(F.col(text_col)).alias("words"))

    def places(size: int) -> Column:
        k, step = _anchor_steps(size)
        at = F.sequence(F.lit(1), F.size("words") - (k - 1), F.lit(step))
        found = F.transform(at, lambda a: F.struct(F.lit(size).alias("size"), a.alias("at"), F.xxhash64(F.slice("words", a, k)).alias("hash")))
        return F.when(F.size("words") >= size, found)

    def of_windows(size: int) -> DataFrame:
        k, step = _anchor_steps(size)
        grams = F.transform(F.sequence(F.lit(1), F.lit(step)), lambda a: F.xxhash64(F.slice("gram", a, k)))
        return windows.where(F.col("size") == size).select(F.lit(size).alias("size"), F.explode(grams).alias("hash")).distinct()

    # Every row of docs has an anchor of size 0, which is always found and brings the number of words.
    own = F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("hash"))
    none = F.array().cast("array<struct<size:int,at:int,hash:long>>")
    anchors = F.concat(F.array(own), *[F.coalesce(places(s), none) for s in sizes])
    always = windows.sparkSession.range(1).select(F.lit(0).alias("size"), F.lit(0).cast("long").alias("hash"))
    wanted = written(reduce(DataFrame.unionByName, [of_windows(s) for s in sizes], always), "benchmark-anchors")
    step_of = reduce(lambda e, s: e.when(F.col("size") == s, _anchor_steps(s)[1]), sizes, F.when(F.col("size") == 0, 1))
    first = F.greatest(F.col("at") - step_of + 1, F.lit(1))
    around = F.when(F.col("size") > 0, F.slice("words", first, F.col("at") + F.col("size") - first))
    looked = words.select("doc", "mark", "words", F.explode(anchors).alias("a")).select("doc", "mark", "words", "a.*")
    columns = ["doc", "mark", F.when(F.col("size") == 0, F.size("words")).alias("n_words"), "size", first.alias("at"), around.alias("around")]
    if _small(wanted, F.lit(12), broadcast_windows * 4, broadcast_bytes):
        return looked.join(F.broadcast(wanted), ["size", "hash"], "left_semi").select(*columns)
    # Too many anchors to broadcast: the words around each go along in the shuffle, not the whole text.
    return looked.select(*columns, "hash").join(wanted, ["size", "hash"], "left_semi").select("doc", "mark", "n_words", "size", "at", "around")


def hits(scanned: DataFrame, windows: DataFrame, broadcast_windows: int, broadcast_bytes: int) -> DataFrame:
    """doc, mark, start (word position from 0), size, items of every document window that is an item's window."""
    found = scanned.where("size > 0")
    starts = F.sequence(F.lit(0), F.size("around") - F.col("size"))
    hashes = F.transform(F.when(F.size("around") >= F.col("size"), starts), lambda i: F.struct((F.col("at") - 1 + i).alias("start"), F.slice("around", i + 1, F.col("size")).alias("own")))
    own = found.select("doc", "mark", "size", F.explode(hashes).alias("w")).select("doc", "mark", "size", "w.start", "w.own", F.xxhash64("w.own").alias("hash"))
    wanted = windows.withColumnRenamed("size", "s")
    if _small(windows, F.aggregate("gram", F.lit(24), lambda n, w: n + F.octet_length(w) + 8) + 16 * F.size("items"), broadcast_windows, broadcast_bytes):
        wanted = F.broadcast(wanted)
    return own.join(wanted, "hash").where(F.col("own") == F.col("gram")).select("doc", "mark", "start", "size", "items")


def spans(found: DataFrame) -> DataFrame:
    """doc, mark, n_hit (words inside any hit window), items (distinct), ranges (of hit words, merged)."""
    own = ["doc", "mark"]
    places = found.groupBy(*own, "start").agg(F.max("size").alias("size"))
    before = Window.partitionBy(*own).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = places.withColumn("end", F.col("start") + F.col("size")).withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    fresh = ends.where(F.col("end") > F.col("reached")).select(*own, F.greatest("start", "reached").alias("from"), F.col("end").alias("to"))
    covered = fresh.groupBy(*own).agg(F.sum(F.col("to") - F.col("from")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("from", "to"))).alias("ranges"))
    items = found.select(*own, F.explode("items").alias("item")).groupBy(*own).agg(_distinct("item").alias("items"))
    items = items.withColumnsRenamed({"doc": "d", "mark": "m"})
    return covered.join(items, F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).drop("d", "m")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_windows: int = 500_000,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items, ranges of hit words (from, to), contaminated."""
    judged = _judged(docs, benchmark, n, id_col, text_col, item_col, item_text_col, broadcast_windows, broadcast_bytes)
    return judged.select(F.col("doc").alias(id_col), *judged.columns[2:])


def _judged(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, item_col: str, item_text_col: str, broadcast_windows: int, broadcast_bytes: int) -> DataFrame:
    """doc, the mark of its text, and what decontaminate returns."""
    with Scratch(docs.sparkSession) as scratch:
        windows = scratch.written(windows_of_items(benchmark, n, item_col, item_text_col), "benchmark-windows")
        scanned = scratch.written(scan(docs, windows, id_col, text_col, broadcast_windows, broadcast_bytes), "benchmark-scan")
        found = scratch.written(spans(hits(scanned, windows, broadcast_windows, broadcast_bytes)), "benchmark-hits")
        rows = scanned.where("size = 0").select("doc", "mark", F.col("n_words").cast("long").alias("n_words"))
        joined = rows.join(found.withColumnsRenamed({"doc": "d", "mark": "m"}), F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
        return written(
            joined.select(
                "doc",
                "mark",
                "n_words",
                F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"),
                "ranges",
                F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
            ),
            "benchmark-verdicts",
        )


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_share: float = 0.0,
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_windows: int = 500_000,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """docs less what is contaminated: documents with over max_share of their words hit go, the others lose just the hit spans."""
    judged = _judged(docs, benchmark, n, id_col, text_col, item_col, item_text_col, broadcast_windows, broadcast_bytes).where("contaminated")
    doc, mark, share, ranges = (free_name(x, docs) for x in ("doc", "mark", "share", "ranges"))
    # Rows that repeat an id and a text have one verdict.
    judged = judged.groupBy(F.col("doc").alias(doc), F.col("mark").alias(mark)).agg(F.max(F.col("n_hit") / F.col("n_words")).alias(share), F.first("ranges").alias(ranges))
    judged = beside(written(judged, "contaminated"), 48 + 16 * F.size(ranges))
    same = F.col(id_col).eqNullSafe(F.col(doc)) & (_mark(F.col(text_col)) == F.col(mark))
    joined = docs.join(judged, same, "left").where(F.col(share).isNull() | (F.col(share) <= max_share))
    if max_share <= 0.0:
        return joined.select(*docs.columns)
    # Each piece is a word with what stands before it, in the case it has; a null text is never hit.
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"{_ANY_CASE_GAP}*{_ANY_CASE_WORD}"), F.lit(0))
    hit = F.flatten(F.transform(ranges, lambda r: F.sequence(r["from"], r["to"] - 1)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), hit), lambda i: F.get(pieces, i))
    less = F.concat(F.array_join(kept, ""), F.regexp_extract(F.col(text_col), f"{_ANY_CASE_GAP}*$", 0))
    return joined.select(*[F.when(F.col(share).isNull(), F.col(c)).otherwise(less).alias(c) if c == text_col else F.col(c) for c in docs.columns])
