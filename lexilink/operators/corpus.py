"""Corpus preparation: passages, sentences, annotations, arrays, markers, token spans."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAD = -1


def sentence_islands(sentences: DataFrame, merge_title: bool = True) -> DataFrame:
    """(doc_id, island, passage_id, n_sentences, text): runs of consecutive sentences of one passage, with passage 1 counted as 0 where title and abstract belong together."""
    passage = F.when(F.col("passage_id") == 1, 0).otherwise(F.col("passage_id")) if merge_title else F.col("passage_id")
    w = Window.partitionBy("doc_id").orderBy("sentence_id")
    marked = sentences.withColumn("p", passage).withColumn("starts", (F.lag("p").over(w).isNull() | (F.lag("p").over(w) != F.col("p"))).cast("int"))
    island = marked.withColumn("island", F.sum("starts").over(w) - 1)
    text = F.transform(F.array_sort(F.collect_list(F.struct("sentence_id", "text"))), lambda s: s["text"])
    return island.groupBy("doc_id", "island").agg(F.first("p").alias("passage_id"), F.count("*").alias("n_sentences"), F.array_join(text, " ").alias("text"))


def passage_offsets(passages: DataFrame, key: str, order: str) -> DataFrame:
    """passages with `offset`: the lengths of all earlier passages of the document."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return passages.withColumn("offset", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))


def merge_title_abstract(passages: DataFrame) -> DataFrame:
    """(eid, text, n_passages): the first two passages joined by a space, as passage -1, for each document."""
    ordered = F.array_sort(F.collect_list(F.struct("passage_id", "text")))
    g = passages.groupBy("eid").agg(ordered.alias("all"))
    return g.select("eid", F.lit(-1).alias("passage_id"), F.array_join(F.transform(F.slice("all", 1, 2), lambda s: s["text"]), " ").alias("text"), F.size("all").cast("long").alias("n_passages"))


def pad(values: Column, to: Column | int, side: str = "right", value=PAD) -> Column:
    """values filled up with `value` to a length, on the right or the left."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(to) - F.size(values), F.lit(0)))
    return F.concat(values, fill) if side == "right" else F.concat(fill, values)


def pad_batch(rows: DataFrame, batch: str, column: str, side: str = "right", value=PAD) -> DataFrame:
    """Every array padded to the longest of its batch; empty arrays are an error of the caller's data and stay all padding."""
    width = rows.groupBy(batch).agg(F.max(F.size(column)).alias("width"))
    return rows.join(width, batch).withColumn(column, pad(F.col(column), F.col("width"), side, value))


def squeeze_mentions(nested: Column, value=PAD) -> Column:
    """sentence x mention x id to mention x id, without mentions that are padding only."""
    return F.filter(F.flatten(nested), lambda ids: F.exists(ids, lambda x: x != value))


def pad_empty(values: Column, value=PAD) -> Column:
    return F.when(F.size(values) == 0, F.array(F.lit(value))).otherwise(values)


def encode_name(tokens: Column, most: int, cls: int, sep: int, pad_id: int = 0) -> Column:
    """[cls, at most most - 2 tokens, sep], padded to `most`."""
    return pad(F.concat(F.array(F.lit(cls)), F.slice(tokens, 1, most - 2), F.array(F.lit(sep))), most, value=pad_id)


def add_special_tokens(padded: Column, cls: int, sep: int, pad_id: int = 0) -> Column:
    """cls in front, sep right after the last token that is no padding; two longer than before."""
    used = F.size(F.filter(padded, lambda x: x != pad_id))
    return F.concat(F.array(F.lit(cls)), F.slice(padded, F.lit(1), used), F.array(F.lit(sep)), F.slice(padded, used + 1, F.size(padded)))


def attention_mask(tokens: Column, pad_id: int = 0) -> Column:
    return F.transform(tokens, lambda x: (x != pad_id).cast("int"))


def global_attention_mask(tokens: Column, marked: list[int]) -> Column:
    """1 where a long-document encoder attends globally: at the given tokens."""
    return F.transform(tokens, lambda x: x.isin(marked).cast("int"))


def mark_mentions(text: Column, spans: Column, start_mark: str = "[MS] ", end_mark: str = " [ME]") -> Column:
    """text with marks around its spans (start, end), which are ascending and don't overlap; put in from the right, so offsets stay good."""
    right_to_left = F.reverse(F.array_sort(spans))
    return F.aggregate(
        right_to_left,
        text,
        lambda t, s: F.concat(
            F.substring(t, F.lit(1), s["start"]), F.lit(start_mark), F.substring(t, s["start"] + 1, s["end"] - s["start"]), F.lit(end_mark), F.substring(t, s["end"] + 1, F.length(t))
        ),
    )


def extract_mentions(tokens: Column, start: int, end: int) -> Column:
    """The token runs between start and end marks, in order; pairs the k-th start with the k-th end. Other numbers of starts than of ends are an error."""

    def of(t: Column) -> Column:
        at = lambda mark: F.filter(F.transform(t, lambda x, i: F.when(x == mark, i)), lambda i: i.isNotNull())
        runs = F.zip_with(at(start), at(end), lambda a, b: F.slice(t, a + 2, b - a - 1))
        return F.when(F.size(at(start)) == F.size(at(end)), runs).otherwise(F.raise_error(F.lit("start and end marks don't pair")).cast("array<array<int>>"))

    # As a lambda's variable tokens are made once a row; an expression in a lambda is made again for each of its elements.
    return F.get(F.transform(F.array(tokens), of), F.lit(0))


def context_window(left: Column, mention: Column, right: Column, most: int) -> Column:
    """Suffix of left, mention, prefix of right: at most ceil((most - mention - 2) / 2) tokens on each side."""
    side = F.greatest(F.ceil((F.lit(most) - F.size(mention) - 2) / 2).cast("int"), F.lit(0))
    kept_left = F.when(side == 0, F.slice(left, F.lit(1), F.lit(0))).when(F.size(left) > side, F.slice(left, F.size(left) - side + 1, side)).otherwise(left)
    return F.concat(kept_left, mention, F.slice(right, F.lit(1), side))


def token_offsets(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(*key, words, starts, ends): the words of each row's text between single spaces and their character spans, as arrays; none for null."""
    names = [*key, "words", "starts", "ends"]

    def run(iterator):
        # Few texts at a time: what their words take is many times what they take.
        for batch in (whole.slice(at, 100) for whole in iterator for at in range(0, whole.num_rows, 100)):
            words = pc.split_pattern(pc.fill_null(batch.column(len(key)).cast(pa.string()), ""), " ")
            there = batch.column(len(key)).is_valid().to_numpy(zero_copy_only=False)
            counts = words.value_lengths().to_numpy()
            size = pc.utf8_length(words.flatten()).to_numpy().astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            after = np.concatenate([[0], np.cumsum(size + 1)])
            start = after[:-1] - np.repeat(after[bounds[:-1]], counts)
            offsets = pa.array(bounds, pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, x) for x in (words.flatten(), pa.array(start), pa.array(start + size))]
            whole_rows = pa.RecordBatch.from_arrays([*batch.columns[: len(key)], *arrays], names)
            yield whole_rows if there.all() else whole_rows.filter(pa.array(there))

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*key, text).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in key) + ", words array<string>, starts array<long>, ends array<long>")


def tokens_with_offsets(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per word, with its number and character span, counted from single spaces."""
    each = token_offsets(df, key, text).select(*key, F.posexplode(F.arrays_zip("words", "starts", "ends")).alias("token", "t"))
    return each.select(*key, "token", F.col("t.words").alias("word"), F.col("t.starts").alias("start"), F.col("t.ends").alias("end"))


def char_to_token_spans(rows: DataFrame, key: list[str]) -> DataFrame:
    """(*key, start, end, first_token, last_token) of the spans of rows (*key, starts, ends, spans): starts and ends of their tokens, ascending, and an array of (start, end). A token is null where a border isn't its border.

    Spans stand beside the tokens of their own text, so nothing is joined or shuffled."""
    names = [*key, "start", "end", "first_token", "last_token"]
    k = len(key)

    def run(iterator):
        for batch in (whole.slice(at, 100) for whole in iterator for at in range(0, whole.num_rows, 100)):
            lists = [batch.column(k + i) for i in range(4)]  # starts, ends, span_starts, span_ends
            of = lambda x: np.repeat(np.arange(len(x)), pc.fill_null(pc.list_value_length(x), 0).to_numpy())
            flat = [x.flatten().to_numpy() for x in lists]
            row = of(lists[2])
            first_of = np.searchsorted(of(lists[0]), np.arange(batch.num_rows))
            found = []
            for tokens, spans in ((0, 2), (1, 3)):
                # Places of all rows in one ascending order.
                width = 1 + max(int(np.abs(x).max()) if len(x) else 0 for x in (flat[tokens], flat[spans]))
                known, asked = (of(lists[i]) * 2 * width + flat[i] for i in (tokens, spans))
                at = np.searchsorted(known, asked)
                there = np.append(known, -1 - width)[at] == asked
                found.append(pa.array((at - first_of[row]).astype(np.int32), pa.int32(), mask=~there))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in range(k)), pa.array(flat[2]), pa.array(flat[3]), *found], names)

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    spans = [F.col(f"spans.{c}").cast("array<long>").alias(f"span_{c}") for c in ("start", "end")]
    return rows.select(*key, "starts", "ends", *spans).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in key) + ", start long, end long, first_token int, last_token int")


def regroup(passages: DataFrame) -> DataFrame:
    """(eid, passages): passage rows back in their examples, in passage order."""
    return passages.groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("passage_id", "text"))), lambda s: s["text"]).alias("passages"))


def replace_in_order(text: Column, pairs: Column) -> Column:
    """Every pair's short form replaced by its long form, in the order of the pairs, each over the result of the earlier ones."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["short"], p["long"]))


def clean_abbreviations(pairs: DataFrame) -> DataFrame:
    """pairs and, for short forms with " -", a variant without hyphens on both sides; (doc, ord, short, long)."""
    odd = pairs.where(F.contains("short", F.lit(" -")))
    bare = lambda c: F.trim(F.replace(c, F.lit("-"), F.lit("")))
    return pairs.unionByName(odd.withColumns({"short": bare(F.col("short")), "long": bare(F.col("long"))}))


def last_dictionary(pairs: DataFrame, order: str) -> DataFrame:
    """(doc, short, long) over several dictionaries; the last one with an entry wins."""
    return pairs.groupBy("doc", "short").agg(F.max_by("long", order).alias("long"))


def concat_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Corpora of like columns one after another, each row with the name of its split."""
    return reduce(DataFrame.unionByName, [df.withColumn("split", F.lit(name)) for name, df in splits.items()])


def only_test_of(rows: DataFrame, corpus: str, names: list[str]) -> DataFrame:
    """Rows of all splits, but of the named corpora those of the test split only."""
    return rows.where(~F.col(corpus).isin(names) | (F.col("split") == "test"))


def first_token(states: Column) -> Column:
    """The state of the first token of a sequence stands for all."""
    return F.get(states, F.lit(0))


def split_arrays(packed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each place of arrays that run in parallel; arrays of different lengths are an error."""
    even = F.array_min(F.array(*[F.size(c) for c in columns])) == F.array_max(F.array(*[F.size(c) for c in columns]))
    zipped = F.arrays_zip(*columns)
    off = F.raise_error(F.concat(F.lit("arrays of different lengths in "), F.col(key).cast("string")))
    checked = packed.select(key, F.when(even, zipped).otherwise(off.cast(packed.select(zipped.alias("z")).schema["z"].dataType)).alias("z"))
    return checked.select(key, F.explode("z").alias("z")).select(key, *[F.col("z")[c].alias(c) for c in columns])


def checked_examples(rows: DataFrame, pad_id: int = PAD) -> DataFrame:
    """Passage rows back in their examples: a new one wherever the ordinal changes.

    rows: row (their order), idx (the ordinal), eid, passage_id, tokens, and by mention offsets (pairs), identifiers and ids (lists). An example of two eids, and a passage whose three lists of mentions differ in length, are errors. Lists of
    identifiers are padded to the longest of their passage, and a passage without mentions gets one of padding. Returned: eid, passage_ids, tokens, offsets, identifiers, ids (arrays by passage, in order). An ordinal that
    comes back later is an example of its own, told apart by row numbers that don't run on; nothing is numbered over all rows."""
    w = Window.partitionBy("idx").orderBy("row")
    island = F.col("row") - F.row_number().over(w)

    def filled(lists: str) -> Column:
        most = F.greatest(F.array_max(F.transform(lists, F.size)), F.lit(1))
        return F.when(F.size(lists) == 0, F.array(F.array(F.lit(pad_id).cast("long")))).otherwise(F.transform(lists, lambda x: pad(x, most, value=F.lit(pad_id).cast("long"))))

    counts = [F.size(c) for c in ("offsets", "identifiers", "ids")]
    even = (counts[0] == counts[1]) & (counts[1] == counts[2])
    off = F.raise_error(F.concat(F.lit("mentions, offsets and identifiers differ in number in "), F.col("eid").cast("string")))
    none = F.array(F.array(F.lit(pad_id).cast("long"), F.lit(pad_id).cast("long")))
    offsets = F.when(~even, off.cast("array<array<bigint>>")).when(counts[0] == 0, none).otherwise(F.col("offsets"))
    passage = F.struct("row", "passage_id", "tokens", offsets.alias("offsets"), filled("identifiers").alias("identifiers"), filled("ids").alias("ids"))
    held = rows.withColumns({"island": island, "passage": passage}).groupBy("idx", "island").agg(F.min("eid").alias("low"), F.max("eid").alias("high"), F.array_sort(F.collect_list("passage")).alias("p"))
    mixed = F.raise_error(F.concat(F.lit("one example of two documents: "), F.col("low").cast("string"), F.lit(" and "), F.col("high").cast("string")))
    eid = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(mixed.cast(rows.schema["eid"].dataType))
    part = lambda name: F.transform("p", lambda x: x[name])
    return held.select(eid.alias("eid"), part("passage_id").alias("passage_ids"), *[part(c).alias(c) for c in ("tokens", "offsets", "identifiers", "ids")])


def whole_texts(passages: DataFrame, annotations: DataFrame, title_abstract: bool = True) -> DataFrame:
    """(eid, part, text, mentions): title and abstract as one text, joined by a space, with the annotations of both; each later passage as a text of its own.

    passages: eid, passage_id, text; annotations: eid, passage_id, start, end (in the document, whose passages stand one character apart) and mention. Mentions are (start, end, mention) in the part's text, by place. Without title_abstract every passage is a part."""
    mine = annotations.groupBy("eid", "passage_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "mention"))).alias("found"))
    known = passages.select("eid", "passage_id", F.coalesce("text", F.lit("")).alias("text")).join(mine, ["eid", "passage_id"], "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint,mention:string>>")
    held = known.groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("passage_id", "text", F.coalesce("found", empty).alias("found")))).alias("p"))
    # Where each passage begins in the document.
    begins = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.aggregate(F.slice("p", F.lit(1), i), F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]) + 1))
    placed = held.select("eid", F.zip_with("p", begins, lambda x, b: F.struct(x["text"].alias("text"), x["found"].alias("found"), b.alias("begin"))).alias("p"))
    rebased = lambda x: F.transform(x["found"], lambda m: F.struct((m["start"] - x["begin"]).alias("start"), (m["end"] - x["begin"]).alias("end"), m["mention"].alias("mention")))
    alone = lambda x: F.struct(x["text"].alias("text"), rebased(x).alias("mentions"))
    if title_abstract:
        head = F.slice("p", 1, 2)
        first = F.struct(F.array_join(F.transform(head, lambda x: x["text"]), " ").alias("text"), F.flatten(F.transform(head, lambda x: x["found"])).alias("mentions"))
        parts = F.concat(F.array(first), F.transform(F.slice("p", F.lit(3), F.size("p")), alone))
    else:
        parts = F.transform("p", alone)
    return placed.select("eid", F.posexplode(parts).alias("part", "t")).select("eid", "part", "t.text", "t.mentions")


def collected_mentions(annotations: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(hexdigest, text, ids): one row per native mention with all its identifiers as in the map (identifier, id), in order; identifiers that the map lacks are an error, foreign mentions are left out.

    annotations: hexdigest, text, is_foreign, identifiers (an array)."""
    each = annotations.where("NOT is_foreign").select("hexdigest", "text", F.posexplode("identifiers").alias("k", "identifier"))
    native = each.withColumn("text", F.when(F.col("k") == 0, F.col("text")))  # once is enough
    met = native.join(identifiers.select("identifier", "id"), "identifier", "left")
    unknown = F.raise_error(F.concat(F.lit("no number for identifier "), F.col("identifier").cast("string")))
    mapped = met.withColumn("id", F.when(F.col("id").isNull(), unknown.cast("string")).otherwise(F.col("id").cast("string")))
    return mapped.groupBy("hexdigest").agg(F.max("text").alias("text"), F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda s: s["id"]).alias("ids"))
