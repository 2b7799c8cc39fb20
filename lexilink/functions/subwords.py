"""The tokenizer seam: ids and character offsets of whole texts by a given tokenizer, and spans of characters as spans of tokens."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around mentions and, reserved, around foreign ones.
SPECIAL = ("[MS]", "[ME]", "[FS]", "[FE]")


def from_file(path: str, special: tuple[str, ...] = ()) -> Callable:
    """A tokenizer of the tokenizers library, with further special tokens that it lacks at the end of its vocabulary; loaded once per worker."""

    def load(kept: dict = {}):  # noqa: B006
        if path not in kept:
            from tokenizers import Tokenizer

            kept[path] = Tokenizer.from_file(path)
            kept[path].add_special_tokens([s for s in special if kept[path].token_to_id(s) is None])
        return kept[path]

    return load


def word_tokenizer(special: tuple[str, ...] = ()) -> Callable:
    """Words between white space, all unknown: offsets without a vocabulary."""

    def load():
        from tokenizers import Tokenizer, models, pre_tokenizers

        t = Tokenizer(models.WordLevel({"[UNK]": 0}, unk_token="[UNK]"))
        t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        t.add_special_tokens(list(special))
        return t

    return load


def tokenize(df: DataFrame, key: list[str], text: str, load: Callable, rows: int = 256) -> DataFrame:
    """key, ids, starts, ends (in characters) of every whole text; a null text has no tokens."""
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)

    def run(iterator):
        tokenizer = load()
        for batch in iterator:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = tokenizer.encode_batch([t or "" for t in part.column(len(key)).to_pylist()], add_special_tokens=False)
                lists = [[e.ids for e in found], [[s for s, _ in e.offsets] for e in found], [[e for _, e in x.offsets] for x in found]]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(key)], *[pa.array(x, pa.list_(pa.int32())) for x in lists]], [*key, "ids", "starts", "ends"])

    return df.select(*key, F.col(text).alias("text")).mapInArrow(run, f"{fields}, ids array<int>, starts array<int>, ends array<int>")


def token_span(start: Column, end: Column, starts: Column, ends: Column) -> Column:
    """(first, last) token of a character span; a span that doesn't begin and end with tokens is an error."""
    first, last = F.array_position(starts, start.cast("int")), F.array_position(ends, end.cast("int"))
    off = F.raise_error(F.concat(F.lit("no tokens begin and end with the span "), start.cast("string"), F.lit("-"), end.cast("string")))
    return F.when((first > 0) & (last >= first), F.struct((first - 1).cast("int").alias("first"), (last - 1).cast("int").alias("last"))).otherwise(off.cast("struct<first:int,last:int>"))


def extended_vocabulary(vocabulary: DataFrame, needed: DataFrame) -> DataFrame:
    """(token, code): the vocabulary and, behind its largest code, the needed tokens that it lacks, in their order; both are (token, code) and (token, place)."""
    from lexilink.operators.sharding import global_row_number

    top = vocabulary.agg(F.coalesce(F.max("code"), F.lit(-1)).alias("top"))
    fresh = global_row_number(needed.groupBy("token").agg(F.min("place").alias("place")).join(vocabulary, "token", "left_anti"), ["place", "token"], "n", 1)
    return vocabulary.select("token", "code").unionByName(fresh.join(F.broadcast(top)).select("token", (F.col("n") + F.col("top")).alias("code")))
