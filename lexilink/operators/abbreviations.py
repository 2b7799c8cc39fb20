"""Abbreviations: extraction of (long form, short form) pairs, and re-location of mentions after expansion.

Extraction follows the published Schwartz-Hearst rules: a candidate stands in parentheses after its long form, has two to ten characters and a letter, and its characters
are found in the long form from right to left, the first at the start of a word.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilink.operators.corpus import replace_in_order

_INSIDE = re.compile(r"\(([^()\n]{2,60})\)")


def long_form(short: str, before: str) -> str | None:
    """The shortest text at the end of `before` that spells `short`."""
    words = before.split()
    window = " ".join(words[-min(len(short) + 5, len(short) * 2) :])
    at = len(window)
    for k in range(len(short) - 1, -1, -1):
        c = short[k].lower()
        if not c.isalnum():
            continue
        at -= 1
        while at >= 0 and (window[at].lower() != c or (k == 0 and at > 0 and window[at - 1].isalnum())):
            at -= 1
        if at < 0:
            return None
    found = window[at:] if at == 0 else window[window.rfind(" ", 0, at) + 1 :]
    return None if len(found) <= len(short) or short in found.split() else found


def parentheses(text: str):
    """(before, inside) of every pair of parentheses without others in it: the rest of the line before it, white space at its end left out. Each character is looked at a fixed number of times, however long lines are."""
    at = 0
    for found in _INSIDE.finditer(text):
        before = text[at : found.start()].rstrip()
        yield before[max(before.rfind(c) for c in "()\n") + 1 :], found.group(1)
        at = found.end()


def extract_pairs(text: str) -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    for before, inside in parentheses(text or ""):
        short = re.split(r"[,;]", inside)[0].strip()
        if 2 <= len(short) <= 10 and len(short.split()) <= 2 and any(c.isalpha() for c in short) and short[0].isalnum():
            found = long_form(short, before)
            if found:
                out.setdefault(short, found)
    return list(out.items())


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, ord, short, long) of every text."""

    def run(iterator):
        for pdf in iterator:
            rows = [(doc, k, s, lf) for doc, text in zip(pdf["doc"], pdf["text"], strict=True) for k, (s, lf) in enumerate(extract_pairs(text))]
            yield pd.DataFrame(rows, columns=["doc", "ord", "short", "long"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInPandas(run, "doc long, ord long, short string, long string")


def parse_extractor_output(lines: DataFrame, block: int = 1_000_000) -> DataFrame:
    """(doc, short, long, score) from lines (ord, line): a header `id|...` names the document of the rows `short|long|score` below it.

    A header holds until the next one: within blocks of lines by a window, and from block to block by each block's last header."""
    parts = F.split("line", r"\|", -1)
    is_row = (F.size(parts) == 3) & F.get(parts, F.lit(2)).try_cast("double").isNotNull()
    header = F.when(F.get(parts, F.lit(0)).rlike(r"^\d+$") & ~is_row, F.get(parts, F.lit(0)).cast("int"))
    blocks = lines.select("ord", parts.alias("parts"), header.alias("header"), F.floor(F.col("ord") / block).alias("block"))
    last = blocks.groupBy("block").agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("ord"))).alias("last"))
    before = last.select("block", F.last("last", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    within = F.last("header", ignorenulls=True).over(Window.partitionBy("block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    known = blocks.withColumn("within", within).join(F.broadcast(before), "block").withColumn("doc", F.coalesce("within", "before"))
    rows = known.where((F.size("parts") == 3) & F.get("parts", F.lit(2)).try_cast("double").isNotNull())
    return rows.select("doc", F.trim(F.get("parts", F.lit(0))).alias("short"), F.trim(F.get("parts", F.lit(1))).alias("long"), F.get("parts", F.lit(2)).cast("double").alias("score"))


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def relocate(text: str, mentions: list[str]) -> list[tuple[int, int] | None]:
    """Whole-word places of mentions, left to right, each looked for from the end of the one before."""
    out, at, lost = [], 0, set()
    for m in mentions:
        # What isn't found from one place on isn't found from a later one.
        start = text.find(m, at) if m and m not in lost else -1
        while start >= 0 and (_in_word(text, start - 1) or _in_word(text, start + len(m))):
            start = text.find(m, start + 1)
        if start < 0:
            lost.add(m)
            out.append(None)
        else:
            at = start + len(m)
            out.append((start, at))
    return out


def remap_mentions(passages: DataFrame) -> DataFrame:
    """(doc, passage_id, mention, start, end, place) of the mentions that are found, in offsets of the document, with their places in the passage by start.

    passages has (doc, passage_id, offset, text, mentions); mentions are in the order of the text."""
    names = ["doc", "passage_id", "mention", "start", "end", "place"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]

    def run(iterator):
        # Few passages at a time: a row for each of their mentions is held.
        for batch in (whole.slice(at, 200) for whole in iterator for at in range(0, whole.num_rows, 200)):
            columns = [[] for _ in names]
            for doc, pid, offset, text, mentions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mentions = mentions or []
                # Places ascend, as each mention is looked for from the end of the one before.
                found = [(m, *span) for m, span in zip(mentions, relocate(text or "", mentions), strict=True) if span]
                if found:
                    words, starts, ends = zip(*found, strict=True)
                    added = [doc] * len(found), [pid] * len(found), words, [offset + x for x in starts], [offset + x for x in ends], range(1, len(found) + 1)
                    for column, more in zip(columns, added, strict=True):
                        column.extend(more)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = passages.select(F.col("doc").cast("long"), F.col("passage_id").cast("long"), F.col("offset").cast("long"), "text", "mentions")
    return rows.mapInArrow(run, "doc long, passage_id long, mention string, start long, end long, place int")


def expand(rows: DataFrame, text: str, mentions: str, pairs: str) -> DataFrame:
    """rows with every pair's short form replaced by its long form, in their order, in the text and within each of its mentions."""
    return rows.withColumns({text: replace_in_order(F.col(text), F.col(pairs)), mentions: F.transform(mentions, lambda m: F.aggregate(pairs, m, lambda t, p: F.replace(t, p["short"], p["long"])))})
