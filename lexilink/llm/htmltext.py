"""Main text of HTML pages: blocks, a recurrent labeller over them, and the labelled blocks joined.

Edge cases: a null or empty page and a page without main text give the empty text; equal pages give equal texts; a page of any length is
read whole; an empty table gives an empty one; only the columns named are read, so further columns may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilink.llm import wordbytes as wb
from lexilink.llm.blocklabel import Labeller
from lexilink.llm.common import give_back
from lexilink.llm.htmlblocks import blocks


def main_texts(pages: list[str | None], model: Labeller, long: int = 200_000) -> list[str]:
    """Pages longer than `long` characters are read one at a time, so that of no two of them the blocks are held at once."""
    if len(pages) > 1 and any(len(p or "") > long for p in pages):
        out: list[str] = []
        few: list[str | None] = []
        for p in pages:
            if len(p or "") > long:
                out += main_texts(few, model, long) + main_texts([p], model, long)
                few = []
            else:
                few.append(p)
        return out + main_texts(few, model, long)
    found = [blocks(p or "") for p in pages]
    return ["\n\n".join(b.text for b, main in zip(f, labels, strict=True) if main) for f, labels in zip(found, model.label(found), strict=True)]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars per row of pages."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(iterator):
        model = Labeller.load()
        for batch in wb.batches(iterator, "html", 2 << 20):
            texts = main_texts(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])
        give_back()

    plain = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("html"))
    return plain.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
