"""Outside predictors behind one face: what they read is written for them, what they write is parsed, and only corpora that they know are given to them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilink.operators.abbreviations import extract_pairs, parse_extractor_output
from lexilink.operators.sharding import global_row_number
from lexilink.sources.writers import one_line


class Predictor(ABC):
    """corpora: the names it takes, none for all."""

    corpora: tuple[str, ...] = ()

    @abstractmethod
    def create_input(self, passages: DataFrame) -> DataFrame:
        """(value): the lines it reads, of passages (eid, passage_id, text)."""

    @abstractmethod
    def parse_output(self, lines: DataFrame) -> DataFrame:
        """Its predictions, from the lines (ord, line) it wrote."""

    def run(self, passages: DataFrame, corpus: str, path: str, tool: Callable[[SparkSession, str, str], None]) -> DataFrame:
        """Writes `path`/in, lets the tool turn it into `path`/out, and parses that. Output lines are `number<tab>line`."""
        if self.corpora and corpus not in self.corpora:
            raise ValueError(f"{corpus} is none of {self.corpora}")
        spark = passages.sparkSession
        self.create_input(passages).select("value").write.text(f"{path}/in")
        tool(spark, f"{path}/in", f"{path}/out")
        parts = F.split("value", "\t", 2)
        return self.parse_output(spark.read.text(f"{path}/out").select(F.get(parts, F.lit(0)).cast("long").alias("ord"), F.get(parts, F.lit(1)).alias("line")))


class AbbreviationFinder(Predictor):
    """Reads `id|text` a line; writes a header `id|...` and, below it, `short|long|score`."""

    def create_input(self, passages: DataFrame) -> DataFrame:
        texts = passages.groupBy("eid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage_id", F.coalesce("text", F.lit("")).alias("text")))), lambda s: one_line(s["text"])), " ").alias("text"))
        return texts.select(F.concat_ws("|", F.col("eid").cast("string"), "text").alias("value"))

    def parse_output(self, lines: DataFrame) -> DataFrame:
        return parse_extractor_output(lines)


def find_abbreviations(spark: SparkSession, source: str, target: str) -> None:
    """The tool of AbbreviationFinder, in process: every text's definitions by the library's own rules."""

    def run(iterator):
        for pdf in iterator:
            rows = []
            for value in pdf["value"]:
                doc, _, text = value.partition("|")
                rows.append((int(doc), 0, f"{doc}|text"))
                rows += [(int(doc), k, f"{short}|{long}|1.0") for k, (short, long) in enumerate(extract_pairs(text), 1)]
            import pandas as pd

            yield pd.DataFrame(rows, columns=["doc", "k", "line"])

    lines = spark.read.text(source).mapInPandas(run, "doc long, k long, line string")
    global_row_number(lines, ["doc", "k"], "ord").select(F.concat_ws("\t", F.col("ord").cast("string"), "line")).write.text(target)
