"""A training corpus from `documents`: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and reads again as the next stage's docs; a stage's table goes once the next one is written. All
stages but the last return the columns of documents. The isolation forest and the packing can't be said in SQL, so ORACLE_SQL is None and the tests hold every stage against a brute-force version.

Edge cases, for docs of any stage: a null or empty text has no words, so the quality rules reject it; further on it has one empty line, is near nothing, holds no benchmark window and is
packed as its end token alone. Rows that repeat an id with other texts are judged each by its own text; rows that repeat both an id and a text are kept or rejected together until the join keeps one of them. Null ids are documents
like others: of a class of near duplicates, one with an id stays before one without, the smallest id first, then the smallest hash of a text. Tables without rows give tables without rows. Columns beyond those of documents come along whatever
their names are, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilink.llm.common import Scratch, table, written
from lexilink.llm.decontaminate import remove_contaminated
from lexilink.llm.jaccard import keep_one
from lexilink.llm.linededup import dedup_lines
from lexilink.llm.packing import pack_documents
from lexilink.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in three documents or more stay in the one with the largest id; n_chars follows the text."""
    less = dedup_lines(docs, with_counts=False)
    return less.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return keep_one(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's token ids goes."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        before = None
        for name, stage in STAGES[:-1]:
            docs = scratch.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            if before is not None:
                scratch.drop(before)
            before = docs
        return written(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
