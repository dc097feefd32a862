"""The corpus pipeline: five stages, each one of the training-data operators on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import decontaminate, line_dedup, mixing, near_copies, toxicity
from loomlog.llm.common import delete, read, run_tables, written

#: Weights of the sources in the mix, taken in turn by code point.
WEIGHTS = [5, 2, 1]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model is fitted on the labelled ones among docs.

    Null and empty texts get the base score; equal texts score alike; rows that share a doc_id are judged one by one.
    All columns of docs are returned. Without labelled documents nothing is dropped.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, toxicity.training_labels(spark, sf_dir)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one holds; n_chars follows the text.

    Every row stays; a text may become empty, and null stays null, with no n_chars. The smallest doc_id that holds a line keeps
    it, null ids first; rows that share a doc_id are one document. Columns of docs come back under their names.
    """
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard 0.8), the one of smallest doc_id.

    SimHash fingerprints within radius 2 give the first links, each checked on the shingles. They reach only almost exact
    copies, so what they leave apart is compared by the shingles themselves.
    Null, empty and wordless texts are copies of each other. Rows that repeat a doc_id stay once for each distinct text;
    rows without a doc_id go if their group has one. All columns of docs are returned.
    """
    return near_copies.drop_near_copies(docs, threshold=0.8, k=5)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows that share a doc_id stay or go together.

    Null and empty texts hold none. All columns of docs are returned. Without benchmark items nothing is dropped.
    """
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; a row for each row of docs, see mixing.mix_sources."""
    return mixing.mix_sources(docs, WEIGHTS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontaminate", drop_benchmark),
    ("mix_sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir.

    What a stage writes on its way is deleted once its result is written, and that once the next one's is. The last
    two stay, as the returned frame reads them.
    """
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with run_tables(spark) as made:
            docs = written(stage(spark, docs, sf_dir), name)
            result = made.pop()
        delete(spark, before)
        before = [result]
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model and XXH64 shingles are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
