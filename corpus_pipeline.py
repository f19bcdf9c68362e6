"""The training-data pipeline over documents: quality classifier, quality rules, line dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read
again as the next stage's docs. All but the last return the columns of documents; packing returns the pieces of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewake.llm import linededup, packing, rules, simhash, weaklabel
from framewake.llm.common import Tables, documents, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, trained on the weak labels of this input, keeps.

    Null and empty texts, and such of white space, go. Repeated rows share one decision. Extra columns, whatever their names,
    are handed through; an empty table stays empty.
    """
    return weaklabel.keep_good(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table.

    A null text counts as one without words, and goes as all of under 20 words do. Repeated rows share one decision. Extra
    columns are handed through; an empty table stays empty.
    """
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which each line that ten or more of them share stays only where it occurs first.

    First is the smallest doc_id; of repeated ids the first row by file and place in it; null ids come last. Every row
    counts as a document and every row stays, its text shortened, a null one as the empty text; n_chars is the new length.
    Other columns are handed through; an empty table stays empty.
    """
    return linededup.dedupe_lines(docs, first=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id.

    Of rows with that id the first by file and place in it stays; rows of null ids come last. Null and empty texts have
    fingerprint zero and are one group. Columns are handed through as they were; an empty table stays empty.
    """
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of 1024 tokens.

    Null and empty texts are the end id alone; repeated rows and ids are packed each; an empty table gives no piece.
    """
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("packing", pack)]

#: Fingerprints, the trained scorer and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage stored is deleted when the next one has read it."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with Tables(spark) as tables:
            docs = stored(stage(spark, docs, sf_dir), name)
        tables.delete(but=(tables.paths[-1],))
        if before:
            before.delete()
        before = tables
    return STAGES[-1][1](spark, docs, sf_dir)
