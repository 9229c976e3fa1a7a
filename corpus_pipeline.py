"""A corpus pipeline: toxicity, language, near duplicates, mixing and tokens, each stage one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's docs. Rows with a null text pass the toxicity
stage and go at the language stage, which finds no language in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import bpe, langid, raking, simhash, toxicity
from siteloom.llm.common import forget, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go; all columns stay.

    A null, empty or wordless text stays, and everything where labels lack a class; an equal score stays; repeated rows share a fate; whole texts are scored; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or clearly in another than declared, go; all columns stay.

    A null or empty text, or one without letters, goes; a null declared language contradicts nothing; of languages at one distance the first by name counts; repeated rows share a fate; whole texts are
    ranked; an empty table stays empty.
    """
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id, with all columns.

    Rows without id, text or word stay; of rows of one id and text one stays; rows of one id and other texts are documents of their own; texts of any length vote whole; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by raked weights, half of all tokens (raking.SHARE), with all columns.

    Null sources and languages are margins of their own; a null or empty text has topic 0 and no tokens; a row without id is drawn by its text; rows of one id and cell share a fate; an empty
    table stays empty.
    """
    return raking.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, tokens, n_tokens, exact) of what is left.

    A null text has null tokens, an empty one none; repeated rows give repeated rows; whole texts are encoded; an empty table gives no rows.
    """
    return bpe.tokenize(docs, keep=("lang", "source"))


STAGES = [("toxicity", drop_toxic), ("language_id", keep_identified), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("byte_bpe", tokenize)]

#: SQL cannot express the stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between two of them the rows are written as Parquet in the shared checkpoint folder, and deleted when the next stage's are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
            if before is not None:
                forget(before)
            before = docs
    return docs
