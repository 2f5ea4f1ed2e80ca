"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzframe.llm import line_dedup, near_dedup, packing, pii, weak_rules
from quartzframe.llm.common import documents, materialize, release, scratch_mark
from quartzframe.llm.token_store import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weakly supervised rules reject.

    Null and empty texts are rejected, as they have too few words. Repeated rows, and rows of one id, are judged each by
    its own text. Long texts are read whole. All columns stay, whatever their names.
    """
    return weak_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that occur before, and documents of which no line is left.

    Null and empty texts have nothing to keep and are dropped. Rows with a null id keep all lines. Rows of one id and
    text are one occurrence, so repeated rows all stay. Ties can't occur: a line's first place is its least document and
    line number. Further columns stay.
    """
    return line_dedup.clean(docs).where(F.length("text") > 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the least id.

    Texts without words are linked with nothing and stay, as do rows with a null id. Repeated rows of one id and text stay
    once. Long texts are compared whole. Further columns stay.
    """
    return near_dedup.filter_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by format-preserving pseudonyms.

    Null and empty texts stay as they are; repeated rows are treated alike; long texts are searched whole. Further columns stay.
    """
    return pii.pseudonymize(docs, pii.QUERY_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences, a row for each piece.

    Null and empty texts have only their end id; repeated rows, and rows with a null id, are packed each on its own; long
    documents run over several sequences. Only doc_id and text are read.
    """
    return packing.pack(docs, tokenizer_path(packing.TOKENIZER), packing.END)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]

#: Expectation-maximisation, edit joins and tokenizers are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        mark = scratch_mark()
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark, keep=docs)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
