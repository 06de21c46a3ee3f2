"""The corpus pipeline: stages over documents, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents; the last adds the pieces of each text.

Defined results: a null or empty text has no letter, so the first stage drops it; very long texts go through whole; rows that
repeat id and text leave one row, rows that repeat an id with other texts are judged each by its own text; of equal texts the
longest original stays, then the least id (null last); of near copies the least id; an empty table gives an empty table with the same columns; other columns
pass through unchanged, but those named like the ones that the last stage adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import keep, read
from loomstat.llm.decontamination import drop_leaks
from loomstat.llm.exact_dedup import drop_duplicates
from loomstat.llm.language_id import fit_language_model, keep_identified
from loomstat.llm.ngram_join import one_of_each_group
from loomstat.llm.queries import vocabulary
from loomstat.llm.sentencepiece_lattice import load_pieces, with_pieces
from loomstat.shipping import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter go."""
    ship(spark)
    return keep_identified(docs, fit_language_model(docs, F.lit(True)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_duplicates(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces."""
    ship(spark)
    return with_pieces(docs, load_pieces(vocabulary("piece_bpe_32k.model")))


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("n-gram join", ngram_join), ("decontamination", decontamination), ("SentencePiece", sentencepiece)]

#: SQL cannot say the first and last stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
