"""A training-data pipeline: each stage reads what its predecessor kept, as Parquet, and its decisions take effect.

Texts of no clear language go; one document of each near-duplicate group stays; benchmark passages are cut out; secrets
are replaced by a placeholder; what is left is encoded, with a check that decoding gives the text back.

Defined cases: the language stage drops null, empty and letterless texts, which have no language; later stages keep null
texts as they are. Rows with a null doc_id pass like any other. Repeated rows are copies, of which one stays. An empty
table gives no rows. Columns that documents has besides its own pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import discard, materialise, read_table
from heliograph.llm.decontaminate import remove_contamination
from heliograph.llm.language import fit_dictionaries, identify_language
from heliograph.llm.lexicon import bpe_round_trip
from heliograph.llm.ngram_join import keep_one
from heliograph.llm.queries import TOKENIZER
from heliograph.llm.secret_scan import fit_on_texts, redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language is clear: a text of no letters, of a narrow margin or of two languages goes."""
    names = ["text" if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)]  # so that no column meets a result's name
    return identify_language(docs.toDF(*names), fit_dictionaries(docs)).where(~F.col("rejected")).select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts that are 0.8 alike or more in runs of five words: that of the smallest doc_id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the words of benchmark passages; n_chars follows the text."""
    return remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a placeholder for each secret; n_chars follows the text."""
    return redact(docs, fit_on_texts(docs))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token number and digests of the ids and of the decoded text for each row."""
    return bpe_round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("bpe", bpe)]
# Compression, MinHash, suffix arrays, forests and merges are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all documents; a stage's table is deleted once the next is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
