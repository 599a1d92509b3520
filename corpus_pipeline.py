"""A corpus pipeline: toxic documents go, shared lines go, near-copies go, sources are mixed, and the rest is packed.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, with the columns of documents for all stages but the last.
Other columns of docs pass through all stages but the last, whatever their
names; an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contourlake.llm.common import shuffle_width, table, written
from contourlake.llm.lines import drop_shared_lines
from contourlake.llm.mixing import MAX_EPOCHS, mix
from contourlake.llm.packing import pack
from contourlake.llm.probminhash import keep_one
from contourlake.llm.toxicity import fit_toxicity, reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are toxic with a probability of a half or more go; the model is fitted on the labelled rows of docs.

    Null and empty texts have no features and get the model's base score. Rows without an id are scored but not fitted on,
    repeated rows are scored alike. Without toxic labels nothing is rejected.
    """
    return reject_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that two documents share stay in the one with the smallest id; no document goes, `n_chars` follows the text.

    A null or empty text is one empty line and comes out empty. Rows of one id are one document, whose lines are not shared by that alone.
    Lines of rows without an id stay and count for no other.
    """
    out = drop_shared_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the document with the smallest id stays.

    Texts without words, null and empty ones among them, are no copies of each other and stay, as do rows without an id;
    of rows with one id the one whose text has the smallest hash stays.
    """
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought towards equal weights: small ones repeat, up to MAX_EPOCHS times, and every document comes once at least. Rows are in the order of their turn.

    A null source is a source of its own; null and empty texts have no tokens and come once at least, as do repeated rows.
    """
    mixed = mix(docs, max_epochs=MAX_EPOCHS).repartitionByRange(shuffle_width(spark), "turn").sortWithinPartitions("turn")
    return mixed.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids.

    A null or empty text is the end mark alone; repeated rows, and rows without an id, are documents of their own.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Training, sketches and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order on documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
