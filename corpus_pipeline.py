"""A corpus pipeline of five stages; each takes the documents that the one before it kept.

All stages keep the columns of documents but for the last. A null text is treated as an empty one, and stays null where the
row is kept. Columns besides doc_id and text may have any names and values. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, training_fold, with_checkpoints
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.jaccard_join import one_of_each_class
from tessera.llm.piece_bpe import encode_decode
from tessera.llm.queries import piece_model
from tessera.llm.secret_scan import redact_secrets
from tessera.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go; each row is judged by its whole text alone, so repeated rows share their fate.

    The model learns from the labels outside of the held-out fold. With too few labels it is their rate for every text.
    """
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels").where(training_fold(5, 0))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id, one without doc_id only if all lack it.

    Rows equal in doc_id and text are one document. Empty and null texts are in no group and all stay, repeated rows once.
    """
    return one_of_each_class(with_checkpoints(spark, docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, up to edits in a fifth of its words, go; repeated rows each by themselves.

    Items that are null or have no words match nothing.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, and the user names and endpoints that are linked to one, are replaced by a mark; no row goes.

    n_chars follows the new text. Spans that overlap become one mark. Repeated rows are changed alike.
    """
    return redact_secrets(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded and n_tokens of every row; the other columns end here. A null text has the begin and end ids alone."""
    return encode_decode(docs, piece_model()).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("pieces", pieces),
]

#: The models and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_checkpoints(spark, table(spark, sf_dir, "documents"))
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
