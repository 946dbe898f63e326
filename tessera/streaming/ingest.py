"""New documents as a stream: cleaning and chunking keep no state, so the batch functions serve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean
from tessera.operators import chunking
from tessera.operators.sections import sections


def stream_chunks(docs: DataFrame, strategy: str = "fixed", size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Chunks of a stream of (doc_id, text); texts are NFC."""
    cleaned = docs.select("doc_id", clean(F.col("text")).alias("text"))
    if strategy != "fixed":
        cleaned = cleaned.withColumn("sections", sections("text"))
    return chunking.chunk_documents(cleaned, strategy, size, overlap)
