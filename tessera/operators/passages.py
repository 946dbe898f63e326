"""Which documents hold which of many passages, word for word."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of passages that are searched for at a time; more are taken in blocks.
BLOCK = 4 << 20


def passage_blocks(questions: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows, size = [], 0
    for r in questions.select(F.col("q_id").cast("long").alias("q_id"), "question").where("question <> ''").toLocalIterator():
        rows.append((r["q_id"], r["question"]))
        size += len(r["question"])
        if size >= BLOCK:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def containing(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """q_id, doc_id of the documents (doc_id, text) that contain a question's text; empty texts are in none.

    An automaton of a bounded block of passages reads each text once, however many passages there are.
    """
    spark, out = docs.sparkSession, None
    schema = f"q_id long, doc_id {dict(docs.dtypes)['doc_id']}"
    for block in passage_blocks(questions):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            owners: dict[str, list[int]] = {}
            for q, text in shared.value:
                owners.setdefault(text, []).append(q)
            automaton = ahocorasick.Automaton()
            for text, ids in owners.items():
                automaton.add_word(text, tuple(ids))
            automaton.make_automaton()
            for batch in batches:
                found = [(q, at) for at, text in enumerate(batch.column("text").to_pylist()) for q in sorted({q for _, ids in automaton.iter(text or "") for q in ids})]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int64()), batch.column("doc_id").take(pa.array([at for _, at in found]))], names=["q_id", "doc_id"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
