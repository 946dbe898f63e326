"""Character-bigram BM25 over chunks (chunk_no, text), for many questions (q_id, question) at once.

Bigrams are counted in Arrow batches. A ranking broadcasts a bounded block of questions, multiplies each batch of chunks by
it, and passes on the best chunks of each partition, so that neither postings nor pairs of question and chunk are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import grams as gr
from tessera.operators.topk import SCORED, Best

K1, B = 1.2, 0.75
#: Scores are compared after rounding to so many places, so that the order of a sum does not decide ties.
PLACES = 9
#: Bytes of questions, and cells of their bigram table, in one block; more are searched in blocks.
QUESTION_BYTES, QUESTION_CELLS = 1 << 20, 4 << 20
#: Chunks that are multiplied at a time.
CHUNKS = 512


def gram_table(chunks: DataFrame) -> DataFrame:
    """chunk_no, length, codes and counts: the bigrams of each chunk as numbers, for an index that is searched often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in gr.steps(batch):
                row, code, n, length = gr.counted(gr.texts_of(part))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([part.column("chunk_no"), pa.array(length, pa.int64()), lists(code, pa.int64()), lists(n, pa.int64())], names=["chunk_no", "length", "codes", "counts"])

    return chunks.select(F.col("chunk_no").cast("long").alias("chunk_no"), "text").mapInArrow(run, "chunk_no long, length long, codes array<long>, counts array<long>")


def term_frequencies(chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """chunk_no, gram, tf, len, without a shuffle, as each chunk is one row; of the grams in only where that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in gr.steps(batch):
                row, code, n, length = gr.counted(gr.texts_of(part))
                kinds, at = np.unique(code, return_inverse=True)
                names = pa.array([gr.gram_text(c) for c in kinds.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("chunk_no").take(pa.array(row)), names.take(pa.array(at)), pa.array(n, pa.int64()), pa.array(length[row], pa.int64())], names=["chunk_no", "gram", "tf", "len"])

    rows = chunks.select(F.col("chunk_no").cast("long").alias("chunk_no"), "text").mapInArrow(run, "chunk_no long, gram string, tf long, len long")
    return rows if only is None else rows.join(only.select("gram").distinct(), "gram", "left_semi")


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """gram and df, the number of chunks that have it; batches are added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in gr.steps(batch):
                _, code, _, _ = gr.counted(gr.texts_of(part))
                kinds, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([gr.gram_text(c) for c in kinds.tolist()], pa.string()), pa.array(n, pa.int64())], names=["gram", "df"])

    return chunks.select("text").mapInArrow(run, "gram string, df long").groupBy("gram").agg(F.sum("df").alias("df"))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: chunk count and mean length in grams (1 for an empty corpus)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in gr.steps(batch):
                code, _ = gr.grams(gr.texts_of(part))
                yield pa.RecordBatch.from_pydict({"n": pa.array([part.num_rows], pa.int64()), "total": pa.array([len(code)], pa.int64())})

    sums = chunks.select("text").mapInArrow(run, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return sums.select("n", F.when(F.col("total") == 0, 1.0).otherwise(F.col("total") / F.col("n")).alias("mean"))


def gram_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def postings(chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """gram, chunk_no, weight. Document frequencies and mean length are those of the whole corpus."""
    rows = term_frequencies(chunks, only).join(document_frequencies(chunks), "gram").crossJoin(F.broadcast(corpus_statistics(chunks)))  # one row of statistics
    return rows.select("gram", "chunk_no", (gram_idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("mean"))).alias("weight"))


class Asked:
    """A block of questions: their bigrams, and which question has which (bigrams x questions)."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        code, row = gr.grams([q or "" for _, q in rows])
        self.codes, at = np.unique(code, return_inverse=True)
        self.table = np.zeros((len(self.codes), len(rows)))
        self.table[at, row] = 1.0

    def place(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of codes are asked for, and their places."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[at] == codes)
        return hit, at[hit]


def question_blocks(questions: DataFrame) -> Iterator[Asked]:
    """The questions in blocks of bounded size; each row is read once, partition by partition."""

    def fitting(rows: list[tuple[int, str]]) -> Iterator[Asked]:
        block = Asked(rows)
        if block.table.size <= QUESTION_CELLS or len(rows) == 1:
            yield block
        else:
            yield from fitting(rows[: len(rows) // 2])
            yield from fitting(rows[len(rows) // 2 :])

    rows, size = [], 0
    for r in questions.select(F.col("q_id").cast("long").alias("q_id"), "question").toLocalIterator():
        rows.append((r["q_id"], r["question"]))
        size += 4 * len(r["question"] or "")
        if size >= QUESTION_BYTES:
            yield from fitting(rows)
            rows, size = [], 0
    if rows:
        yield from fitting(rows)


def _terms(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch of chunks, or of a gram table, with row, code and count of their bigrams, and their lengths."""
    if "codes" in batch.schema.names:
        for a in range(0, batch.num_rows, CHUNKS):
            part = batch.slice(a, CHUNKS)
            codes = part.column("codes")
            row = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(codes)))
            yield part, row, np.asarray(codes.flatten()), np.asarray(part.column("counts").flatten()), np.asarray(part.column("length"))
    else:
        for part in gr.steps(batch, size=CHUNKS << 11):
            yield part, *gr.counted(gr.texts_of(part))


def block_statistics(chunks: DataFrame, block) -> tuple[int, float, np.ndarray]:
    """Chunk count, mean length, and the document frequency of each bigram of a broadcast block of questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, n, total = block.value, 0, 0
        df = np.zeros(len(asked.codes), np.int64)
        for batch in batches:
            for part, _, code, _, length in _terms(batch):
                df += np.bincount(asked.place(code)[1], minlength=len(df))
                n, total = n + part.num_rows, total + int(length.sum())
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(-2, len(df))), "n": pa.array(np.concatenate([[n, total], df]), pa.int64())})

    found = chunks.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(block.value.codes) + 2, np.int64)
    for r in found:  # two more rows than the block has bigrams, at most
        df[r["at"] + 2] = r["n"]
    return int(df[0]), float(df[1] / df[0]) if df[1] else 1.0, df[2:]


def idf_of(n: int, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


def question_statistics(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """gram (as a number), idf and mean of the questions' bigrams over all chunks: a row for each bigram that is asked for."""
    spark = chunks.sparkSession
    rows: dict[int, tuple[float, float]] = {}
    for asked in question_blocks(questions):
        n, mean, df = block_statistics(chunks, spark.sparkContext.broadcast(asked))
        rows.update(zip(asked.codes.tolist(), ((x, mean) for x in idf_of(n, df).tolist()), strict=True))
    return spark.createDataFrame([(c, *x) for c, x in rows.items()], "gram long, idf double, mean double")


def top(scored: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """Adds rank within q_id; keeps limit rows of each, if given."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(*order)))
    return out if limit is None else out.where(F.col("rank") <= limit)


def by_score(score: str = "score") -> tuple[Column, Column]:
    return F.round(score, PLACES).desc(), F.col("chunk_no").asc()


def bm25_scores(questions: DataFrame, chunks: DataFrame, limit: int | None = None, eligible: DataFrame | None = None) -> DataFrame:
    """q_id, chunk_no, score above 0; with limit the best of each partition. chunks has texts, or is a gram_table()."""
    spark = chunks.sparkSession
    rows = chunks.select("chunk_no", "length", "codes", "counts") if "codes" in chunks.columns else chunks.select(F.col("chunk_no").cast("long").alias("chunk_no"), "text")
    wanted = rows if eligible is None else rows.join(eligible.select("chunk_no").distinct(), "chunk_no", "left_semi")
    out = None
    for asked in question_blocks(questions):
        block = spark.sparkContext.broadcast(asked)
        n, mean, df = block_statistics(rows, block)
        idf = idf_of(n, df)

        def run(batches: Iterator[pa.RecordBatch], block=block, idf=idf, mean=mean) -> Iterator[pa.RecordBatch]:
            asked = block.value
            best = Best(asked.ids, limit)
            for batch in batches:
                for part, row, code, tf, length in _terms(batch):
                    hit, at = asked.place(code)
                    row, tf = row[hit], tf[hit]
                    weights = np.zeros((part.num_rows, len(asked.codes)))
                    weights[row, at] = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
                    best.add((weights @ asked.table).T, np.asarray(part.column("chunk_no")), 0.0)
            found = best.batch()
            if found is not None:
                yield found

        scored = wanted.mapInArrow(run, SCORED)
        out = scored if out is None else out.unionByName(scored)
    return spark.createDataFrame([], SCORED) if out is None else out


def bm25_ranking(questions: DataFrame, chunks: DataFrame, limit: int | None = 100, eligible: DataFrame | None = None) -> DataFrame:
    """q_id, chunk_no, score, rank. eligible (chunk_no) restricts results, never the statistics. chunks may be a gram_table()."""
    return top(bm25_scores(questions, chunks, limit, eligible), limit, *by_score())


def asked_terms(rows: DataFrame) -> DataFrame:
    """rows (text, question and keys) without these two, as gram, tf and len of the bigrams that the question asks for.

    Each row gives one row of gram -1 besides, so that its length counts where it has none of them.
    """
    keys = [c for c in rows.columns if c not in ("text", "question")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in gr.steps(batch):
                row, code, n, length = gr.counted(gr.texts_of(part))
                asked, which = gr.grams(gr.texts_of(part, "question"))
                kinds, at = np.unique(np.concatenate([code, asked]), return_inverse=True)
                own, wanted = row * len(kinds) + at[: len(code)], which * len(kinds) + at[len(code) :]
                hit = np.isin(own, wanted)
                every = np.arange(part.num_rows)
                row = np.concatenate([every, row[hit]])
                cols = [part.column(k).take(pa.array(row)) for k in keys]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([np.full(len(every), -1), code[hit]]), pa.int64()), pa.array(np.concatenate([np.zeros(len(every), np.int64), n[hit]]), pa.int64()), pa.array(length[row], pa.int64())], names=[*keys, "gram", "tf", "len"])

    types = dict(rows.dtypes)
    return rows.select(*keys, "text", "question").mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "gram long", "tf long", "len long"]))


def local_scores(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """candidates (q_id, chunk_no, text) with lexical: BM25 with the statistics of each question's candidates alone."""
    rows = candidates.select("q_id", "chunk_no", "text").join(questions.select("q_id", "question"), "q_id")
    q, qg = Window.partitionBy("q_id"), Window.partitionBy("q_id", "gram")
    itself = F.col("gram") < 0
    terms = asked_terms(rows).withColumns({"n": F.count_if(itself).over(q), "mean": F.avg(F.when(itself, F.col("len"))).over(q), "df": F.count(F.lit(1)).over(qg)})
    w = gram_idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean")))
    sums = terms.groupBy("q_id", "chunk_no").agg(F.sum(F.when(itself, 0.0).otherwise(w)).alias("lexical"))
    return candidates.join(sums, ["q_id", "chunk_no"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))


def z_score(value: Column | str, by: str = "q_id") -> Column:
    """Standard score within a question; 0 where all are equal."""
    w = Window.partitionBy(by)
    value = F.col(value) if isinstance(value, str) else value
    spread = F.stddev_pop(value).over(w)
    return F.when(F.round(spread, 12) == 0, 0.0).otherwise((value - F.avg(value).over(w)) / spread)
