"""Fusion, expansion, reranking and selection of hits; every frame is keyed by q_id, so one job serves all questions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bigrams, filter_key, nfc
from tessera.operators.dense import dot
from tessera.operators.lexical import PLACES, asked_terms, local_scores, saturation, top, z_score
from tessera.session import broadcast_if_small, with_checkpoints

RRF_K, CAP = 60, 2
EXPAND_DOCS, EXPAND_CHUNKS, COMPARE_DOCS = 2, 5, 3


def rrf(rankings: list[DataFrame], k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (q_id, chunk_no, rank): q_id, chunk_no, rrf_score, rank. Ties keep first-seen order."""
    lists = [r.select("q_id", "chunk_no", "rank", F.lit(i).alias("list")) for i, r in enumerate(rankings)]
    rows = lists[0]
    for x in lists[1:]:
        rows = rows.unionByName(x)
    fused = rows.groupBy("q_id", "chunk_no").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.min(F.struct("list", "rank")).alias("first"))
    return top(fused, limit, F.round("rrf_score", 12).desc(), F.col("first.list"), F.col("first.rank")).drop("first")


def metadata_filter(chunks: DataFrame, filters: dict[str, str], metadata: str = "metadata") -> DataFrame:
    """Chunks whose metadata equal every filter, both sides in NFC; a missing key fails."""
    for key, value in filters.items():
        chunks = chunks.where(nfc(F.try_element_at(F.col(metadata), F.lit(key))) == unicodedata.normalize("NFC", value))
    return chunks


def resolved(filters: dict[str, str], chunks: DataFrame, metadata: str = "metadata") -> dict[str, str]:
    """filters with their values resolved against those that chunks have; the driver gets one row for each filter."""
    if not filters:
        return {}
    spark = chunks.sparkSession
    keys = F.explode(F.array(*map(F.lit, filters)))
    known = chunks.select(keys.alias("key"), metadata).select("key", nfc(F.try_element_at(F.col(metadata), F.col("key"))).alias("value")).where("value is not null").distinct()
    wanted = spark.createDataFrame([(0, k, unicodedata.normalize("NFC", v)) for k, v in filters.items()], "q_id int, key string, value string")
    found = resolve_filters(wanted, known)
    return {r["key"]: r["value"] for r in found.collect()}


def resolve_filters(filters: DataFrame, values: DataFrame) -> DataFrame:
    """filters (q_id, key, value) with value replaced by the only known value (key, value) whose key contains its own.

    An exact match, none or several leave it as it is. values has distinct metadata values: one for each key, not rows.
    """
    known = values.select(F.col("key"), F.col("value").alias("known"), filter_key(F.col("value")).alias("known_key")).distinct()
    pairs = filters.withColumn("wanted", filter_key(F.col("value"))).join(known, "key", "left")
    contains = (F.col("wanted") != "") & F.contains("known_key", "wanted")
    found = pairs.groupBy("q_id", "key", "value").agg(
        F.count_if(contains).alias("n"), F.max(F.when(contains, F.col("known"))).alias("only"), F.coalesce(F.max(F.col("known") == F.col("value")), F.lit(False)).alias("exact")
    )
    return found.select("q_id", "key", F.when(~F.col("exact") & (F.col("n") == 1), F.col("only")).otherwise(F.col("value")).alias("value"))


def overlap_share(grams: Column, own: Column) -> Column:
    return F.size(F.filter(grams, lambda g: F.array_contains(own, g))) / F.greatest(F.size(grams), F.lit(1))


def residual_question(question: Column, project: Column) -> Column:
    """question without the words half of whose bigrams stand in project; question itself if none is left."""
    own = F.array_distinct(bigrams(project))
    kept = F.filter(F.filter(F.split(question, r"(?U)\s+"), lambda w: w != ""), lambda w: (F.size(bigrams(w)) == 0) | (overlap_share(bigrams(w), own) < 0.5))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), question)


def first_docs(candidates: DataFrame, n: int) -> DataFrame:
    """The first n distinct documents of each question's candidates (q_id, doc_id, rank)."""
    firsts = candidates.groupBy("q_id", "doc_id").agg(F.min("rank").alias("first_rank"))
    return firsts.withColumn("doc_rank", F.row_number().over(Window.partitionBy("q_id").orderBy("first_rank"))).where(F.col("doc_rank") <= n)


def within_documents(texts: DataFrame, chunks: DataFrame, statistics: DataFrame) -> DataFrame:
    """BM25 of each (q_id, doc_id, question) among the document's own chunks (doc_id, chunk_no, text).

    statistics is that of lexical.question_statistics() over all chunks, for the bigrams of these questions.
    """
    rows = chunks.select("doc_id", "chunk_no", "text").join(texts.select("q_id", "doc_id", "question"), "doc_id")
    terms = asked_terms(rows).join(broadcast_if_small(statistics, 24), "gram")
    weight = F.col("idf") * saturation(F.col("tf"), F.col("len"), F.col("mean"))
    scored = terms.groupBy("q_id", "doc_id", "chunk_no").agg(F.sum(weight).alias("score")).where("score > 0")
    order = Window.partitionBy("q_id", "doc_id").orderBy(F.round("score", PLACES).desc(), "chunk_no")
    return scored.withColumn("rank", F.row_number().over(order))


def expand_candidates(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, statistics: DataFrame, projects: DataFrame, count: int = EXPAND_CHUNKS, docs: int = EXPAND_DOCS, aspects: bool = False) -> DataFrame:
    """Candidates (q_id, chunk_no, doc_id, rank), then up to count unseen chunks of each of the first docs documents.

    The added chunks (of chunks: doc_id, chunk_no, text) are the document's best for the question less its project words;
    expanded marks them. With aspects, a question of several sentences is replaced by the one that has least in common with
    the document's first candidate.
    """
    first = first_docs(candidates, docs).join(questions.select("q_id", "question"), "q_id").join(projects.select("doc_id", "project"), "doc_id", "left")
    rest = residual_question(F.col("question"), F.coalesce("project", F.lit("")))
    if aspects:
        met = candidates.select("q_id", "doc_id", F.col("rank").alias("first_rank"), "chunk_no").join(chunks.select("chunk_no", F.col("text").alias("met")), "chunk_no").drop("chunk_no")
        first = first.join(met, ["q_id", "doc_id", "first_rank"], "left")
        rest = F.coalesce(aspect_sentence(F.col("question"), F.coalesce("met", F.lit(""))), rest)
    asked = first.select("q_id", "doc_id", "doc_rank", rest.alias("question"))
    best = within_documents(asked, chunks, statistics).join(candidates.select("q_id", "chunk_no"), ["q_id", "chunk_no"], "left_anti")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q_id", "doc_id").orderBy("rank"))).where(F.col("n") <= count)
    last = candidates.groupBy("q_id").agg(F.max("rank").alias("last"))
    added = best.join(asked.select("q_id", "doc_id", "doc_rank"), ["q_id", "doc_id"]).join(last, "q_id")
    added = added.select("q_id", "chunk_no", "doc_id", (F.col("last") + (F.col("doc_rank") - 1) * count + F.col("n")).cast("int").alias("rank"), F.lit(True).alias("expanded"))
    return candidates.select("q_id", "chunk_no", "doc_id", F.col("rank").cast("int").alias("rank"), F.lit(False).alias("expanded")).unionByName(added)


def lexical_rerank(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Candidates (q_id, chunk_no, text, score, rank) by the sum of standard scores of cosine and local BM25."""
    scored = local_scores(candidates, questions)
    scored = scored.withColumn("rerank_score", z_score("score") + z_score("lexical")).withColumnRenamed("rank", "candidate_rank")
    return top(scored, None, F.round("rerank_score", PLACES).desc(), F.col("candidate_rank"))


def model_rerank(candidates: DataFrame, questions: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]], batch: int = 16) -> DataFrame:
    """Candidates by the scores an injected model gives to (question, passage) pairs."""

    @F.pandas_udf("double")
    def score(question: pd.Series, passage: pd.Series) -> pd.Series:
        pairs = list(zip(question, passage, strict=True))
        out = [float(s) for a in range(0, len(pairs), batch) for s in model(pairs[a : a + batch])]
        if len(out) != len(pairs) or not pd.Series(out).map(lambda x: abs(x) < float("inf")).all():
            raise ValueError("the model gave too few scores, or one that is not finite")
        return pd.Series(out)

    scored = candidates.join(questions.select("q_id", "question"), "q_id").withColumn("rerank_score", score("question", "text")).drop("question")
    return top(scored.withColumnRenamed("rank", "candidate_rank"), None, F.col("rerank_score").desc(), F.col("candidate_rank"))


def cap_per_doc(ranked: DataFrame, cap: int | None = CAP, limit: int | None = None, lifted: DataFrame | None = None) -> DataFrame:
    """At most cap hits of a document, in rank order, then limit of a question. Questions in lifted have no cap."""
    rows = ranked.withColumn("of_doc", F.row_number().over(Window.partitionBy("q_id", "doc_id").orderBy("rank")))
    if lifted is not None:
        rows = rows.join(lifted.select("q_id", F.lit(True).alias("free")).distinct(), "q_id", "left")
    if cap is not None:
        rows = rows.where((F.col("of_doc") <= cap) | (F.coalesce(F.col("free"), F.lit(False)) if lifted is not None else F.lit(False)))
    rows = rows.drop("of_doc", "free", "hit_no")
    out = rows.withColumn("hit_no", F.row_number().over(Window.partitionBy("q_id").orderBy("rank")))
    return out if limit is None else out.where(F.col("hit_no") <= limit)


def document_signatures(chunks: DataFrame) -> DataFrame:
    """doc_id and the least doc_id whose ordered chunk texts are the same."""
    signature = chunks.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", F.sha2("text", 256).alias("h")))), lambda x: x["h"]), ","), 256).alias("signature"))
    return signature.withColumn("same_as", F.min("doc_id").over(Window.partitionBy("signature"))).drop("signature")


def select_without_repeats(ranked: DataFrame, signatures: DataFrame, cap: int | None = CAP, limit: int | None = None, lifted: DataFrame | None = None) -> DataFrame:
    """Greedy choice in rank order: equal documents share a cap, and a text is taken once. Questions in lifted have no cap.

    A hit that the cap turns away does not count as taken, so the choice depends on its order and is made by question. A
    question's candidates are a pool of at most some hundreds, whatever the corpus.
    """
    rows = ranked.join(signatures, "doc_id", "left").select("q_id", "chunk_no", "doc_id", "text", "rank", F.coalesce("same_as", "doc_id").alias("same_as"))
    free = lifted.select("q_id", F.lit(True).alias("free")).distinct() if lifted is not None else None
    rows = rows.withColumn("free", F.lit(False)) if free is None else rows.join(free, "q_id", "left").withColumn("free", F.coalesce("free", F.lit(False)))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group, taken, counts, kept = group.sort_values("rank"), set(), {}, []
        most = None if cap is None or group["free"].iloc[0] else cap
        for at, (doc, text) in enumerate(zip(group["same_as"], group["text"], strict=True)):
            if (most is None or counts.get(doc, 0) < most) and text not in taken:
                counts[doc] = counts.get(doc, 0) + 1
                taken.add(text)
                kept.append(at)
        out = group.iloc[kept].head(limit) if limit else group.iloc[kept]
        return out.assign(hit_no=range(1, len(out) + 1))[["q_id", "chunk_no", "doc_id", "rank", "hit_no"]]

    types = dict(ranked.dtypes)
    return rows.groupBy("q_id").applyInPandas(choose, f"q_id {types['q_id']}, chunk_no {types['chunk_no']}, doc_id {types['doc_id']}, rank int, hit_no int")


def name_grams(names: DataFrame, share: float = 0.05) -> DataFrame:
    """doc_id, gram of names (doc_id, name): bigrams that at most a share of all names, or one, have."""
    total = names.agg(F.count(F.lit(1)).alias("total"))
    grams = names.select("doc_id", F.explode(F.array_distinct(bigrams(F.col("name")))).alias("gram"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).where(F.col("df") <= F.greatest(F.lit(1.0), F.col("total") * share))
    return grams.join(df.select("gram"), "gram")


def named_docs(questions: DataFrame, ranked: DataFrame | None, own: DataFrame) -> DataFrame:
    """q_id, doc_id, named_rank, strict: candidate documents whose own name bigrams a question has, in candidate order.

    Questions and names meet by the bigrams that they share. Without ranked, all documents are candidates, in order of doc_id.
    """
    asked = questions.select("q_id", F.explode(F.array_distinct(bigrams(F.col("question")))).alias("gram"))
    hits = own.join(asked, "gram").groupBy("q_id", "doc_id").agg(F.count(F.lit(1)).alias("hit")).where("hit >= 3")
    counted = hits.join(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("size")), "doc_id")
    counted = counted.withColumn("rank", F.col("doc_id")) if ranked is None else counted.join(ranked.groupBy("q_id", "doc_id").agg(F.min("rank").alias("rank")), ["q_id", "doc_id"])
    strict = F.col("hit") / F.col("size") >= 0.5
    named = counted.where(strict | (F.col("hit") >= 5)).withColumn("strict", strict)
    return named.withColumn("named_rank", F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))).select("q_id", "doc_id", "named_rank", "strict")


def uncapped_questions(named: DataFrame) -> DataFrame:
    """Questions that name one document, by the loose and by the strict rule."""
    return named.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("strict").alias("strict")).where("n = 1 and strict").select("q_id")


def aspect_sentence(question: Column, matched: Column) -> Column:
    """Of two or more sentences the one that shares the least bigrams with matched; else null."""
    parts = F.filter(F.transform(F.split(question, r"(?<=[?？.!])\s+|\n+"), lambda x: F.trim(x)), lambda s: s != "")
    own = F.array_distinct(bigrams(matched))
    ranked = F.transform(parts, lambda s, i: F.struct(overlap_share(bigrams(s), own).alias("share"), i.alias("i"), s.alias("s")))
    return F.when(F.size(parts) >= 2, F.array_min(ranked)["s"])


def aspect_slot(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """Where a question has an aspect, the first document's candidates go to the front, reranked by it.

    text is what is reranked; the aspect is told apart from the chunk itself, in body where that column is there.
    """
    top_hit = ranked.where("rank = 1").select("q_id", F.col("doc_id").alias("top_doc"), F.col("body" if "body" in ranked.columns else "text").alias("top_text"))
    aspects = questions.join(top_hit, "q_id").select("q_id", "top_doc", aspect_sentence(F.col("question"), F.col("top_text")).alias("question")).where("question is not null")
    same = ranked.join(aspects, "q_id").where(F.col("doc_id") == F.col("top_doc"))
    moved = lexical_rerank(same.select("q_id", "chunk_no", "text", "score", "rank"), aspects).select("q_id", "chunk_no", F.col("rank").alias("front"))
    rows = ranked.join(moved, ["q_id", "chunk_no"], "left").withColumnRenamed("rank", "before")
    return top(rows, None, F.col("front").asc_nulls_last(), F.col("before")).drop("front", "before")


def compare_slot(ranked: DataFrame, named: DataFrame, pool: DataFrame, questions: DataFrame) -> DataFrame:
    """Where a question names two documents or more, all their chunks go to the front, one of each document in turn.

    pool has (q_id, chunk_no, doc_id, text, score) of the named documents' chunks.
    """
    few = named.where(F.col("named_rank") <= COMPARE_DOCS)
    several = few.groupBy("q_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("q_id")
    rows = pool.join(few.join(several, "q_id", "left_semi"), ["q_id", "doc_id"])
    # each document's chunks are a question of their own, so that scores are standardised within it
    keyed = rows.withColumn("pair", F.struct("q_id", "named_rank"))
    own = keyed.select(F.to_json("pair").alias("q_id"), "chunk_no", "text", "score", F.row_number().over(Window.partitionBy("pair").orderBy("chunk_no")).alias("rank"))
    asked = keyed.select(F.to_json("pair").alias("key"), "q_id").distinct().join(questions, "q_id").select(F.col("key").alias("q_id"), "question")
    turn = lexical_rerank(own, asked).select(F.from_json("q_id", "q_id bigint, named_rank int").alias("pair"), "chunk_no", F.col("rank").alias("turn"))
    front = turn.select("pair.q_id", "pair.named_rank", "chunk_no", "turn")
    merged = ranked.select("q_id", "chunk_no", F.col("rank").alias("before")).join(front, ["q_id", "chunk_no"], "full")
    return top(merged, None, F.col("turn").asc_nulls_last(), F.col("named_rank").asc_nulls_last(), F.col("before")).select("q_id", "chunk_no", "rank")


def next_chunk(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk that follows each question's first hit in its document, if it is not a hit: q_id, chunk_no, score."""
    following = chunks.select("doc_id", "chunk_no", F.lead("chunk_no").over(Window.partitionBy("doc_id").orderBy("chunk_no")).alias("next"))
    first = hits.where("rank = 1").join(following, ["doc_id", "chunk_no"]).where("next is not null")
    added = first.select("q_id", F.col("next").alias("chunk_no"), "doc_id", "score", F.lit(True).alias("neighbor"))
    return added.join(hits.select("q_id", "chunk_no"), ["q_id", "chunk_no"], "left_anti")


def reselect_within_docs(hits: DataFrame, queues: DataFrame) -> DataFrame:
    """Slot n of a document among the hits gets number n of the document's queue (q_id, doc_id, chunk_no, within_doc_rank)."""
    slots = hits.withColumn("slot", F.row_number().over(Window.partitionBy("q_id", "doc_id").orderBy("rank"))).select("q_id", "doc_id", "rank", "slot")
    return slots.join(queues, (slots["q_id"] == queues["q_id"]) & (slots["doc_id"] == queues["doc_id"]) & (slots["slot"] == queues["within_doc_rank"])).select(slots["q_id"], slots["doc_id"], "chunk_no", "rank", "within_doc_rank")


def reselect_without_repeats(hits: DataFrame, queues: DataFrame) -> DataFrame:
    """As reselect_within_docs, but a text is taken once; a document without other texts leaves its slot empty."""
    slots = hits.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("slots"))
    lined = queues.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "within_doc_rank", "chunk_no", "text"))).alias("queue"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for q, wanted, queue in zip(group["q_id"], group["slots"], group["queue"], strict=True):
            waiting: dict = {}
            for x in queue:
                waiting.setdefault(x["doc_id"], []).append(x)
            taken: set[str] = set()
            for s in wanted:
                line = waiting.get(s["doc_id"], [])
                while line and line[0]["text"] in taken:
                    line.pop(0)
                if line:
                    x = line.pop(0)
                    taken.add(x["text"])
                    rows.append((q, s["doc_id"], x["chunk_no"], s["rank"], x["within_doc_rank"]))
        return pd.DataFrame(rows, columns=["q_id", "doc_id", "chunk_no", "rank", "within_doc_rank"])

    types = {**dict(hits.dtypes), "chunk_no": dict(queues.dtypes)["chunk_no"]}
    return slots.join(lined, "q_id").mapInPandas(lambda it: map(fill, it), f"q_id {types['q_id']}, doc_id {types['doc_id']}, chunk_no {types['chunk_no']}, rank int, within_doc_rank int")


def document_queues(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Rank fusion within each (q_id, doc_id) of rankings (q_id, doc_id, chunk_no, rank)."""
    parts = [r.select(F.struct("q_id", "doc_id").alias("q_id"), "chunk_no", "rank") for r in rankings]
    return rrf(parts, k).select("q_id.q_id", "q_id.doc_id", "chunk_no", F.col("rank").alias("within_doc_rank"))


def cosines_within(texts: DataFrame, members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of each (q_id, doc_id, embedding) with the vectors of the document's own chunks (doc_id, chunk_no), ranked."""
    asked = members.select("doc_id", "chunk_no").join(texts.select("doc_id"), "doc_id", "left_semi")
    own = asked.join(vectors.select("chunk_no", F.col("embedding").alias("own")), "chunk_no")
    scored = own.join(texts.select("q_id", "doc_id", "embedding"), "doc_id").select("q_id", "doc_id", "chunk_no", dot(F.col("embedding"), F.col("own")).alias("score"))
    order = Window.partitionBy("q_id", "doc_id").orderBy(F.round("score", PLACES).desc(), "chunk_no")
    return scored.withColumn("rank", F.row_number().over(order))


def reselection_queues(docs: DataFrame, chunks: DataFrame, statistics: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column], full: bool = False) -> tuple[DataFrame, DataFrame]:
    """The queues of documents (q_id, doc_id, question, project), and the cosines of their chunks with the question itself.

    chunks has doc_id, chunk_no and text of all eligible chunks, of which those of the documents are read. BM25 and cosine
    of the residual question are fused, with full those of the question too.
    """
    docs = docs.select("q_id", "doc_id", "question", "project")
    own = chunks.select("doc_id", "chunk_no", "text").join(broadcast_if_small(docs.select("doc_id").distinct(), 64), "doc_id", "left_semi")
    own = with_checkpoints(own).checkpoint()  # the chunks of a few documents for each question
    rest = docs.select("q_id", "doc_id", residual_question(F.col("question"), F.coalesce("project", F.lit(""))).alias("question"))
    rest, whole = (x.select("q_id", "doc_id", "question", embed(F.col("question")).alias("embedding")).checkpoint() for x in (rest, docs))
    cosines = cosines_within(whole, own, vectors)
    rankings = [within_documents(rest, own, statistics), cosines_within(rest, own, vectors)]
    if full:
        rankings += [within_documents(whole, own, statistics), cosines]
    return document_queues(rankings), cosines.select("q_id", "doc_id", "chunk_no", "score")


def retrieval_signals(hits: DataFrame) -> DataFrame:
    """docs, top_doc_share, best_score and rerank_gap of each question's hits (q_id, doc_id, rank, score, rerank_score)."""
    first = Window.partitionBy("q_id").orderBy("rank")
    rows = hits.withColumn("top_doc", F.first("doc_id").over(first)).withColumn("is_top", F.col("doc_id") == F.col("top_doc"))
    other = F.min_by("rerank_score", F.when(~F.col("is_top"), F.col("rank")))
    return rows.groupBy("q_id").agg(
        F.countDistinct("doc_id").alias("docs"), F.avg(F.col("is_top").cast("double")).alias("top_doc_share"), F.max("score").alias("best_score"),
        (F.min_by("rerank_score", "rank") - other).alias("rerank_gap"),
    )
