"""The commands parse, build, ask and evaluate, over tables of documents, questions and cases.

Models are injected: embed takes texts and gives vectors; rerank takes (question, passage) pairs and gives scores; generate
takes prompts and gives (text, truncated) pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import values as vals
from tessera.functions.text import clean, document_key, nfc, nfkc
from tessera.operators import answers, chunking, dense, evaluation, ingest, lexical, retrieval
from tessera.operators import sections as sec
from tessera.plans.profile import Profile, pool_size
from tessera.session import broadcast_if_small, with_checkpoints
from tessera.sources import files
from tessera.sources.binary_documents import read_texts
from tessera.sources.tables import drop_contents, number_tables

STRIDE = 1 << 24


@F.pandas_udf(T.StringType())
def _finish_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else number_tables(drop_contents(t)))


def parse(spark: SparkSession, manifest: str, folder: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text, metadata, sections) and error rows of a manifest and a folder of files."""
    rows = files.read_manifest(spark, manifest, limit)
    columns = [c for c in rows.columns if c not in ("pos", "filename")]
    notice = F.col(f"`{ingest.NOTICE}`") if ingest.NOTICE in columns else F.lit("")
    listed = rows.select("pos", "filename", notice.alias("notice"), ingest.metadata_map(columns).alias("metadata"))
    texts = read_texts(files.read_raw_files(spark, folder)).withColumn("text", _finish_text(clean(nfc("text"))))
    docs, errors = ingest.split_documents(ingest.match_files(listed, texts))
    own = F.create_map(F.lit("filename"), F.col("filename"), F.lit("source"), F.concat(F.lit("files/"), F.col("filename")))
    full = docs.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, v: ~k.isin("filename", "source")), own, vals.fields(F.col("text"))))
    return full.select("pos", document_key(F.col("filename")).alias("doc_id"), "text", "metadata", sec.sections("text").alias("sections")), errors


@dataclass
class Index:
    """Chunks, their vectors, and the bigrams of the texts that BM25 searches: tables that are read many times, see save()."""

    chunks: DataFrame
    vectors: DataFrame
    grams: DataFrame


def build(documents: DataFrame, profile: Profile, embed: Callable[[list[str]], list[list[float]]]) -> Index:
    """Chunks with global numbers and the tables that they overlap, their vectors, and the bigrams of the chunks behind their project names.

    documents has pos, an integer that orders the documents; chunk numbers follow it.
    """
    cut = chunking.chunk_documents(documents, profile.strategy, profile.chunk_size, profile.chunk_overlap, profile.version)
    meta = documents.select("doc_id", "pos", "metadata", chunking.tables_of("text").alias("all_tables"), sec.valid_entries(F.col("sections"), F.col("text")).alias("entries"))
    chunks = cut.join(meta, "doc_id").select(
        "doc_id", "chunk_id", (F.col("pos") * STRIDE + F.col("chunk_no")).alias("chunk_no"), "text", "start_char", "end_char", "metadata",
        sec.section_of(F.col("entries"), F.col("start_char")).alias("section_path"),
        chunking.overlapping(F.col("all_tables"), F.col("start_char"), F.col("end_char")).alias("tables"),
    )
    vector = dense.embedder(embed)
    context = profile.embedding_context
    headers = F.transform("tables", lambda t: F.regexp_replace(t["header_text"], r"(?U)^\s+|\s+$|[^\S\n]+(?=\n)", ""))
    shown = answers.embedding_input(F.col("text"), F.col("metadata"), "project" if context == "project_blend" else context, F.col("section_path"), headers)
    if context == "project_blend":
        body, mixed = vector("text"), vector(shown)
        vectors = chunks.select("chunk_no", "text", shown.alias("shown"), body.alias("body"), mixed.alias("mixed")).select("chunk_no", F.when(F.col("text") == F.col("shown"), F.col("body").cast("array<double>")).otherwise(dense.blended(F.col("body"), F.col("mixed"))).alias("embedding"))
    else:
        vectors = chunks.select("chunk_no", vector(shown).alias("embedding"))
    indexed = chunks.withColumn("text", answers.with_project(F.col("text"), F.col("metadata"))) if profile.bm25_prefix else chunks
    return Index(chunks, vectors, lexical.gram_table(indexed.select("chunk_no", "text")))


def save(index: Index, path: str, config: dict[str, object]) -> Index:
    """Writes an index and reads it back; config is written last, with counts and dimension, when all of it agrees."""
    spark = index.chunks.sparkSession
    files.write_index({"chunks": index.chunks, "vectors": index.vectors, "grams": index.grams}, path, config)
    return load(spark, path)[0]


def load(spark: SparkSession, path: str) -> tuple[Index, dict]:
    tables, config = files.read_index(spark, path)
    return Index(tables["chunks"], tables["vectors"], tables["grams"]), config


def project_of(metadata: Column) -> Column:
    return F.concat_ws(" ", *[F.try_element_at(metadata, F.lit(k)) for k in answers.NAME_FIELDS])


def held(df: DataFrame) -> DataFrame:
    """df, a few rows for each question, written out so that the steps that read it do not compute it again."""
    return with_checkpoints(df).checkpoint()


def retrieve(questions: DataFrame, index: Index, profile: Profile, embed: Callable[[list[str]], list[list[float]]], rerank: Callable | None = None, filters: dict[str, str] | None = None, rewrites: DataFrame | None = None) -> DataFrame:
    """Hits (q_id, rank, chunk_no, doc_id, chunk_id, text, metadata, section_path, tables, score, rrf_score, rerank_score) of questions.

    The order is: filters resolved, eligibility, rankings, gate, fusion, pool, expansion, rerank, slots, cap, top k, reselection,
    neighbour. filters may name a value in part, if one value alone has that part. With rewrites (q_id, rewrite) the question
    that reranks is all texts searched for, joined; expansion and slots go by the question itself. Reselection adds
    within_doc_rank; a chunk that was no hit before has its cosine with the question as its only score.
    """
    if questions.where(F.trim(F.coalesce("question", F.lit(""))) == "").limit(1).count():
        raise ValueError("a question is blank")
    chunks = index.chunks
    filters = retrieval.resolved(filters or {}, chunks)
    body = retrieval.metadata_filter(chunks, filters).select("chunk_no", "doc_id", "chunk_id", "text", "metadata", "section_path", "tables")
    eligible = body.select("chunk_no") if filters else None
    rewritten = rewrites is not None and profile.rewrite != "off"
    asked = answers.query_variants(questions, rewrites if rewritten else questions, profile.rewrite if rewritten else "off")
    vector = dense.embedder(embed)
    queries = held(asked.select("q_id", "variant", "question", vector("question").alias("embedding")))
    first = queries.where("variant = 0")
    own = index.vectors.join(eligible, "chunk_no", "left_semi") if filters else index.vectors
    pool, rankings = pool_size(profile), []
    for v in (0, 1) if rewritten and profile.rewrite == "both" else (0,):
        part = queries.where(F.col("variant") == v)
        rankings.append(held(dense.dense_ranking(part.select("q_id", "embedding"), own, profile.vector_k or pool)))
        if profile.hybrid:
            rankings.append(held(lexical.bm25_ranking(part, index.grams, profile.bm25_k, eligible)))
    open_ = dense.min_score_gate(rankings[0], profile.min_score).select("q_id")
    fused = held(retrieval.rrf(rankings, profile.rrf_k or retrieval.RRF_K, pool if profile.rerank != "none" else None).join(open_, "q_id", "left_semi"))
    found = body.select("chunk_no", "doc_id").join(broadcast_if_small(fused, 40), "chunk_no")
    lifted = None
    names = chunks.groupBy("doc_id").agg(F.min_by("metadata", "chunk_no").alias("metadata"))
    projects = names.select("doc_id", project_of(F.col("metadata")).alias("project"))
    plain = lexical.question_statistics(chunks.select("chunk_no", "text"), questions) if profile.expand and profile.rerank != "none" or profile.within_doc != "off" else None
    if profile.rerank != "none":
        if profile.expand:
            found = held(retrieval.expand_candidates(held(found), questions, body.select("doc_id", "chunk_no", "text"), plain, projects, profile.expand, aspects=profile.slots))
        passage = answers.with_project(F.col("text"), F.col("metadata"), F.col("section_path") if profile.rerank_section else None)
        scored = dense.cosines(found.select("q_id", "chunk_no"), first, own)
        texts = body.select("chunk_no", F.col("text").alias("body"), passage.alias("text"))
        shown = texts.join(broadcast_if_small(found.select("q_id", "chunk_no", "doc_id", "rank"), 40), "chunk_no").join(scored, ["q_id", "chunk_no"])
        by = queries.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant", "question"))), lambda x: x["question"]), " ").alias("question"))
        use_model = profile.rerank == "model" and rerank is not None
        ranked = held(retrieval.model_rerank(shown, by, rerank) if use_model else retrieval.lexical_rerank(held(shown), by))
        if profile.slots:
            ranked = held(retrieval.aspect_slot(ranked, questions))
        grams = retrieval.name_grams(names.select("doc_id", F.coalesce(F.try_element_at("metadata", F.lit("사업명")), F.lit("")).alias("name")))
        named = held(retrieval.named_docs(questions, ranked, grams))
        if profile.slots:
            few = named.where(F.col("named_rank") <= retrieval.COMPARE_DOCS).select("q_id", "doc_id")
            whole = held(body.select("chunk_no", "doc_id", passage.alias("text")).join(broadcast_if_small(few, 64), "doc_id"))
            whole = whole.join(dense.cosines(whole.select("q_id", "chunk_no"), first, own), ["q_id", "chunk_no"])
            ranked = retrieval.compare_slot(ranked, named, whole.select("q_id", "chunk_no", "doc_id", "text", "score"), questions)
            ranked = body.select("chunk_no", "doc_id").join(broadcast_if_small(held(ranked), 40), "chunk_no")
        if profile.uncap_named:
            lifted = retrieval.uncapped_questions(named)
        found = ranked
    keep = [c for c in ("rerank_score",) if c in found.columns]
    found = found.select("q_id", "chunk_no", "doc_id", "rank", *keep)
    if profile.dedup:
        signatures = retrieval.document_signatures(chunks)
        top = retrieval.select_without_repeats(found.join(body.select("chunk_no", "text"), "chunk_no"), signatures, profile.max_per_doc, profile.top_k, lifted).select("q_id", "chunk_no", "doc_id", F.col("hit_no").alias("rank"))
        top = top.join(found.select("q_id", "chunk_no", *keep), ["q_id", "chunk_no"]) if keep else top
    else:
        top = retrieval.cap_per_doc(found, profile.max_per_doc, profile.top_k, lifted).drop("rank").withColumnRenamed("hit_no", "rank")
    top = held(top)
    hits = top.join(dense.cosines(top, first, own), ["q_id", "chunk_no"], "left").join(fused.select("q_id", "chunk_no", "rrf_score"), ["q_id", "chunk_no"], "left").withColumn("neighbor", F.lit(False))
    if profile.within_doc != "off":
        hits = held(hits)
        docs = hits.select("q_id", "doc_id").distinct().join(questions.select("q_id", "question"), "q_id").join(projects, "doc_id")
        queues, fresh = retrieval.reselection_queues(docs, body, plain, own, vector, profile.within_doc == "residual+full")
        if profile.dedup:
            picked = retrieval.reselect_without_repeats(hits, queues.join(body.select("chunk_no", "text"), "chunk_no"))
        else:
            picked = retrieval.reselect_within_docs(hits, queues)
        before = hits.drop("doc_id", "rank")
        hits = picked.join(before, ["q_id", "chunk_no"], "left").join(fresh.withColumnRenamed("score", "fresh"), ["q_id", "doc_id", "chunk_no"], "left")
        hits = hits.withColumns({"score": F.coalesce("score", "fresh"), "neighbor": F.lit(False)}).drop("fresh")
    if profile.neighbor:
        last = top.groupBy("q_id").agg(F.max("rank").alias("last"))
        added = retrieval.next_chunk(hits, chunks).join(last, "q_id").withColumn("rank", F.col("last") + 1).drop("last")
        hits = hits.unionByName(added, allowMissingColumns=True)
    columns = chunks.select(body.columns).drop("doc_id")
    return columns.join(broadcast_if_small(held(hits), 128), "chunk_no")


def ask(questions: DataFrame, hits: DataFrame, profile: Profile, generate: Callable[..., list[tuple[str, bool]]], options: Mapping[str, object] | None = None, reminder: str = "") -> DataFrame:
    """q_id, question, answer, status, sources; a question without hits is answered without the model.

    options go to the generator by name; reminder stands behind the sources of each prompt.

    Profiles with signals have a struct of them besides, null for questions without hits.
    """
    tables = F.col("tables") if "tables" in hits.columns else F.array().cast(chunking.TABLES)
    headers = F.transform(tables, lambda t: F.struct(t["table_id"].alias("table_id"), t["header_text"].alias("header_text")))
    sources = answers.number_citations(hits).withColumn("table_headers", headers)
    prompts = answers.prompts(questions, answers.contexts(sources), profile.prompt_filters and "filters" in questions.columns, reminder)
    said = answers.generate(prompts, generate, options)
    listed = sources.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("citation", "doc_id", "chunk_id", "score", "text"))).alias("sources"))
    rows = questions.select("q_id", "question").join(said.select("q_id", "text", "truncated", "error"), "q_id", "left").join(listed, "q_id", "left").withColumn("n_sources", F.size("sources"))
    if profile.signals:
        hits = hits if "rerank_score" in hits.columns else hits.withColumn("rerank_score", F.lit(None).cast("double"))
        signs = retrieval.retrieval_signals(hits)
        rows = rows.join(signs.select("q_id", F.struct(*[c for c in signs.columns if c != "q_id"]).alias("signals")), "q_id", "left")
    return answers.finish_answers(rows).withColumn("status", F.when(F.col("error").isNotNull(), "api_error").otherwise(F.col("status")))


def evaluate(cases: DataFrame, said: DataFrame, verdicts: DataFrame | None = None, grounded_values: bool = True) -> DataFrame:
    """Records of cases (q_id, expected_doc_ids, expected_keywords, answerable, grading, ...) and answers.

    With grounded_values a refusal may state values that its sources have; without, it may state none.
    """
    bad = evaluation.violations(cases.withColumnRenamed("q_id", "index")).limit(1).collect()
    if bad:
        raise ValueError(f"case {bad[0]['index']}: {bad[0]['problem']}")
    rows = cases.drop("question").join(said, "q_id", "left")
    rows = rows.join(verdicts, "q_id", "left") if verdicts is not None else rows.withColumn("verdict", F.lit(None).cast("string"))
    empty = F.array().cast("array<struct<citation:int,doc_id:string,chunk_id:string,score:double,text:string>>")
    rows = rows.withColumns({"sources": F.coalesce("sources", empty), "answer": nfc(F.coalesce("answer", F.lit(""))), "answerable": F.coalesce("answerable", F.lit(True)), "keywords": F.coalesce("expected_keywords", F.array().cast("array<string>")), "expected": F.coalesce("expected_doc_ids", F.array().cast("array<string>"))})
    rows = rows.withColumns({"amounts": vals.amounts("answer"), "periods": vals.periods("answer"), "plain": nfkc("answer")})
    rows = rows.withColumn("refused", vals.is_refusal(F.col("plain"), F.col("status")))
    used = F.when(F.size("expected") > 0, F.filter("sources", lambda s: F.array_contains(F.col("expected"), s["doc_id"]))).otherwise(evaluation.used_sources(F.col("plain"), F.col("sources")))
    rows = rows.withColumn("evidence", F.array_join(F.transform(used, lambda s: s["text"]), "\n"))
    rows = rows.withColumns({"evidence_amounts": vals.amounts("evidence"), "evidence_periods": vals.periods("evidence")})
    has = F.col("evidence") != ""
    clean_values = (F.size("amounts") + F.size("periods") == 0) | (evaluation.grounded(F.col("amounts"), F.col("evidence_amounts"), has) & evaluation.grounded(F.col("periods"), F.col("evidence_periods"), has))
    if not grounded_values:
        clean_values = F.size("amounts") + F.size("periods") == 0
    clean = (F.col("status") == "no_hits") | (F.col("refused") & clean_values)
    numeric = vals.values_present(F.col("amounts"), F.col("periods"), F.col("expected_values.amount_won"), F.col("expected_values.period"))
    forbidden = vals.values_present(F.col("amounts"), F.col("periods"), F.col("forbidden_values.amount_won"), F.col("forbidden_values.period"))
    words = F.get(vals.keyword_counts("keywords", F.array("answer")), F.lit(0)) == F.size("keywords")
    grading = evaluation.default_grading(F.col("grading"), F.col("answerable"), F.col("keywords"))
    rows = rows.withColumn("content", evaluation.content_score(grading, clean, forbidden, numeric, F.when(F.size("keywords") > 0, words), F.col("verdict")))
    texts = F.transform("sources", lambda s: F.coalesce(s["text"], F.lit("")))
    rows = rows.withColumns({"source_values": vals.values_each(texts), "source_keywords": vals.keyword_counts("keywords", texts)})
    hit = evaluation.answer_chunk_hit(F.col("expected"), F.col("sources"), F.col("source_values"), F.col("source_keywords"), F.col("keywords"), F.col("expected_values"))
    cited = evaluation.gold_cited(F.col("expected"), F.col("plain"), F.col("sources"))
    able = lambda c: F.when(F.col("answerable"), c)
    return rows.select(
        F.col("q_id").alias("index"), "answerable", "grading", "status", "refused", able(evaluation.recall(F.col("expected"), F.col("sources"))).alias("recall_at_k"), able(evaluation.reciprocal_rank(F.col("expected"), F.col("sources"))).alias("mrr"),
        evaluation.keyword_coverage(F.col("keywords"), F.col("answer")).alias("keyword_coverage"), able(cited).alias("gold_cited"), F.col("content").alias("answer_content_score"),
        evaluation.final_score(F.col("content"), F.col("requires_gold_citation"), F.col("answerable"), cited).alias("answer_score"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "question_type", "source",
        evaluation.cluster_key(F.col("doc_cluster"), F.col("expected"), F.col("q_id")).alias("cluster"), able(hit).alias("answer_chunk_hit"),
    )
