import sys
import zlib

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.functions.text import bigrams_py
from tessera.operators import evaluation, lexical
from tessera.plans import pipeline, profile
from tessera.streaming.ingest import stream_chunks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import this file


def embed(texts):
    """A stub: hashed bigram counts."""
    out = []
    for t in texts:
        v = [0.01] * 32
        for g in bigrams_py(t):
            v[zlib.crc32(g.encode()) % 32] += 1.0
        out.append(v)
    return out


def stored(index):
    return pipeline.Index(index.chunks.cache(), index.vectors.cache(), index.grams.cache())


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    (root / "files").mkdir()
    (root / "files" / "a.txt").write_text("1. 사업 개요\n사업명: 도서관 시스템 구축\n사업 예산: 130,000,000원\n사업기간: 계약일로부터 120일\n" + "도서관 자료를 관리한다. " * 60)
    (root / "files" / "b.txt").write_text("1. 제안 요청\n병원 예약 시스템을 만든다. 예산액: 5억 원\n" + "병원 환자를 관리한다. " * 60)
    (root / "files" / "c.txt").write_text((root / "files" / "b.txt").read_text())
    (root / "list.csv").write_text("﻿파일명,사업명,발주 기관,공고 번호\na.txt,도서관 시스템 구축,시립도서관,N1\nb.txt,병원 예약 시스템,시립병원,\nc.txt,병원 예약 시스템,시립병원,N2\nd.txt,없음,없음,\n", encoding="utf-8")
    docs, errors = pipeline.parse(spark, str(root / "list.csv"), str(root / "files"))
    return docs.cache(), errors


def test_parse(parsed):
    docs, errors = parsed
    rows = {r["metadata"]["filename"]: r for r in docs.collect()}
    assert set(rows) == {"a.txt", "c.txt"}
    assert rows["a.txt"]["metadata"]["원문 사업 금액"] == "130000000" and rows["a.txt"]["sections"][0]["path"] == "1. 사업 개요"
    assert sorted(r["filename"] for r in errors.collect()) == ["b.txt", "d.txt"]


def test_ask_and_evaluate(spark, parsed):
    docs, _ = parsed
    p = profile.resolve(profile.A, {}, {})
    q = spark.createDataFrame([(1, "도서관 시스템 구축의 예산은 얼마인가요?"), (2, "병원 예약 시스템의 예산은?")], "q_id long, question string")
    hits = docs.select(F.when(F.col("metadata")["사업명"] == "도서관 시스템 구축", 1).otherwise(2).cast("long").alias("q_id"), F.lit(1).alias("rank"), "doc_id", F.lit("c").alias("chunk_id"), "text", "metadata", F.lit("").alias("section_path"), F.lit(0.9).alias("score"))
    said = pipeline.ask(q, hits, p, lambda prompts: [("예산은 130,000,000원입니다【1】.", False)] * len(prompts)).cache()
    assert {r["status"] for r in said.collect()} == {"ok"} and "[1]" in said.first()["answer"]
    gold = [r["doc_id"] for r in docs.where("metadata['사업명'] = '도서관 시스템 구축'").collect()]
    schema = """q_id long, question string, answerable boolean, expected_doc_ids array<string>, expected_keywords array<string>, grading string, weight double, requires_gold_citation boolean, question_type string, source string, doc_cluster string,
      expected_values struct<amount_won:array<bigint>,period:array<struct<unit:string,value:string>>>, forbidden_values struct<amount_won:array<bigint>,period:array<struct<unit:string,value:string>>>"""
    cases = spark.createDataFrame([(1, "x", True, gold, None, "numeric", 1.0, True, "t", "s", None, ([130_000_000], None), None), (2, "x", False, None, None, None, 1.0, None, "t", "s", None, None, None)], schema)
    rows = {r["index"]: r for r in pipeline.evaluate(cases, said).collect()}
    assert rows[1]["answer_score"] == 1.0 and rows[1]["mrr"] == 1.0 and rows[2]["answer_score"] == 0.0
    summary = evaluation.summarise(pipeline.evaluate(cases, said)).first()
    assert summary["answer_accuracy"] == 1.0 and summary["refusal_accuracy"] == 0.0


CASE = """q_id long, question string, answerable boolean, expected_doc_ids array<string>, expected_keywords array<string>, grading string, weight double, requires_gold_citation boolean, question_type string, source string, doc_cluster string,
  expected_values struct<amount_won:array<bigint>,period:array<struct<unit:string,value:string>>>, forbidden_values struct<amount_won:array<bigint>,period:array<struct<unit:string,value:string>>>"""


def test_keyword_grading(spark):
    """Keywords count without regard to white space and case, or as equal amounts and periods; all are needed."""
    said = [("예산은 4억 7천만 원입니다.", ["470,000,000원"], 1.0), ("기한은 ‘24년 12월 31일이다", ["2024-12-31", "기 한"], 1.0), ("예산은 4억 7천만 원입니다.", ["470,000,000원", "없는 말"], 0.0), ("예산은 4억 원입니다.", ["470,000,000원"], 0.0), ("ABC def", ["abcD"], 1.0)]
    cases = spark.createDataFrame([(i, "x", True, ["d"], words, "keyword", 1.0, None, "t", "s", None, None, None) for i, (_, words, _) in enumerate(said)], CASE)
    answers = spark.createDataFrame([(i, "x", text, "ok", []) for i, (text, _, _) in enumerate(said)], "q_id long, question string, answer string, status string, sources array<struct<citation:int,doc_id:string,chunk_id:string,score:double,text:string>>")
    got = {r["index"]: r["answer_score"] for r in pipeline.evaluate(cases, answers).collect()}
    assert got == {i: score for i, (_, _, score) in enumerate(said)}


def test_citations_of_any_width(spark):
    """Full-width brackets and digits cite too, as does a refusal in compatibility forms refuse."""
    sources = [(1, "x", "1", 0.9, "글"), (2, "d", "2", 0.8, "글")]
    said = ["답 ［２］", "답 [1]", "답 【2】"]
    cases = spark.createDataFrame([(i, "x", True, ["d"], None, None, 1.0, None, "t", "s", None, None, None) for i in range(3)], CASE)
    answers = spark.createDataFrame([(i, "x", text, "ok", sources) for i, text in enumerate(said)], "q_id long, question string, answer string, status string, sources array<struct<citation:int,doc_id:string,chunk_id:string,score:double,text:string>>")
    assert [r["gold_cited"] for r in pipeline.evaluate(cases, answers).orderBy("index").collect()] == [True, False, True]


def test_retrieve_checks_and_joins_rewrites(spark, parsed):
    """A blank question is an error; with a rewrite both texts are searched, and the scores are those of the question."""
    docs, _ = parsed
    p = profile.resolve(profile.B, {"rewrite": "both", "top_k": 2, "strategy": "fixed", "chunk_size": 200, "chunk_overlap": 10}, {"TESSERA_MIN_SCORE": "off"})
    index = stored(pipeline.build(docs, p, embed))
    blank = spark.createDataFrame([(1, "  ")], "q_id long, question string")
    with pytest.raises(ValueError, match="blank"):
        pipeline.retrieve(blank, index, p, embed)
    q = spark.createDataFrame([(1, "도서관 예산은 얼마인가요?")], "q_id long, question string")
    rewrites = spark.createDataFrame([(1, "병원 예약 시스템")], "q_id long, rewrite string")
    hits = pipeline.retrieve(q, index, p, embed, rewrites=rewrites).collect()
    vectors = {r["chunk_no"]: r["embedding"] for r in index.vectors.collect()}
    v = embed(["도서관 예산은 얼마인가요?"])[0]
    length = sum(x * x for x in v) ** 0.5
    assert sum(not h["neighbor"] for h in hits) == 2
    for h in hits:
        if h["neighbor"]:  # has the score of the hit before it
            continue
        assert h["score"] == pytest.approx(sum(a * b for a, b in zip(v, vectors[h["chunk_no"]], strict=True)) / length, abs=1e-5)


def test_answer_chunk_hit(spark):
    """Sources of expected documents alone count; all kinds of expected values in one source, else any keyword."""
    sources = [(1, "x", "1", 0.9, "5억 원, 3개월, 도서관"), (2, "d", "2", 0.8, "예산은 1억 3천만 원"), (3, "d", "3", 0.7, "기간은 120일, 병원")]
    months, days = [("개월", "3")], [("일", "120")]
    want = [(([500_000_000], None), ["병원"], True, 0.0), (([130_000_000], None), None, True, 1.0), ((None, days), None, True, 1.0), (([130_000_000], days), None, True, 0.0), ((None, months), None, True, 0.0), (None, ["도서관", "병 원"], True, 1.0), (None, ["130,000,000원"], True, 1.0), (None, ["도서관"], True, 0.0), (None, None, True, None), (None, ["병원"], False, None)]
    cases = spark.createDataFrame([(i, "x", able, ["d"], words, None, 1.0, None, "t", "s", None, values, None) for i, (values, words, able, _) in enumerate(want)], CASE)
    said = spark.createDataFrame([(i, "x", "답", "ok", sources) for i in range(len(want))], "q_id long, question string, answer string, status string, sources array<struct<citation:int,doc_id:string,chunk_id:string,score:double,text:string>>")
    records = pipeline.evaluate(cases, said)
    assert {r["index"]: r["answer_chunk_hit"] for r in records.collect()} == {i: x[3] for i, x in enumerate(want)}
    assert evaluation.summarise(records).first()["answer_chunk_hit_rate"] == 0.5


def test_filter(spark, parsed):
    docs, _ = parsed
    p = profile.resolve(profile.A, {"rerank": "none"}, {"TESSERA_MIN_SCORE": "off"})
    index = stored(pipeline.build(docs, p, embed))
    q = spark.createDataFrame([(1, "도서관")], "q_id long, question string")
    assert {r[0] for r in pipeline.retrieve(q, index, p, embed, filters={"발주 기관": "시립병원"}).select(F.col("metadata")["사업명"]).collect()} == {"병원 예약 시스템"}


def test_table_headers(spark):
    """A chunk in the middle of a long table has its section and header in its embedding input and in the prompt."""
    table = "<!-- table:T1 -->\n| 항목 | 금액 |\n|---|---|\n" + "".join(f"| 품목{i} | {i}원 |\n" for i in range(40)) + "<!-- /table:T1 -->"
    text = "1. 개요\n소개 글이다.\n" + table + "\n끝" + "맺음 말이다. " * 30
    docs = spark.createDataFrame([("d", 0, text, {"사업명": "x"}, [(0, "1. 개요")])], "doc_id string, pos long, text string, metadata map<string,string>, sections array<struct<start:int,path:string>>")
    p = profile.resolve(profile.A, {"strategy": "fixed", "chunk_size": 100, "chunk_overlap": 10, "embedding_context": "table"}, {})
    index = stored(pipeline.build(docs, p, embed))
    rows = index.chunks.join(index.vectors, "chunk_no").orderBy("chunk_no").collect()
    first, last = text.index("<!-- table"), text.index("<!-- /table:T1 -->") + len("<!-- /table:T1 -->")
    seen = set()
    for r in rows:
        inside = r["start_char"] < last and r["end_char"] > first
        assert [t["table_id"] for t in r["tables"]] == (["T1"] if inside else [])
        header = r["tables"][0]["header_text"].strip() if inside else ""
        extra = f"\n표 헤더:\n{header}" if header not in r["text"] else ""
        v = embed([f"절: 1. 개요{extra}\n\n{r['text']}" if inside else r["text"]])[0]
        length = sum(x * x for x in v) ** 0.5
        assert r["embedding"] == pytest.approx([x / length for x in v], abs=1e-5)
        seen.add((inside, extra != ""))
    assert seen == {(False, False), (True, False), (True, True)}
    hits = index.chunks.where(f"start_char >= {first + 100}").orderBy("chunk_no").limit(1).withColumns({"q_id": F.lit(1).cast("long"), "rank": F.lit(1), "score": F.lit(0.9)})
    said = pipeline.ask(spark.createDataFrame([(1, "품목은?")], "q_id long, question string"), hits, p, lambda prompts: [(x, False) for x in prompts]).first()
    assert '"tables":[{"table_id":"T1","header_text":"| 항목 | 금액 |' in said["answer"]


def expected_queue(index, question, project, full):
    """The fused queue of a document by plain Python, over the whole index's BM25 weights and vectors."""
    weights, rest = {}, " ".join(w for w in question.split() if sum(g in bigrams_py(project) for g in bigrams_py(w)) < 0.5 * len(bigrams_py(w))) or question
    for r in lexical.postings(index.chunks.select("chunk_no", "text")).collect():
        weights[r["chunk_no"], r["gram"]] = r["weight"]
    vectors = {r["chunk_no"]: r["embedding"] for r in index.vectors.collect()}
    numbers = sorted(r["chunk_no"] for r in index.chunks.where(F.col("metadata")["사업명"] == "도서관 시스템 구축").collect())
    fused = {}
    for text in (rest, question) if full else (rest,):
        v = embed([text])[0]
        words = {n: sum(weights.get((n, g), 0.0) for g in set(bigrams_py(text))) for n in numbers}
        cosine = {n: sum(a * b for a, b in zip(v, vectors[n], strict=True)) for n in numbers}
        for ranked in ([n for n in numbers if words[n] > 0], numbers):
            score = words if ranked is not numbers else cosine
            for i, n in enumerate(sorted(ranked, key=lambda n: (-round(score[n], 9), n)), 1):
                fused[n] = fused.get(n, 0.0) + 1 / (60 + i)
    return sorted(fused, key=lambda n: -round(fused[n], 12))


@pytest.mark.parametrize(("mode", "dedup"), [("residual", False), ("residual+full", True)])
def test_within_doc(spark, parsed, mode, dedup):
    docs, _ = parsed
    options = {"rerank": "none", "top_k": 3, "max_per_doc": 3, "chunk_size": 60, "chunk_overlap": 5, "bm25_prefix": False, "strategy": "fixed", "dedup": dedup}
    p, off = (profile.resolve(profile.A, {**options, "within_doc": m}, {"TESSERA_MIN_SCORE": "off"}) for m in (mode, "off"))
    index = stored(pipeline.build(docs, p, embed))
    question = "도서관 시스템 구축 계약일로부터 며칠 동안 관리한다"
    q = spark.createDataFrame([(1, question)], "q_id long, question string")
    narrow = {"사업명": "도서관 시스템 구축"}
    rows = pipeline.retrieve(q, index, p, embed, filters=narrow).orderBy("rank").collect()
    before = {r["chunk_no"]: r for r in pipeline.retrieve(q, index, off, embed, filters=narrow).collect()}
    texts = {r["chunk_no"]: r["text"] for r in index.chunks.collect()}
    queue = expected_queue(index, question, "도서관 시스템 구축 시립도서관", mode != "residual")
    if dedup:
        queue = [n for i, n in enumerate(queue) if texts[n] not in [texts[m] for m in queue[:i]]]
    assert [r["chunk_no"] for r in rows] == queue[: len(before)]
    assert all(r["score"] is not None and r["within_doc_rank"] >= 1 and (r["rrf_score"] is not None) == (r["chunk_no"] in before) for r in rows)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "가나  다\n\n\n\n라" * 300)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    run = stream_chunks(stream).writeStream.format("memory").queryName("chunks_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("chunks_out").count() > 1
