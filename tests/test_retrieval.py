import random

from pyspark.sql import functions as F

from tessera.operators import answers, dense, evaluation, ingest, lexical, retrieval, topk


def test_rrf_ties_keep_first_seen(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "q_id int, chunk_no long, rank int")
    b = spark.createDataFrame([(1, 2, 1), (1, 1, 2)], "q_id int, chunk_no long, rank int")
    assert [r["chunk_no"] for r in retrieval.rrf([a, b]).orderBy("rank").collect()] == [1, 2]


def test_filter_keeps_statistics(spark):
    chunks = spark.createDataFrame([(0, "가나다"), (1, "가나"), (2, "라마")], "chunk_no long, text string")
    q = spark.createDataFrame([(1, "가나다")], "q_id int, question string")
    whole = {r["chunk_no"]: r["score"] for r in lexical.bm25_ranking(q, chunks).collect()}
    part = {r["chunk_no"]: r["score"] for r in lexical.bm25_ranking(q, chunks, eligible=chunks.where("chunk_no = 1").select("chunk_no")).collect()}
    assert set(whole) == {0, 1} and part == {1: whole[1]}


def test_fuzzy_filter(spark):
    f = spark.createDataFrame([(1, "기관", "한국철도공사"), (2, "기관", "한국"), (3, "기관", "없음")], "q_id int, key string, value string")
    v = spark.createDataFrame([("기관", "한국철도공사 (용역)"), ("기관", "한국전력")], "key string, value string")
    got = {r["q_id"]: r["value"] for r in retrieval.resolve_filters(f, v).collect()}
    assert got == {1: "한국철도공사 (용역)", 2: "한국", 3: "없음"}


def test_cap_and_greedy_choice(spark):
    rows = [(1, i, d, t, i + 1) for i, (d, t) in enumerate([("a", "x"), ("a", "y"), ("a", "z"), ("b", "z"), ("c", "x"), ("c", "w")])]
    ranked = spark.createDataFrame(rows, "q_id int, chunk_no long, doc_id string, text string, rank int")
    assert [r["chunk_no"] for r in retrieval.cap_per_doc(ranked, 2).orderBy("rank").collect()] == [0, 1, 3, 4, 5]
    lifted = spark.createDataFrame([(1,)], "q_id int")
    assert retrieval.cap_per_doc(ranked, 1, lifted=lifted).count() == 6
    signatures = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "doc_id string, same_as string")
    # z was turned away by a's cap, so b may still have it
    assert [r["chunk_no"] for r in retrieval.select_without_repeats(ranked, signatures, 2).orderBy("rank").collect()] == [0, 1, 3, 5]


def test_select_without_repeats_lifts_the_cap(spark):
    """A question in lifted takes all texts of a document, each once; other questions keep the cap."""
    rows = [(q, n, "a", text, n + 1) for q in (1, 2) for n, text in enumerate(["x", "y", "x", "z", "w"])]
    ranked = spark.createDataFrame(rows, "q_id int, chunk_no long, doc_id string, text string, rank int")
    signatures = spark.createDataFrame([("a", "a")], "doc_id string, same_as string")
    lifted = spark.createDataFrame([(1,)], "q_id int")
    out = retrieval.select_without_repeats(ranked, signatures, 2, 3, lifted).orderBy("q_id", "rank").collect()
    assert [(r["q_id"], r["chunk_no"]) for r in out] == [(1, 0), (1, 1), (1, 3), (2, 0), (2, 1)]


def test_residual_question(spark):
    df = spark.createDataFrame([("도서관 시스템 구축 예산", "도서관 시스템 구축"), ("도서관", "도서관")], "q string, p string")
    assert [r[0] for r in df.select(retrieval.residual_question(F.col("q"), F.col("p"))).collect()] == ["예산", "도서관"]


def test_aspect_sentence(spark):
    df = spark.createDataFrame([("입찰 자격은 무엇인가요? 도서관 시스템을 구축하는 사업이다.", "도서관 시스템을 구축하는 사업"), ("하나뿐?", "x")], "q string, t string")
    assert [r[0] for r in df.select(retrieval.aspect_sentence(F.col("q"), F.col("t"))).collect()] == ["입찰 자격은 무엇인가요?", None]


def test_reselection(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3)], "q_id int, doc_id string, rank int")
    queues = spark.createDataFrame([(1, "a", 10, 1, "x"), (1, "a", 11, 2, "y"), (1, "b", 20, 1, "x"), (1, "b", 21, 2, "x")], "q_id int, doc_id string, chunk_no long, within_doc_rank int, text string")
    assert [r["chunk_no"] for r in retrieval.reselect_within_docs(hits, queues).orderBy("rank").collect()] == [10, 20, 11]
    assert [r["chunk_no"] for r in retrieval.reselect_without_repeats(hits, queues).orderBy("rank").collect()] == [10, 11]


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in v.select(dense.normalised(F.col("v"))).collect()] == [[0.6, 0.8], None]
    one = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_no long, embedding array<float>")
    q = one.where("chunk_no = 0").select(F.col("chunk_no").alias("q_id"), "embedding")
    assert [r["chunk_no"] for r in dense.dense_ranking(q, one, 2).orderBy("rank").collect()] == [0, 1]


def test_embedder_halves(spark):
    def model(texts):
        if len(texts) > 2:
            raise MemoryError
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("a" * i,) for i in range(1, 9)], "t string").coalesce(1)
    assert df.select(dense.embedder(model)("t").alias("v")).count() == 8


def test_rewrites_and_answers(spark):
    q = spark.createDataFrame([(1, "가"), (2, "나" * 400)], "q_id int, question string")
    cache = spark.createDataFrame([], "key string, rewrite string")
    got = {r["q_id"]: (r["rewrite"], r["status"]) for r in answers.rewrite_questions(q, cache, lambda t: [x + "!" for x in t], "m").collect()}
    assert got[1] == ("가!", "ok") and got[2][1] == "too_long"
    raw = spark.createDataFrame([(1, "답【2】", False, 1), (2, " \n", False, 1), (3, "x", True, 1), (4, None, False, 0)], "q_id int, text string, truncated boolean, n_sources int")
    out = {r["q_id"]: (r["status"], r["answer"]) for r in answers.finish_answers(raw).collect()}
    assert out[1] == ("ok", "답[2]") and [out[i][0] for i in (2, 3, 4)] == ["empty", "truncated", "no_hits"]


def test_percentile_and_bootstrap(spark):
    two = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert evaluation.nearest_rank(two, "v", (0.5,)).first()[0] == 1.0
    rows = [(random.Random(i).random(), 1.0 + i % 2, f"c{i % 5}") for i in range(20)]
    got = evaluation.cluster_bootstrap(spark.createDataFrame(rows, "score double, weight double, cluster string"), 50, 7).first()
    keys = sorted({c for *_, c in rows})
    rng, means = random.Random(7), []
    for _ in range(50):
        picked = [r for k in rng.choices(keys, k=len(keys)) for r in rows if r[2] == k]
        means.append(sum(s * w for s, w, _ in picked) / sum(w for _, w, _ in picked))
    means.sort()
    assert abs(got["low"] - means[1]) < 1e-12 and abs(got["high"] - means[47]) < 1e-12
    assert evaluation.cluster_bootstrap(spark.createDataFrame(rows[:1], "score double, weight double, cluster string")).first()["low"] is None


def test_dedup_prefers_a_notice(spark):
    rows = spark.createDataFrame([(0, "a", "", "t", None), (1, "b", "N", "t", None), (2, "c", "M", "t", None), (3, "c", "", None, None), (4, "d", "", None, None)], "pos int, filename string, notice string, text string, read_error string")
    files = rows.where("text is not null").select("filename", "text", "read_error")
    docs, errors = ingest.split_documents(ingest.match_files(rows.select("pos", "filename", "notice"), files))
    assert [r["filename"] for r in docs.collect()] == ["b"]
    assert sorted((r["filename"], r["error"]) for r in errors.collect()) == [("a", "same text as b"), ("c", "duplicate file name"), ("c", "same text as b"), ("d", "no such file")]


def test_case_violations(spark):
    schema = "index int, question string, answerable boolean, expected_doc_ids array<string>, expected_keywords array<string>, grading string, weight double, expected_values struct<amount_won:array<bigint>,period:array<struct<unit:string,value:string>>>"
    rows = [(0, "q", True, ["d"], ["k"], "keyword", 1.0, None), (1, " ", True, None, None, "numeric", 1.0, None), (2, "q", False, None, ["k"], "keyword", -1.0, None)]
    got = {(r["index"], r["problem"]) for r in evaluation.violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "blank question"), (1, "answerable without documents"), (1, "numeric without values"), (2, "unanswerable with a value grading"), (2, "negative weight")}


def test_prompts_and_options(spark):
    q = spark.createDataFrame([(1, "왜?", {"기관": "시립"}), (2, "뭐?", None)], "q_id int, question string, filters map<string,string>")
    context = spark.createDataFrame([(1, "[]"), (2, "[]")], "q_id int, context string")
    rows = answers.prompts(q, context, True, "\n다시: {question}")
    assert [r["prompt"] for r in rows.orderBy("q_id").collect()] == ["질문: 왜?\n기관: 시립\n\n검색 자료(JSON):\n[]\n다시: 왜?", "질문: 뭐?\n\n검색 자료(JSON):\n[]\n다시: 뭐?"]

    def model(prompts, limit=0):
        if limit < 5:
            raise RuntimeError("429 too many")
        return [("x" * limit, True) for _ in prompts]

    assert {(r["text"], r["truncated"], r["error"]) for r in answers.generate(rows, model, {"limit": 7}).collect()} == {("xxxxxxx", True, None)}
    assert {r["error"] for r in answers.generate(rows, model).collect()} == {"too many requests"}


def test_vectors_of_two_sizes_are_refused(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0])], "chunk_no long, embedding array<float>")
    assert [r["chunk_no"] for r in dense.check_vectors(rows).collect()] == [1]


def test_questions_in_blocks(spark, monkeypatch):
    """Rankings are the same however the questions are dealt into blocks, and however few rows a partition may hold."""
    rnd = random.Random(2)
    chunks = spark.createDataFrame([(i, " ".join(rnd.choice(["ab", "bc", "cd", "de"]) for _ in range(rnd.randrange(1, 9)))) for i in range(200)], "chunk_no long, text string").repartition(3)
    vectors = spark.createDataFrame([(i, [rnd.random(), rnd.random()]) for i in range(200)], "chunk_no long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, x) for i, x in enumerate(["ab", "bc de", "cd", "xy", ""])], "q_id long, question string")
    asked = vectors.where("chunk_no < 5").select(F.col("chunk_no").alias("q_id"), "embedding")
    rows = lambda df: sorted((r["q_id"], r["rank"], r["chunk_no"], round(r["score"], 9)) for r in df.collect())
    whole, near = rows(lexical.bm25_ranking(q, chunks, 7)), rows(dense.dense_ranking(asked, vectors, 7))
    assert len(whole) == 21 and len(near) == 35
    table = lexical.gram_table(chunks)
    monkeypatch.setattr(lexical, "QUESTION_BYTES", 8)
    monkeypatch.setattr(lexical, "QUESTION_CELLS", 1)
    monkeypatch.setattr(dense, "QUERY_BYTES", 20)
    monkeypatch.setattr(topk, "HELD", 3)
    assert rows(lexical.bm25_ranking(q, chunks, 7)) == rows(lexical.bm25_ranking(q, table, 7)) == whole and rows(dense.dense_ranking(asked, vectors, 7)) == near
    every = rows(lexical.bm25_ranking(q, chunks, None))
    assert [r for r in every if r[1] <= 7] == whole


def test_nearest_rank_without_groups(spark, monkeypatch):
    """The range of a rank is narrowed by counts; ties, one value and no rows included."""
    monkeypatch.setattr(evaluation, "SORTED", 10)
    rnd = random.Random(4)
    for values in ([rnd.gauss(0, 1) for _ in range(500)], [1.0] * 300 + [2.0] * 50, [rnd.randrange(5) * 1.0 for _ in range(200)], [7.0], [1e9, *range(100)]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        got = evaluation.nearest_rank(df, "v", (0.0, 0.5, 0.95, 1.0)).first()
        assert list(got) == [sorted(values)[round(q * (len(values) - 1))] for q in (0.0, 0.5, 0.95, 1.0)]
    assert evaluation.nearest_rank(spark.createDataFrame([], "v double"), "v", (0.5,)).first()[0] is None
