"""More queries over whole tables: steps whose input the tables do not have is made from each row's number and text."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import answers, chunking, dense, evaluation, lexical, retrieval
from tessera.operators import sections as sec
from tessera.plans import pipeline
from tessera.plans.catalogue import DOC_POSTINGS, POSTINGS, candidates, documents, grams_sql, places, query, questions, table, vectors
from tessera.session import with_checkpoints
from tessera.sources import binary_documents, files, tables


def s(c: Column) -> Column:
    return c.cast("string")


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def number() -> Column:
    return F.col("doc_id")


@query("""SELECT doc_id, '사업명' || chr(10) || '☑ 확인 ' || doc_id || chr(10) || '제출: 내용 끝' || chr(10) || '• 항목 [ ] 가-나' || chr(10) || chr(10) || '뒤 ' || doc_id AS text FROM documents""")
def clean_text_layout(spark, sf):
    raw = joined("사 업 명\n- 이 하 여 백 -\n□\n√ 확인 ", s(number()), "\x07\n제 출: 내용·······끝　\nŸ 항목 [\n] 가­나\n- 본 페이지 -\n\n\n\n뒤 ", s(number()), " ")
    return documents(spark, sf).select("doc_id", tx.clean(raw).alias("text"))


@query("""SELECT doc_id, '가나/다 ' || doc_id AS cell, '사업명' AS label, 'x [' || doc_id % 9 || '] y [2]' AS answer, substr(sha256('f' || doc_id || chr(10) || 'g'), 1, 64) AS hash FROM documents""")
def text_marks(spark, sf):
    return documents(spark, sf).select(
        "doc_id", tx.cell_text(joined(" 가나|다 \n  ", s(number()), " ")).alias("cell"), tx.cell_text(F.lit("사 업 명")).alias("label"),
        tx.citation_brackets(joined("x 【", s(number() % 9), "】 y ［ 2 ］")).alias("answer"), tx.text_hash(joined("f", s(number()), "\r\ng")).alias("hash"),
    )


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '사업명: 사업 ' || doc_id || chr(10) || '발주 기관: 기관' || chr(10) || chr(10) || '본문' WHEN 1 THEN '절: 1. 가' || chr(10) || '표 헤더:' || chr(10) || '| 머리 |' || chr(10) || chr(10) || '본문' ELSE '본문' END AS shown,
'사업 ' || doc_id || ' 기관' || chr(10) || '1. 가' || chr(10) || '본문' AS passage FROM documents""")
def embedding_inputs(spark, sf):
    meta = F.create_map(F.lit("사업명"), joined("사업  ", s(number())), F.lit("발주 기관"), F.lit("기관"))
    flat = F.create_map(F.lit("사업명"), joined("사업 ", s(number())), F.lit("발주 기관"), F.lit("기관"))
    body, section = F.lit("본문"), F.lit("1.  가")
    heads = lambda *h: F.array(*map(F.lit, h))
    shown = F.when(number() % 3 == 0, answers.embedding_input(body, meta, "project")).when(number() % 3 == 1, answers.embedding_input(body, meta, "table", section, heads("| 머리 |", "| 머리 |", "본문")))
    return documents(spark, sf).select("doc_id", shown.otherwise(answers.embedding_input(body, meta, "table", section, F.array().cast("array<string>"))).alias("shown"), answers.with_project(body, flat, F.lit("1. 가")).alias("passage"))


HEADED = """h AS (SELECT doc_id, 'Ⅰ' || chr(10) || '개요 ' || doc_id || '번' || chr(10) || '1. 배경' || chr(10) || text || chr(10) || CASE doc_id % 3 WHEN 0 THEN '2. 범위' WHEN 1 THEN '4. 건너뜀' ELSE '[붙임 1] 서식' END || chr(10) || '가. 세부' AS t FROM documents)"""


@query(f"""WITH {HEADED} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Ⅰ 개요 ' || doc_id || '번 > 2. 범위 > 가. 세부' WHEN 1 THEN 'Ⅰ 개요 ' || doc_id || '번 > 1. 배경 > 가. 세부' ELSE '[붙임 1] 서식 > 가. 세부' END AS last, CASE doc_id % 3 WHEN 1 THEN 3 ELSE 4 END AS n,
strpos(t, '1. 배경') - 1 AS second, 'Ⅰ 개요 ' || doc_id || '번 > 1. 배경' AS at_second FROM h""")
def section_walk(spark, sf):
    # the documents' own lines are no headings, so the path goes on behind them
    body = joined("Ⅰ\n개요 ", s(number()), "번\n1. 배경\n", F.col("text"), "\n", F.when(number() % 3 == 0, "2. 범위").when(number() % 3 == 1, "4. 건너뜀").otherwise("[붙임 1] 서식"), "\n가. 세부")
    rows = documents(spark, sf).select("doc_id", body.alias("t")).withColumn("found", sec.sections("t")).withColumn("good", sec.valid_entries(F.reverse("found"), F.col("t")))
    second = F.col("good")[1]["start"]
    return rows.select("doc_id", sec.section_of(F.col("good"), F.length("t")).alias("last"), F.size("good").alias("n"), second.cast("long").alias("second"), sec.section_of(F.col("good"), second).alias("at_second"))


@query("""SELECT vec_id FROM embeddings WHERE vec_id % 17 IN (3, 5, 7)""")
def vector_contract(spark, sf):
    v, n = F.col("embedding"), F.col("chunk_no") % 17
    broken = F.when(n == 3, F.slice(v, 1, 63)).when(n == 5, F.transform(v, lambda x: F.lit(0.0).cast("float"))).when(n == 7, F.transform(v, lambda x: F.lit(float("nan")).cast("float"))).otherwise(v)
    return dense.check_vectors(vectors(spark, sf).withColumn("embedding", broken)).select(F.col("chunk_no").alias("vec_id"))


@query("""WITH q AS (SELECT vec_id AS q_id, embedding FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.q_id, b.vec_id AS cno, q.embedding AS a, b.embedding AS e FROM q JOIN embeddings b ON b.vec_id % 7 = q.q_id % 7)
SELECT q_id, cno AS chunk_no, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a[i] AS DOUBLE) * CAST(e[i] AS DOUBLE))), 6) AS score FROM p""")
def vector_pairs(spark, sf):
    v = vectors(spark, sf)
    asked = v.where("chunk_no % 50 = 0").select(F.col("chunk_no").alias("q_id"), "embedding")
    pairs = asked.select("q_id", (F.col("q_id") % 7).alias("r")).join(v.select("chunk_no", (F.col("chunk_no") % 7).alias("r")), "r")
    return dense.cosines(pairs, asked, v).select("q_id", "chunk_no", places("score").alias("score"))


PREFIXED = DOC_POSTINGS.replace("SELECT doc_id, doc_id AS cno, text FROM documents", "SELECT doc_id, doc_id AS cno, source || ' ' || lang || chr(10) || text AS text FROM documents")


@query(f"WITH {PREFIXED} SELECT q_id, rank, cno AS chunk_no, round(score, 6) AS score FROM rk WHERE rank <= 10")
def bm25_prefix_index(spark, sf):
    meta = F.create_map(F.lit("사업명"), F.col("source"), F.lit("발주 기관"), F.col("lang"))
    index = lexical.gram_table(documents(spark, sf).select(F.col("doc_id").alias("chunk_no"), answers.with_project(F.col("text"), meta).alias("text")))
    return lexical.bm25_ranking(questions(spark, sf), index, 10).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_no", places("score").alias("score"))


@query(f"""WITH {DOC_POSTINGS}, nm AS (SELECT doc_id, source || ' ' || doc_id AS name FROM documents), ng AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest({grams_sql("name")}) AS gram FROM nm)),
c AS (SELECT gram, count(*) AS n FROM ng GROUP BY gram) SELECT doc_id, gram FROM ng JOIN c USING (gram) WHERE n <= greatest(1.0, (SELECT count(*) FROM nm) * 0.05)""")
def name_gram_index(spark, sf):
    return retrieval.name_grams(documents(spark, sf).select("doc_id", joined(F.col("source"), " ", s(number())).alias("name")))


@query(f"""WITH {POSTINGS} SELECT q_id, cno AS chunk_no, row_number() OVER (PARTITION BY q_id ORDER BY length(ch.text) % 7 + CASE WHEN contains(lower(ch.text), lower(substr(b.text, 1, 4))) THEN 10 ELSE 0 END DESC, rank) AS rank FROM rk JOIN ch USING (cno) JOIN benchmark b ON item_id = q_id WHERE rank <= 50""")
def model_rerank(spark, sf):
    model = lambda pairs: [len(p) % 7 + 10 * (q[:4].lower() in p.lower()) for q, p in pairs]
    out = retrieval.model_rerank(candidates(spark, sf), questions(spark, sf), model)
    return out.select("q_id", "chunk_no", F.col("rank").cast("long").alias("rank"))


# Every third question's rewrite is cached, texts of over 250 estimated tokens are left alone, every second other one comes back empty.
@query("""WITH t AS (SELECT doc_id, text || ' ' || doc_id AS text, CAST(ceil((length(text || ' ' || doc_id) + 1) / 3.0) AS BIGINT) + 10 > 250 AS long FROM documents)
SELECT doc_id AS q_id, CASE WHEN doc_id % 3 = 0 THEN 'cached ' || doc_id WHEN long OR length(text) % 2 = 0 THEN text ELSE 'new ' || text END AS rewrite,
CASE WHEN doc_id % 3 = 0 THEN 'cached' WHEN long THEN 'too_long' WHEN length(text) % 2 = 0 THEN 'empty' ELSE 'ok' END AS status FROM t""")
def rewrite_questions(spark, sf):
    q = documents(spark, sf).select(number().alias("q_id"), joined(F.col("text"), " ", s(number())).alias("question"))
    cache = q.where("q_id % 3 = 0").select(F.sha2(joined("1\nm\n", F.col("question")), 256).alias("key"), joined("cached ", s(F.col("q_id"))).alias("rewrite"))
    out = answers.rewrite_questions(q, cache, lambda texts: [" " if len(t) % 2 == 0 else "new " + t for t in texts], "m")
    return out.select("q_id", "rewrite", "status")


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '문서에서 관련 내용을 찾을 수 없습니다.' WHEN turn % 3 = 2 THEN '답변을 생성하지 못했습니다. 다시 시도해 주세요.' ELSE 'x[' || turn || '] ' || conv_id || CASE WHEN conv_id % 4 = 1 THEN chr(10) || chr(10) || '(답변이 길어 중간에 잘렸습니다.)' ELSE '' END END AS answer FROM conversations""")
def answer_texts(spark, sf):
    c, turn = table(spark, sf, "conversations"), F.col("turn")
    raw = c.select("conv_id", "turn", F.when(turn % 3 == 2, " \n ").otherwise(joined("x【", s(turn), "】 ", s(F.col("conv_id")), "\n")).alias("text"), (F.col("conv_id") % 4 == 1).alias("truncated"), F.when(turn % 5 == 4, 0).otherwise(3).alias("n_sources"))
    return answers.finish_answers(raw).select("conv_id", "turn", "answer")


@query("""SELECT doc_id AS q_id, '질문: 묻다 ' || doc_id || chr(10) || '기관: 시립' || chr(10) || chr(10) || '검색 자료(JSON):' || chr(10) || '[{"citation":1,"names":{"사업명":"사업 ' || doc_id || '"},"사업 정보":{"분야":"' || lang || '"},"section_path":"1. 가","tables":[{"table_id":"T1","header_text":"| a |"}],"text":"본문"}, {"citation":2,"names":{"사업명":"사업 ' || doc_id || '"},"text":"다음"}]' AS prompt FROM documents""")
def prompt_texts(spark, sf):
    docs = documents(spark, sf)
    heads = lambda h: F.array(F.struct(F.lit("T1").alias("table_id"), F.lit(h).alias("header_text")))
    source = lambda n, text, path, h: F.struct(F.lit(n).alias("rank"), F.lit(text).alias("text"), F.lit(path).alias("section_path"), heads(h).alias("table_headers"))
    meta = F.create_map(F.lit("사업명"), joined("사업 ", s(number())), F.lit("분야"), F.col("lang"), F.lit("filename"), F.lit("f"), F.lit("발주 기관"), F.lit(""))
    rows = docs.select(number().alias("q_id"), number(), meta.alias("metadata"), F.inline(F.array(source(2, "다음", "", ""), source(1, "본문", "1. 가", "| a |"))))
    q = docs.select(number().alias("q_id"), joined("묻다 ", s(number())).alias("question"), F.create_map(F.lit("기관"), F.lit("시립")).alias("filters"))
    return answers.prompts(q, answers.contexts(answers.number_citations(rows)), True)


# Each document is a case: an amount that is right, wrong or cited wrongly; keywords; refusals that are right, missing or state a value; a judged answer.
@query("""WITH k AS (SELECT doc_id AS i, doc_id + 1 AS n, doc_id % 8 AS kind FROM documents)
SELECT i AS "index", kind IN (0, 1, 2, 3, 7) AS answerable, CASE WHEN kind IN (0, 1, 2, 3, 7) THEN 1.0 END AS recall_at_k, CASE WHEN kind IN (0, 1, 2, 7) THEN 1.0 WHEN kind = 3 THEN 0.5 END AS mrr,
CASE kind WHEN 3 THEN 0.5 END AS keyword_coverage, CASE WHEN kind IN (0, 1) THEN true WHEN kind IN (2, 3, 7) THEN false END AS gold_cited,
CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 WHEN 5 THEN 0.0 WHEN 6 THEN CASE WHEN i % 16 = 6 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN i % 16 = 7 THEN 0.5 END END AS content,
CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 WHEN 5 THEN 0.0 WHEN 6 THEN CASE WHEN i % 16 = 6 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN i % 16 = 7 THEN 0.5 END END AS score,
CASE WHEN kind IN (0, 1, 2, 3) THEN 1.0 END AS answer_chunk_hit, kind IN (4, 6) AS refused, CASE WHEN kind IN (0, 1, 2, 3, 7) THEN 'd' || i ELSE CAST(i AS VARCHAR) END AS cluster FROM k""")
def graded_cases(spark, sf):
    n, kind = number() + 1, number() % 8
    won = joined(s(n), "백만원")
    none = F.lit(None)
    gold, other = joined("d", s(number())), F.lit("x")
    able = kind.isin(0, 1, 2, 3, 7)
    source = lambda c, doc, text: F.struct(F.lit(c).alias("citation"), doc.alias("doc_id"), F.lit("c").alias("chunk_id"), F.lit(0.5).alias("score"), text.alias("text"))
    first, second = F.when(kind == 3, other).otherwise(gold), F.when(kind == 3, gold).otherwise(other)
    amount = joined("예산은 ", won)
    states = F.when(kind == 6, F.when(number() % 16 == 6, amount).otherwise("예산은 없다")).otherwise(amount)
    answer = (
        F.when(kind == 0, joined(amount, "입니다 [1].")).when(kind == 1, joined("예산은 ", s(n + 1), "백만원입니다 [1].")).when(kind == 2, joined(amount, "입니다 [2].")).when(kind == 3, joined("도서관 예산 ", s(n), ",000,000원"))
        .when(kind == 4, "해당 내용은 확인되지 않습니다.").when(kind == 5, "예산은 1억 원입니다.").when(kind == 6, joined("해당 내용은 확인되지 않습니다. 다만 예산은 ", won, "입니다.")).otherwise("서술하는 답이다.")
    )
    period = "array<struct<unit:string,value:string>>"
    values = F.when(kind.isin(0, 1, 2), F.struct(F.array(n * 1_000_000).alias("amount_won"), none.cast(period).alias("period")))
    docs = documents(spark, sf)
    cases = docs.select(
        number().alias("q_id"), F.lit("q").alias("question"), able.alias("answerable"), F.when(able, F.array(gold)).otherwise(F.array().cast("array<string>")).alias("expected_doc_ids"),
        F.when(kind == 3, F.array(won, F.lit("도서관"))).alias("expected_keywords"), F.when(kind.isin(0, 1, 2), "numeric").when(kind == 7, "llm").alias("grading"), F.lit(1.0).alias("weight"), (kind == 2).alias("requires_gold_citation"),
        F.lit("t").alias("question_type"), F.lit("s").alias("source"), F.lit("").alias("doc_cluster"), values.alias("expected_values"), F.when(F.lit(False), F.struct(F.array(n).alias("amount_won"), none.cast(period).alias("period"))).alias("forbidden_values"),
    )
    said = docs.select(number().alias("q_id"), F.lit("q").alias("question"), answer.alias("answer"), F.lit("ok").alias("status"), F.array(source(1, first, states), source(2, second, F.when(kind == 3, amount).otherwise("다른 글"))).alias("sources"))
    verdicts = docs.where("doc_id % 16 = 7").select(number().alias("q_id"), F.lit("partial").alias("verdict"))
    out = pipeline.evaluate(cases, said, verdicts)
    return out.select("index", "answerable", "recall_at_k", "mrr", "keyword_coverage", "gold_cited", F.col("answer_content_score").alias("content"), F.col("answer_score").alias("score"), "answer_chunk_hit", "refused", "cluster")


@query("""WITH c AS (SELECT doc_id AS i, doc_id % 9 AS k FROM documents)
SELECT i AS "index", CASE k WHEN 1 THEN 'blank question' WHEN 2 THEN 'answerable without documents' WHEN 3 THEN 'unknown grading' WHEN 4 THEN 'numeric without values' WHEN 5 THEN 'keyword without keywords' WHEN 6 THEN 'unanswerable with a value grading' WHEN 7 THEN 'negative weight' END AS problem FROM c WHERE k BETWEEN 1 AND 7""")
def case_violations(spark, sf):
    k = number() % 9
    values = F.struct(F.array(F.lit(1).cast("long")).alias("amount_won"), F.lit(None).cast("array<struct<unit:string,value:string>>").alias("period"))
    rows = documents(spark, sf).select(
        number().alias("index"), F.when(k == 1, " ").otherwise("q").alias("question"), (k != 6).alias("answerable"), F.when(~k.isin(2, 6), F.array(F.lit("d"))).alias("expected_doc_ids"),
        F.when(k == 6, F.array(F.lit("w"))).alias("expected_keywords"), F.when(k == 3, "other").when(k == 4, "numeric").when(k.isin(5, 6), "keyword").when(k == 8, "numeric").alias("grading"),
        F.when(k == 7, -1.0).otherwise(1.0).alias("weight"), F.when(k == 8, values).alias("expected_values"),
    )
    return evaluation.violations(rows)


# The last row of the cache counts; what is not cached is judged, by the last digit of the answer.
@query("""SELECT doc_id AS q_id, CASE doc_id % 3 WHEN 0 THEN 'partial' ELSE CASE WHEN doc_id % 2 = 0 THEN 'correct' ELSE 'incorrect' END END AS verdict, doc_id % 3 <> 0 AS fresh FROM documents""")
def judge_verdicts(spark, sf):
    docs = documents(spark, sf)
    nothing = lambda kind: F.lit(None).cast(kind)
    cases = docs.select(number().alias("q_id"), joined("q ", s(number())).alias("question"), nothing("string").alias("reference_answer"), F.array(F.lit("a"), F.lit("b")).alias("reference_facts"), F.lit("원문").alias("reference_excerpt"), F.lit("사업").alias("reference_project"))
    said = docs.select(number().alias("q_id"), joined("답 ", s(number())).alias("answer"))
    prompt = joined("m\njudge-v3\n[질문]\nq ", s(number()), "\n\n[참고 근거]\n대상 사업: 사업\n고유 근거: b\n원문 발췌:\n원문\n\n[답변]\n답 ", s(number()))
    cached = docs.where("doc_id % 3 = 0").select(F.sha2(prompt, 256).alias("key"), F.explode(F.array(F.struct(F.lit(2).alias("at"), F.lit("partial").alias("verdict")), F.struct(F.lit(1).alias("at"), F.lit("correct").alias("verdict")))).alias("x")).select("key", "x.*")
    judge = lambda prompts: ['so: {"verdict" : "%s"}' % ("correct" if int(p[-1]) % 2 == 0 else "incorrect") for p in prompts]
    return evaluation.judge_cases(cases, said, cached, judge, "m").select("q_id", "verdict", "fresh")


@query("""WITH p AS (SELECT doc_id, text, '앞 ' || doc_id || chr(10) AS a, '<!-- table:T1 -->' || chr(10) || '| 가 | 나 |' || chr(10) || '|---|---|' || chr(10) || '| ' || doc_id || ' | x |' || chr(10) || '<!-- /table:T1 -->' AS t FROM documents)
SELECT doc_id, CAST(length(a) AS INTEGER) AS start_char, CAST(length(a) + length(t) AS INTEGER) AS end_char, '| 가 | 나 |' || chr(10) || '|---|---|' AS header_text, CAST(length(a) + 18 AS INTEGER) AS header_start_char, CAST(length(a) + 18 + 19 AS INTEGER) AS header_end_char FROM p""")
def table_marks(spark, sf):
    grid = joined("<!-- table:T1 -->\n| 가 | 나 |\n|---|---|\n| ", s(number()), " | x |\n<!-- /table:T1 -->")
    crossed = "<!-- table:T2 --><!-- table:T3 -->x<!-- /table:T3 --><!-- /table:T2 -->"
    rows = documents(spark, sf).select("doc_id", F.inline(chunking.tables_of(joined("앞 ", s(number()), "\n", grid, F.col("text"), crossed))))
    return rows.select("doc_id", "start_char", "end_char", "header_text", "header_start_char", "header_end_char")


@query("""SELECT doc_id, '<!-- table:T1 -->' || chr(10) || '| 구분 | ' || doc_id || ' | 값 |' || chr(10) || '|---|---|---|' || chr(10) || '| 합 | a | ' || lang || ' |' || chr(10) || '| 합 | b | 2 |' || chr(10) || '<!-- /table:T1 -->' || chr(10) || '<!-- table:T2 -->' || chr(10) || '| x | y |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || '| 3 | 4 |' || chr(10) || '<!-- /table:T2 -->' AS markdown FROM documents""")
def table_markdown(spark, sf):
    @F.pandas_udf("string")
    def render(numbers: pd.Series, lang: pd.Series) -> pd.Series:
        def one(i, x):
            spanned = tables.render_table(4, 4, [(0, 0, 1, 1, "구분"), (0, 1, 1, 1, str(i)), (0, 2, 1, 2, "값"), (1, 0, 3, 1, "합"), (1, 1, 1, 1, "a"), (1, 2, 1, 1, x), (2, 1, 1, 1, "b"), (2, 2, 1, 1, "2"), (3, 1, 1, 1, "b"), (3, 2, 1, 1, "2")])
            pages = tables.merge_pages([[[["x", "y"], ["1", "2"]]], [[["x", "y"], ["3", "4"]]]])
            return tables.number_tables("\n".join([spanned, *map(tables.page_table, pages)]))

        return pd.Series([one(i, x) for i, x in zip(numbers, lang, strict=True)])

    return documents(spark, sf).select("doc_id", render("doc_id", "lang").alias("markdown"))


@query("""SELECT doc_id, sha256(replace(text, chr(9), ' ') || chr(10) || '끝 ' || doc_id) AS sha FROM documents WHERE NOT regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F]')""")
def record_paragraphs(spark, sf):
    @F.pandas_udf("string")
    def decode(text: pd.Series, numbers: pd.Series) -> pd.Series:
        def record(body: bytes) -> bytes:
            return struct.pack("<I", 67 | min(len(body), 0xFFF) << 20) + (struct.pack("<I", len(body)) if len(body) >= 0xFFF else b"") + body

        def one(t, i):
            # each tab is a control of eight units in the records, of which one becomes a space
            units = t.encode("utf-16-le").replace(b"\t\0", b"\t\0" * 8)
            return "\n".join(binary_documents.section_paragraphs(record(units) + record(b"\x0d\0") + record(f"끝 {i}".encode("utf-16-le")))).replace("\n\n끝", "\n끝")

        return pd.Series([one(t, i) for t, i in zip(text, numbers, strict=True)])

    rows = documents(spark, sf).where(~F.col("text").rlike(r"[\x00-\x08\x0B-\x1F]"))
    return rows.select("doc_id", F.sha2(decode("text", "doc_id"), 256).alias("sha"))


@query("SELECT doc_id, text, lang, source FROM documents")
def manifest_csv_json_roundtrip(spark, sf):
    """Through files: a manifest as CSV, its texts as JSON, in the folder that the cluster shares."""
    docs = with_checkpoints(documents(spark, sf).select("doc_id", "text", "lang", "source"))
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/roundtrip-{uuid.uuid4().hex}"
    manifest = docs.select(s(number()).alias("파일명"), "lang", "source").coalesce(1)
    manifest.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(f"{folder}/manifest")
    files.write_json(docs.select(s(number()).alias("filename"), "text"), f"{folder}/texts")
    rows = files.read_manifest(spark, f"{folder}/manifest")
    texts = spark.read.schema("filename string, text string").json(f"{folder}/texts")
    return rows.join(texts, "filename").select(F.col("filename").cast("long").alias("doc_id"), "text", "lang", "source")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS source, lang, 'f' || doc_id AS name FROM documents""")
def metadata_columns(spark, sf):
    from tessera.operators import ingest

    rows = documents(spark, sf).select("doc_id", F.when(number() % 5 != 0, F.col("source")).alias("source"), "lang", F.lit("x").alias(ingest.TEXT), joined("f", s(number())).alias("name"))
    meta = rows.select("doc_id", ingest.metadata_map(["source", "lang", ingest.TEXT, "name"]).alias("m"))
    return meta.where(~F.array_contains(F.map_keys("m"), ingest.TEXT)).select("doc_id", *[F.col("m")[k].alias(k) for k in ("source", "lang", "name")])


@query("SELECT item_id AS q_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passage_search(spark, sf):
    from tessera.operators import passages

    return passages.containing(documents(spark, sf), questions(spark, sf))

