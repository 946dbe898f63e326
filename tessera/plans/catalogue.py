"""Queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import values as vals
from tessera.operators import answers, chunking, dense, evaluation, ingest, lexical, passages, retrieval
from tessera.operators import sections as sec
from tessera.plans import standins
from tessera.session import broadcast_if_small, with_checkpoints

#: Chunk numbers of a document lie in a range of their own, in order.
STRIDE = 1 << 24

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.chunk_fixed(documents(spark, sf).select("doc_id", "text"))
    return out.withColumn("chunk_no", F.col("doc_id") * STRIDE + F.col("chunk_no"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_no"), "embedding", "label")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of vectors: every vector of the first label."""
    return vectors(spark, sf).where("label = 0").select(F.col("chunk_no").alias("q_id"), "embedding")


def places(value: Column | str, n: int = 6) -> Column:
    return F.round(value, n)


CHUNKS = """
ch AS (SELECT doc_id, no, doc_id * 16777216 + no AS cno, no * 850 AS start_char, least(no * 850 + 1000, length(text)) AS end_char, substr(text, no * 850 + 1, 1000) AS text
       FROM (SELECT doc_id, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - 1000) / 850.0) AS BIGINT)) + 1)) AS no FROM documents WHERE length(text) > 0)
       WHERE regexp_matches(substr(text, no * 850 + 1, 1000), '\\S'))"""


def grams_sql(text: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_transform(range(1, greatest(length(w) - 1, 1) + 1), lambda i: substr(w, i, 2))))"


POSTINGS = CHUNKS + f""",
g AS (SELECT cno, doc_id, {grams_sql("text")} AS gr FROM ch),
tf AS (SELECT cno, gram, any_value(len) AS len, count(*) AS tf FROM (SELECT cno, len(gr) AS len, unnest(gr) AS gram FROM g) GROUP BY cno, gram),
dfs AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
st AS (SELECT count(*) AS n, avg(len(gr)) AS mean FROM g),
post AS (SELECT gram, cno, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS w FROM tf JOIN dfs USING (gram), st),
qg AS (SELECT DISTINCT item_id AS q_id, gram FROM (SELECT item_id, unnest({grams_sql("text")}) AS gram FROM benchmark)),
sc AS (SELECT q_id, cno, sum(w) AS score FROM post JOIN qg USING (gram) GROUP BY q_id, cno),
rk AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, cno) AS rank FROM sc WHERE score > 0)"""


@query(f"WITH {CHUNKS} SELECT doc_id, doc_id || ':' || no AS chunk_id, start_char, end_char, text FROM ch")
def chunk_fixed(spark, sf):
    return chunks(spark, sf).select("doc_id", "chunk_id", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), "text")


@query("""
WITH f AS (SELECT doc_id, no * 850 AS s, least(no * 850 + 1000, length(text)) AS e FROM (SELECT doc_id, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - 1000) / 850.0) AS BIGINT)) + 1)) AS no FROM documents WHERE length(text) > 0)),
o AS (SELECT doc_id, 0 AS s, least(1000, length(text)) AS e FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, 200, 500 FROM documents WHERE length(text) >= 500),
u AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) - 1 AS no FROM (SELECT * FROM f UNION SELECT * FROM o))
SELECT u.doc_id, u.doc_id || ':' || no AS chunk_id, s AS start_char, e AS end_char FROM u JOIN documents d USING (doc_id) WHERE regexp_matches(substr(text, s + 1, e - s), '\\S')""")
def chunk_overview_union(spark, sf):
    docs = documents(spark, sf).where(F.length("text") > 0)
    fixed = docs.select("doc_id", F.lit(0).alias("start"), F.least(F.lit(1000), F.length("text")).alias("end"))
    inner = docs.where(F.length("text") >= 500).select("doc_id", F.lit(200).alias("start"), F.lit(500).alias("end"))
    out = chunking.chunk_with_overviews(docs, fixed.unionByName(inner))
    return out.select("doc_id", "chunk_id", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


def walked(spark, sf, strategy, version=3):
    docs = documents(spark, sf).select("doc_id", "text", sec.sections("text").alias("sections"))
    return chunking.chunk_documents(docs, strategy, version=version).select("doc_id", "chunk_id", "start_char", "end_char", F.sha2("text", 256).alias("sha"))


# The walk over a text, one chunk after the other: line ends, paragraph ends (two line ends with blanks between) and sentence
# ends are numbered lists, and each step takes the last one that lies in the later half of its chunk. The documents have no
# headings and no tables, so the structured walks take the same steps, and the overview strategies are fixed windows.
BOUNDARY = """
WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
ln AS (SELECT doc_id, i, p, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(range(1, len(ps))) AS i, unnest(ps[1:len(ps) - 1]) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM t))),
lk AS (SELECT doc_id, e, regexp_matches(p, '^[ \\t]*\\r?$') AS linked, lag(e) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM ln),
nl AS (SELECT doc_id, list(e) AS ends, coalesce(list({'e': e, 'b': before}) FILTER (WHERE linked AND before IS NOT NULL), []) AS paras FROM lk GROUP BY doc_id),
sp AS (SELECT doc_id, i, m, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p
       FROM (SELECT doc_id, regexp_extract_all(text, '[.!?。！？]\\s+') AS ms, regexp_split_to_array(text, '[.!?。！？]\\s+') AS ps FROM t))),
sn AS (SELECT doc_id, list({'e': e, 's': e - length(m)}) AS sents FROM sp GROUP BY doc_id),
b AS (SELECT t.doc_id, n, coalesce(ends, []) AS ends, coalesce(paras, []) AS paras, coalesce(sents, []) AS sents FROM t LEFT JOIN nl ON nl.doc_id = t.doc_id LEFT JOIN sn ON sn.doc_id = t.doc_id),
w(doc_id, no, s, e) AS (
  SELECT doc_id, -1, 0, 0 FROM b
  UNION ALL
  SELECT doc_id, no + 1, a, CASE WHEN a + 1000 >= n THEN n ELSE coalesce(
    list_max(list_transform(list_filter(paras, lambda x: x.b - 1 >= a AND x.e <= a + 1000 AND x.e >= a + 500), lambda x: x.e)),
    list_max(list_filter(ends, lambda x: x <= a + 1000 AND x >= a + 500)),
    list_max(list_transform(list_filter(sents, lambda x: x.s >= a AND x.s + 1 < a + 1000 AND least(x.e, a + 1000) >= a + 500), lambda x: least(x.e, a + 1000))), a + 1000) END
  FROM (SELECT w.doc_id, no, n, ends, paras, sents, CASE WHEN no < 0 THEN 0 ELSE greatest(s + 1, e - 150) END AS a FROM w JOIN b ON b.doc_id = w.doc_id WHERE no < 0 OR e < n))
SELECT w.doc_id, w.doc_id || ':' || no AS chunk_id, CAST(s AS INTEGER) AS start_char, CAST(e AS INTEGER) AS end_char, sha256(substr(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT))) AS sha
FROM w JOIN t ON t.doc_id = w.doc_id WHERE no >= 0 AND regexp_matches(substr(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)), '\\S')"""
WINDOWS = f"WITH {CHUNKS} SELECT doc_id, doc_id || ':' || no AS chunk_id, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, sha256(text) AS sha FROM ch"


@query(BOUNDARY)
def chunk_boundary(spark, sf):
    return walked(spark, sf, "boundary")


@query(BOUNDARY)
def chunk_structured_v2(spark, sf):
    return walked(spark, sf, "structured", 2)


@query(BOUNDARY)
def chunk_structured_v3(spark, sf):
    return walked(spark, sf, "structured", 3)


@query(WINDOWS)
def chunk_overview(spark, sf):
    return walked(spark, sf, "overview")


@query(WINDOWS)
def chunk_overview_stable(spark, sf):
    return walked(spark, sf, "overview_stable")


@query(f"""WITH {CHUNKS}, s AS (SELECT doc_id, unnest(range(0, length(text), 700)) AS start FROM documents)
SELECT ch.doc_id, ch.no, coalesce(max_by('part ' || (start // 700), start), '') AS section_path FROM ch LEFT JOIN s ON s.doc_id = ch.doc_id AND start + 300 <= start_char GROUP BY ch.doc_id, ch.no""")
def section_asof(spark, sf):
    docs = documents(spark, sf).where(F.length("text") > 0)
    entries = F.transform(F.sequence(F.lit(0), F.expr("(length(text) - 1) div 700")), lambda i: F.struct((i * 700 + 300).cast("int").alias("start"), F.concat(F.lit("part "), i.cast("string")).alias("path")))
    rows = docs.select("doc_id", "text", entries.alias("sections")).select("doc_id", "text", "sections", F.inline(chunking.fixed_windows(F.col("text"))))
    return rows.where(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).rlike(r"\S")).select("doc_id", F.col("no").cast("long").alias("no"), sec.section_of(F.col("sections"), F.col("start")).alias("section_path"))


@query(f"""WITH {CHUNKS}, t AS (SELECT doc_id, unnest(range(0, length(text), 900)) + 100 AS a FROM documents)
SELECT ch.doc_id, ch.no, count(a) AS tables FROM ch LEFT JOIN t ON t.doc_id = ch.doc_id AND a + 250 > start_char AND a < end_char GROUP BY ch.doc_id, ch.no""")
def table_overlap(spark, sf):
    docs = documents(spark, sf).where(F.length("text") > 0)
    tables = F.transform(F.sequence(F.lit(0), F.expr("(length(text) - 1) div 900")), lambda i: F.struct((i * 900 + 100).alias("start_char"), (i * 900 + 350).alias("end_char")))
    rows = docs.select("doc_id", "text", tables.alias("tables")).select("doc_id", "text", "tables", F.inline(chunking.fixed_windows(F.col("text"))))
    return rows.where(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).rlike(r"\S")).select("doc_id", F.col("no").cast("long").alias("no"), F.size(chunking.overlapping(F.col("tables"), F.col("start"), F.col("end"))).cast("long").alias("tables"))


@query("""WITH t AS (SELECT doc_id, unnest(range(0, length(text), 900)) + 100 AS a FROM documents)
SELECT d.doc_id, a AS span_start FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id AND a < length(text) // 2 AND length(text) // 2 < a + 250 WHERE length(text) > 0""")
def point_in_span(spark, sf):
    docs = documents(spark, sf).where(F.length("text") > 0)
    spans = F.transform(F.sequence(F.lit(0), F.expr("(length(text) - 1) div 900")), lambda i: F.struct((i * 900 + 100).cast("long").alias("start"), (i * 900 + 350).cast("long").alias("end")))
    return docs.select("doc_id", chunking.containing(spans, F.expr("length(text) div 2"))["start"].alias("span_start"))


@query("""WITH s AS (SELECT user_id AS doc_id, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + 1 + event_id % 3 AS b FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
m AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN a < before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT doc_id, min(a) AS start, max(b) AS "end" FROM i GROUP BY doc_id, island""")
def interval_coalesce(spark, sf):
    # floor() alone makes 0 of NaN and the nearest long of what no long holds; the SQL's cast refuses both
    held = (F.col("value") >= -(2.0**63)) & (F.col("value") < 2.0**63)
    at = F.when(held, F.floor("value").cast("long")).otherwise(F.raise_error(F.lit("an event's value is NaN or beyond 64 bits")))
    spans = table(spark, sf, "events").where("value is not null and user_id is not null").select(F.col("user_id").alias("doc_id"), at.alias("start"), (at + 1 + F.col("event_id") % 3).alias("end"))
    return chunking.coalesce_spans(spans)


MANIFEST = """m AS (SELECT doc_id AS pos, 'f' || (doc_id - doc_id % 50 % 2) || '.pdf' AS filename, CASE WHEN doc_id % 3 = 0 THEN 'N' || doc_id ELSE '' END AS notice FROM documents),
f AS (SELECT 'f' || doc_id || '.pdf' AS filename, text FROM documents WHERE doc_id % 7 <> 0),
j AS (SELECT pos, m.filename, notice, text, CASE WHEN row_number() OVER (PARTITION BY m.filename ORDER BY pos) > 1 THEN 'duplicate file name' WHEN text IS NULL THEN 'no such file' END AS error FROM m LEFT JOIN f USING (filename))"""


def manifest_rows(spark, sf):
    docs = documents(spark, sf)
    manifest = docs.select(F.col("doc_id").alias("pos"), F.concat(F.lit("f"), (F.col("doc_id") - F.col("doc_id") % 50 % 2).cast("string"), F.lit(".pdf")).alias("filename"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("N"), F.col("doc_id").cast("string"))).otherwise("").alias("notice"))
    files = docs.where(F.col("doc_id") % 7 != 0).select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), "text", F.lit(None).cast("string").alias("read_error"))
    return ingest.match_files(manifest, files)


@query(f"WITH {MANIFEST} SELECT pos, filename, error, length(text) AS n_chars FROM j")
def manifest_left_join(spark, sf):
    return manifest_rows(spark, sf).select("pos", "filename", "error", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {MANIFEST} SELECT DISTINCT filename FROM m WHERE filename NOT IN (SELECT filename FROM f)")
def manifest_anti(spark, sf):
    rows = manifest_rows(spark, sf)
    return rows.where("error = 'no such file'").select("filename").distinct()


DEDUP = f"""WITH {MANIFEST}, k AS (SELECT *, first_value(filename) OVER w AS kept_by, row_number() OVER w AS n FROM j WHERE error IS NULL
WINDOW w AS (PARTITION BY text ORDER BY CASE WHEN notice = '' THEN 1 ELSE 0 END, pos))"""


@query(f"{DEDUP} SELECT pos, filename, substr(sha256(filename), 1, 16) AS doc_id FROM k WHERE n = 1")
def doc_dedup_exact(spark, sf):
    return ingest.split_documents(manifest_rows(spark, sf))[0].select("pos", "filename", "doc_id")


@query(f"{DEDUP} SELECT filename, error FROM j WHERE error IS NOT NULL UNION ALL SELECT filename, 'same text as ' || kept_by FROM k WHERE n > 1")
def doc_dedup_errors(spark, sf):
    return ingest.split_documents(manifest_rows(spark, sf))[1]


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(html, '>', ' ....... '), '<', ' ' || chr(10) || chr(10) || chr(10) || chr(10)),
'[·.…ㆍ‥․]{5,}', ' ', 'g'), '[\\t\\r\\f\\v ]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM pages""")
def clean_text_basic(spark, sf):
    raw = F.replace(F.replace(F.col("html"), F.lit(">"), F.lit(" ....... ")), F.lit("<"), F.lit(" \n\n\n\n"))
    return table(spark, sf, "pages").select("page_id", tx.clean(raw).alias("text"))


@query(f"WITH g AS (SELECT doc_id, {grams_sql('text')} AS gr FROM documents) SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest(gr) AS gram FROM g) GROUP BY doc_id, gram")
def bigram_tf(spark, sf):
    rows = documents(spark, sf).select(F.col("doc_id").alias("chunk_no"), "text")
    return lexical.term_frequencies(rows).select(F.col("chunk_no").alias("doc_id"), "gram", "tf")


@query(f"WITH g AS (SELECT doc_id, {grams_sql('text')} AS gr FROM documents) SELECT gram, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(gr) AS gram FROM g) GROUP BY gram")
def bigram_df(spark, sf):
    return lexical.document_frequencies(documents(spark, sf))


@query(f"WITH {POSTINGS} SELECT gram, cno AS chunk_no, round(w, 6) AS weight FROM post")
def bm25_postings(spark, sf):
    return lexical.postings(chunks(spark, sf)).select("gram", "chunk_no", places("weight").alias("weight"))


@query(f"WITH {POSTINGS} SELECT q_id, rank, cno AS chunk_no, round(score, 6) AS score FROM rk WHERE rank <= 5")
def bm25_topk(spark, sf):
    return lexical.bm25_ranking(questions(spark, sf), chunks(spark, sf), 5).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_no", places("score").alias("score"))


FILTERED = POSTINGS.replace("FROM sc WHERE score > 0", "FROM sc JOIN ch USING (cno) JOIN documents d ON d.doc_id = ch.doc_id WHERE score > 0 AND lang = 'en'").replace("SELECT *, row_number()", "SELECT q_id, cno, score, row_number()")


@query(f"WITH {FILTERED} SELECT q_id, rank, cno AS chunk_no, round(score, 6) AS score FROM rk WHERE rank <= 5")
def bm25_topk_filtered(spark, sf):
    docs = documents(spark, sf).withColumn("metadata", F.create_map(F.lit("lang"), "lang"))
    eligible = retrieval.metadata_filter(docs, {"lang": "en"}).select("doc_id")
    rows = chunks(spark, sf)
    return lexical.bm25_ranking(questions(spark, sf), rows, 5, rows.join(eligible, "doc_id", "left_semi").select("chunk_no")).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_no", places("score").alias("score"))


LOCAL = POSTINGS + f""",
cand AS (SELECT rk.q_id, rk.cno, rk.score, rk.rank, g.gr FROM rk JOIN g USING (cno) WHERE rank <= 50),
ls AS (SELECT q_id, count(*) AS n, avg(len(gr)) AS mean FROM cand GROUP BY q_id),
lt AS (SELECT q_id, cno, gram, any_value(len) AS len, count(*) AS tf FROM (SELECT q_id, cno, len(gr) AS len, unnest(gr) AS gram FROM cand) JOIN qg USING (q_id, gram) GROUP BY q_id, cno, gram),
lw AS (SELECT lt.q_id, cno, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS w FROM (SELECT *, count(*) OVER (PARTITION BY q_id, gram) AS df FROM lt) lt JOIN ls USING (q_id)),
loc AS (SELECT c.q_id, c.cno, c.rank, c.score, coalesce(sum(w), 0) AS lexical FROM cand c LEFT JOIN lw ON lw.q_id = c.q_id AND lw.cno = c.cno GROUP BY ALL),
z AS (SELECT q_id, cno, rank, lexical, score, CASE WHEN round(stddev_pop(score) OVER p, 12) = 0 THEN 0 ELSE (score - avg(score) OVER p) / stddev_pop(score) OVER p END
 + CASE WHEN round(stddev_pop(lexical) OVER p, 12) = 0 THEN 0 ELSE (lexical - avg(lexical) OVER p) / stddev_pop(lexical) OVER p END AS rerank FROM loc WINDOW p AS (PARTITION BY q_id)),
rr AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(rerank, 9) DESC, rank) AS new_rank FROM z)"""


def candidates(spark, sf, n=50):
    rows = chunks(spark, sf)
    ranked = with_checkpoints(lexical.bm25_ranking(questions(spark, sf), rows, n)).checkpoint()
    # n rows a question; the chunks are read once more for their texts
    return rows.select("chunk_no", "doc_id", "text").join(broadcast_if_small(ranked, 32), "chunk_no").checkpoint()


@query(f"WITH {LOCAL} SELECT q_id, cno AS chunk_no, round(lexical, 6) AS lexical FROM loc")
def bm25_candidate_local(spark, sf):
    return lexical.local_scores(candidates(spark, sf), questions(spark, sf)).select("q_id", "chunk_no", places("lexical").alias("lexical"))


@query(f"WITH {LOCAL} SELECT q_id, cno AS chunk_no, new_rank AS rank, round(rerank, 5) AS rerank_score FROM rr")
def zscore_rerank(spark, sf):
    out = retrieval.lexical_rerank(candidates(spark, sf), questions(spark, sf))
    return out.select("q_id", "chunk_no", F.col("rank").cast("long").alias("rank"), places("rerank_score", 5).alias("rerank_score"))


DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"
DENSE = f"""dn AS (SELECT a.vec_id AS q_id, b.vec_id AS cno, b.label, {DOT} AS score FROM embeddings a, embeddings b WHERE a.label = 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, cno) AS rank FROM dn)"""


def ranked_columns(df):
    return df.select("q_id", "chunk_no", F.col("rank").cast("long").alias("rank"), places("score").alias("score"))


@query(f"WITH {DENSE} SELECT q_id, cno AS chunk_no, rank, round(score, 6) AS score FROM dr WHERE rank <= 10")
def dense_topk(spark, sf):
    return ranked_columns(dense.dense_ranking(vector_queries(spark, sf), vectors(spark, sf), 10))


@query(f"WITH {DENSE.replace('WHERE a.label = 0', 'WHERE a.label = 0 AND b.label IN (0, 1, 2)')} SELECT q_id, cno AS chunk_no, rank, round(score, 6) AS score FROM dr WHERE rank <= 10")
def dense_topk_filtered(spark, sf):
    v = vectors(spark, sf)
    return ranked_columns(dense.dense_ranking(vector_queries(spark, sf), v, 10, v.where("label in (0, 1, 2)").select("chunk_no")))


@query(f"WITH {DENSE} SELECT q_id, round(max(score), 6) AS best_score FROM dn WHERE cno <> q_id GROUP BY q_id HAVING round(max(score), 9) >= 0.3")
def min_score_gate(spark, sf):
    # each question is a vector of the table itself, so the best of the others is among the first two
    scores = dense.dense_ranking(vector_queries(spark, sf), vectors(spark, sf), 2).where("chunk_no <> q_id")
    return dense.min_score_gate(scores, 0.3).select("q_id", places("best_score").alias("best_score"))


BLEND = """WITH p AS (SELECT vec_id, embedding, lead(embedding) OVER (ORDER BY vec_id) AS context FROM embeddings),
x AS (SELECT vec_id, list_transform(range(1, 65), lambda i: 0.8 * CAST(embedding[i] AS DOUBLE) + 0.2 * CAST(context[i] AS DOUBLE)) AS v FROM p WHERE context IS NOT NULL),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS l FROM x)
SELECT vec_id, round(v[1] / l, 6) AS first, round(v[64] / l, 6) AS last, round(list_sum(list_transform(v, lambda y: y / l)), 5) AS total FROM n"""


@query(BLEND)
def vector_blend_normalised(spark, sf):
    e = table(spark, sf, "embeddings")
    # vec_id counts up by one, so the neighbour is a join and not a global sort
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("context")), "vec_id")
    v = pairs.select("vec_id", dense.blended(F.col("embedding"), F.col("context")).alias("v"))
    return v.select("vec_id", places(F.element_at("v", 1)).alias("first"), places(F.element_at("v", -1)).alias("last"), places(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


DOC_POSTINGS = POSTINGS.replace(CHUNKS, "\nch AS (SELECT doc_id, doc_id AS cno, text FROM documents)")
QUERY_VECTORS = f"""dn AS (SELECT a.vec_id AS q_id, b.vec_id AS cno, {DOT} AS score FROM embeddings a JOIN benchmark q ON q.item_id = a.vec_id, embeddings b),
dr AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, cno) AS rank FROM dn)"""


def lists(spark, sf):
    """Dense and BM25 rankings of whole documents; document and question numbers are taken as vector numbers."""
    v = vectors(spark, sf)
    q = questions(spark, sf)
    asked = v.join(q, v["chunk_no"] == q["q_id"]).select("q_id", "embedding")
    docs = documents(spark, sf).select("doc_id", F.col("doc_id").alias("chunk_no"), "text")
    return dense.dense_ranking(asked, v, 100), lexical.bm25_ranking(q, docs, 100)


FUSE = """al AS (SELECT q_id, cno, rank, 0 AS list FROM dr WHERE rank <= 100 UNION ALL SELECT q_id, cno, rank, 1 FROM rk WHERE rank <= 100),
fu AS (SELECT q_id, cno, sum(1.0 / (60 + rank)) AS rrf, min(list * 1000 + rank) AS first FROM al GROUP BY q_id, cno),
fr AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(rrf, 12) DESC, first) AS rank FROM fu)"""


@query(f"WITH {DOC_POSTINGS}, {QUERY_VECTORS}, {FUSE} SELECT q_id, cno AS chunk_no, rank, round(rrf, 9) AS rrf_score FROM fr WHERE rank <= 50")
def hybrid_rrf(spark, sf):
    return retrieval.rrf(list(lists(spark, sf)), limit=50).select("q_id", "chunk_no", F.col("rank").cast("long").alias("rank"), places("rrf_score", 9).alias("rrf_score"))


REWRITE = DOC_POSTINGS.replace("FROM benchmark)", "FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000000, substr(text, 1, length(text) // 2) FROM benchmark))")


@query(f"""WITH {REWRITE}, al AS (SELECT q_id % 1000000 AS q_id, cno, rank, q_id // 1000000 AS list FROM rk WHERE rank <= 100),
fu AS (SELECT q_id, cno, sum(1.0 / (60 + rank)) AS rrf, min(list * 1000 + rank) AS first FROM al GROUP BY q_id, cno),
fr AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(rrf, 12) DESC, first) AS rank FROM fu)
SELECT q_id, cno AS chunk_no, rank, round(rrf, 9) AS rrf_score FROM fr WHERE rank <= 20""")
def rrf_with_rewrites(spark, sf):
    q = questions(spark, sf)
    rewrites = q.select("q_id", F.expr("substring(question, 1, length(question) div 2)").alias("rewrite"))
    both = answers.query_variants(q, rewrites, "both")
    docs = documents(spark, sf).select(F.col("doc_id").alias("chunk_no"), "text")
    ranked = lexical.bm25_ranking(both.select((F.col("variant") * 1000000 + F.col("q_id")).alias("q_id"), "question"), docs, 100)
    split = [ranked.where(F.expr(f"q_id div 1000000 = {v}")).withColumn("q_id", F.col("q_id") % 1000000) for v in (0, 1)]
    return retrieval.rrf(split, limit=20).select("q_id", "chunk_no", F.col("rank").cast("long").alias("rank"), places("rrf_score", 9).alias("rrf_score"))


@query("""WITH f AS (SELECT n_nationkey AS q_id, 'name' AS key, substr(n_name, 1, 4) AS value FROM nation UNION ALL SELECT n_nationkey + 100, 'name', n_name FROM nation),
k AS (SELECT DISTINCT n_name AS known, regexp_replace(lower(n_name), '[^\\p{L}\\p{N}]', '', 'g') AS kk FROM nation),
m AS (SELECT q_id, key, value, count(*) FILTER (WHERE contains(kk, regexp_replace(lower(value), '[^\\p{L}\\p{N}]', '', 'g'))) AS n, max(CASE WHEN contains(kk, regexp_replace(lower(value), '[^\\p{L}\\p{N}]', '', 'g')) THEN known END) AS only_one, bool_or(known = value) AS exact FROM f, k GROUP BY q_id, key, value)
SELECT q_id, key, CASE WHEN NOT exact AND n = 1 THEN only_one ELSE value END AS value FROM m""")
def filter_fuzzy_resolve(spark, sf):
    n = table(spark, sf, "nation")
    short = n.select(F.col("n_nationkey").alias("q_id"), F.lit("name").alias("key"), F.substring("n_name", 1, 4).alias("value"))
    whole = n.select((F.col("n_nationkey") + 100).alias("q_id"), F.lit("name").alias("key"), F.col("n_name").alias("value"))
    return retrieval.resolve_filters(short.unionByName(whole), n.select(F.lit("name").alias("key"), F.col("n_name").alias("value")))


def projects(spark, sf):
    return documents(spark, sf).select("doc_id", F.concat_ws(" ", "source", "lang").alias("project"))


GRAMS_OF_WORD = grams_sql("w")
EXPAND = f"""WITH {POSTINGS}, cd AS (SELECT q_id, cno, ch.doc_id, rank FROM rk JOIN ch USING (cno) WHERE rank <= 20),
fd AS (SELECT * FROM (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY min(rank)) AS doc_rank FROM cd GROUP BY q_id, doc_id) WHERE doc_rank <= 2),
pr AS (SELECT doc_id, list_distinct({grams_sql("concat_ws(' ', source, lang)")}) AS own FROM documents),
rw AS (SELECT q_id, doc_id, doc_rank, text AS question, own, unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS w FROM fd JOIN pr USING (doc_id) JOIN benchmark ON item_id = q_id),
rs AS (SELECT q_id, doc_id, doc_rank, question, w, {GRAMS_OF_WORD} AS g, own FROM rw),
rq AS (SELECT q_id, doc_id, doc_rank, any_value(question) AS question, list_distinct(flatten(coalesce(list(g) FILTER (WHERE len(list_filter(g, lambda x: list_contains(own, x))) < 0.5 * greatest(len(g), 1)), []))) AS rest,
       count(*) FILTER (WHERE len(list_filter(g, lambda x: list_contains(own, x))) < 0.5 * greatest(len(g), 1)) AS kept FROM rs GROUP BY q_id, doc_id, doc_rank),
ag AS (SELECT q_id, doc_id, doc_rank, unnest(CASE WHEN kept = 0 THEN list_distinct({grams_sql("question")}) ELSE rest END) AS gram FROM rq),
ws AS (SELECT ag.q_id, ag.doc_id, doc_rank, post.cno, sum(w) AS score FROM ag JOIN post USING (gram) JOIN ch ON ch.cno = post.cno AND ch.doc_id = ag.doc_id GROUP BY ALL),
wr AS (SELECT *, row_number() OVER (PARTITION BY q_id, doc_id ORDER BY round(score, 9) DESC, cno) AS n FROM ws WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM cd WHERE cd.q_id = ws.q_id AND cd.cno = ws.cno)),
ls AS (SELECT q_id, max(rank) AS last FROM cd GROUP BY q_id)
SELECT q_id, cno AS chunk_no, doc_id, rank, false AS expanded FROM cd UNION ALL
SELECT wr.q_id, cno, doc_id, last + (doc_rank - 1) * 5 + n, true FROM wr JOIN ls USING (q_id) WHERE n <= 5"""


@query(EXPAND)
def expand_candidates(spark, sf):
    rows = chunks(spark, sf)
    q = questions(spark, sf)
    out = retrieval.expand_candidates(candidates(spark, sf, 20), q, rows, lexical.question_statistics(rows, q), projects(spark, sf))
    return out.select("q_id", "chunk_no", "doc_id", F.col("rank").cast("long").alias("rank"), "expanded")


@query(f"""WITH {POSTINGS}, cd AS (SELECT rk.*, ch.doc_id, row_number() OVER (PARTITION BY q_id, ch.doc_id ORDER BY rank) AS n FROM rk JOIN ch USING (cno) WHERE rank <= 50),
kp AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS hit_no FROM cd WHERE n <= 2) SELECT q_id, cno AS chunk_no, doc_id, rank, hit_no FROM kp WHERE hit_no <= 5""")
def cap_per_doc(spark, sf):
    return retrieval.cap_per_doc(candidates(spark, sf), 2, 5).select("q_id", "chunk_no", "doc_id", F.col("rank").cast("long").alias("rank"), F.col("hit_no").cast("long").alias("hit_no"))


SELECT_ONCE = f"""WITH RECURSIVE {POSTINGS}, dg AS (SELECT doc_id, sha256(string_agg(sha256(text), ',' ORDER BY cno)) AS sig FROM ch GROUP BY doc_id),
sm AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS same FROM dg),
cd AS (SELECT q_id, cno, ch.doc_id, same, sha256(ch.text) AS h, rank FROM rk JOIN ch USING (cno) JOIN sm ON sm.doc_id = ch.doc_id WHERE rank <= 50),
wk(q_id, rank, cno, doc_id, taken, docs, good) AS (
  SELECT DISTINCT q_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), false FROM cd
  UNION ALL
  SELECT c.q_id, c.rank, c.cno, c.doc_id, CASE WHEN ok THEN list_append(taken, h) ELSE taken END, CASE WHEN ok THEN list_append(docs, same) ELSE docs END, ok
  FROM (SELECT cd.*, taken, docs, NOT list_contains(taken, h) AND len(list_filter(docs, lambda x: x = cd.same)) < 2 AS ok FROM wk JOIN cd ON cd.q_id = wk.q_id AND cd.rank = wk.rank + 1) c),
kp AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS hit_no FROM wk WHERE good)
SELECT q_id, cno AS chunk_no, doc_id, CAST(rank AS INTEGER) AS rank, CAST(hit_no AS INTEGER) AS hit_no FROM kp WHERE hit_no <= 5"""


@query(SELECT_ONCE)
def select_dedup(spark, sf):
    rows = chunks(spark, sf)
    return retrieval.select_without_repeats(candidates(spark, sf), retrieval.document_signatures(rows), 2, 5)


NAMED = f"""nm AS (SELECT item_id AS doc_id, substr(text, 1, 24) AS name FROM benchmark),
ng AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest({grams_sql("name")}) AS gram FROM nm)),
nd AS (SELECT gram FROM ng GROUP BY gram HAVING count(*) <= greatest(1.0, (SELECT count(*) FROM nm) * 0.05)),
own AS (SELECT ng.* FROM ng JOIN nd USING (gram)),
aq AS (SELECT DISTINCT item_id AS q_id, gram FROM (SELECT item_id, unnest({grams_sql("text")}) AS gram FROM benchmark)),
hc AS (SELECT q.item_id AS q_id, o.doc_id, count(*) AS size, count(aq.gram) AS hit FROM benchmark q CROSS JOIN own o LEFT JOIN aq ON aq.q_id = q.item_id AND aq.gram = o.gram GROUP BY q.item_id, o.doc_id),
nr AS (SELECT q_id, doc_id, hit / size >= 0.5 AS strict, row_number() OVER (PARTITION BY q_id ORDER BY doc_id) AS named_rank FROM hc WHERE hit >= 3 AND (hit / size >= 0.5 OR hit >= 5))"""


def named(spark, sf):
    """Every item is a candidate document whose name is its first characters."""
    q = questions(spark, sf)
    names = q.select(F.col("q_id").alias("doc_id"), F.substring("question", 1, 24).alias("name"))
    return retrieval.named_docs(q, None, retrieval.name_grams(names))


@query(f"WITH {NAMED} SELECT q_id, doc_id, named_rank, strict FROM nr")
def named_docs(spark, sf):
    return named(spark, sf).select("q_id", "doc_id", F.col("named_rank").cast("long").alias("named_rank"), "strict")


@query(f"WITH {NAMED} SELECT q_id FROM nr GROUP BY q_id HAVING count(*) = 1 AND bool_and(strict)")
def uncap_named(spark, sf):
    return retrieval.uncapped_questions(named(spark, sf))


def local_sql(pool: str, asked: str, keys: str) -> str:
    """CTEs fz (keys, cno, before, turn): pool (keys, cno, text, score, before) reranked with its own statistics by the bigrams asked (keys, gram)."""
    by = ", ".join(f"p.{k} = l.{k}" for k in keys.split(", ")).replace(", ", " AND ")
    z = lambda c: f"CASE WHEN round(stddev_pop({c}) OVER g, 12) = 0 THEN 0 ELSE ({c} - avg({c}) OVER g) / stddev_pop({c}) OVER g END"
    return f"""pg AS (SELECT {keys}, cno, score, before, {grams_sql("text")} AS gr FROM ({pool})),
ps AS (SELECT {keys}, count(*) AS n, CASE WHEN avg(len(gr)) = 0 THEN 1 ELSE avg(len(gr)) END AS mean FROM pg GROUP BY {keys}),
pt AS (SELECT {keys}, cno, gram, any_value(len) AS len, count(*) AS tf FROM (SELECT {keys}, cno, len(gr) AS len, unnest(gr) AS gram FROM pg) JOIN ({asked}) USING ({keys}, gram) GROUP BY {keys}, cno, gram),
pw AS (SELECT {keys}, cno, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS lex FROM (SELECT *, count(*) OVER (PARTITION BY {keys}, gram) AS df FROM pt) JOIN ps USING ({keys}) GROUP BY {keys}, cno),
pl AS (SELECT p.* EXCLUDE (gr), coalesce(lex, 0) AS lex FROM pg p LEFT JOIN pw l ON {by} AND p.cno = l.cno),
pz AS (SELECT *, {z("score")} + {z("lex")} AS rerank FROM pl WINDOW g AS (PARTITION BY {keys})),
fz AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(rerank, 9) DESC, before) AS turn FROM pz)"""


ASPECT = f"""WITH {POSTINGS}, cd AS (SELECT q_id, cno, ch.doc_id, ch.text, score, rank FROM rk JOIN ch USING (cno) WHERE rank <= 50),
tp AS (SELECT q_id, doc_id AS top_doc, list_distinct({grams_sql("text")}) AS own FROM cd WHERE rank = 1),
sq AS (SELECT q_id, top_doc, own, list_filter(list_transform(string_split(regexp_replace(regexp_replace(b.text, '([?？.!])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM tp JOIN benchmark b ON item_id = q_id),
su AS (SELECT q_id, top_doc, own, i, parts[i] AS s FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM sq WHERE len(parts) >= 2)),
sv AS (SELECT q_id, top_doc, s, row_number() OVER (PARTITION BY q_id ORDER BY len(list_filter(g, lambda x: list_contains(own, x))) / greatest(len(g), 1), i) AS nth FROM (SELECT *, {grams_sql("s")} AS g FROM su)),
ap AS (SELECT q_id, top_doc, s FROM sv WHERE nth = 1),
{local_sql("SELECT cd.q_id, cno, text, score, rank AS before FROM cd JOIN ap ON ap.q_id = cd.q_id AND cd.doc_id = ap.top_doc", f"SELECT DISTINCT q_id, unnest({grams_sql('s')}) AS gram FROM ap", "q_id")}
SELECT cd.q_id, cd.cno AS chunk_no, CAST(row_number() OVER (PARTITION BY cd.q_id ORDER BY turn NULLS LAST, rank) AS INTEGER) AS rank FROM cd LEFT JOIN fz ON fz.q_id = cd.q_id AND fz.cno = cd.cno"""


@query(ASPECT)
def aspect_slot(spark, sf):
    q = questions(spark, sf)
    return retrieval.aspect_slot(candidates(spark, sf), q).select("q_id", "chunk_no", "rank")


COMPARE = f"""WITH {POSTINGS}, cd AS (SELECT q_id, cno, ch.doc_id, score, rank FROM rk JOIN ch USING (cno) WHERE rank <= 20),
fd AS (SELECT * FROM (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY min(rank)) AS named FROM cd GROUP BY q_id, doc_id) WHERE named <= 2),
nq AS (SELECT q_id FROM fd GROUP BY q_id HAVING count(*) >= 2),
{local_sql("SELECT fd.q_id, fd.named, ch.cno, ch.text, coalesce(cd.score, 0) AS score, ch.cno AS before FROM fd JOIN nq USING (q_id) JOIN ch ON ch.doc_id = fd.doc_id LEFT JOIN cd ON cd.q_id = fd.q_id AND cd.cno = ch.cno", "SELECT DISTINCT fd.q_id, named, gram FROM fd JOIN qg ON qg.q_id = fd.q_id", "q_id, named")},
mg AS (SELECT coalesce(cd.q_id, fz.q_id) AS q_id, coalesce(cd.cno, fz.cno) AS cno, turn, named, rank FROM cd FULL JOIN fz ON fz.q_id = cd.q_id AND fz.cno = cd.cno)
SELECT q_id, cno AS chunk_no, CAST(row_number() OVER (PARTITION BY q_id ORDER BY turn NULLS LAST, named NULLS LAST, rank) AS INTEGER) AS rank FROM mg"""


@query(COMPARE)
def compare_slot(spark, sf):
    q, rows = questions(spark, sf), chunks(spark, sf)
    ranked = candidates(spark, sf, 20)
    first = retrieval.first_docs(ranked, 2).select("q_id", "doc_id", F.col("doc_rank").alias("named_rank"), F.lit(True).alias("strict"))
    pool = rows.join(first.select("q_id", "doc_id"), "doc_id").join(ranked.select("q_id", "chunk_no", "score"), ["q_id", "chunk_no"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return retrieval.compare_slot(ranked, first, pool.select("q_id", "chunk_no", "doc_id", "text", "score"), q)


@query(f"""WITH {POSTINGS}, nx AS (SELECT doc_id, cno, lead(cno) OVER (PARTITION BY doc_id ORDER BY cno) AS nxt FROM ch), h AS (SELECT * FROM rk WHERE rank <= 5)
SELECT h.q_id, nxt AS chunk_no, doc_id, round(score, 6) AS score FROM h JOIN nx USING (cno) WHERE rank = 1 AND nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h o WHERE o.q_id = h.q_id AND o.cno = nxt)""")
def next_chunk(spark, sf):
    return retrieval.next_chunk(candidates(spark, sf, 5), chunks(spark, sf)).select("q_id", "chunk_no", "doc_id", places("score").alias("score"))


@query()
def within_doc_reselect(spark, sf):
    q, rows = questions(spark, sf), chunks(spark, sf)
    hits = retrieval.cap_per_doc(candidates(spark, sf), 2, 5).checkpoint()  # five rows a question, read by each queue
    docs = hits.select("q_id", "doc_id").distinct().join(q, "q_id")
    embed = dense.embedder(standins.embed)  # the tables have no vectors of chunks
    own = rows.join(broadcast_if_small(docs.select("doc_id").distinct(), 16), "doc_id", "left_semi")
    queues, _ = retrieval.reselection_queues(docs.join(projects(spark, sf), "doc_id"), own, lexical.question_statistics(rows, q), own.select("chunk_no", embed(F.col("text")).alias("embedding")), embed, True)
    return retrieval.reselect_within_docs(hits.withColumn("rank", F.col("hit_no")), queues).select("q_id", "doc_id", "chunk_no", F.col("rank").cast("long").alias("rank"), F.col("within_doc_rank").cast("long").alias("within_doc_rank"))


@query(f"""WITH {LOCAL}, h AS (SELECT rr.q_id, ch.doc_id, rr.score, rr.rerank, rr.new_rank AS rank FROM rr JOIN ch USING (cno) WHERE new_rank <= 5),
t AS (SELECT q_id, doc_id AS top_doc, rerank AS top_rerank FROM h WHERE rank = 1)
SELECT h.q_id, count(DISTINCT doc_id) AS docs, round(avg(CASE WHEN doc_id = top_doc THEN 1.0 ELSE 0.0 END), 6) AS top_doc_share, round(max(score), 6) AS best_score,
round(any_value(top_rerank) - min_by(rerank, rank) FILTER (WHERE doc_id <> top_doc), 5) AS rerank_gap FROM h JOIN t USING (q_id) GROUP BY h.q_id""")
def retrieval_signals(spark, sf):
    ranked = retrieval.lexical_rerank(candidates(spark, sf), questions(spark, sf)).where("rank <= 5")
    out = retrieval.retrieval_signals(ranked)
    return out.select("q_id", "docs", places("top_doc_share").alias("top_doc_share"), places("best_score").alias("best_score"), places("rerank_gap", 5).alias("rerank_gap"))


@query(f"""WITH {POSTINGS}, s AS (SELECT q_id, doc_id, rank AS citation, row_number() OVER (PARTITION BY q_id, doc_id ORDER BY rank) AS n FROM rk JOIN ch USING (cno) WHERE rank <= 5)
SELECT q_id, citation, CASE WHEN n = 1 THEN source END AS project_info FROM s JOIN documents USING (doc_id)""")
def context_first_source(spark, sf):
    meta = documents(spark, sf).select("doc_id", F.create_map(F.lit("부서"), F.col("source"), F.lit("사업명"), F.col("lang")).alias("metadata"))
    empty = F.array().cast("array<struct<table_id:string,header_text:string>>")
    src = answers.number_citations(candidates(spark, sf, 5)).join(meta, "doc_id").withColumns({"section_path": F.lit(""), "table_headers": empty})
    return answers.context_items(src).select("q_id", F.col("citation").cast("long").alias("citation"), F.try_element_at(F.col("item.사업 정보"), F.lit("부서")).alias("project_info"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'no_hits' WHEN turn % 3 = 2 THEN 'empty' WHEN conv_id % 4 = 1 THEN 'truncated' ELSE 'ok' END AS status,
CASE WHEN turn % 5 = 4 THEN 37 WHEN turn % 3 = 2 THEN 0 WHEN conv_id % 4 = 1 THEN 1 ELSE 2 END >= 0 AS answered FROM conversations""")
def answer_envelope(spark, sf):
    c = table(spark, sf, "conversations")
    raw = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, " \n ").otherwise(F.concat(F.lit("x【1】 "), "text")).alias("text"), (F.col("conv_id") % 4 == 1).alias("truncated"), F.when(F.col("turn") % 5 == 4, 0).otherwise(3).alias("n_sources"))
    return answers.finish_answers(raw).select("conv_id", "turn", "status", F.col("answer").isNotNull().alias("answered"))


# Each document gets a Korean sentence whose values follow from its number, behind its own text; the tables have none of their own.
SAID = """s AS (SELECT doc_id, text || '. 예산은 ' || CASE doc_id % 4 WHEN 0 THEN (doc_id + 1) || '백만원' WHEN 1 THEN (doc_id + 1) || '억 ' || (doc_id % 9 + 1) || '천만 원' WHEN 2 THEN (doc_id + 1) || ',000,000원' ELSE '제3조의2에 따라 삼천만 원' END
|| '이며 기간은 ' || (doc_id % 90 + 1) || CASE WHEN doc_id % 2 = 0 THEN '일' ELSE '개월' END || ', 기한은 ' || CASE WHEN doc_id % 2 = 0 THEN '2024. 2. 31' ELSE '‘25년 12월 ' || (doc_id % 28 + 1) || '일' END AS said FROM documents)"""


def said(spark, sf):
    i, t = F.col("doc_id"), lambda c: c.cast("string")
    amount = F.when(i % 4 == 0, F.concat(t(i + 1), F.lit("백만원"))).when(i % 4 == 1, F.concat(t(i + 1), F.lit("억 "), t(i % 9 + 1), F.lit("천만 원"))).when(i % 4 == 2, F.concat(t(i + 1), F.lit(",000,000원"))).otherwise("제3조의2에 따라 삼천만 원")
    until = F.when(i % 2 == 0, "2024. 2. 31").otherwise(F.concat(F.lit("‘25년 12월 "), t(i % 28 + 1), F.lit("일")))
    whole = F.concat("text", F.lit(". 예산은 "), amount, F.lit("이며 기간은 "), t(i % 90 + 1), F.when(i % 2 == 0, "일").otherwise("개월"), F.lit(", 기한은 "), until)
    return documents(spark, sf).select("doc_id", whole.alias("said"))


# Numbers of a text without numerals of its own are amounts where commas group them.
@query(f"""WITH {SAID}, n AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '[0-9](?:[0-9,.\\s]*[0-9])?'), lambda x: regexp_matches(x, '[0-9]{{1,3}}(,[0-9]{{3}})+')),
lambda x: CAST(replace(regexp_extract_all(replace(x, ' ', ''), '[0-9][0-9,]*(?:\\.[0-9]+)?')[-1], ',', '') AS DOUBLE)) AS own FROM documents),
v AS (SELECT doc_id, list_transform(own, lambda x: CAST(round_even(x, 0) AS BIGINT)) || [CASE doc_id % 4 WHEN 0 THEN (doc_id + 1) * 1000000 WHEN 1 THEN (doc_id + 1) * 100000000 + (doc_id % 9 + 1) * 10000000
WHEN 2 THEN (doc_id + 1) * 1000000 ELSE 30000000 END] AS every FROM n)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(every, lambda x: x >= 10000))), ',') AS amounts FROM v""")
def value_extract_amounts(spark, sf):
    return said(spark, sf).select("doc_id", F.array_join(F.transform(vals.amounts("said"), lambda x: x.cast("string")), ",").alias("amounts"))


@query(f"""WITH {SAID}, d AS (SELECT doc_id, regexp_extract_all(text, '([0-9]{{4}}|[0-9]{{2}})\\s*[./\\-]\\s*([0-9]{{1,2}})\\s*[./\\-]\\s*([0-9]{{1,2}})', 1) AS y,
regexp_extract_all(text, '([0-9]{{4}}|[0-9]{{2}})\\s*[./\\-]\\s*([0-9]{{1,2}})\\s*[./\\-]\\s*([0-9]{{1,2}})', 2) AS m, regexp_extract_all(text, '([0-9]{{4}}|[0-9]{{2}})\\s*[./\\-]\\s*([0-9]{{1,2}})\\s*[./\\-]\\s*([0-9]{{1,2}})', 3) AS a FROM documents),
own AS (SELECT doc_id, list_transform(list_filter(range(1, len(y) + 1), lambda i: CAST(m[i] AS INT) BETWEEN 1 AND 12 AND CAST(a[i] AS INT) BETWEEN 1 AND 31),
lambda i: '날짜:' || CASE WHEN len(y[i]) = 2 THEN '20' || y[i] ELSE y[i] END || '-' || lpad(CAST(CAST(m[i] AS INT) AS VARCHAR), 2, '0') || '-' || lpad(CAST(CAST(a[i] AS INT) AS VARCHAR), 2, '0')) AS p FROM d)
SELECT doc_id, array_to_string(list_sort(list_distinct(p || [CASE WHEN doc_id % 2 = 0 THEN '날짜:2024-02-31' ELSE '날짜:2025-12-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END,
CASE WHEN doc_id % 2 = 0 THEN '일:' ELSE '개월:' END || (doc_id % 90 + 1)])), ',') AS periods FROM own""")
def value_extract_periods(spark, sf):
    return said(spark, sf).select("doc_id", F.array_join(F.array_sort(F.transform(vals.periods("said"), lambda x: F.concat_ws(":", x["unit"], x["value"]))), ",").alias("periods"))


# Every turn of a conversation cites numbers that follow from its place, in one of the forms of a citation.
@query("""WITH c AS (SELECT conv_id, turn, text, conv_id % 7 + 1 AS a, conv_id % 7 + 1 + turn % 4 AS b FROM conversations),
own AS (SELECT *, list_filter(flatten(list_transform(regexp_extract_all(translate(text, '【】', '[]'), '\\[\\s*(?:(?:출처|문서|근거|자료)\\s*:?)?\\s*([\\d\\s,\\-–]+?)\\s*번?\\s*\\]', 1), lambda g: string_split(g, ','))), lambda p: regexp_matches(trim(p), '^\\d+$')) AS said FROM c)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(said, lambda x: CAST(trim(x) AS BIGINT)) || CASE turn % 4 WHEN 0 THEN [a] WHEN 1 THEN [a, b] WHEN 2 THEN range(a, b + 1) ELSE range(a, b + 1) END)), ',') AS cited FROM own""")
def citations_parse(spark, sf):
    a = F.col("conv_id") % 7 + 1
    b, turn, t = a + F.col("turn") % 4, F.col("turn") % 4, lambda c: c.cast("string")
    mark = F.when(turn == 0, F.concat(F.lit(" [출처: "), t(a), F.lit("번]"))).when(turn == 1, F.concat(F.lit("【"), t(a), F.lit("】["), t(b), F.lit(", "), t(a), F.lit("]"))).when(turn == 2, F.concat(F.lit("["), t(b), F.lit("-"), t(a), F.lit("]"))).otherwise(F.concat(F.lit("[ "), t(a), F.lit(" – "), t(b), F.lit(" ] (9)")))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", mark).alias("answer"))
    return c.select("conv_id", "turn", F.array_join(F.transform(vals.citations(F.col("answer")), lambda x: x.cast("string")), ",").alias("cited"))


# Every turn refuses in its first sentence, states a value there, refuses later, or does not refuse.
@query("SELECT conv_id, turn, (conv_id + turn) % 4 IN (0, 3) AS refused FROM conversations")
def refusal_flags(spark, sf):
    kind = (F.col("conv_id") + F.col("turn")) % 4
    first = F.when(kind == 0, "해당 내용은 확인되지 않습니다.\n").when(kind == 1, F.concat(F.lit("예산은 "), (F.col("conv_id") + 1).cast("string"), F.lit("억 원이며 기간은 확인되지 않습니다.\n"))).when(kind == 2, "기간은 3개월입니다 [1]. 세부 일정은 확인되지 않습니다.\n").otherwise("사업명을 알려주십시오.\n")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(first, "text").alias("answer"))
    return c.select("conv_id", "turn", vals.is_refusal(F.col("answer")).alias("refused"))


# A labelled field of every document, in one of the ways to write an amount, behind the text.
@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN (doc_id + 1) * 1000000 WHEN 1 THEN (doc_id + 10) * 1000 WHEN 2 THEN (doc_id + 1) * 1000000 WHEN 3 THEN (doc_id + 1) * 100000000 + 50000000 WHEN 4 THEN (doc_id % 900 + 1) * 1000000 END AS won FROM documents""")
def value_extract_won(spark, sf):
    i = F.col("doc_id")
    t = lambda c: c.cast("string")
    value = F.when(i % 6 == 0, F.concat(F.lit("금 "), t(i + 1), F.lit(",000,000원"))).when(i % 6 == 1, F.concat(t(i + 10), F.lit("천원"))).when(i % 6 == 2, F.concat(t(i + 1), F.lit("백만원(VAT포함)"))).when(i % 6 == 3, F.concat(t(i + 1), F.lit("억 5천만 원"))).when(i % 6 == 4, F.concat(F.lit("￦ "), t(i % 900 + 1), F.lit(",000,000"))).otherwise("없음")
    return documents(spark, sf).select("doc_id", vals.won(value).alias("won"))


@query("""SELECT doc_id, '금 ' || (doc_id + 1) || ',000,000원' AS budget, CAST((doc_id + 1) * 1000000 AS VARCHAR) AS won, '계약일로부터 ' || (doc_id % 300 + 1) || '일' AS period, CASE WHEN doc_id % 2 = 0 THEN '제한경쟁입찰' ELSE '수의계약' END AS method FROM documents""")
def field_extract(spark, sf):
    i = F.col("doc_id")
    t = lambda c: c.cast("string")
    lines = F.concat(F.lit("\n1. 사업 예산 : 금 "), t(i + 1), F.lit(",000,000원 ○ 기타\n사업기간: 계약일로부터 "), t(i % 300 + 1), F.lit("일\n계약 방법 | "), F.when(i % 2 == 0, "제한경쟁입찰").otherwise("수의계약"), F.lit(" |\n"))
    f = vals.fields(F.concat("text", lines))
    pick = lambda k: F.element_at("f", k)
    return documents(spark, sf).select("doc_id", f.alias("f")).select("doc_id", pick("원문 사업 예산").alias("budget"), pick("원문 사업 금액").alias("won"), pick("원문 사업 기간").alias("period"), pick("원문 계약 방법").alias("method"))


# Cases: each item asks for the documents that hold its passage; the first letters stand for a question type.
CASES = f"""{POSTINGS}, gold AS (SELECT item_id, list(DISTINCT d.doc_id) AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
src AS (SELECT q_id, list(doc_id ORDER BY rank) AS docs FROM rk JOIN ch USING (cno) WHERE rank <= 5 GROUP BY q_id),
rec AS (SELECT b.item_id AS "index", g.item_id IS NOT NULL AS answerable, CASE WHEN g.item_id IS NOT NULL THEN len(list_intersect(expected, docs)) / len(expected) END AS recall_at_k,
 CASE WHEN g.item_id IS NOT NULL THEN coalesce(1.0 / list_min(list_filter(list_transform(range(1, len(docs) + 1), lambda i: CASE WHEN list_contains(expected, docs[i]) THEN i END), lambda x: x IS NOT NULL)), 0) END AS mrr,
 CASE WHEN item_id % 4 = 0 THEN NULL ELSE (item_id % 3) / 2.0 END AS answer_score, 1 + item_id % 2 AS weight, 'type' || (item_id % 3) AS question_type, CASE WHEN item_id % 2 = 0 THEN 'keyword' END AS grading, 'src' || (item_id % 5) AS source,
 CASE item_id % 6 WHEN 0 THEN 'no_hits' WHEN 1 THEN 'truncated' ELSE 'ok' END AS status, item_id % 7 / 4.0 AS latency_seconds
 FROM benchmark b LEFT JOIN gold g USING (item_id) LEFT JOIN src ON src.q_id = b.item_id)"""


def records(spark, sf):
    q = questions(spark, sf)
    docs = documents(spark, sf)
    gold = passages.containing(docs, q).groupBy("q_id").agg(F.collect_set("doc_id").alias("expected"))
    hits = candidates(spark, sf, 5).groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("sources"))
    rows = q.join(gold, "q_id", "left").join(hits, "q_id", "left").withColumn("answerable", F.col("expected").isNotNull())
    item = F.col("q_id")
    return rows.select(
        item.alias("index"), "answerable", F.when(F.col("answerable"), evaluation.recall(F.col("expected"), F.col("sources"))).alias("recall_at_k"),
        F.when(F.col("answerable"), evaluation.reciprocal_rank(F.col("expected"), F.col("sources"))).alias("mrr"),
        F.when(item % 4 != 0, (item % 3) / 2.0).alias("answer_score"), (1 + item % 2).cast("double").alias("weight"), F.concat(F.lit("type"), (item % 3).cast("string")).alias("question_type"),
        F.when(item % 2 == 0, "keyword").alias("grading"), F.concat(F.lit("src"), (item % 5).cast("string")).alias("source"),
        F.when(item % 6 == 0, "no_hits").when(item % 6 == 1, "truncated").otherwise("ok").alias("status"), (item % 7 / 4.0).alias("latency_seconds"),
    ).withColumns({"answer_content_score": F.col("answer_score"), "keyword_coverage": F.lit(None).cast("double"), "answer_chunk_hit": F.lit(None).cast("double"), "gold_cited": F.when(F.col("answerable"), F.col("mrr") > 0), "refused": F.col("status") == "no_hits"})


@query(f'WITH {CASES} SELECT "index", answerable, round(recall_at_k, 6) AS recall_at_k, round(mrr, 6) AS mrr FROM rec')
def eval_records(spark, sf):
    return records(spark, sf).select("index", "answerable", places("recall_at_k").alias("recall_at_k"), places("mrr").alias("mrr"))


@query(f"""WITH {CASES} SELECT count(*) AS count, count(*) FILTER (WHERE answerable) AS answerable_count, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr_at_k,
round(avg(answer_score) FILTER (WHERE answerable), 6) AS answer_accuracy, round(sum(answer_score * weight) FILTER (WHERE answerable) / sum(weight) FILTER (WHERE answerable AND answer_score IS NOT NULL), 6) AS answer_accuracy_dedup,
count(*) FILTER (WHERE answerable AND answer_score IS NULL AND grading IS NOT NULL) AS ungraded_count, round(avg(answer_score) FILTER (WHERE NOT answerable), 6) AS refusal_accuracy,
round(avg(CASE WHEN status = 'no_hits' THEN 1.0 ELSE 0.0 END) FILTER (WHERE answerable AND status = 'ok'), 6) AS false_refusal_rate, count(*) FILTER (WHERE status = 'truncated') AS status_truncated_count, round(avg(CASE WHEN mrr > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE answerable), 6) AS gold_citation_rate FROM rec""")
def eval_summary(spark, sf):
    s = evaluation.summarise(records(spark, sf))
    rounded = ("recall_at_k", "mrr_at_k", "answer_accuracy", "answer_accuracy_dedup", "refusal_accuracy", "false_refusal_rate", "gold_citation_rate")
    return s.select("count", "answerable_count", "ungraded_count", "status_truncated_count", *[places(c).alias(c) for c in rounded])


@query(f"""WITH {CASES}, gr AS (SELECT * REPLACE (coalesce(grading, '-') AS grading) FROM rec WHERE answerable AND answer_score IS NOT NULL)
SELECT CASE WHEN grouping(question_type) = 0 THEN 'question_type' WHEN grouping(grading) = 0 THEN 'grading' ELSE 'source' END AS dimension, coalesce(question_type, grading, source) AS value, count(*) AS count, round(avg(answer_score), 6) AS accuracy, round(sum(answer_score * weight) / sum(weight), 6) AS accuracy_dedup
FROM gr GROUP BY GROUPING SETS ((question_type), (grading), (source))""")
def eval_breakdown(spark, sf):
    return evaluation.breakdown(records(spark, sf)).select("dimension", "value", "count", places("accuracy").alias("accuracy"), places("accuracy_dedup").alias("accuracy_dedup"))


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (WHERE pos = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (WHERE pos = round_even(0.95 * (n - 1), 0)) AS p95 FROM v GROUP BY event_type""")
def latency_percentiles(spark, sf):
    return evaluation.nearest_rank(table(spark, sf, "events"), "value", (0.5, 0.95), ("event_type",))


@query(f"""WITH {CASES} SELECT round(avg(latency_seconds), 6) AS latency_seconds, min_by(latency_seconds, "index") AS latency_first_seconds, round(avg(latency_seconds) FILTER (WHERE status = 'ok'), 6) AS latency_ok_mean_seconds,
round(avg(latency_seconds) FILTER (WHERE "index" > (SELECT min(item_id) FROM benchmark)), 6) AS latency_warm_mean_seconds FROM rec""")
def latency_statistics(spark, sf):
    s = evaluation.latency_statistics(records(spark, sf))
    return s.select(*[places(c).alias(c) for c in s.columns])


@query()
def bootstrap_ci(spark, sf):
    r = table(spark, sf, "labels").select(F.col("quality").cast("double").alias("score"), (1 + F.col("toxic")).cast("double").alias("weight"), F.concat(F.lit("c"), (F.col("doc_id") % 20).cast("string")).alias("cluster"))
    return evaluation.cluster_bootstrap(r)


@query("""SELECT metric, max(value) FILTER (WHERE scenario = 'A') AS "A", max(value) FILTER (WHERE scenario = 'B') AS "B" FROM
(SELECT event_type AS metric, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS scenario, count(*) AS value FROM events GROUP BY ALL) GROUP BY metric""")
def metric_pivot(spark, sf):
    long = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("scenario")).agg(F.count(F.lit(1)).alias("value"))
    return evaluation.pivot_metrics(long)


@query("SELECT role AS model, sum(length(text)) AS input, sum(turn) AS output, sum(length(text) + turn) AS total FROM conversations GROUP BY role")
def token_usage_rollup(spark, sf):
    n, t = F.length("text").cast("long"), F.col("turn")
    calls = table(spark, sf, "conversations").select(F.create_map("role", F.struct(n.alias("input"), t.alias("output"), (n + t).alias("total"))).alias("usage"))
    return evaluation.token_usage(calls)


@query("""SELECT doc_id, length(text) - length(regexp_replace(text, '[ㄱ-ㆎ가-힣一-鿿]', '', 'g')) + CAST(ceil((length(text) + 1 - (length(text) - length(regexp_replace(text, '[ㄱ-ㆎ가-힣一-鿿]', '', 'g')))) / 3.0) AS BIGINT) + 10 AS tokens,
substr(sha256(source), 1, 16) AS key, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS hash, replace(lower(regexp_replace(text, '\\s+', '', 'g')), 'ß', 'ss') AS compact FROM documents""")
def text_scalars(spark, sf):
    return documents(spark, sf).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"), tx.document_key(F.col("source")).alias("key"), tx.text_hash(F.col("text")).alias("hash"), tx.compact(F.col("text")).alias("compact"))
