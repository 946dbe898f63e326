"""Context, prompts and answer envelopes."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import citation_brackets, token_estimate

# Names shown for every source, fields that are not shown, and notices.
NAME_FIELDS = ("사업명", "발주 기관")
HIDDEN_FIELDS = ("filename", "source", "파일명", "start_char", "end_char", "section_path", "tables")
NO_HITS = "문서에서 관련 내용을 찾을 수 없습니다."
EMPTY = "답변을 생성하지 못했습니다. 다시 시도해 주세요."
TRUNCATED = "\n\n(답변이 길어 중간에 잘렸습니다.)"
REWRITE_INPUT_TOKENS = 250


def number_citations(hits: DataFrame) -> DataFrame:
    return hits.withColumn("citation", F.row_number().over(Window.partitionBy("q_id").orderBy("rank")))


def context_items(sources: DataFrame) -> DataFrame:
    """q_id, citation, item: a struct of names, project fields (with a document's first source alone), section, headers, text.

    sources has q_id, citation, doc_id, text, metadata (map), section_path and table_headers (array of struct).
    """
    first = F.row_number().over(Window.partitionBy("q_id", "doc_id").orderBy("citation")) == 1
    named = F.map_filter("metadata", lambda k, v: k.isin(*NAME_FIELDS) & (v != ""))
    info = F.map_filter("metadata", lambda k, v: ~k.isin(*NAME_FIELDS, *HIDDEN_FIELDS) & (v != ""))
    filled = lambda m: F.when(F.size(m) > 0, m)
    headers = F.filter("table_headers", lambda t: t["header_text"] != "")
    return sources.withColumn("is_first", first).select(
        "q_id", "citation",
        F.struct(
            F.col("citation").alias("citation"), filled(named).alias("names"), F.when(F.col("is_first"), filled(info)).alias("사업 정보"),
            F.nullif("section_path", F.lit("")).alias("section_path"), F.when(F.size(headers) > 0, headers).alias("tables"), F.col("text").alias("text"),
        ).alias("item"),
    )


def contexts(sources: DataFrame) -> DataFrame:
    """q_id, context: the items as one JSON array in order of citation."""
    items = context_items(sources).groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("citation", F.to_json("item").alias("json")))).alias("items"))
    return items.select("q_id", F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["json"]), ", "), F.lit("]")).alias("context"))


def prompts(questions: DataFrame, context: DataFrame, with_filters: bool = False, reminder: str = "") -> DataFrame:
    """q_id, prompt; the second profile adds one line for each filter (map column filters).

    reminder is put behind the sources, with {question} replaced, for models that lose sight of a question before them.
    """
    lines = F.lit("")
    if with_filters:
        pairs = F.array_sort(F.map_entries(F.coalesce("filters", F.create_map().cast("map<string,string>"))))
        lines = F.array_join(F.transform(pairs, lambda e: F.concat(F.lit("\n"), e["key"], F.lit(": "), e["value"])), "")
    return questions.join(context, "q_id").select("q_id", F.concat(F.lit("질문: "), "question", lines, F.lit("\n\n검색 자료(JSON):\n"), "context", F.replace(F.lit(reminder), F.lit("{question}"), F.col("question"))).alias("prompt"))


def finish_answers(raw: DataFrame) -> DataFrame:
    """answer and status of model outputs (q_id, text, truncated, n_sources): no_hits, empty, truncated or ok."""
    body = F.regexp_replace(citation_brackets(F.coalesce("text", F.lit(""))), r"(?U)^\s+|\s+$", "")
    status = F.when(F.coalesce("n_sources", F.lit(0)) == 0, "no_hits").when(body == "", "empty").when(F.coalesce("truncated", F.lit(False)), "truncated").otherwise("ok")
    answer = F.when(status == "no_hits", NO_HITS).when(status == "empty", EMPTY).when(status == "truncated", F.concat(body, F.lit(TRUNCATED))).otherwise(body)
    return raw.select(*[c for c in raw.columns if c not in ("text", "truncated", "n_sources")], answer.alias("answer"), status.alias("status"))


def generate(prompt_rows: DataFrame, model: Callable[..., list[tuple[str, bool]]], options: Mapping[str, object] | None = None) -> DataFrame:
    """prompt_rows with text and truncated from an injected generator; a rate limit becomes an error text, not a failure.

    options, such as a limit on the length of an answer, go to each call by name.
    """
    named = dict(options or {})

    @F.pandas_udf("text string, truncated boolean, error string")
    def call(prompt: pd.Series) -> pd.DataFrame:
        try:
            rows = [(t, cut, None) for t, cut in model(prompt.tolist(), **named)]
        except Exception as e:  # the caller sees the error by row
            rows = [(None, False, rate_limit_message(str(e)))] * len(prompt)
        return pd.DataFrame(rows, columns=["text", "truncated", "error"])

    return prompt_rows.withColumn("out", call("prompt")).select("*", "out.*").drop("out")


def rate_limit_message(error: str) -> str:
    low = error.lower()
    if "quota" in low or "insufficient" in low:
        return "quota used up"
    if "rate" in low or "429" in low:
        return "too many requests"
    return f"model call failed: {error}"


def rewrite_questions(questions: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[str]], model_name: str, version: int = 1, instruction: str = "") -> DataFrame:
    """q_id, rewrite, status: from the cache (key, rewrite), or too long, or by the injected model; the question itself otherwise."""
    key = F.sha2(F.concat(F.lit(f"{version}\n{model_name}\n"), "question"), 256)
    known = questions.withColumn("key", key).join(cache.select("key", F.col("rewrite").alias("cached")), "key", "left")
    known = known.withColumn("long", token_estimate(F.col("question"), instruction) > REWRITE_INPUT_TOKENS)

    @F.pandas_udf("string")
    def call(question: pd.Series) -> pd.Series:
        wanted = question[question.notna()]
        out = pd.Series([None] * len(question), index=question.index, dtype=object)
        if len(wanted):
            try:
                out[wanted.index] = model(wanted.tolist())
            except Exception:  # a failed call falls back to the question
                pass
        return out

    asked = known.withColumn("fresh", call(F.when(F.col("cached").isNull() & ~F.col("long"), F.col("question"))))
    status = F.when(F.col("cached").isNotNull(), "cached").when(F.col("long"), "too_long").when(F.col("fresh").isNull(), "failed").when(F.trim("fresh") == "", "empty").otherwise("ok")
    return asked.select("q_id", "key", F.coalesce("cached", F.nullif(F.trim("fresh"), F.lit("")), "question").alias("rewrite"), status.alias("status"))


def query_variants(questions: DataFrame, rewrites: DataFrame, mode: str) -> DataFrame:
    """q_id, variant, question for mode off, only or both (distinct texts, the original first)."""
    if mode == "off":
        return questions.select("q_id", F.lit(0).alias("variant"), "question")
    both = questions.join(rewrites.select("q_id", "rewrite"), "q_id", "left")
    second = F.coalesce("rewrite", "question")
    texts = F.array(second) if mode == "only" else F.array_distinct(F.array(F.col("question"), second))
    return both.select("q_id", F.posexplode(texts).alias("variant", "question"))


def embedding_input(text: Column, metadata: Column, context: str, section: Column | None = None, headers: Column | None = None) -> Column:
    """Text with its project, section or table headers in front; headers that the text has already are left out. NFC is assumed."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    lines: list[Column] = []
    if context == "project":
        lines = [F.when(flat(F.try_element_at(metadata, F.lit(k))) != "", F.concat(F.lit(f"{k}: "), flat(F.try_element_at(metadata, F.lit(k))))) for k in NAME_FIELDS]
    elif context in ("section", "table"):
        path = F.when(flat(section) != "", F.concat(F.lit("절: "), flat(section)))
        lines = [path if context == "section" else F.when(F.size(headers) > 0, path)]
        if context == "table":
            missing = F.array_distinct(F.filter(F.transform(headers, lambda h: F.trim(h)), lambda h: (h != "") & ~F.contains(text, h)))
            lines.append(F.nullif(F.array_join(F.transform(missing, lambda h: F.concat(F.lit("표 헤더:\n"), h)), "\n"), F.lit("")))
    head = F.concat_ws("\n", *lines) if lines else F.lit("")
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n\n"), text))


def with_project(text: Column, metadata: Column, section: Column | None = None) -> Column:
    """Project and agency, and with section its line, in front of a text."""
    names = F.concat_ws(" ", *[F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit("")) for k in NAME_FIELDS])
    head = [F.nullif(names, F.lit(""))]
    if section is not None:
        head.append(F.nullif(section, F.lit("")))
    return F.concat_ws("\n", *head, text)
