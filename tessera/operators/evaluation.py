"""Grading of answers, records of cases, and their aggregates."""

from __future__ import annotations

import random
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.functions.values import citations, values_present

STATUSES = ("ok", "no_hits", "empty", "truncated", "api_error")
VERDICTS = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0}
SEED, ITERATIONS = 20261012, 1000


def violations(cases: DataFrame) -> DataFrame:
    """index, problem of every broken rule of the case contract."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    answerable, grading = F.coalesce("answerable", F.lit(True)), F.col("grading")
    rules = {
        "blank question": F.trim(F.coalesce("question", F.lit(""))) == "",
        "answerable without documents": answerable & none("expected_doc_ids"),
        "unknown grading": grading.isNotNull() & ~grading.isin("numeric", "keyword", "llm", "refusal"),
        "numeric without values": (grading == "numeric") & none("expected_values.amount_won") & none("expected_values.period"),
        "keyword without keywords": (grading == "keyword") & none("expected_keywords"),
        "unanswerable with a value grading": ~answerable & grading.isin("numeric", "keyword"),
        "negative weight": F.col("weight") < 0,
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return cases.select("index", F.explode(broken).alias("problem"))


def reciprocal_rank(expected: Column, sources: Column) -> Column:
    """1 / rank of the first source (array of structs with doc_id, in order) from an expected document, else 0."""
    ranks = F.filter(F.transform(sources, lambda s, i: F.when(F.array_contains(expected, s["doc_id"]), i + 1)), lambda x: x.isNotNull())
    return F.coalesce(1 / F.array_min(ranks), F.lit(0.0))


def recall(expected: Column, sources: Column) -> Column:
    distinct = F.array_distinct(expected)
    return F.size(F.array_intersect(distinct, F.transform(sources, lambda s: s["doc_id"]))) / F.nullif(F.size(distinct), F.lit(0))


def keyword_coverage(keywords: Column, answer: Column) -> Column:
    return F.size(F.filter(keywords, lambda w: F.contains(fold(answer), fold(w)))) / F.nullif(F.size(keywords), F.lit(0))


def used_sources(answer: Column, sources: Column) -> Column:
    cited = citations(answer)
    return F.when(F.size(cited) == 0, sources).otherwise(F.filter(sources, lambda s: F.array_contains(cited, s["citation"])))


def gold_cited(expected: Column, answer: Column, sources: Column) -> Column:
    return F.exists(F.filter(sources, lambda s: F.array_contains(citations(answer), s["citation"])), lambda s: F.array_contains(expected, s["doc_id"]))


def answer_chunk_hit(expected: Column, sources: Column, found: Column, counts: Column, keywords: Column, values: Column) -> Column:
    """1 if a source of an expected document has the expected values or, where there are none, any keyword; null without both.

    found has the amounts and periods of each source's text, counts how many keywords it has; both in order of the sources.
    """
    wanted = lambda k: F.coalesce(F.size(values[k]), F.lit(0)) > 0
    gold = F.filter(F.transform(sources, lambda s, i: F.struct(F.array_contains(expected, s["doc_id"]).alias("gold"), F.get(found, i).alias("found"), F.get(counts, i).alias("count"))), lambda x: x["gold"])
    valued = F.exists(gold, lambda x: values_present(x["found"]["amounts"], x["found"]["periods"], values["amount_won"], values["period"]))
    return F.when(wanted("amount_won") | wanted("period"), valued.cast("double")).when(F.size(keywords) > 0, F.exists(gold, lambda x: x["count"] > 0).cast("double"))


def grounded(values: Column, evidence: Column, has_evidence: Column) -> Column:
    return has_evidence & (F.size(F.array_except(values, evidence)) == 0)


def default_grading(grading: Column, answerable: Column, keywords: Column) -> Column:
    return F.coalesce(grading, F.when(~answerable, "refusal").when(F.size(keywords) > 0, "keyword"))


def content_score(grading: Column, clean_refusal: Column, forbidden: Column, numeric: Column, keyword: Column, verdict: Column) -> Column:
    """Score by grading; null where nothing grades the case."""
    number = lambda c: c.cast("double")
    judged = F.try_element_at(F.create_map(*[F.lit(x) for p in VERDICTS.items() for x in p]), verdict)
    return F.when(grading == "refusal", number(clean_refusal & ~F.coalesce(forbidden, F.lit(False)))).when(grading == "numeric", number(numeric)).when(grading == "keyword", number(keyword)).when(grading == "llm", judged)


def final_score(content: Column, needs_citation: Column, answerable: Column, cited: Column) -> Column:
    return F.when(content.isNotNull() & F.coalesce(needs_citation, F.lit(False)) & answerable & ~cited, 0.0).otherwise(content)


def weighted_mean(score: Column, weight: Column) -> Column:
    known = F.when(score.isNotNull(), weight)
    return F.sum(score * weight) / F.nullif(F.sum(known), F.lit(0.0))


def cluster_key(cluster: Column, expected: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(cluster, F.lit("")), F.nullif(F.array_join(F.array_sort(expected), "|"), F.lit("")), index.cast("string"))


def summarise(records: DataFrame) -> DataFrame:
    """One row of means, rates and counts over records; means leave out nulls."""
    able, bad = F.col("answerable"), ~F.col("answerable")
    graded = able & F.col("answer_score").isNotNull()
    of = lambda cond, value: F.avg(F.when(cond, value))
    refusal = of(bad, F.col("answer_score"))
    total = F.count(F.lit(1))
    return records.agg(
        total.alias("count"), F.count_if(able).alias("answerable_count"), F.count_if(bad).alias("unanswerable_count"),
        of(able, F.col("recall_at_k")).alias("recall_at_k"), of(able, F.col("mrr")).alias("mrr_at_k"), F.avg("keyword_coverage").alias("keyword_coverage"),
        of(able, F.col("answer_chunk_hit")).alias("answer_chunk_hit_rate"), of(graded, F.col("answer_score")).alias("answer_accuracy"),
        weighted_mean(F.when(graded, F.col("answer_score")), F.col("weight")).alias("answer_accuracy_dedup"),
        of(graded, F.col("answer_content_score")).alias("answer_content_accuracy"),
        F.count_if(graded).alias("graded_count"), F.count_if(able & F.col("answer_score").isNull() & F.col("grading").isNotNull()).alias("ungraded_count"),
        of(able, F.col("gold_cited").cast("double")).alias("gold_citation_rate"),
        of(able & (F.col("status") == "ok"), F.col("refused").cast("double")).alias("false_refusal_rate"),
        refusal.alias("refusal_accuracy"), (1 - refusal).alias("unanswerable_hallucination_rate"), F.count_if(bad & F.col("answer_score").isNotNull()).alias("refusal_graded_count"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}_count") for s in STATUSES],
        F.count_if(~F.col("status").isin(*STATUSES)).alias("status_other_count"), (F.count_if(F.col("status") == "truncated") / total).alias("truncated_rate"),
    )


def breakdown(records: DataFrame) -> DataFrame:
    """dimension, value, count, accuracy, accuracy_dedup by question_type, grading and source, in one pass of grouping sets."""
    records.createOrReplaceTempView("tessera_breakdown")
    return records.sparkSession.sql(
        """
        SELECT CASE grouping_id() WHEN 3 THEN 'question_type' WHEN 5 THEN 'grading' ELSE 'source' END AS dimension,
               CASE grouping_id() WHEN 3 THEN question_type WHEN 5 THEN grading ELSE source END AS value,
               count(*) AS count, avg(answer_score) AS accuracy, sum(answer_score * weight) / nullif(sum(weight), 0.0D) AS accuracy_dedup
        FROM (SELECT coalesce(question_type, '-') AS question_type, coalesce(grading, '-') AS grading, coalesce(source, '-') AS source, answer_score, weight
              FROM tessera_breakdown WHERE answerable AND answer_score IS NOT NULL)
        GROUP BY GROUPING SETS ((question_type), (grading), (source))
        """
    )


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


#: Rows up to which the values around a rank are sorted in one task.
SORTED = 100_000


def nearest_rank(values: DataFrame, column: str, quantiles: tuple[float, ...] = (0.5, 0.95), by: tuple[str, ...] = ()) -> DataFrame:
    """The value at rank round(q (n - 1)), halves to the even rank; one column p<q> for each quantile.

    Groups are sorted each by itself. Without groups, the range of a rank is narrowed by counts until few values are left.
    """
    known = values.where(F.col(column).isNotNull())
    if not by:
        return _global_rank(known.select(F.col(column).cast("double").alias("v")), quantiles, known.schema[column].dataType)
    w = Window.partitionBy(*by)
    ranked = known.withColumn("at", F.row_number().over(w.orderBy(column)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    picks = [F.max(F.when(F.col("at") == F.bround(F.lit(q) * (F.col("n") - 1)), F.col(column))).alias(f"p{round(q * 100)}") for q in quantiles]
    return ranked.groupBy(*by).agg(*picks)


def _global_rank(known: DataFrame, quantiles: tuple[float, ...], kind) -> DataFrame:
    spark, out = known.sparkSession, {}
    total = known.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    for q in quantiles:
        rank, n, low, high, part = round(q * (total["n"] - 1)), total["n"], total["low"], total["high"], known
        while n > SORTED and low < high:
            step = (high - low) / 1000
            slot = F.least(F.floor((F.col("v") - low) / step), F.lit(999))
            counts = {r["slot"]: r for r in part.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}  # 1000 rows at most
            for k in sorted(counts):
                if rank < counts[k]["n"]:
                    break
                rank -= counts[k]["n"]
            n, low, high = counts[k]["n"], counts[k]["low"], counts[k]["high"]
            part = part.where((F.col("v") >= low) & (F.col("v") <= high))
        value = low if low == high else part.orderBy("v").limit(rank + 1).agg(F.max("v").alias("v")).first()["v"] if n else None
        out[f"p{round(q * 100)}"] = value
    return spark.createDataFrame([tuple(out.values())], ", ".join(f"{k} double" for k in out)).select(*[F.col(k).cast(kind).alias(k) for k in out])


def latency_statistics(records: DataFrame) -> DataFrame:
    """mean, first, ok and warm mean of latency_seconds over records in order of index."""
    first = records.agg(F.min("index").alias("least"))
    rows = records.crossJoin(F.broadcast(first))
    lat = F.col("latency_seconds")
    return rows.agg(F.avg(lat).alias("latency_seconds"), F.min_by("latency_seconds", "index").alias("latency_first_seconds"), F.avg(F.when(F.col("status") == "ok", lat)).alias("latency_ok_mean_seconds"), F.avg(F.when(F.col("index") > F.col("least"), lat)).alias("latency_warm_mean_seconds"))


def cluster_bootstrap(rows: DataFrame, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """low, high: a 95 % interval of the weighted mean of (score, weight, cluster), clusters drawn with replacement.

    Clusters are summed up first, so that the one task that draws has two numbers for each cluster: cases are written by
    people, and their clusters are documents that these asked about. Nulls for fewer than two.
    """
    sums = rows.groupBy("cluster").agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cluster")
        s, w = group["s"].tolist(), group["w"].tolist()
        if len(s) < 2:
            return pd.DataFrame({"low": [None], "high": [None]}, dtype="float64")
        # the same numbers as random.Random(seed).choices() draws, all of an iteration at once
        _, state, _ = random.Random(seed).getstate()
        rng = np.random.RandomState()
        rng.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
        s, w, means = np.array(s), np.array(w), []
        for _ in range(iterations):
            picked = (rng.random_sample(len(s)) * len(s)).astype(np.int64)
            total = w[picked].sum()
            if total:
                means.append(float(s[picked].sum() / total))
        means.sort()
        return pd.DataFrame({"low": [means[int(0.025 * len(means))]], "high": [means[int(0.975 * len(means)) - 1]]})

    return sums.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(draw, "low double, high double")


# Labels of a judge's input, its version, and where a verdict stands in the output.
JUDGE_VERSION = "judge-v3"
REFERENCE = ("모범답안: ", "대상 사업: ", "고유 근거: ", "원문 발췌:\n")
SECTIONS = ("[질문]\n", "\n\n[참고 근거]\n", "\n\n[답변]\n")
VERDICT = r'"verdict"\s*:\s*"(correct|partial|incorrect)"'


def judge_prompts(cases: DataFrame, said: DataFrame) -> DataFrame:
    """q_id, prompt of cases with a reference (a model answer, or a project, facts behind the first one, and an excerpt)."""
    of = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    facts = F.transform(F.slice(F.coalesce("reference_facts", F.array().cast("array<string>")), 2, 1 << 20), lambda x: F.concat(F.lit(REFERENCE[2]), x))
    parts = F.concat_ws("\n", of(REFERENCE[1], F.col("reference_project")), facts, of(REFERENCE[3], F.col("reference_excerpt")))
    reference = F.coalesce(of(REFERENCE[0], F.col("reference_answer")), parts)
    rows = cases.join(said.select("q_id", "answer"), "q_id")
    return rows.select("q_id", F.concat(F.lit(SECTIONS[0]), "question", F.lit(SECTIONS[1]), reference, F.lit(SECTIONS[2]), F.coalesce("answer", F.lit(""))).alias("prompt"))


def judge_llm(rows: DataFrame, cache: DataFrame, judge: Callable[[list[str]], list[str]], model: str = "", version: str = JUDGE_VERSION) -> DataFrame:
    """rows (prompt and others) with key, verdict and fresh: the last row of the cache (key, verdict, at) by key, else the judge's.

    The key is that of model, version and prompt. The judge gives texts that have a verdict in them; one without is an error.
    """
    last = cache.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("at").desc()))).where("n = 1").select("key", F.col("verdict").alias("cached"))

    @F.pandas_udf("string")
    def ask(prompt: pd.Series) -> pd.Series:
        wanted = prompt[prompt.notna()]
        out = pd.Series([None] * len(prompt), index=prompt.index, dtype=object)
        if len(wanted):
            found = [re.search(VERDICT, text or "") for text in judge(wanted.tolist())]
            if len(found) != len(wanted) or not all(found):
                raise ValueError("the judge gave an answer without a verdict")
            out[wanted.index] = [m[1] for m in found]
        return out

    known = rows.withColumn("key", F.sha2(F.concat(F.lit(f"{model}\n{version}\n"), "prompt"), 256)).join(last, "key", "left")
    return known.withColumn("verdict", F.coalesce("cached", ask(F.when(F.col("cached").isNull(), F.col("prompt"))))).withColumn("fresh", F.col("cached").isNull()).drop("cached")


def judge_cases(cases: DataFrame, said: DataFrame, cache: DataFrame, judge: Callable[[list[str]], list[str]], model: str = "") -> DataFrame:
    return judge_llm(judge_prompts(cases, said), cache, judge, model).select("q_id", "key", "verdict", "fresh")


def token_usage(calls: DataFrame) -> DataFrame:
    """model, input, output, total over call rows with usage map<model, struct<input, output, total>>; all-zero models are left out."""
    rows = calls.select(F.explode("usage").alias("model", "u")).groupBy("model").agg(*[F.sum(f"u.{k}").alias(k) for k in ("input", "output", "total")])
    return rows.where("input > 0 or output > 0 or total > 0")


def pivot_metrics(long: DataFrame, scenarios: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """metric and a column for each scenario of rows (metric, scenario, value)."""
    return long.groupBy("metric").pivot("scenario", list(scenarios)).agg(F.first("value"))
