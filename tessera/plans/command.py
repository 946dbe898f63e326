"""The command line: parse, build, ask, all, evaluate and check-config, for one profile or for both.

    python -m tessera.plans.command ask --scenario A --question "..." --embed package.module:function --generate ...

Models are functions of installed modules, see models.py. Settings come from arguments, the environment, a settings file and
the profile, in that order.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import re
import sys
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.plans import models, pipeline, tracking
from tessera.plans.profile import Profile, code_version, parse_filters, read_settings, resolve, scenarios, settings
from tessera.plans.trace import Trace
from tessera.session import ship
from tessera.sources import files

COMMANDS = ("parse", "build", "ask", "all", "evaluate", "check-config")
#: Metrics that are compared where both profiles are evaluated.
COMPARED = ("recall_at_k", "mrr_at_k", "answer_accuracy", "answer_accuracy_dedup", "answer_content_accuracy", "refusal_accuracy", "false_refusal_rate", "gold_citation_rate")
CASES = """question string, answerable boolean, expected_doc_ids array<string>, expected_keywords array<string>, grading string, weight double, requires_gold_citation boolean, question_type string, source string,
  doc_cluster string, filters map<string,string>, expected_values struct<amount_won:array<bigint>,period:array<struct<unit:string,value:string>>>, forbidden_values struct<amount_won:array<bigint>,period:array<struct<unit:string,value:string>>>,
  reference_answer string, reference_facts array<string>, reference_excerpt string, reference_project string"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Retrieval over documents")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--scenario", default=os.environ.get("TESSERA_SCENARIO", "A"))
    p.add_argument("--question")
    p.add_argument("--owner", default=os.environ.get("TESSERA_OWNER", "user"))
    p.add_argument("--limit", type=int)
    for name in ("top-k", "max-per-doc", "chunk-size", "chunk-overlap"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--filter", action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("--root", default=".", help="folder that the others are relative to")
    for name, default in (("raw-dir", "data/raw"), ("processed-dir", "data/processed"), ("index-dir", "indexes"), ("results-dir", "results"), ("reports-dir", "reports"), ("state-dir", "state"), ("settings", "settings.env")):
        p.add_argument(f"--{name}", default=default)
    for name in ("eval-file", "judge-cache", "embed", "generate", "rerank-model", "judge"):
        p.add_argument(f"--{name}")
    return p


def checked(args: argparse.Namespace, p: argparse.ArgumentParser) -> argparse.Namespace:
    """Arguments that fit the command; paths that are relative stand under the root."""
    needs = {"ask": ("question", "embed", "generate"), "all": ("question", "embed", "generate"), "build": ("embed",), "evaluate": ("eval_file", "embed", "generate")}
    for name in needs.get(args.command, ()):
        if not (getattr(args, name) or "").strip():
            p.error(f"{args.command} needs --{name.replace('_', '-')}")
    if args.judge_cache and not args.judge:
        p.error("--judge-cache needs --judge")
    if args.command != "evaluate" and args.judge:
        p.error("--judge is for evaluate")
    for name in ("limit", "top_k", "max_per_doc"):
        if (getattr(args, name) or 1) < 1:
            p.error(f"--{name.replace('_', '-')} must be 1 or more")
    if not re.fullmatch(r"[A-Za-z]{1,20}", args.owner):
        p.error("--owner is given by letters")
    for name in ("raw_dir", "processed_dir", "index_dir", "results_dir", "reports_dir", "state_dir", "settings", "eval_file", "judge_cache"):
        value = getattr(args, name)
        if value is not None:
            setattr(args, name, str(Path(args.root) / value))
    return args


def documents_hash(docs: DataFrame) -> str:
    """Tells whether documents changed; does not depend on their order."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id", "text", F.to_json("metadata")).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{row['n']} {row['h']}".encode()).hexdigest()


class Run:
    """One command for one profile."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace, profile: Profile, trace: Trace, experiment: Mapping[str, object]):
        self.spark, self.args, self.profile, self.trace, self.experiment = spark, args, profile, trace, experiment
        self.embed, self.generate, self.rerank, self.judge = (models.parse(k, getattr(args, a)) for k, a in (("embedding", "embed"), ("generation", "generate"), ("reranking", "rerank_model"), ("judging", "judge")))
        self.index_path = f"{args.index_dir}/{profile.name}"

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.args.processed_dir}/documents")

    def parse(self) -> dict:
        with self.trace.span("parse") as span:
            docs, errors = pipeline.parse(self.spark, f"{self.args.raw_dir}/data_list.csv", f"{self.args.raw_dir}/files", self.args.limit)
            span["documents"], span["errors"] = files.write_documents(docs, errors, self.args.processed_dir)
        return {"documents": span["documents"], "errors": span["errors"]}

    def build(self) -> dict:
        with self.trace.span("build") as span:
            docs = self.documents()
            config = {"embedding_model": self.embed.name, "strategy": self.profile.strategy, "chunk_size": self.profile.chunk_size, "chunk_overlap": self.profile.chunk_overlap, "documents": documents_hash(docs)}
            index = pipeline.save(pipeline.build(docs, self.profile, self.embed), self.index_path, config)
            span["chunks"] = index.chunks.count()
        return {"chunks": span["chunks"]}

    def index(self) -> pipeline.Index:
        """The index, if it is of these documents and of this embedding model."""
        index, config = pipeline.load(self.spark, self.index_path)
        if config["embedding_model"] != self.embed.name:
            raise ValueError(f"the index was built with {config['embedding_model']}, not {self.embed.name}")
        if config["documents"] != documents_hash(self.documents()):
            raise ValueError("the documents changed since the index was built; build it again")
        return index

    def answers(self, questions: DataFrame) -> DataFrame:
        """Hits and answers of questions (q_id, question, filters), one job for all questions with the same filters."""
        index, out = self.index(), None
        given = parse_filters(self.args.filter)
        groups = questions.select(F.to_json(F.coalesce("filters", F.create_map().cast("map<string,string>"))).alias("f")).distinct().collect()
        for row in groups:  # the filters of a case file
            part = questions.where(F.to_json(F.coalesce("filters", F.create_map().cast("map<string,string>"))) == row["f"])
            every = {**given, **json.loads(row["f"])}
            part = part.withColumn("filters", F.create_map(*[F.lit(x) for pair in every.items() for x in pair]).cast("map<string,string>"))
            with self.trace.span("retrieve", question_sha256=sorted(hashlib.sha256(r["question"].encode()).hexdigest() for r in part.select("question").collect()), filter_keys=sorted(every)):
                hits = pipeline.held(pipeline.retrieve(part, index, self.profile, self.embed, self.rerank, every))
            self.trace.retrieval([r.asDict() for r in hits.select("q_id", "doc_id", "chunk_id", "score").orderBy("q_id", "rank").collect()] if self.trace.active else [])
            said = pipeline.ask(part, hits, self.profile, self.generate)
            out = said if out is None else out.unionByName(said)
        with self.trace.span("generate"):
            return pipeline.held(out)

    def ask(self) -> dict:
        q = self.spark.createDataFrame([(1, self.args.question, None)], "q_id long, question string, filters map<string,string>")
        row = self.answers(q).first().asDict(recursive=True)
        if row["status"] == "api_error":
            raise RuntimeError("no answer was generated; the index is kept, so that ask can be tried again")
        names = {r["doc_id"]: r["filename"] for r in self.documents().select("doc_id", F.col("metadata")["filename"].alias("filename")).where(F.col("doc_id").isin([s["doc_id"] for s in row["sources"] or []])).collect()}
        print("\n".join(tracking.console_lines(row["answer"], [{**s, "filename": names.get(s["doc_id"], "")} for s in row["sources"] or []])))
        return row

    def evaluate(self) -> dict:
        cases = files.read_json_array(self.spark, self.args.eval_file, CASES).withColumn("q_id", F.monotonically_increasing_id())
        said = self.answers(cases.select("q_id", "question", "filters"))
        verdicts = None
        if self.judge is None:
            open_ = cases.where("grading = 'llm'").count()
            if open_:
                print(f"warning: without a judge {open_} cases are not graded", file=sys.stderr)
        else:
            cache = files.read_cache(self.spark, self.args.judge_cache, "key string, verdict string, at timestamp")
            judged = pipeline.held(evaluation.judge_cases(cases.where("grading = 'llm'"), said, cache, self.judge, self.judge.name))
            if self.args.judge_cache:
                files.append_cache(judged.where("fresh").select("key", "verdict", F.current_timestamp().alias("at")), self.args.judge_cache)
            verdicts = judged.select("q_id", "verdict")
        records = pipeline.held(pipeline.evaluate(cases, said, verdicts))
        summary = evaluation.summarise(records).first().asDict()
        self.trace.scores(summary)
        summary |= evaluation.cluster_bootstrap(records.where("answerable and answer_score is not null").select(F.col("answer_score").alias("score"), "weight", "cluster")).select(F.col("low").alias("answer_accuracy_low"), F.col("high").alias("answer_accuracy_high")).first().asDict()
        listed = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  a case file is read by people
        return {"summary": summary, "breakdown": listed(evaluation.breakdown(records).orderBy("dimension", "value")), "statuses": listed(evaluation.status_counts(records).orderBy("status")), "records": listed(records)}

    def __call__(self, command: str) -> dict:
        steps = ("parse", "build", "ask") if command == "all" else (command,)
        for step in steps:
            result = getattr(self, step)()
        return {"command": command, "experiment": dict(self.experiment), "settings": settings(self.profile), "token_usage": self.trace.usage, **result}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict[str, dict]:
    p = parser()
    args = checked(p.parse_args(argv), p)
    try:
        env = read_settings(args.settings)
        given = {k: getattr(args, k) for k in ("top_k", "max_per_doc", "chunk_size", "chunk_overlap")}
        profiles = [resolve(x, given, env) for x in scenarios(args.scenario)]
    except ValueError as e:
        p.error(str(e))
    if args.command == "check-config":
        print(json.dumps({x.name: settings(x) for x in profiles}, ensure_ascii=False, indent=2))
        return {x.name: settings(x) for x in profiles}
    spark = ship(spark or SparkSession.builder.appName("tessera").getOrCreate())
    stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%fZ")
    Path(args.state_dir).mkdir(parents=True, exist_ok=True)
    results: dict[str, dict] = {}
    for profile in profiles:
        number = tracking.next_run(f"{args.state_dir}/runs.db", args.owner)
        experiment = {"experiment_id": number, "owner": args.owner, "scenario": profile.name, "filters_sha256": hashlib.sha256(json.dumps(parse_filters(args.filter), sort_keys=True).encode()).hexdigest(), **code_version(args.root)}
        trace = Trace.from_settings(env, {**experiment, "command": args.command})
        print(f"run {number}, profile {profile.name}, {'with' if trace.active else 'without'} a trace")
        with trace.span(f"{number}-{args.command}", **trace.metadata):
            results[profile.name] = result = Run(spark, args, profile, trace, experiment)(args.command)
        path = tracking.save_result(f"{args.results_dir}/{profile.name}", args.command, number, stamp, result)
        print(f"result: {path}")
        if "summary" in result:
            report = Path(args.reports_dir) / f"{number}.md"
            report.parent.mkdir(parents=True, exist_ok=True)
            report.write_text(tracking.report(result["summary"], result["settings"], experiment, trace.usage, stamp), encoding="utf-8", newline="\n")
    if len(results) > 1 and all("summary" in r for r in results.values()):
        print(tracking.comparison({k: r["summary"] for k, r in results.items()}, COMPARED))
    return results


if __name__ == "__main__":
    main()
