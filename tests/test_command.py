import json
import warnings

import pytest

from tessera.plans import command, models
from tessera.plans.trace import Trace
from tessera.sources import files

STANDINS = ["--embed", "tessera.plans.standins:embed", "--generate", "tessera.plans.standins:generate"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    raw = root / "data" / "raw"
    (raw / "files").mkdir(parents=True)
    (raw / "files" / "a.txt").write_text("1. 사업 개요\n사업명: 도서관 시스템 구축\n사업 예산: 130,000,000원\n" + "도서관 자료를 관리한다. " * 40)
    (raw / "files" / "b.txt").write_text("1. 제안 요청\n병원 예약 시스템을 만든다. 예산액: 5억 원\n" + "병원 환자를 관리한다. " * 40)
    (raw / "data_list.csv").write_text("\ufeff파일명,사업명,발주 기관,공고 번호\na.txt,도서관 시스템 구축,시립도서관,N1\nb.txt,병원 예약 시스템,시립병원,\nc.txt,없음,없음,\n", encoding="utf-8")
    (root / "settings.env").write_text("# settings\nTESSERA_MIN_SCORE=off\nTESSERA_RERANK='lexical'\nTESSERA_TRACE=" + str(root / "trace.jsonl") + "\n")
    return root


def test_commands(spark, root, capsys):
    where = ["--root", str(root), "--owner", "ab"]
    said = command.main(["all", "--question", "도서관 시스템 구축의 예산은?", "--scenario", "both", *where, *STANDINS], spark)
    assert set(said) == {"A", "B"} and all(r["status"] == "ok" and r["answer"].endswith("[1]") for r in said.values())
    assert said["A"]["signals"]["docs"] >= 1 and "signals" not in said["B"]
    assert said["B"]["experiment"]["experiment_id"] == "ab-0002" and "a.txt" in capsys.readouterr().out
    errors = [json.loads(x) for p in (root / "data" / "processed" / "errors").glob("*.json") for x in p.read_text().splitlines()]
    assert [e["filename"] for e in errors] == ["c.txt"]
    with pytest.raises(ValueError, match="built with"):
        command.main(["ask", "--question", "x", *where, "--embed", "tessera.plans.standins:generate", *STANDINS[2:]], spark)


def test_filters_are_resolved(spark, root):
    said = command.main(["ask", "--question", "예산은 얼마?", "--filter", "발주 기관=병원", "--root", str(root), *STANDINS], spark)["A"]
    assert {s["doc_id"] for s in said["sources"]} == {r["doc_id"] for r in spark.read.parquet(f"{root}/data/processed/documents").where("metadata['filename'] = 'b.txt'").collect()}


def test_evaluate(spark, root, capsys):
    gold = spark.read.parquet(f"{root}/data/processed/documents").where("metadata['filename'] = 'a.txt'").first()["doc_id"]
    cases = [
        {"question": "도서관 시스템 구축의 예산은?", "expected_doc_ids": [gold], "expected_values": {"amount_won": [130_000_000], "period": None}, "grading": "numeric"},
        {"question": "도서관 시스템 구축의 내용은?", "expected_doc_ids": [gold], "grading": "llm", "reference_answer": "1. 사업 개요", "filters": {"발주 기관": "시립도서관"}},
        {"question": "우주 정거장은?", "answerable": False},
    ]
    (root / "cases.json").write_text(json.dumps(cases, ensure_ascii=False))
    run = ["evaluate", "--scenario", "both", "--root", str(root), "--eval-file", "cases.json", *STANDINS]
    result = command.main([*run, "--judge", "tessera.plans.standins:judge", "--judge-cache", "judge"], spark)
    for r in result.values():
        assert {"ok"} >= {x["status"] for x in r["statuses"]} and {x["dimension"] for x in r["breakdown"]} == {"question_type", "grading", "source"}
        assert r["summary"]["count"] == 3 and r["summary"]["recall_at_k"] == 1.0 and r["summary"]["ungraded_count"] == 0
    # equal answers of both profiles are judged once
    assert "| recall_at_k | 1.000 | 1.000 |" in capsys.readouterr().out and 1 <= spark.read.parquet(f"{root}/judge").count() <= 2
    before = spark.read.parquet(f"{root}/judge").count()
    run[2] = "A"
    again = command.main([*run, "--judge", "tessera.plans.standins:judge", "--judge-cache", "judge"], spark)
    assert spark.read.parquet(f"{root}/judge").count() == before and again["A"]["summary"]["answer_accuracy"] == result["A"]["summary"]["answer_accuracy"]
    plain = command.main(run, spark)
    assert plain["A"]["summary"]["ungraded_count"] == 1 and "1 cases are not graded" in capsys.readouterr().err
    spans = [json.loads(x) for x in (root / "trace.jsonl").read_text().splitlines()]
    assert {"parse", "build", "retrieve", "generate", "retrieval-results"} <= {s.get("span") for s in spans}
    assert "도서관" not in (root / "trace.jsonl").read_text() and any(s.get("score") == "recall_at_k" for s in spans)
    assert list((root / "reports").glob("*.md"))


def test_stale_index(spark, root):
    folder = root / "data" / "processed" / "documents"
    changed = spark.read.parquet(str(folder)).limit(1).toPandas()
    files.write_documents(spark.createDataFrame(changed, spark.read.parquet(str(folder)).schema), spark.createDataFrame([], "filename string, error string"), str(folder.parent))
    with pytest.raises(ValueError, match="build it again"):
        command.main(["ask", "--question", "x", "--root", str(root), *STANDINS], spark)


def test_bad_arguments(root, capsys):
    for argv in (["ask"], ["evaluate"], ["ask", "--question", "x"], ["build", "--embed", "m:f", "--top-k", "0"], ["parse", "--judge", "m:f"], ["parse", "--owner", "a b"], ["check-config", "--scenario", "C"], ["check-config", "--chunk-size", "10", "--chunk-overlap", "10"]):
        with pytest.raises(SystemExit):
            command.main([*argv, "--root", str(root)])
    shown = command.main(["check-config", "--scenario", "AB", "--top-k", "7", "--root", str(root)])
    assert shown["A"]["top_k"] == 7 and shown["A"]["min_score"] is None and shown["B"]["strategy"] == "structured"


def test_models():
    model = models.parse("embedding", "tessera.plans.standins:embed,name=x")
    assert model.name == "x" and len(model(["ab"])[0]) == 64
    for bad in ("nothing", "no.such:thing", "tessera.plans.standins:nothing", "tessera.plans.standins:annotations"):
        with pytest.raises(ValueError):
            models.parse("embedding", bad).load()
    generate = models.local_generator(lambda m: ("x", 5, False) if m[1]["content"] == "long" else (m[0]["content"], 2, False), "do", " so", 5)
    assert generate(["long", "short"]) == [("x", True), ("do so", False)]


def test_trace(tmp_path):
    assert not Trace.from_settings({}).active and not Trace.from_settings({"TESSERA_TRACE": str(tmp_path / "t"), "TESSERA_TRACE_ENABLED": "no"}).active
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert not Trace.from_settings({"TESSERA_TRACE": str(tmp_path)}).active and seen
    trace = Trace.from_settings({"TESSERA_TRACE": str(tmp_path / "t" / "x.jsonl")})
    with pytest.raises(KeyError), trace.span("step"):
        raise KeyError("secret")
    trace.tokens("m", {"input": 3})
    trace.tokens("m", {"input": 4, "output": 1})
    rows = (tmp_path / "t" / "x.jsonl").read_text()
    assert '"error": "KeyError"' in rows and "secret" not in rows and trace.usage == {"m": {"input": 7, "output": 1}}


def test_sinks(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id string, text string")
    errors = spark.createDataFrame([("a", "no such file")], "filename string, error string")
    with pytest.raises(ValueError, match="no document"):
        files.write_documents(none, errors, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p" / "errors")).count() == 1 and spark.read.parquet(str(tmp_path / "p" / "documents")).count() == 0
    cache = str(tmp_path / "cache")
    assert files.read_cache(spark, cache, "key string, verdict string, at long").count() == 0
    for at, v in ((1, "a"), (2, "b")):
        files.append_cache(spark.createDataFrame([("k", v, at), (v, v, at)], "key string, verdict string, at long"), cache)
    files.compact_cache(spark, cache)
    assert sorted((r["key"], r["verdict"]) for r in files.read_cache(spark, cache, "key string, verdict string, at long").collect()) == [("a", "a"), ("b", "b"), ("k", "b")]
