import array
import re

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import secret_scan as ss
from tessera.llm.common import training_fold
from tessera.llm.decontaminate import Searcher, fitting_distance, words_of
from tessera.llm.toxicity import fit_toxicity
from tests.llm.conftest import COLUMNS, ODD
from tests.llm.test_dedup import brute_join

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")


def brute_secrets(text):
    """(start, kind, end) of all strong findings, and of weak parts that have a complementary part within 256 code points."""
    found = []
    for kind, pattern in enumerate((ss.ASSIGN, ss.ACCESS, ss.HEX, ss.NAME, ss.TOKEN, ss.ENDPOINT)):
        for m in re.finditer(pattern, text):
            if kind == 0 and len(m[2]) < 12 or kind == 4 and not all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]")):
                continue
            found.append((m.start(), kind, m.end()))
    base = [x for x in found if x[1] < 3]
    weak = [w for w in found if w[1] >= 3 and not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    secret = lambda x: ss.ROLES[x[1]] == "secret"
    linked = [w for w in weak if any(secret(w) != secret(o) and o[0] <= w[2] + 256 and w[0] <= o[2] + 256 for o in base + weak)]
    return sorted(base + linked)


def brute_redacted(text):
    out, at = [], 0
    for a, _, b in brute_secrets(text):
        if a >= at or not out:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_secrets_match_brute_force(docs):
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in ss.secret_scan(docs).select("doc_id", "spans").collect()}
    assert got == {r["doc_id"]: brute_secrets(r["text"] or "") for r in docs.collect()} and sum(map(len, got.values())) > 3


def test_run_matches_brute_force(spark, sf, docs):
    """All five stages, each by a plain version of it, over the whole table."""
    out = {r["doc_id"]: (array.array("I", bytes(r["ids"])).tolist(), r["decoded"]) for r in corpus_pipeline.run(spark, sf).collect()}
    model = fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet").where(training_fold(5, 0)))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r, s in zip(rows, model.score([t or "" for _, t in rows]), strict=True) if s < 0.5]
    rows = [r for r, (i, top, _) in zip(sorted(rows), brute_join(sorted(rows)), strict=True) if i == top]
    s = Searcher([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 0.8)
    clean = []
    for i, t in rows:
        ids = np.array([s.number.get(w, 0) for w in words_of(t)], np.int64)
        if not any(len(ids) and np.isin(w, ids).mean() > 0.5 and fitting_distance(w, ids)[0] <= d for w, d in zip(s.words, s.allowed, strict=True)):
            clean.append((i, t))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(brute_redacted(t), add_bos=True, add_eos=True) for i, t in clean}
    assert out == {i: (x, library.decode(x)) for i, x in want.items()} and 100 < len(out) < 200


def test_stages_are_these():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "pieces"] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, sf, make, name):
    """Nulls in all columns, empty and very long texts, repeated rows, columns with names that the stages use, and no rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    long = "plain words of a long text that goes on " * 60_000
    df = make([*ODD, (8, "w" * 5000), (9, long), (None, "user=bob password=abcdefghijklmnop")])
    out = stage(spark, df, sf)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in out.select("doc_id").collect()))
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    if name == "pieces":
        assert out.columns == ["doc_id", "ids", "decoded", "n_tokens"] and got == ids
    else:
        assert out.columns == df.columns and out.schema == df.schema
    if name == "near_duplicates":  # 5 has a copy of its own and one in 6; 8 stands twice; empty and null texts are in no class
        assert got == sorted({(i is None, i or 0) for i, _ in ODD if i != 6} | {(False, 9)}) + [(True, 0)] * 2
    elif name in ("toxicity", "decontamination", "secrets"):
        assert got == ids
    if name == "secrets":
        texts = {r["text"] for r in out.collect()}
        assert "[secret] [secret]" in texts and long in texts and None in texts
    empty = stage(spark, make([]), sf)
    assert empty.count() == 0
    nothing = spark.createDataFrame([(None,) * 5] * 2, COLUMNS)
    assert stage(spark, nothing, sf).count() >= 1
