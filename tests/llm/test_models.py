import array
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.boosting import BoostedTrees, Isotonic
from tessera.llm.common import held_out, training_fold, with_checkpoints
from tessera.llm.decontaminate import Searcher, drop_contaminated, find_items, fitting_distance, long_fitting_distance, words_of
from tessera.llm.language_id import GRAMS, SHARE, fit_filters, gram_hashes, identify_language
from tessera.llm.jaccard_join import ngram_jaccard_join
from tessera.llm.piece_bpe import Encoder, Vocabulary, check_settings, encode_decode, message
from tessera.llm.quality_rules import quality_rules
from tessera.llm.toxicity import BEGINNINGS, INSULTS, OBFUSCATED, SECOND_PERSON, SPACED, STRETCHED, Lexicon, drop_toxic, features, fit_toxicity, score_toxicity
from tests.llm.conftest import ODD

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(open(MODEL, "rb").read()))


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]) | st.sampled_from("abst eéü\n\t ▁<>0x1漢"), max_size=120))
@settings(max_examples=300, deadline=None)
def test_encoding_is_the_librarys(encoder, library, text):
    ids = array.array("I", encoder.encode(text, True, True)).tolist()
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert encoder.decode(ids) == library.decode(ids)


@given(st.lists(st.integers(0, 31999) | st.integers(0, 300), max_size=30))
@settings(max_examples=200, deadline=None)
def test_decoding_is_the_librarys(encoder, library, ids):
    assert encoder.decode(ids) == library.decode(ids)


def test_other_models_are_refused():
    """A model with other settings would be encoded wrongly without a word."""
    raw = open(MODEL, "rb").read()
    assert {n for n, _ in message(raw)} >= {1, 2, 3}
    check_settings(raw)
    for extra, says in ((b"\x12\x02\x18\x01", "no BPE"), (b"\x1a\x02\x18\x00", "no space in front"), (b"\x1a\x02\x20\x01", "drops white space"), (b"\x1a\x03\x12\x01x", "normalises"), (b"\x0a\x05\x0a\x01x\x18\x04", "defined by a user")):
        with pytest.raises(ValueError, match=says):
            check_settings(raw + extra)


def test_very_long_text(spark, library):
    """A text of over eight megabytes goes through each operator that looks at texts, whole; a copy of it is found."""
    text = " ".join(f"word{i % 9973} said the 7 thing. You" for i in range(300_000))
    assert len(text) > 8 << 20
    df = with_checkpoints(spark, spark.createDataFrame([(1, text, "en"), (2, text, None), (3, "a short one", "en")], "doc_id long, text string, lang string"))
    ids = {r["doc_id"]: bytes(r["ids"]) for r in encode_decode(df.where("doc_id < 3"), MODEL).select("doc_id", "ids").collect()}
    assert ids[1] == ids[2] == np.array(library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_jaccard_join(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    assert {r["lang_pred"] for r in identify_language(df, fit_filters(df.where("lang is not null"))).collect()} == {"en"}
    rules = {r["doc_id"]: r for r in quality_rules(df).collect()}
    assert rules[1]["n_words"] == rules[1]["n_repeat_words"] == 1_800_000


def test_encode_documents(docs, library, make):
    got = {r["doc_id"]: (array.array("I", bytes(r["ids"])).tolist(), r["decoded"]) for r in encode_decode(docs, MODEL).collect()}
    want = {r["doc_id"]: library.encode(r["text"], add_bos=True, add_eos=True) for r in docs.collect()}
    assert got == {k: (v, library.decode(v)) for k, v in want.items()}
    odd = encode_decode(make(ODD), MODEL).collect()
    assert len(odd) == len(ODD) and {len(r["ids"]) for r in odd if r["doc_id"] in (1, 2)} == {8}
    assert encode_decode(make([]), MODEL).count() == 0


def test_language(spark, docs, make):
    labelled = docs.select("doc_id", "text", "lang")
    filters = fit_filters(labelled.where(training_fold(3, 1)))
    out = identify_language(docs, filters).join(labelled.select("doc_id", "lang"), "doc_id").withColumn("held", held_out(3, 1))
    held = out.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.95
    odd = identify_language(make([*ODD, (30, "123 !!"), (31, "a")]), filters).collect()
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3, 30)} == {"und"} and all(0 <= r["score"] <= 1 for r in odd)
    assert next(r for r in odd if r["doc_id"] == 31)["lang_pred"] in filters.langs
    nothing = fit_filters(labelled.limit(0))
    assert {r["lang_pred"] for r in identify_language(make(ODD), nothing).collect()} == {"und"}
    assert identify_language(make([]), filters).count() == 0


def brute_grams(text):
    """n-grams of a text by plain string operations: letters lower-cased, runs of anything else one break, breaks at both ends."""
    flat = re.sub(r"\x00+", "\x00", "\x00" + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "\x00" for c in text) + "\x00")
    return [(n, flat[i : i + n]) for n in GRAMS for i in range(len(flat) - n + 1)]


def test_filters_against_exact_sets(spark, docs):
    """The languages that the filter gives for each n-gram contain all that have it, and others at about the predicted rate."""
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null")
    rows = [(r["lang"], r["text"]) for r in labelled.collect()]
    filters = fit_filters(labelled, sample=10**9)
    counts = {lang: Counter(g for k, t in rows if k == lang for g in brute_grams(t)) for lang in filters.langs}
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    every = sorted(set().union(*counts.values()))
    # the hash of each n-gram, from a text that has it
    known = {}
    for _, t in rows:
        h, _, _ = gram_hashes([t])
        known.update(zip(brute_grams(t), h.tolist(), strict=True))
    masks = filters.languages(np.array([known[g] for g in every], np.uint64))
    false = np.zeros(len(filters.langs))
    for i, lang in enumerate(filters.langs):
        top = np.array([max(counts[k][g] / total[k] for k in filters.langs) for g in every])
        own = np.array([counts[lang][g] for g in every])
        member = (own > 0) & (own / total[lang] >= SHARE * top - 1e-15)
        found = filters.has(masks, i).astype(bool)
        assert found[member].all()
        false[i] = found[~member].mean()
    assert len(every) > 5000 and np.all(false < 3 * filters.false + 0.005)


def test_predictions_against_exact_sets(spark, docs):
    """What the filter predicts is what exact sets of n-grams predict, for nearly every text."""
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null")
    filters = fit_filters(labelled, sample=10**9)
    rows = [(r["lang"], r["text"]) for r in labelled.collect()]
    counts = {lang: Counter(g for k, t in rows if k == lang for g in brute_grams(t)) for lang in filters.langs}
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    sets = {lang: {g for g, n in counts[lang].items() if n / total[lang] >= SHARE * max(counts[k][g] / total[k] for k in filters.langs) - 1e-15} for lang in filters.langs}
    pred, _ = filters.predict([t for _, t in rows])
    same = 0
    for (_, t), p in zip(rows, pred, strict=True):
        grams = brute_grams(t)
        same += p == max(filters.langs, key=lambda k: sum(g in sets[k] for g in grams))
    assert same >= 0.99 * len(rows)


def test_languages_that_tie(spark):
    """Two languages with the same texts: the first by name."""
    df = spark.createDataFrame([(1, "some words here", "xb"), (2, "some words here", "xa"), (3, "andere worte", "xc")], "doc_id long, text string, lang string")
    got = [r["lang_pred"] for r in identify_language(df, fit_filters(df)).orderBy("doc_id").collect()]
    assert got == ["xa", "xa", "xc"]


def test_many_languages(spark):
    rows = [(i, f"{chr(97 + i // 26)}{chr(97 + i % 26)}q" * 5, f"l{i:02d}") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = identify_language(df, fit_filters(df)).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id']:02d}" for r in out)


def test_isotonic_and_trees():
    x = np.array([0.0, 1, 2, 3])
    assert Isotonic().fit(x, np.array([0.0, 1, 0, 1]), np.ones(4))(np.array([-5.0, 1.5, 9.0])).tolist() == [0.0, 0.5, 1.0]
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((BoostedTrees(trees=40, depth=3).fit(x, y, np.ones(800)).raw(x) > 0) == (y > 0)).mean() > 0.95


def test_toxicity(spark, make):
    rnd = random.Random(2)
    words = [f"{a}{b}" for a in "bdfgklm" for b in ("ala", "ome", "ira", "usto")]
    rows, labels = [], []
    for i in range(400):
        said = [rnd.choice(words) for _ in range(30)]
        if i % 4 == 0:
            for w in ("idiot", "grubbelig"):
                said[rnd.randrange(30)] = w
        rows.append((i, " ".join(said)))
        labels.append((i, int(i % 4 == 0)))
    docs = make(rows)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, marks.where(training_fold(5, 0)))
    out = score_toxicity(docs, model).join(marks, "doc_id").where(held_out(5, 0)).collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) > 0.95 * len(out)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and 280 <= kept.count() <= 320
    odd = score_toxicity(make(ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert score_toxicity(make([]), model).count() == 0
    lone = fit_toxicity(docs, marks.where("toxic = 0"))
    assert {r["score"] for r in score_toxicity(docs.limit(3), lone).collect()} == {0.0}


def brute_features(text, lexicon):
    """The same features, word by word."""
    words, low = re.findall(r"[^\W_]+", text.lower()), []
    for w in words:
        own = [w, *[w[:k] + "-" for k in BEGINNINGS if k <= len(w)]]
        low.append(max([0.0] + [math.log((lexicon.counts[x][0] + 0.5) / (lexicon.toxic + 1)) - math.log((lexicon.counts[x][1] + 0.5) / (lexicon.other + 1)) for x in own if x in lexicon.counts]))
    n, letters = max(len(words), 1), max(len("".join(words)), 1)
    bad, hard = [w in INSULTS for w in words], [v >= 1.5 for v in low]
    top = sorted((max(v for w, v in zip(words, low, strict=True) if w == x) for x in set(words)), reverse=True)
    top = [v for v in top if v > 0] + [0.0] * 5
    spots = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    gaps = [min(abs(i - j) for j in spots) for i in range(len(words)) if (bad[i] or hard[i]) and spots]
    capitals = sum(len(x) for x in re.findall(r"\b[A-Z]{3,}\b", text))
    masked = len(OBFUSCATED.findall(text)) + len(SPACED.findall(text))
    return [
        sum(bad) / n, len({w for w, b in zip(words, bad, strict=True) if b}), sum(low) / n, top[0], sum(top[:3]), sum(top[:5]), sum(hard) / n, len({w for w, b in zip(words, hard, strict=True) if b}), sum(hard), sum(bad),
        1 / (1 + min(gaps)) if gaps else 0.0, sum(g <= 5 for g in gaps) / n, capitals / letters, text.count("!") / n, text.count("?") / n, masked / n, len(STRETCHED.findall(text)) / n, math.log1p(len(words)),
    ]


def test_features_match_brute_force(docs):
    words = sorted({w for r in docs.select("text").collect() for w in re.findall(r"[^\W_]+", (r["text"] or "").lower())})
    rnd = random.Random(9)
    lexicon = Lexicon({**{w: (rnd.randrange(3, 30), rnd.randrange(9)) for w in rnd.sample(words, 300)}, **{w[:4] + "-": (20, 3) for w in rnd.sample(words, 50)}}, 40, 60)
    texts = [r["text"] or "" for r in docs.select("text").collect()] + ["", "!!", "You STUPID 1d10t, y o u are a f o o l!!! Sooo bad", "i d i o t you", "idiot", "x" * 100_000]
    for t in texts:
        assert features(t, lexicon) == pytest.approx(brute_features(t, lexicon), abs=1e-9)


@pytest.mark.parametrize(("said", "masked", "spaced"), [("you id1ot", 1, 0), ("a$$hole b@d", 2, 0), ("y o u r e", 0, 1), ("plain words 1234", 0, 0), ("a b c", 0, 0), ("i.d.i.o.t!", 0, 1)])
def test_obfuscation(said, masked, spaced):
    assert (len(OBFUSCATED.findall(said)), len(SPACED.findall(said))) == (masked, spaced)


def area(scores, labels):
    """The area under the curve: how often a toxic row scores above another, ties by half."""
    a, b = np.array([s for s, y in zip(scores, labels, strict=True) if y]), np.array([s for s, y in zip(scores, labels, strict=True) if not y])
    return float(((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :])).mean())


def test_toxicity_of_held_out_rows(spark):
    """The given labels at the next larger size: rows that were not learned from, for each of the five folds in turn left out."""
    sf = "/root/testdata/sf0.01"
    docs = with_checkpoints(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores, truth = [], []
    for out in (0, 2):
        model = fit_toxicity(docs, labels.where(training_fold(5, out)))
        rows = score_toxicity(docs.where(held_out(5, out)), model).join(labels.select("doc_id", "toxic"), "doc_id").collect()
        scores += [r["score"] for r in rows]
        truth += [r["toxic"] for r in rows]
    assert sum(truth) >= 10 and area(scores, truth) > 0.9


def test_drop_toxic_odd_rows(spark, make):
    rows = [(i, "you stupid idiot, you worthless scum" if i % 3 == 0 else "a fine day in the green park with friends") for i in range(200)]
    model = fit_toxicity(make(rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    odd = [*ODD, (40, rows[0][1]), (40, rows[0][1]), (41, rows[1][1]), (41, rows[1][1]), (42, rows[1][1] + " " + "word " * 200_000)]
    kept = drop_toxic(make(odd), model)
    assert kept.columns == make(odd).columns
    assert sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in kept.collect()) == sorted((i or -1, len(t or "")) for i, t in odd if i != 40)
    assert drop_toxic(make([]), model).count() == 0


ITEMS = [(1, "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion"), (2, "short item"), (3, None), (4, " "), (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen")]


def brute_distance(item, text):
    rows = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, rows[0] = rows[0], i
        for j, t in enumerate(text, 1):
            last, rows[j] = rows[j], min(last + (w != t), rows[j] + 1, rows[j - 1] + 1)
    return min(rows)


@given(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.lists(st.integers(1, 4), max_size=14))
@settings(max_examples=200, deadline=None)
def test_fitting_distance(item, text):
    d, a, b = fitting_distance(np.array(item), np.array(text, dtype=np.int64))
    assert d == brute_distance(item, text) and 0 <= a <= b <= len(text)
    if b > a:
        assert d == brute_distance(item, text[a:b])


def edited(words, edits, rnd):
    words = words[:]
    for _ in range(edits):
        at = rnd.randrange(len(words))
        kind = rnd.randrange(3)
        if kind == 0:
            words[at] = f"new{rnd.randrange(99)}"
        elif kind == 1:
            words.insert(at, f"more{rnd.randrange(99)}")
        else:
            del words[at]
    return words


def test_search_recall():
    rnd = random.Random(4)
    items = [(i, " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randrange(1, 4) for _ in range(rnd.randrange(5, 60)))) for i in range(60)]
    s = Searcher(items, 0.8)
    found = total = 0
    for _ in range(400):
        k = rnd.randrange(len(s.items))
        text = ["start"] * 20 + edited([w.decode() for w in s.items[k][1]], s.allowed[k], rnd) + ["end"] * 20
        ids = np.array([s.number.get(w.encode(), 0) for w in text])
        if fitting_distance(s.words[k], ids)[0] <= s.allowed[k]:
            total += 1
            found += k in [m[1] for m in s.search([" ".join(text)])]
    assert found >= 0.99 * total


@pytest.mark.parametrize("kinds", ["delete", "insert", "replace", "delete insert replace"])
@pytest.mark.parametrize("size", [20, 59, 60, 100, 200, 300])
def test_search_recall_by_length_and_edits(size, kinds):
    """Scattered edits at the allowed count; items of LONG words or more are always found."""
    rnd = random.Random(size)
    items = [(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(size))) for i in range(30)]
    s = Searcher(items, 0.8)
    found = 0
    for k in range(len(items)):
        words = [w.decode() for w in s.items[k][1]]
        for at in sorted(rnd.sample(range(size), s.allowed[k]), reverse=True):
            kind = rnd.choice(kinds.split())
            words[at : at + (kind != "insert")] = [] if kind == "delete" else [f"new{rnd.random()}".replace(".", "x")]
        match = [m for m in s.search([" ".join(["start"] * 20 + words + ["end"] * 20)]) if m[1] == k]
        found += bool(match) and match[0][2] <= s.allowed[k]
    assert found == len(items) if size >= 60 else found >= 0.99 * len(items)


@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), max_size=16), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_long_fitting_distance(item, text, most):
    item, text = np.array(item), np.array(text, dtype=np.int64)
    d, _, end = fitting_distance(item, text)
    got = long_fitting_distance(item, text, most)
    if d > most:
        assert got is None
    else:
        assert (got[0], got[2]) == (d, end) and fitting_distance(item, text[got[1] : got[2]])[0] == d


def test_long_items_and_texts(spark, make):
    """An item of 50,000 words with edits here and there, among many short ones, in a text of some megabytes."""
    rnd = random.Random(11)
    words = [f"w{rnd.randrange(30_000)}" for _ in range(50_000)]
    items = spark.createDataFrame([(0, " ".join(words)), *((i, " ".join(f"s{rnd.randrange(500)}" for _ in range(20))) for i in range(1, 2000))], "item_id long, text string")
    near = [f"x{i}" if i % 400 == 50 else w for i, w in enumerate(words)]
    rows = [(1, " ".join(["before"] * 3000 + near + ["after"] * 3000)), (2, "other words " * 300_000), (3, " ".join(words[:25_000]))]
    got = [(r["doc_id"], r["item_id"], r["distance"], r["start_word"], r["end_word"]) for r in find_items(make(rows), items).collect()]
    assert got == [(1, 0, 125, 3000, 53_000)]
    assert sorted(r["doc_id"] for r in drop_contaminated(make(rows), items).collect()) == [2, 3]


def test_find_items_matches_brute_force(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in find_items(docs, bench).collect()}
    s = Searcher([(r["item_id"], r["text"]) for r in bench.collect()], 0.8)
    want = set()
    for r in docs.collect():
        ids = np.array([s.number.get(w, 0) for w in words_of(r["text"])], np.int64)
        for k, (item, _) in enumerate(s.items):
            if len(ids) and np.isin(s.words[k], ids).mean() > 0.5 and fitting_distance(s.words[k], ids)[0] <= s.allowed[k]:
                want.add((r["doc_id"], item))
    assert got == want and got


def test_find_items_odd_rows(spark, make):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    near = ITEMS[0][1].replace("lazy", "sleepy").replace("strong", "bitter")
    rows = [*ODD, (20, f"x {near.upper()} y"), (21, f"x {near} y"), (21, f"x {near} y"), (22, "A short, item!"), (23, "the quick brown fox")]
    got = sorted((r["doc_id"], r["item_id"], r["distance"], r["start_word"], r["end_word"]) for r in find_items(make(rows), bench).collect())
    assert got == [(20, 1, 2, 1, 17), (21, 1, 2, 1, 17), (21, 1, 2, 1, 17), (22, 2, 0, 1, 3)]
    assert sorted(r["doc_id"] or 0 for r in drop_contaminated(make(rows), bench).collect()) == sorted((i or 0) for i, _ in [*ODD, (23, "")])
    assert find_items(make([]), bench).count() == 0 and find_items(make(rows), bench.limit(0)).count() == 0
