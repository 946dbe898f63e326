"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.boosting import BoostedTrees, Isotonic
from tessera.llm.common import keyed, steps, with_checkpoints

# Common insults of the languages served, and words that address someone.
INSULTS = frozenset(
    "idiot idiots stupid moron morons dumb loser losers scum trash garbage pathetic disgusting worthless clown fool ugly"
    " hate kill die shut vermin filth pig rat liar coward imbecile retarded freak creep"
    " imbécile crétin connard salaud débile ordure minable pourri abruti nul"
    " dumm dummkopf trottel arschloch abschaum ekelhaft widerlich versager schwein dreck"
    " estúpido idiota imbécil basura asqueroso patético inútil tonto payaso escoria".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton vous votre du dich dir dein ihr euch usted ustedes tú ti vosotros".split())
WORD = re.compile(r"[^\W_]+")
OBFUSCATED = re.compile(r"(?<![^\W\d_])[^\W\d_]+[*@$!0134][*@$!0134\w]*[^\W\d_]")
SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-*][^\W\d_]){3,}(?!\w)")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
CAPITALS = re.compile(r"\b[A-Z]{3,}\b")

#: Labelled rows that are learned from, about so many of each label; which ones depends on doc_id and text alone.
SAMPLE = 6000
#: Learned lexicon: an item stands in so many toxic rows of the sample, and in such a part of them, and is so much likelier
#: there (logarithm of the ratio). Beside whole words their beginnings of so many letters count.
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS = 5, 0.005, 1.0
BEGINNINGS = range(3, 9)
#: Words whose lexicon value a worker keeps.
KEPT_WORDS = 300_000


def items_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen."""
    return [word, *[word[:n] + "-" for n in BEGINNINGS if n <= len(word)]]


class Lexicon:
    """counts: item -> toxic and other rows that contain it."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, other: int):
        self.counts, self.toxic, self.other = counts, toxic, other
        self.known: dict[str, float] = {}

    def odds(self, a: int, b: int, own: int | None = None) -> float:
        """Logarithm of how much likelier toxic rows are to contain an item; own is the label of a row to leave out."""
        a, b = a - (own == 1), b - (own == 0)
        return float(np.log((a + 0.5) / (self.toxic + 1.0)) - np.log((b + 0.5) / (self.other + 1.0)))

    def value(self, word: str, own: int | None) -> float:
        if own is None:
            value = self.known.get(word)
            if value is not None:
                return value
        value = max((self.odds(*self.counts[i], own) for i in items_of(word) if i in self.counts), default=0.0)
        value = max(value, 0.0)
        if own is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = value
        return value


FEATURES = 18


def features(text: str, lexicon: Lexicon, own: int | None = None) -> list[float]:
    """Lexicon densities, second-person proximity, capitals, punctuation and obfuscation rates of a whole text."""
    words = WORD.findall(text.lower())
    n = max(len(words), 1)
    letters = max(sum(map(len, words)), 1)
    kinds = set(words)
    worth = {w: v for w in kinds if (v := lexicon.value(w, own)) > 0}
    values = [worth[w] for w in words if w in worth] if worth else []
    harsh = {w for w, v in worth.items() if v >= 1.5}
    bad, you = kinds & INSULTS, kinds & SECOND_PERSON
    fixed = [i for i, w in enumerate(words) if w in bad] if bad else []
    strong = [i for i, w in enumerate(words) if w in harsh] if harsh else []
    best = sorted(worth.values(), reverse=True)[:5] + [0.0] * 5
    address = [i for i, w in enumerate(words) if w in you] if you else []
    near, close = np.inf, 0
    if address:
        for i in sorted({*fixed, *strong}):
            k = bisect_left(address, i)
            d = min(abs(i - j) for j in address[max(k - 1, 0) : k + 1])
            near, close = min(near, d), close + (d <= 5)
    capitals = sum(map(len, CAPITALS.findall(text)))
    return [
        len(fixed) / n, float(len(bad)), sum(values) / n, best[0], sum(best[:3]), sum(best[:5]),
        len(strong) / n, float(len(harsh)), float(len(strong)), float(len(fixed)),
        0.0 if near == np.inf else 1 / (1 + near), close / n,
        capitals / letters, text.count("!") / n, text.count("?") / n,
        (len(OBFUSCATED.findall(text)) + len(SPACED.findall(text))) / n, len(STRETCHED.findall(text)) / n, float(np.log1p(len(words))),
    ]


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, trees: BoostedTrees | None, calibrate: Isotonic | None, rate: float):
        self.lexicon, self.trees, self.calibrate, self.rate = lexicon, trees, calibrate, rate

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), FEATURES)
        return np.clip(self.calibrate(self.trees.raw(x)), 0.0, 1.0)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each item, by label, of each batch; the empty item stands in every row."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({"", *(i for w in set(WORD.findall(text.lower())) for i in items_of(w))})
        for toxic in (0, 1):
            yield pa.RecordBatch.from_pydict({"item": pa.array(list(counts[toxic]), pa.string()), "toxic": pa.array([toxic] * len(counts[toxic]), pa.int32()), "n": pa.array(list(counts[toxic].values()), pa.int64())})


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """A model from labels (doc_id, toxic 0 or 1) of docs, of which about sample are taken for each label.

    Labels are drawn by doc_id before they meet the documents, so at most some 2 * sample of them are broadcast. A document
    with several labels counts as toxic if one is; rows with another or null label or doc_id are left out. A training row's
    own label does not count in its lexicon features. A quarter of the sample calibrates; the rest grows the trees. Without
    documents of both labels every score is the rate of label 1 among the labels.
    """
    spark = docs.sparkSession
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if len(sizes) < 2 or min(sizes.values()) < 4:
        return ToxicityModel(Lexicon({}, 0, 0), None, None, rate)
    part = {k: min(1.0, sample / n) for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = marks.where(draw < F.when(F.col("toxic") == 1, part[1]).otherwise(part[0]))
    taken = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    by_label = lambda k: F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0))
    counts = taken.mapInArrow(counted, "item string, toxic int, n long").groupBy("item").agg(by_label(1).alias("a"), by_label(0).alias("b"))
    counts = with_checkpoints(spark, counts.where(F.col("a") >= LEAST_ROWS)).checkpoint()
    rows = counts.where("item = ''").first()
    toxic, other = (rows["a"], rows["b"]) if rows else (0, 0)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (other + 1.0))
    # bounded by the sample
    found = counts.where((F.col("item") != "") & (F.col("a") >= LEAST_SHARE * toxic) & (odds >= LEAST_ODDS)).collect()
    lexicon = Lexicon({r["item"]: (r["a"], r["b"]) for r in found}, toxic, other)
    shared = spark.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, shared.value, own) for t, own in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "toxic": batch.column("toxic"), "fold": batch.column("fold")})

    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id", "text"), F.lit(4)).cast("int").alias("fold")
    data = taken.select("text", "toxic", fold).mapInArrow(measured, "x array<double>, toxic int, fold int").toPandas()
    x, y, held = np.array(data["x"].tolist()).reshape(len(data), FEATURES), data["toxic"].to_numpy(float), data["fold"].to_numpy() == 0
    if len(set(y)) < 2:  # labels, but no documents of both kinds
        return ToxicityModel(Lexicon({}, 0, 0), None, None, rate)
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    # rows of different parts count as many as they stand for; sorted, as the order of rows must not matter
    order = np.lexsort((*x.T, y, held))
    x, y, held = x[order], y[order], held[order]
    weight = np.where(y == 1, 1 / part[1], 1 / part[0])
    weight /= weight.mean()
    trees = BoostedTrees().fit(x[~held], y[~held], weight[~held])
    fit_on = held if held.any() else ~held
    return ToxicityModel(lexicon, trees, Isotonic().fit(trees.raw(x[fit_on]), y[fit_on], weight[fit_on]), rate)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, fp, score (0 to 1) and predicted (1 if score is 0.5 or more) of every row, from its whole text alone.

    A null text is empty and is scored as such.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                score = shared.value.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fp": part.column("fp"), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return keyed(docs).mapInArrow(run, "doc_id long, fp long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs, all columns, without the rows that the model predicts as toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                yield part.filter(pa.array(shared.value.score([t or "" for t in part.column("text").to_pylist()]) < 0.5))

    return docs.mapInArrow(run, docs.schema)
