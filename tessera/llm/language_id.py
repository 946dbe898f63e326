"""Language identification with one bit-sliced Bloom filter for all languages.

Slot h of the filter holds a mask with one bit for each language. The and of an n-gram's slots has the bits of all
languages that contain it. The share of a text's n-grams with a language's bit, corrected for the false positives that the
fill of that language's slice predicts, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import GOLDEN, keyed, mix, steps, with_checkpoints

#: Lengths of the n-grams, in letters or single breaks between words.
GRAMS = (3, 5)
#: Slots of the filter for each n-gram of the language that has most, and how many an n-gram takes.
ROOM, HASHES = 32, 3
#: About so many labelled rows of each language are learned from; which ones depends on doc_id alone.
SAMPLE = 2000
#: An n-gram belongs to a language if it has at least this part of the highest rate that any language has for it.
SHARE = 0.2
UNDECIDED = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """The lower-case form of each code point that is a letter; 0 for the others."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(table)
    return _LETTERS[0]


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the row of each, and whether a row has a letter.

    What is not a letter is a break; runs of them count once, and each text starts and ends with one.
    """
    flat = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), sizes + 1)
    row = np.concatenate([[0], row])
    low = letters()[flat]
    low[0] = 0
    border = np.cumsum(np.concatenate([[0], sizes + 1]))
    keep = (low > 0) | np.concatenate([[True], low[:-1] > 0])
    keep[border] = True
    low, row, at_border = low[keep], row[keep], np.isin(np.flatnonzero(keep), border)
    keep = (low > 0) | at_border | np.append(~at_border[1:], True)  # the break at the end of a text is its border
    low, row, at_border = low[keep], row[keep], at_border[keep]
    has = np.zeros(len(texts), bool)
    has[row[low > 0]] = True
    part = np.cumsum(at_border)  # grams may end, but not go on, at a border
    out_h, out_r = [], []
    h1 = mix(low.astype(np.uint64) + GOLDEN)
    for n in GRAMS:
        if len(h1) < n:
            continue
        g = h1[: len(h1) - n + 1].copy()
        for j in range(1, n):
            g = g * GOLDEN + h1[j : len(h1) - n + 1 + j]
        start = np.arange(len(g))
        inside = part[start] == part[start + n - 2]
        out_h.append(mix(g[inside] + np.uint64(n)))
        out_r.append(row[start + 1][inside])
    return np.concatenate(out_h) if out_h else np.zeros(0, np.uint64), np.concatenate(out_r) if out_r else np.zeros(0, np.int64), has


def slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The slots of each hash in a filter of size slots, by double hashing."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(size)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """masks: slots x words of 64 languages; langs: their names; false: the rate of false positives that each slice's fill predicts."""

    def __init__(self, langs: list[str], masks: np.ndarray, most: int):
        # few languages take few bytes of a slot, so that more of the filter is near the processor
        narrow = next((k for k in (np.uint8, np.uint16, np.uint32) if len(langs) <= 8 * np.dtype(k).itemsize), np.uint64)
        self.langs, self.masks, self.most = langs, masks.astype(narrow), most
        fill = np.array([self.has(self.masks[:, i // 64], i).mean() for i in range(len(langs))])
        self.false = fill**HASHES

    @staticmethod
    def has(masks: np.ndarray, lang: int) -> np.ndarray:
        return masks >> masks.dtype.type(lang % 64) & masks.dtype.type(1)

    def languages(self, h: np.ndarray, word: int = 0) -> np.ndarray:
        """A mask of all languages that contain each n-gram, 64 of them from number 64 * word on."""
        first, *rest = slots(h, len(self.masks))
        found = self.masks[first, word]
        for p in rest:
            found = found & self.masks[p, word]
        return found

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        h, row, has = gram_hashes(texts)
        count = np.bincount(row, minlength=len(texts)).astype(float)
        rate = np.zeros((len(texts), len(self.langs)))
        for w in range(self.masks.shape[1]):
            found = self.languages(h, w)
            for i in range(w * 64, min(len(self.langs), w * 64 + 64)):
                seen = np.bincount(row, self.has(found, i), len(texts))
                share = seen / np.maximum(count, 1)
                rate[:, i] = np.clip((share - self.false[i]) / max(1 - self.false[i], 1e-9), 0, 1)
        if not self.langs:
            return [UNDECIDED] * len(texts), np.zeros(len(texts))
        best = rate.argmax(1)
        best[rate.max(1) == 0] = self.most
        total = rate.sum(1)
        score = np.where(total > 0, rate.max(1) / np.maximum(total, 1e-12), 0.0)
        pred = [self.langs[b] if ok else UNDECIDED for b, ok in zip(best.tolist(), has.tolist(), strict=True)]
        return pred, np.where(has, score, 0.0)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each batch by language."""
    for batch in batches:
        for part in steps(batch, size=1 << 21):
            lang = np.asarray(part.column("lang"))
            h, row, _ = gram_hashes(part.column("text").to_pylist())
            for i in np.unique(lang).tolist():
                values, n = np.unique(h[lang[row] == i], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([i] * len(values), pa.int32()), "gram": pa.array(values.view(np.int64)), "n": pa.array(n, pa.int64())})


def fit_filters(labelled: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from the rows of labelled (doc_id, text, lang), of which about sample are taken for each language.

    Rows with null lang are left out. Counting and membership are computed by the executors; the driver gets the languages
    and the filter's slots. Their number follows the n-grams of the language that has most, which the sample bounds, so that
    no slice fills up however many languages there are.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Filters([], np.zeros((1, 1), np.uint64), 0)
    spark = labelled.sparkSession
    index = spark.createDataFrame([(x, i, min(1.0, sample / sizes[x])) for i, x in enumerate(langs)], "lang string, i int, part double")
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.join(F.broadcast(index), "lang").where(draw < F.col("part")).select(F.col("i").alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counts = rows.mapInArrow(counted, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(total), "lang").select("lang", "gram", "n", (F.col("n") / F.col("total")).alias("rate"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("all"))
    member = best.select("gram", F.inline(F.filter("all", lambda x: x["rate"] >= F.col("top") * SHARE))).select("gram", "lang")
    member = with_checkpoints(spark, member).checkpoint()
    most = member.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    size = 1 << max(16, (ROOM * most - 1).bit_length())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column("gram")).view(np.uint64)
            lang = np.asarray(batch.column("lang"))
            bit = np.left_shift(np.uint64(1), (lang % 64).astype(np.uint64)).view(np.int64)
            for p in slots(h, size):
                yield pa.RecordBatch.from_pydict({"slot": pa.array(p, pa.int64()), "word": pa.array(lang // 64, pa.int32()), "mask": pa.array(bit, pa.int64())})

    filled = member.mapInArrow(placed, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((size, (len(langs) + 63) // 64), np.uint64)
    masks[filled["slot"].to_numpy(np.int64), filled["word"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    return Filters(langs, masks, max(range(len(langs)), key=lambda i: sizes[langs[i]]))


def identify_language(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, fp, lang_pred and score (0 to 1) of every row, from its whole text alone.

    lang_pred is und, with score 0, if text is null or has no letter, or if nothing was learned; it is the most frequent
    learned language, with score 0, if no n-gram is known. Languages that tie go by name, the first one wins. score is the
    winner's part of all languages' corrected rates. Repeated rows each have their own result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, size=1 << 21):
                pred, score = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fp": part.column("fp"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    return keyed(docs).mapInArrow(run, "doc_id long, fp long, lang_pred string, score double")
