"""Benchmark passages in documents, up to edits.

Item-sized windows of a document's words and the items are embedded by a random walk (CGK): at each step the walk writes
the word it stands on and, by a random bit of step and word, goes on or stays. Few edits change few steps, so embedded
windows are near in Hamming distance, and hashes of sampled steps find them. Candidates are verified by edit distance.

Within the allowed edits an item keeps some number of its runs of words whole, so only windows that so many runs of one
item point to are embedded; this leaves no match out. In long items the walks drift too far apart under many edits, so the
windows that their runs point to are all verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import GOLDEN, bytes_hash, keyed, mix, steps

WORD = re.compile(r"[^\W_]+")
#: Independent walks, hashes of each, and sampled steps in a hash. A match at the threshold is missed with a
#: probability below 0.01 in items shorter than LONG words; the tests measure it.
WALKS, HASHES, SAMPLED = 8, 24, 3
#: Items of so many words or more are not embedded; nothing of them is left to chance.
LONG = 60
#: Items of so many words or more are compared edit by edit, as the table of all places would take too long.
VERY_LONG = 1000
#: Item text that is searched for at a time; a larger benchmark is taken in blocks of about this size.
BLOCK_BYTES = 16 << 20
#: Windows that are embedded at a time.
WINDOWS = 4096


def words_of(text: str) -> list[bytes]:
    return [w.encode() for w in WORD.findall(text.lower())]


def embed(words: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """The walk's output for each row of word hashes (rows x most words); three steps for each word, 0 past its end."""
    most = words.shape[1]
    at = np.zeros(len(words), np.int64)
    out = np.zeros((len(words), 3 * most), np.uint64)
    rows = np.arange(len(words))
    for j in range(3 * most):
        here = np.where(at < sizes, words[rows, np.minimum(at, most - 1)], np.uint64(0))
        out[:, j] = here
        at += (mix(here + np.uint64((walk * 8191 + j + 1) * int(GOLDEN) % (1 << 64))) >> np.uint64(63)).astype(np.int64)
    return out


def hashes(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys of each row: one for each walk and sample of steps; rows of different size never share one."""
    rng = np.random.default_rng(97)
    out = []
    rows = np.arange(len(words))
    for walk in range(WALKS):
        e = embed(words, sizes, walk)
        for h in range(HASHES):
            where = rng.random(SAMPLED)
            key = mix(sizes.astype(np.uint64) * GOLDEN + np.uint64(walk * HASHES + h))
            for f in where.tolist():
                key = mix(key * GOLDEN + e[rows, (f * 2 * sizes).astype(np.int64)])  # a walk needs two steps a word
            out.append(key)
    return np.stack(out, 1)


def fitting_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of item to a stretch of text, and where that starts and ends; of equals the first end."""
    n = len(text)
    column = np.arange(n + 1)
    big = 1 << 20
    row = column.copy() + big * 0  # distance * big + start; row 0 costs nothing anywhere
    for i, w in enumerate(item.tolist(), 1):
        change = row[:-1] + np.where(text == w, 0, big)
        fresh = np.concatenate([[row[0] + big], np.minimum(change, row[1:] + big)])
        row = np.minimum.accumulate(fresh - column * big) + column * big  # words of text that the item lacks
        del i
    end = int(np.argmin(row // big))
    return int(row[end] // big), int(row[end] % big), end


def run_codes(words: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit value for each run of so many word numbers; equal runs have equal ones, and candidates are verified."""
    words = words.astype(np.uint64)
    code = words[: max(len(words) - run + 1, 0)].copy()
    for j in range(1, run):
        code = mix(code * GOLDEN + words[j : len(words) - run + 1 + j])
    return code


def long_fitting_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """fitting_distance() if it is at most most, in steps of one edit, each for all diagonals at once; else nothing.

    On each diagonal the farthest place in the item is kept that so many edits reach, and where that path started. How far
    two stretches agree is found by halving, from the hashes of their beginnings.
    """
    m, n = len(item), len(text)
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(m, n), GOLDEN))])

    def beginnings(x: np.ndarray) -> np.ndarray:
        # the hash of a stretch is (end - start) times a power that puts both sides at one scale
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * power[: len(x)])])

    a, b = beginnings(item), beginnings(text)

    def agree(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i in item and from j in text on are equal."""
        low, high = np.zeros(len(i), np.int64), np.minimum(m - i, n - j)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = (a[i + middle] - a[i]) * power[np.maximum(j - i, 0)] == (b[j + middle] - b[j]) * power[np.maximum(i - j, 0)]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    diagonal = np.arange(-min(most, m), n + 1)  # place in text less place in item
    least = np.maximum(0, -diagonal)
    reach = np.where(diagonal >= 0, 0, -1)  # below 0: not reached
    start = np.maximum(diagonal, 0)
    for edits in range(most + 1):
        if edits:
            bad = -(1 << 40)
            before = np.where(reach < 0, bad, reach)
            change = np.minimum(before + 1, np.minimum(m, n - diagonal))
            skip = np.append(bad, before[:-1])  # a word of text that the item lacks: from the diagonal below
            drop = np.minimum(np.append(before[1:] + 1, bad), m)
            options = np.stack([before, change, skip, drop])
            options[:, :] = np.where((options < least) | (options > np.minimum(m, n - diagonal)), bad, options)
            pick = options.argmax(0)
            starts = np.stack([start, start, np.append(0, start[:-1]), np.append(start[1:], 0)])
            reach, start = options[pick, np.arange(len(diagonal))], starts[pick, np.arange(len(diagonal))]
            reach = np.where(reach < 0, -1, reach)
        live = np.flatnonzero((reach >= 0) & (reach < m) & (reach + diagonal < n))
        live = live[item[reach[live]] == text[reach[live] + diagonal[live]]]  # most diagonals end at once
        reach[live] += agree(reach[live], reach[live] + diagonal[live])
        done = np.flatnonzero(reach == m)
        if len(done):
            end = int((diagonal[done] + m).min())
            return edits, int(start[done[0]]), end
    return None


class Searcher:
    """The items' words, runs and hashes; as large as a few times the items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        self.items = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        vocabulary = sorted({w for _, ws in self.items for w in ws})
        self.number = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.hash = np.concatenate([np.zeros(1, np.uint64), bytes_hash(vocabulary)]) if vocabulary else np.zeros(1, np.uint64)
        self.words = [np.array([self.number[w] for w in ws]) for _, ws in self.items]
        self.allowed = [int(len(w) * (1 - similarity) + 1e-9) for w in self.words]
        self.least: list[int] = []  # runs in common with any match, at least
        seeds: dict[int, list[np.ndarray]] = {}
        for k, (w, d) in enumerate(zip(self.words, self.allowed, strict=True)):
            run = next((q for q in (3, 2) if self.shared(len(w), d, q) >= 2), 1)
            self.least.append(max(self.shared(len(w), d, run), 1))
            code = run_codes(w, run)
            seeds.setdefault(run, []).append(np.stack([code.view(np.int64), np.full(len(code), k), np.arange(len(code))]))
        self.seeds = {}
        for run, rows in seeds.items():
            code, item, place = np.concatenate(rows, 1)
            order = np.argsort(code, kind="stable")
            self.seeds[run] = code[order], item[order], place[order]
        short = np.array([k for k, w in enumerate(self.words) if len(w) < LONG], np.int64)
        sizes = np.array([len(self.words[k]) for k in short], np.int64)
        padded = np.zeros((len(short), int(sizes.max(initial=1))), np.uint64)
        for r, k in enumerate(short.tolist()):
            padded[r, : sizes[r]] = self.hash[self.words[k]]
        keys = hashes(padded, sizes) if len(short) else np.zeros((0, WALKS * HASHES), np.uint64)
        flat = keys.ravel()
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner = flat[order], short[order // (WALKS * HASHES)]

    @staticmethod
    def shared(words: int, edits: int, run: int) -> int:
        """Runs of run words that words words keep whole under so many edits."""
        return words - run + 1 - run * edits

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that enough runs of one item in a text point to: start and size, and of long items item and start."""
        found = []
        for run, (codes, item, place) in self.seeds.items():
            if len(ids) < run:
                continue
            whole = ids[: len(ids) - run + 1] > 0
            for j in range(1, run):
                whole &= ids[j : len(ids) - run + 1 + j] > 0
            at = np.flatnonzero(whole)
            code = run_codes(ids, run)[at].view(np.int64)
            lo, hi = np.searchsorted(codes, code), np.searchsorted(codes, code, side="right")
            n = hi - lo
            hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([item[hit], np.repeat(at, n) - place[hit], np.repeat(at, n)]))
        if not found:
            return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
        item, start, at = np.concatenate(found, 1)
        order = np.lexsort((at, start, item))
        item, start = item[order], start[order]
        # an item's runs in one match lie on diagonals no farther apart than its edits
        most, least = np.array(self.allowed)[item], np.array(self.least)[item]
        last = np.arange(len(item)) + least - 1
        ok = last < len(item)
        ok[ok] = (item[last[ok]] == item[ok]) & (start[last[ok]] - start[ok] <= most[ok])
        mark = np.zeros(len(item) + 1, np.int64)
        np.add.at(mark, np.flatnonzero(ok), 1)
        np.add.at(mark, last[ok] + 1, -1)
        chosen = np.cumsum(mark)[:-1] > 0
        item, start = item[chosen], np.maximum(start[chosen], 0)
        size = np.array([len(w) for w in self.words])[item]
        long = size >= LONG
        return np.unique(np.stack([start, size], 1)[~long], axis=0), np.unique(np.stack([item, start], 1)[long], axis=0)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, edit distance, start word, end word) of each item's best match in each text."""
        get = self.number.get
        ids, sizes = [], []
        for t in texts:
            found = words_of(t)
            ids.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
        spots = [self.windows(x) for x in ids]
        sizes = [len(w) for w, _ in spots]
        windows = np.concatenate([w for w, _ in spots]) if spots else np.zeros((0, 2), np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()

        def verify(t: int, k: int, s: int) -> None:
            d, m = self.allowed[k], len(self.words[k])
            if (t, k) in best and best[t, k][0] == 0:
                return
            if np.array_equal(ids[t][s : s + m], self.words[k]):
                best[t, k] = (0, s, s + m)
                return
            tile = (t, k, s // max(d, 1))
            if tile in tried:
                return
            tried.add(tile)
            left = max(0, s - 2 * d)
            stretch = ids[t][left : s + m + 2 * d + 1]
            found = fitting_distance(self.words[k], stretch) if m < VERY_LONG else long_fitting_distance(self.words[k], stretch, d)
            if found is None:
                return
            distance, x, y = found
            if distance <= d and ((t, k) not in best or (distance, left + x) < best[t, k][:2]):
                best[t, k] = (distance, left + x, left + y)

        for t, (_, whole) in enumerate(spots):
            for k, s in whole.tolist():
                verify(t, k, s)
        for a in range(0, len(windows), WINDOWS):
            start, size = windows[a : a + WINDOWS].T
            row = text[a : a + WINDOWS]
            h = np.zeros((len(start), int(size.max())), np.uint64)
            for r, (t, s, n) in enumerate(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)):
                part = ids[t][s : s + n]
                # a word that no item has is told apart from the end of the window
                h[r, : len(part)] = np.where(part > 0, self.hash[part], np.uint64(7))
            keys = hashes(h, size)
            lo, hi = np.searchsorted(self.keys, keys.ravel()), np.searchsorted(self.keys, keys.ravel(), side="right")
            n = hi - lo
            hit = np.flatnonzero(n)
            window = np.repeat(hit // keys.shape[1], n[hit])
            item = self.owner[np.repeat(lo[hit], n[hit]) + np.arange(n[hit].sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])]
            for w, k in np.unique(np.stack([window, item], 1), axis=0).tolist():
                verify(int(row[w]), k, int(start[w]))
        return [(*at, *v) for at, v in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded text; equal items of one id come once."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_BYTES))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield sorted((r["item_id"], r["text"]) for r in part.collect())


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, fp, item_id, distance, start_word, end_word: the best match of each item in each row, if near enough.

    Words are runs of letters and digits, lower-cased. An item matches if its edit distance in words to some stretch of the
    text is at most 1 - similarity of its own words. Items without words, or with null id or text, match nothing; so do
    null texts. Repeated rows each have their matches; items of one id with different texts are different items. Of matches
    that tie, the first end counts, and the first start for it; of items of VERY_LONG words or more, the start is that of one
    such match.
    """
    spark = docs.sparkSession
    out = None
    for items in benchmark_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Searcher(items, similarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = shared.value
            for batch in batches:
                for part in steps(batch):
                    rows = s.search(part.column("text").to_pylist())
                    if rows:
                        at, item, distance, start, end = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": part.column("doc_id").take(pa.array(at)), "fp": part.column("fp").take(pa.array(at)), "item_id": pa.array([s.items[k][0] for k in item], pa.int64()),
                            "distance": pa.array(distance, pa.int32()), "n_item_words": pa.array([len(s.words[k]) for k in item], pa.int32()), "start_word": pa.array(start, pa.int64()), "end_word": pa.array(end, pa.int64()),
                        })

        found = keyed(docs).mapInArrow(run, "doc_id long, fp long, item_id long, distance int, n_item_words int, start_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, without the rows that find_items() finds an item in."""
    for items in benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Searcher(items, similarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch):
                    keep = np.ones(part.num_rows, bool)
                    found = shared.value.search([t or "" for t in part.column("text").to_pylist()])
                    keep[[m[0] for m in found]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
