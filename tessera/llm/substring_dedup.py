"""Removal of repeated word windows by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import (
    GOLDEN, MARKS, PACKED, by_bucket, by_buckets, bytes_hash, eights, frequent_anchors, keyed, mark_rows, mix, narrow, pack, packed_rows, put_back,
    ragged, ready_rows, shuffle_partitions, sliding_min, spans_by_row, steps, text_size, unpack, wide, with_marks,
)

#: Bytes of text for which there is a bucket.
BUCKET_BYTES = 8 << 20
#: Bytes of strings that a map task keeps because they stood more than once; beyond them it starts anew.
KEPT_BYTES = 16 << 20


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: A word of so many bytes or more is hashed by itself, and not eight bytes at a time with the others.
LONG_WORD = 1 << 12


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts and ends, in bytes."""
    blank = np.concatenate([[True], SPACES[np.frombuffer(raw, np.uint8)], [True]])
    return np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])


def single_spaced(raw: bytes) -> bytes:
    """raw with one space for each stretch of white space, so that equal words are equal bytes."""
    flat = np.frombuffer(raw, np.uint8)
    blank = SPACES[flat]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return np.where(blank, np.uint8(32), flat)[keep].tobytes()


def word_hashes(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A value for each word that is the same wherever its bytes stand; different words may share one, if rarely."""
    view = eights(np.frombuffer(raw + bytes(8), np.uint8))
    size = end - begin
    out = size.astype(np.uint64) * GOLDEN
    live, at = np.flatnonzero(size < LONG_WORD), 0
    while len(live):
        rest = np.minimum(size[live] - at, 8)
        block = view[begin[live] + at].astype(np.uint64) >> (8 * (8 - rest)).astype(np.uint64)
        out[live] = mix((out[live] ^ block) * GOLDEN + np.uint64(at + 1))
        at += 8
        live = live[size[live] > at]
    long = np.flatnonzero(size >= LONG_WORD)
    if len(long):
        out[long] = bytes_hash([raw[a:b] for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)])
    return out


def equal_bytes(flat: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size[i] bytes from a[i] and from b[i] on are equal; flat has eight bytes more than any of them needs."""
    view, same, live = eights(flat), np.ones(len(a), bool), np.arange(len(a))
    at = 0
    while len(live):
        rest = (8 * (8 - np.minimum(size[live] - at, 8))).astype(np.uint64)
        good = view[a[live] + at].astype(np.uint64) >> rest == view[b[live] + at].astype(np.uint64) >> rest
        same[live[~good]] = False
        at += 8
        live = live[good & (size[live] > at)]
    return same


def minimisers(h: np.ndarray, width: int, sub: int, frequent: np.ndarray | None) -> np.ndarray:
    """The least hash of sub consecutive words in each window, from hashes of words."""
    grams = h[: len(h) - sub + 1].copy()
    for j in range(1, sub):
        grams = grams * GOLDEN + h[j : len(h) - sub + 1 + j]
    return sliding_min(put_back(mix(grams), frequent), width - sub + 1)


def anchors_of(width: int, sub: int):
    """For common.frequent_anchors(): the minimisers of each row."""

    def of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        raw, begin, end, row = words_of(part)
        if len(begin) < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = minimisers(word_hashes(raw, begin, end), width, sub, None)
        inside = row[: len(least)] == row[width - 1 :]
        return row[: len(least)][inside], least[inside]

    return of


def words_of(part: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The single-spaced texts of a batch, where each word starts and ends in it, and the row of each word."""
    texts = [x.encode() for x in part.column("text").to_pylist()]
    raw = b"\n".join(texts)
    starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
    row = np.searchsorted(starts, word_bounds(raw)[0], side="right") - 1
    raw = single_spaced(raw)
    return raw, *word_bounds(raw), row


def super_kmers(width: int, sub: int, buckets: int, frequent: np.ndarray | None):
    """Map side: consecutive windows that share a minimiser become one packed string of their bucket.

    Of equal strings in a step, and of those that the task has sent before, only that of the smallest doc_id is sent; the
    others are marked here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, tuple[bytes, int]] = {}  # strings that stood more than once, and the smallest doc_id sent
        sent_bytes = 0
        for batch in batches:
            for part in steps(batch):
                raw, begin, end, row = words_of(part)
                ids = np.asarray(part.column("doc_id").fill_null(0))
                valid_id = np.asarray(part.column("doc_id").is_valid())
                fps = np.asarray(part.column("fp"))
                if len(begin) < width:
                    continue
                h = word_hashes(raw, begin, end)
                flat = np.frombuffer(raw + bytes(8), np.uint8)
                least = minimisers(h, width, sub, frequent)
                first = np.searchsorted(row, np.arange(part.num_rows))
                n = len(least)
                ok = (row[:n] == row[width - 1 :]) & valid_id[row[:n]]
                new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1]) | ~ok[:-1]]) & ok
                start = np.flatnonzero(new)
                if not len(start):
                    continue
                windows = np.add.reduceat(ok.astype(np.int64), start)
                length = windows + width - 1
                # equal strings of this step: the smallest doc_id stays
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + GOLDEN) * (np.uint64(2) * np.arange(len(h), dtype=np.uint64) + np.uint64(1)))])
                plain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + GOLDEN))])
                digest = (total[start + length] - total[start]) - (plain[start + length] - plain[start]) * (np.uint64(2) * start.astype(np.uint64))
                digest = mix(digest + length.astype(np.uint64) * GOLDEN)
                order = np.lexsort((start, ids[row[start]], digest))
                head = np.concatenate([[True], digest[order][1:] != digest[order][:-1]])
                leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
                other = np.flatnonzero((order != leader) & (length[order] == length[leader]))
                twin, kept = order[other], leader[other]
                low, size = begin[start], end[start + length - 1] - begin[start]
                same = size[twin] == size[kept]
                same[same] = equal_bytes(flat, low[twin[same]], low[kept[same]], size[twin[same]])
                twin, kept = twin[same], kept[same]
                later = ids[row[start[twin]]] > ids[row[start[kept]]]
                again = np.unique(kept)
                twin = twin[later]
                stay = np.ones(len(start), bool)
                stay[twin] = False
                # strings that the task has sent: all of a greater doc_id go, and those of the same one need not be sent again
                known = np.fromiter(sent, np.uint64, len(sent))
                old = np.flatnonzero(stay & np.isin(digest, known)) if len(known) else []
                for i in old:
                    text, least_doc = sent[int(digest[i])]
                    if text == raw[begin[start[i]] : end[start[i] + length[i] - 1]] and least_doc <= ids[row[start[i]]]:
                        stay[i] = False
                        if least_doc < ids[row[start[i]]]:
                            twin = np.append(twin, i)
                for i in again.tolist():
                    if stay[i]:
                        text = raw[begin[start[i]] : end[start[i] + length[i] - 1]]
                        sent_bytes += len(text) if int(digest[i]) not in sent else 0
                        sent[int(digest[i])] = (text, int(ids[row[start[i]]]))
                if sent_bytes > KEPT_BYTES:
                    sent, sent_bytes = {}, 0
                if len(twin):
                    at = start[twin] - first[row[start[twin]]]
                    yield ready_rows(ids[row[start[twin]]], fps[row[start[twin]]], at, at + length[twin], buckets)
                start, length = start[stay], length[stay]
                bucket = (mix(least[start] + GOLDEN) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                start, length, bucket = start[order], length[order], bucket[order]
                cut = np.flatnonzero(np.diff(bucket)) + 1
                out_b, out_p = [], []
                for a, b in zip([0, *cut.tolist()] if len(bucket) else [], [*cut.tolist(), len(bucket)], strict=False):
                    s, m = start[a:b], length[a:b]
                    strings = [raw[x:y] for x, y in zip(begin[s].tolist(), end[s + m - 1].tolist(), strict=True)]
                    docs, doc = np.unique(row[s], return_inverse=True)
                    out_b.append(int(bucket[a]))
                    out_p.append(pack(b"\n".join(strings), narrow(m), ids[docs].astype(np.int64), fps[docs].astype(np.int64), narrow(doc), narrow(s - first[row[s]])))
                if out_b:
                    yield packed_rows(out_b, out_p)

    return run


def count_windows(width: int):
    """Bucket side: sorts a bucket's windows, compares neighbours byte by byte and marks all but the smallest doc_id's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ready, payloads in by_buckets(batches):
            if ready is not None:
                yield ready
                continue
            texts, cols, done = [], [[] for _ in range(7)], 0
            while payloads:
                words, length, ids, fps, doc, at = unpack(payloads.pop())
                words, doc = bytes(words) + b"\n", wide(doc)
                begin, end = word_bounds(words)
                kind = np.int32 if done < 1 << 30 else np.int64
                for c, x in zip(cols, (word_hashes(words, begin, end), (begin + done).astype(kind), (end + done).astype(kind), wide(length), np.frombuffer(ids, np.int64)[doc], np.frombuffer(fps, np.int64)[doc], wide(at)), strict=True):
                    c.append(x)
                texts.append(words)
                done += len(words)
            h, begin, end, length, ids, fps, at = map(np.concatenate, cols)
            flat = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
            del cols, texts
            first = np.cumsum(length) - length
            windows = length - width + 1
            pos = ragged(first, windows)
            run_of = np.repeat(np.arange(len(length), dtype=np.int32), windows)
            key = h[pos]
            for j in range(1, width):
                key *= GOLDEN
                key += h[pos + j]
            del h
            order = np.argsort(key)
            twin = key[order][1:] == key[order][:-1]
            near = np.zeros(len(order), bool)
            near[1:] |= twin
            near[:-1] |= twin
            order = order[near]
            if not len(order):
                continue
            low = begin[pos[order]].astype(np.int64)
            size = end[pos[order] + width - 1] - low

            def neighbours(order, low, size, key=key, flat=flat):
                exact = (key[order][1:] == key[order][:-1]) & (size[1:] == size[:-1])
                exact[exact] = equal_bytes(flat, low[1:][exact], low[:-1][exact], size[1:][exact])
                return exact

            exact = neighbours(order, low, size)
            if ((key[order][1:] == key[order][:-1]) & ~exact).any():  # different windows with one hash: sorted by their bytes
                by = sorted(range(len(order)), key=lambda i: (int(key[order[i]]), flat[low[i] : low[i] + size[i]].tobytes()))
                order, low, size = order[by], low[by], size[by]
                exact = neighbours(order, low, size)
            group = np.concatenate([[0], np.cumsum(~exact)])
            doc = ids[run_of[order]]
            low = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, group, doc)
            hit = order[doc > low[group]]
            if len(hit):
                r = run_of[hit]
                s = at[r] + pos[hit] - first[r]
                yield mark_rows(ids[r], fps[r], s, s + width)

    return run


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch):
            n, gone, kept = [], [], []
            for text, (starts, ends) in zip(part.column("text").to_pylist(), spans_by_row(part.column("spans")), strict=True):
                words = text.encode().split()
                n.append(len(words))
                left, at = [], 0
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    left += words[at:s]
                    at = e
                left += words[at:]
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.string())})


def repeated_windows(docs: DataFrame, width: int = 13, sub: int = 3, buckets: int | None = None) -> DataFrame:
    """doc_id, fp, spans of the words that a window covers which also starts in a document with a smaller doc_id."""
    n = shuffle_partitions(docs.sparkSession)
    size, rows = text_size(docs)
    frequent = frequent_anchors(docs, anchors_of(width, sub), size, rows)
    packed = keyed(docs).mapInArrow(super_kmers(width, sub, buckets or n * max(1, round(size / n / BUCKET_BYTES)), frequent), PACKED)
    return by_bucket(packed, n).mapInArrow(count_windows(width), MARKS)


def substring_dedup(docs: DataFrame, width: int = 13, sub: int = 3, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row.

    A word goes if a window of width words covers it whose words also start in a row with a smaller doc_id. A null text
    is empty. A row without doc_id neither loses words nor makes others lose them. Rows with one doc_id do not count
    against each other. buckets is the number of minimiser buckets, which follows the bytes of text; one bucket's strings
    are in memory at a time.
    """
    return with_marks(keyed(docs), repeated_windows(docs, width, sub, buckets)).mapInArrow(removed, "doc_id long, n_words long, n_removed long, kept_text string")
