"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import (
    GOLDEN, MARKS, PACKED, by_bucket, by_buckets, eights, equal_runs, frequent_anchors, keyed, mark_rows, mix, narrow, pack, packed_rows, put_back, ragged,
    ready_rows, shuffle_partitions, sliding_min, spans_by_row, steps, text_size, unpack, wide, with_marks,
)


def difference_cover(period: int) -> np.ndarray:
    """Residues such that every difference modulo period is one of two of them; chosen greedily."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda x: len(missing & ({(x - y) % period for y in cover} | {(y - x) % period for y in cover}))
        best = max((x for x in range(period) if x not in cover), key=gain)
        missing -= {(best - y) % period for y in cover} | {(y - best) % period for y in cover}
        cover.append(best)
    return np.array(sorted(cover))


class Cover:
    """shift[r]: for positions whose difference is r modulo period, how far behind the first's multiple both are in the cover."""

    def __init__(self, period: int):
        self.period, self.residues = period, difference_cover(period)
        self.member = np.zeros(period, bool)
        self.member[self.residues] = True
        self.base = np.zeros(period, np.int64)
        for r in range(period):  # base b in the cover with b + r in the cover too
            self.base[r] = next(b for b in self.residues.tolist() if self.member[(b + r) % period])

    def shift(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Steps below the period after which i and j are both sampled."""
        return (self.base[(j - i) % self.period] - i) % self.period


def key_at(view: np.ndarray, pos: np.ndarray, at: int, depth: int) -> np.ndarray:
    """The eight bytes that stand at behind each position, those beyond depth left out."""
    key = view[pos + at].astype(np.uint64)
    return key >> np.uint64(8 * (8 - depth + at)) if depth - at < 8 else key


def refine(view: np.ndarray, pos: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """pos sorted by the first depth bytes, and the number of each group of equal ones; only ties are sorted on."""
    key = key_at(view, pos, 0, depth)
    order = np.argsort(key)
    pos, key = pos[order], key[order]
    new = np.ones(len(pos), bool)
    new[1:] = key[1:] != key[:-1]
    at = 8
    while at < depth:
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        group = np.cumsum(new[tied], dtype=np.uint64)
        # group and as many of the next bytes as have room make one number to sort by
        room = (64 - int(group[-1]).bit_length()) // 8
        p = pos[tied]
        key = (group << np.uint64(8 * room)) | key_at(view, p, at, depth) >> np.uint64(8 * max(0, min(8, depth - at) - room))
        order = np.argsort(key)
        pos[tied], key = p[order], key[order]
        new[tied[1:]] = key[1:] != key[:-1]
        at += room
    return pos, np.cumsum(new) - 1


def compared(view: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """-1, 0 or 1 as the first depth bytes at a are less than, equal to or greater than those at b."""
    out, live = np.zeros(len(a), np.int8), np.arange(len(a))
    for at in range(0, depth, 8):
        x, y = key_at(view, a[live], at, depth), key_at(view, b[live], at, depth)
        differ = x != y
        out[live[differ]] = np.where(x[differ] < y[differ], -1, 1)
        live = live[~differ]
        if not len(live):
            break
    return out


def part_of(view: np.ndarray, pos: np.ndarray, splitters: np.ndarray, depth: int) -> np.ndarray:
    """How many of the sorted splitters are not greater than each suffix, by the first depth bytes."""
    key, keys = key_at(view, pos, 0, depth), key_at(view, splitters, 0, depth)
    low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) // 2
        less = compared(view, pos[live], splitters[middle], depth) < 0
        high[live[less]], low[live[~less]] = middle[less], middle[~less] + 1
        live = live[low[live] < high[live]]
    return low


#: Positions that are drawn for each block; one of so many becomes a splitter.
DRAWN = 16


def blocks(view: np.ndarray, pos: np.ndarray, depth: int, block: int) -> Iterator[np.ndarray]:
    """pos in blocks of about block suffixes each, all of one block before those of the next by their first depth bytes.

    The blocks are cut at splitters drawn from pos. Suffixes equal in depth bytes share a block.
    """
    if len(pos) <= block:
        yield pos
        return
    drawn, group = refine(view, pos[:: max(1, block // DRAWN)], depth)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    splitters = drawn[first[np.searchsorted(first, np.arange(DRAWN // 2, len(drawn), DRAWN), side="right") - 1]]
    splitters = splitters[np.flatnonzero(np.diff(splitters, prepend=-1))]
    kind = np.uint16 if len(splitters) < 1 << 16 else np.uint32
    part = np.concatenate([part_of(view, pos[a : a + block], splitters, depth).astype(kind) for a in range(0, len(pos), block)])
    for b in range(len(splitters) + 1):
        mine = pos[part == b]
        if len(mine):
            yield mine


class SampleRanks:
    """Ranks, by their first depth bytes, of the positions below limit that the cover samples; no others take room."""

    def __init__(self, view: np.ndarray, limit: int, cover: Cover, depth: int, block: int):
        self.period, self.many = cover.period, len(cover.residues)
        self.column = np.zeros(cover.period, np.int64)
        self.column[cover.residues] = np.arange(self.many)
        self.rank = np.zeros((limit // cover.period + 2) * self.many, np.int32)
        sample = (np.arange(0, limit, cover.period)[:, None] + cover.residues).ravel()
        before = 0
        for piece in blocks(view, sample[sample < limit], depth, block):
            piece, group = refine(view, piece, depth)
            self.rank[self.index(piece)] = group + before
            before += int(group[-1]) + 1

    def index(self, pos: np.ndarray) -> np.ndarray:
        return pos // self.period * self.many + self.column[pos % self.period]

    def at(self, pos: np.ndarray) -> np.ndarray:
        return self.rank[self.index(pos)]


def sort_block(view: np.ndarray, pos: np.ndarray, ranks: SampleRanks, cover: Cover) -> np.ndarray:
    """The suffixes of one block in order: by period bytes, then by the cover ranks that both sides of a tie reach.

    Ties are three-way partitioned around a pivot of each group, all groups at once.
    """
    pos, group = refine(view, pos, cover.period)
    new = np.diff(group, prepend=-1) != 0
    live = np.flatnonzero(~new | np.append(~new[1:], False))  # suffixes of groups of two or more
    new = new[live]
    while len(live):
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        p = pos[live]
        pivot = p[start + np.diff(start, append=len(live)) // 2][group]
        d = cover.shift(p, pivot)
        side = np.sign(ranks.at(p + d) - ranks.at(pivot + d))
        key = group * 3 + side
        order = np.argsort(key, kind="stable")
        pos[live], key, side = p[order], key[order], side[order]
        new = np.diff(key, prepend=-2) != 0
        # the middle part is settled, and so is what stands alone
        keep = (side != 0) & ~(new & np.append(new[1:], True))
        live, new = live[keep], new[keep]
    return pos


def blockwise(text: np.ndarray, pos: np.ndarray, depth: int, period: int, block: int) -> Iterator[np.ndarray]:
    """Suffixes pos in order of their first depth bytes, one block after the other.

    text ends with depth + 2 * period + 8 bytes more than the last position needs. Besides text and pos, two bytes a
    suffix and the ranks of the cover sample are in memory, and what sorting one block takes.
    """
    if not len(pos):
        return
    cover, view = Cover(period), eights(text)
    ranks = SampleRanks(view, int(pos.max()) + period + 1, cover, depth, block)
    for piece in blocks(view, pos, depth, block):
        yield sort_block(view, piece, ranks, cover)


class Strings:
    """Different strings, one after the other in flat, and the owners of each: the places (doc, fp, at) where it stands.

    of is the string of each owner; owners are sorted by string, doc, fp and place, each once.
    """

    def __init__(self, flat: np.ndarray, size: np.ndarray, of: np.ndarray, doc: np.ndarray, fp: np.ndarray, at: np.ndarray):
        self.flat, self.size = flat, size
        self.first = np.cumsum(size) - size
        order = np.lexsort((at, fp, doc, of))
        of, doc, fp, at = of[order], doc[order], fp[order], at[order]
        row = (of[1:] == of[:-1]) & (doc[1:] == doc[:-1]) & (fp[1:] == fp[:-1])
        fresh = np.concatenate([[True], ~(row & (at[1:] == at[:-1]))]) if len(of) else np.zeros(0, bool)
        self.of, self.doc, self.fp, self.at = of[fresh], doc[fresh], fp[fresh], at[fresh]
        # a leader is the first place of its row, in the least document; whatever leads is all that other strings need to know
        new = np.concatenate([[True], self.of[1:] != self.of[:-1]]) if len(self.of) else np.zeros(0, bool)
        least = self.doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else self.doc
        same_row = np.concatenate([[False], ~new[1:] & (self.doc[1:] == self.doc[:-1]) & (self.fp[1:] == self.fp[:-1])]) if len(new) else new
        self.leads = (self.doc == least) & ~same_row

    def repeats(self, length: int, period: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """doc, fp, start and end of the bytes that a length-byte string covers which also stands earlier.

        Everything found comes from neighbours in the sorted order of all length-byte strings. Owners that do not lead
        lose each of them, as the leader stands earlier; leaders lose those that a group of equal ones has earlier.
        """
        text = np.concatenate([self.flat, np.zeros(length + 2 * period + 8, np.uint8)])
        view = eights(text)
        pos = ragged(self.first, self.size - length + 1).astype(np.int32 if len(text) < 1 << 31 else np.int64)
        many = np.bincount(self.of, minlength=len(self.size))
        leader = np.flatnonzero(self.leads)
        leaders = np.bincount(self.of[leader], minlength=len(self.size))
        leader_at = np.cumsum(leaders) - leaders
        followed = np.repeat(many > leaders, self.size)
        sorted_too = np.zeros(len(text), bool)  # places of strings with owners that do not lead, as the sort meets them
        out: list[tuple[np.ndarray, ...]] = []
        for order in blockwise(text, pos, length, period, block):
            same = compared(view, order[:-1], order[1:], length) == 0
            near = np.zeros(len(order), bool)
            near[1:] |= same
            near[:-1] |= same
            sorted_too[order[followed[order]]] = True
            p = order[near]
            if not len(p):
                continue
            r = np.searchsorted(self.first, p, side="right") - 1
            group = np.cumsum(~np.concatenate([[False], same]))[near]
            n = leaders[r]
            who = leader[ragged(leader_at[r], n)]
            group, where = np.repeat(group, n), np.repeat(p - self.first[r], n) + self.at[who]
            doc, fp = self.doc[who], self.fp[who]
            rank = np.lexsort((where, fp, doc, group))
            group, doc, fp, where = group[rank], doc[rank], fp[rank], where[rank]
            head = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))
            mine = np.maximum.accumulate(np.where(np.concatenate([[True], (group[1:] != group[:-1]) | (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])]), np.arange(len(group)), 0))
            # a smaller doc_id, or the same row at an earlier place
            hit = (doc > doc[head]) | (where > where[mine])
            out.append((doc[hit], fp[hit], where[hit], where[hit] + length))
        met = np.flatnonzero(sorted_too)
        if len(met):
            run = np.searchsorted(self.first, met, side="right") - 1
            new = np.concatenate([[True], (met[1:] != met[:-1] + 1) | (run[1:] != run[:-1])])
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(met)) - 1
            run, low, high = run[a], met[a] - self.first[run[a]], met[b] - self.first[run[a]] + length
            others = np.flatnonzero(~self.leads)
            n = np.bincount(self.of[others], minlength=len(self.size))
            who = others[ragged((np.cumsum(n) - n)[run], n[run])]
            out.append((self.doc[who], self.fp[who], self.at[who] + np.repeat(low, n[run]), self.at[who] + np.repeat(high, n[run])))
        none = np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (none, none, none, none)


def classes(flat: np.ndarray, start: np.ndarray, size: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """For each string the first that equals it; strings of one digest that differ are told apart byte by byte."""
    order = np.argsort(digest, kind="stable")
    head = np.concatenate([[True], digest[order][1:] != digest[order][:-1]])
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    other = np.flatnonzero(leader != np.arange(len(leader)))
    same = size[other] == size[leader[other]]
    same[same] = equal_runs(flat, start[other[same]], start[leader[other[same]]], size[other[same]])
    leader[other[~same]] = other[~same]
    return leader


#: Bytes of strings that a map task keeps because they stood more than once; beyond them it starts anew.
KEPT_BYTES = 16 << 20


class Kept:
    """Strings that a task has met more than once and sent, each with the owner it sent, so that it need not send them again."""

    def __init__(self):
        self.known: dict[int, tuple[bytes, int, int, int]] = {}
        self.bytes = 0
        self.digests = np.zeros(0, np.uint64)

    def found(self, digest: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.digests, digest)
        return np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digest) if len(self.digests) else np.zeros(0, np.int64)

    def add(self, rows: list[tuple[int, bytes, int, int, int]]) -> None:
        for digest, raw, doc, fp, at in rows:
            if digest not in self.known:
                self.bytes += len(raw)
            self.known[digest] = (raw, doc, fp, at)
        if self.bytes > KEPT_BYTES:
            self.known, self.bytes = {}, 0
        if rows:
            self.digests = np.sort(np.fromiter(self.known, np.uint64, len(self.known)))


def minimisers(flat: np.ndarray, length: int, anchor: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all anchors, a power of two of bytes each, and the least hash in each string of length bytes."""
    h, span, power = flat.astype(np.uint64) * GOLDEN + np.uint64(0x7F4A7C15), 1, GOLDEN
    while span < anchor:
        h = h[:-span] * power + h[span:]
        power, span = np.uint64(int(power) * int(power) % (1 << 64)), span * 2
    h = put_back(mix(h), frequent)
    return h, sliding_min(h, length - anchor + 1)


def anchors_of(length: int, anchor: int):
    """For common.frequent_anchors(): the minimisers of each row."""

    def of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        raw = [x.encode() for x in part.column("text").to_pylist()]
        flat, sizes = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        if len(flat) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        least = minimisers(flat, length, anchor, None)[1]
        inside = row[: len(least)] == row[length - 1 :]
        return row[: len(least)][inside], least[inside]

    return of


def byte_runs(length: int, anchor: int, period: int, block: int, buckets: int, frequent: np.ndarray | None):
    """Map side: consecutive length-byte strings that share a minimiser of anchor bytes travel as one packed string.

    Packed strings that stand more than once in a step, or in an earlier step of the task, are sorted here as in a bucket:
    that marks all but their leaders, and leaders alone are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept()
        for batch in batches:
            for part in steps(batch):
                raw = [x.encode() for x in part.column("text").to_pylist()]
                sizes = np.fromiter(map(len, raw), np.int64, len(raw))
                flat = np.frombuffer(b"".join(raw), np.uint8)
                ids = np.asarray(part.column("doc_id").fill_null(0))
                valid_id = np.asarray(part.column("doc_id").is_valid())
                fps = np.asarray(part.column("fp"))
                if len(flat) < length:
                    continue
                h, least = minimisers(flat, length, anchor, frequent)
                width = length - anchor + 1
                row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                first = np.cumsum(sizes) - sizes
                n = len(least)
                ok = (row[:n] == row[length - 1 :]) & valid_id[row[:n]]
                new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1]) | ~ok[:-1]]) & ok
                start = np.flatnonzero(new)
                if not len(start):
                    continue
                windows = np.add.reduceat(ok.astype(np.int64), start)
                size = windows + length - 1
                # a string can repeat within its run only if the minimiser stands there twice
                top = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
                chosen = np.flatnonzero(h == ~sliding_min(~top, width)[: len(h)])
                again = np.zeros(len(h) + 1, np.int32)
                again[chosen[:-1][h[chosen][1:] == h[chosen][:-1]] + 1] = 1
                again = np.cumsum(again)
                twice = again[start + size - anchor + 1] > again[start]
                least = least[start]
                del top, chosen, again, h, windows
                view = eights(flat)
                digest = mix(least + size.astype(np.uint64) * GOLDEN) ^ view[start].astype(np.uint64) ^ mix(view[start + size - 8].astype(np.uint64))
                leader = classes(flat, start, size, digest)
                rows = row[start]
                doc, fp, at = ids[rows], fps[rows], start - first[rows]
                stay = np.ones(len(start), bool)
                # what stands more than once here, or did before in this task
                alone = np.bincount(leader, minlength=len(leader)) == 1
                heads = np.flatnonzero(leader == np.arange(len(leader)))
                known = heads[kept.found(digest[heads])]
                old = [(i, *kept.known[int(digest[i])][1:]) for i in known.tolist() if kept.known[int(digest[i])][0] == flat[start[i] : start[i] + size[i]].tobytes()]
                again = ~alone[leader]
                if old:
                    again |= np.isin(leader, [x[0] for x in old])
                mine = np.flatnonzero(again)
                if len(mine):
                    head, of = np.unique(leader[mine], return_inverse=True)
                    extra = [np.array(c, k) for c, k in zip(zip(*old, strict=True), (np.int64,) * 4, strict=True)] if old else [np.zeros(0, np.int64)] * 4
                    strings = Strings(
                        flat[ragged(start[head], size[head])], size[head], np.concatenate([of, np.searchsorted(head, extra[0])]),
                        np.concatenate([doc[mine], extra[1]]), np.concatenate([fp[mine], extra[2]]), np.concatenate([at[mine], extra[3]]),
                    )
                    marks = strings.repeats(length, period, block)
                    if len(marks[0]):
                        yield ready_rows(*marks, buckets)
                    lead = np.flatnonzero(strings.leads)
                    names = set(zip(strings.of[lead].tolist(), strings.doc[lead].tolist(), strings.fp[lead].tolist(), strings.at[lead].tolist(), strict=True))
                    sent = {(int(np.searchsorted(head, x[0])), *x[1:]) for x in old}
                    stay[mine] = [x in names and x not in sent for x in zip(of.tolist(), doc[mine].tolist(), fp[mine].tolist(), at[mine].tolist(), strict=True)]
                    raws = {k: flat[start[i] : start[i] + size[i]].tobytes() for k, i in enumerate(head.tolist())}
                    kept.add([(int(digest[head[k]]), raws[k], d, f, a) for k, d, f, a in names])
                start, size, twice, least, rows, at = start[stay], size[stay], twice[stay], least[stay], rows[stay], at[stay]
                scrambled = mix(least + GOLDEN)
                bucket = (scrambled % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                start, size, bucket, twice, rows, at, tag = start[order], size[order], bucket[order], twice[order], rows[order], at[order], (scrambled[order] >> np.uint64(32)).astype(np.uint32)
                cut = np.flatnonzero(np.diff(bucket)) + 1
                out_b, out_p = [], []
                for a, b in zip([0, *cut.tolist()] if len(bucket) else [], [*cut.tolist(), len(bucket)], strict=False):
                    s, m = start[a:b], size[a:b]
                    docs, which = np.unique(rows[a:b], return_inverse=True)
                    out_b.append(int(bucket[a]))
                    out_p.append(pack(flat[ragged(s, m)], narrow(m), tag[a:b], ids[docs].astype(np.int64), fps[docs].astype(np.int64), narrow(which), narrow(at[a:b]), twice[a:b]))
                if out_b:
                    yield packed_rows(out_b, out_p)

    return run


def sort_suffixes(length: int, period: int, block: int):
    """Bucket side. Strings whose minimiser no other has cannot repeat; the rest is suffix-sorted, equal strings once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ready, payloads in by_buckets(batches):
            if ready is not None:
                yield ready
                continue
            blobs = [unpack(x) for x in payloads]
            tags = np.concatenate([np.frombuffer(b[2], np.uint32) for b in blobs])
            _, back, many = np.unique(tags, return_inverse=True, return_counts=True)
            keep = (many[back] > 1) | np.concatenate([np.frombuffer(b[7], bool) for b in blobs])
            if not keep.any():
                continue
            ids, fps, at, texts, sizes, done = [], [], [], [], [], 0
            for k, b in enumerate(blobs):
                m = wide(b[1])
                mine = np.flatnonzero(keep[done : done + len(m)])
                done += len(m)
                if len(mine):
                    doc = wide(b[5])[mine]
                    ids.append(np.frombuffer(b[3], np.int64)[doc])
                    fps.append(np.frombuffer(b[4], np.int64)[doc])
                    at.append(wide(b[6])[mine])
                    sizes.append(m[mine])
                    texts.append(np.frombuffer(b[0], np.uint8)[ragged((np.cumsum(m) - m)[mine], m[mine])])
                blobs[k] = None
            ids, fps, at, size, flat = map(np.concatenate, (ids, fps, at, sizes, texts))
            del blobs, texts
            start, view = np.cumsum(size) - size, eights(flat)
            digest = mix(tags[keep] + size.astype(np.uint64) * GOLDEN) ^ view[start].astype(np.uint64) ^ mix(view[start + size - 8].astype(np.uint64))
            head, of = np.unique(classes(flat, start, size, digest), return_inverse=True)
            if len(head) < len(size):
                flat = flat[ragged(start[head], size[head])]
            del view
            marks = Strings(flat, size[head], of, ids, fps, at).repeats(length, period, block)
            if len(marks[0]):
                yield mark_rows(*marks)

    return run


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch):
            n, gone, runs, kept = [], [], [], []
            for text, (starts, ends) in zip(part.column("text").to_pylist(), spans_by_row(part.column("spans")), strict=True):
                raw = text.encode()
                left, at = [], 0
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    left.append(raw[at:s])
                    at = e
                left.append(raw[at:])
                n.append(len(raw))
                gone.append(int((ends - starts).sum()))
                runs.append(len(starts))
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary())})


#: Bytes of text for which there is a bucket.
BUCKET_BYTES = 16 << 20


def repeated_bytes(docs: DataFrame, length: int = 100, anchor: int = 16, period: int = 32, block: int = 1 << 19, buckets: int | None = None) -> DataFrame:
    """doc_id, fp, spans of the bytes that a length-byte string covers which also stands earlier."""
    n = shuffle_partitions(docs.sparkSession)
    size, rows = text_size(docs)
    frequent = frequent_anchors(docs, anchors_of(length, anchor), size, rows)
    packed = keyed(docs).mapInArrow(byte_runs(length, anchor, period, block, buckets or n * max(1, round(size / n / BUCKET_BYTES)), frequent), PACKED)
    return by_bucket(packed, n).mapInArrow(sort_suffixes(length, period, block), MARKS)


def suffix_dedup(docs: DataFrame, length: int = 100, anchor: int = 16, period: int = 32, block: int = 1 << 19, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row.

    A byte goes if a string of length bytes covers it that also starts earlier: in a row with a smaller doc_id, or in the
    same row. A null text is empty. A row without doc_id is left as it is and makes no other lose bytes. Different rows
    with one doc_id do not count against each other. period is that of the difference cover, at most length; block is
    about the number of suffixes sorted at a time; buckets follows the bytes of text.
    """
    return with_marks(keyed(docs), repeated_bytes(docs, length, anchor, period, block, buckets)).mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
