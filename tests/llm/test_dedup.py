import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.common import frequent_anchors, merged, pack, sliding_min, text_size, unpack
from tessera.llm.jaccard_join import LEAF, ngram_jaccard_join, one_of_each_class
from tessera.llm import substring_dedup as sub
from tessera.llm import suffix_dedup as sd
from tessera.llm.substring_dedup import anchors_of, count_windows, substring_dedup, super_kmers, word_bounds
from tests.llm.conftest import ODD


def brute_words(rows, width=13):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {k + j for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for j in range(width)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def brute_bytes(rows, length=100):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if i is not None and b[k : k + length] in seen:
                gone[k : k + length] = True
            elif i is not None:
                seen[b[k : k + length]] = i
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def byte_rows(df, **options):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sd.suffix_dedup(df, **options).collect()), key=sort_key)


def sort_key(row):
    return (row[0] is None, row[0] or 0, *map(str, row[1:]))


def test_substring_dedup_matches_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in substring_dedup(docs, buckets=7).collect()]
    assert sorted(got, key=sort_key) == sorted(brute_words(rows), key=sort_key)


def test_substring_dedup_odd_rows(make):
    got = [tuple(r) for r in substring_dedup(make(ODD)).collect()]
    assert sorted(got, key=sort_key) == sorted(brute_words(ODD), key=sort_key)
    assert substring_dedup(make([])).count() == 0


def test_suffix_dedup_matches_brute_force(docs):
    some = docs.orderBy("doc_id").limit(80)
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    assert byte_rows(some, block=5000, buckets=7) == sorted(brute_bytes(rows), key=sort_key)


def patchwork(rnd, pieces, n):
    """Rows of many shared pieces, whole copies and runs of one letter; doc_ids in no order."""
    rows = []
    for i in rnd.sample(range(1000), n):
        kind = rnd.randrange(6)
        if kind == 0 and rows:
            rows.append((i, rnd.choice(rows)[1]))
        elif kind == 1:
            rows.append((i, "ab"[rnd.randrange(2)] * rnd.randrange(90, 300)))
        else:
            rows.append((i, "".join(rnd.choice(pieces)[rnd.randrange(40) :] for _ in range(rnd.randrange(1, 9)))))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_of_patchwork(spark, seed):
    """Shared passages over many rows, in many steps, small blocks and buckets, with and without anchors put back."""
    rnd = random.Random(seed)
    pieces = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(60, 260))) for _ in range(12)]
    rows = patchwork(rnd, pieces, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert byte_rows(df, block=64 << seed, buckets=1 + 4 * seed) == sorted(brute_bytes(rows), key=sort_key)


def test_every_removal_comes_from_the_sort(docs, monkeypatch):
    """Without the sorted order nothing is found to repeat, neither in the steps nor in the buckets."""
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "fp": pa.array([0] * len(rows), pa.int64()), "text": pa.array([t for _, t in rows])})

    def removed():
        packed = list(sd.byte_runs(100, 16, 32, 1 << 19, 1, None)(iter([batch])))
        packed.sort(key=lambda b: b.column("payload").null_count)
        return sum(b.num_rows for b in sd.sort_suffixes(100, 32, 1 << 19)(iter(packed)))

    assert removed() > 50
    monkeypatch.setattr(sd, "sort_block", lambda view, pos, ranks, cover: pos[:0])
    assert removed() == 0


def test_strings_met_before_in_a_task():
    """A string that stands in every step is sent once, unless a smaller document has it."""
    text = "".join(random.Random(1).choices("abcdefgh ", k=400))
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([a, a + 1], pa.int64()), "fp": pa.array([0, 0], pa.int64()), "text": pa.array([text, text])}) for a in (10, 20, 5, 30)]
    packed = list(sd.byte_runs(100, 16, 32, 1 << 19, 1, None)(iter(batches)))
    sent = [np.frombuffer(unpack(p)[3], np.int64).tolist() for b in packed for p in b.column("payload").to_pylist() if p is not None]
    assert sent == [[10], [5]]
    gone = {d for b in packed for d, p in zip(b.column("doc_id").to_pylist(), b.column("payload").to_pylist(), strict=True) if p is None}
    assert gone == {11, 20, 21, 10, 6, 30, 31}


@pytest.mark.parametrize("kinds", [1, 3, 50])
def test_words_of_one_hash_are_told_apart(monkeypatch, kinds):
    """With hashes that nearly all words share the marks are the same, as bytes decide."""
    rnd = random.Random(kinds)
    lines = [" ".join(rnd.choice("abcdef") * rnd.randrange(1, 4) for _ in range(18)) for _ in range(6)]
    rows = [(i, "  \n".join(rnd.choice(lines) for _ in range(4))) for i in rnd.sample(range(100), 40)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in part], pa.int64()), "fp": pa.array([0] * len(part), pa.int64()), "text": pa.array([t for _, t in part])}) for part in (rows[:15], rows[15:])]

    def removed():
        packed = pa.Table.from_batches(list(super_kmers(13, 3, 2, None)(iter(batches)))).sort_by("bucket").to_batches()
        gone = {}
        for b in count_windows(13)(iter(packed)):
            for r in b.to_pylist():
                gone.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
        return {i: len(x) for i, x in gone.items()}

    want = {i: n for i, _, n, _ in brute_words(rows) if n}
    assert removed() == want
    real = sub.word_hashes
    monkeypatch.setattr(sub, "word_hashes", lambda *a: real(*a) % np.uint64(kinds))
    assert removed() == want


def test_word_hashes_do_not_depend_on_the_place():
    words = ["a", "é", "漢字", "x" * 7, "x" * 8, "x" * 9, "x" * 16, "x" * 17, "y" * 5000, "y" * 5001]
    raw = " ".join(words + words[::-1]).encode()
    h = sub.word_hashes(raw, *word_bounds(raw)).tolist()
    assert h[: len(words)] == h[len(words) :][::-1] and len(set(h)) == len(words)
    assert sub.single_spaced(b" a\x0b\n b\t ") == b"a b " and sub.single_spaced(b"") == b""


def test_frequent_anchors(spark, make):
    """Anchors of a passage that all rows share are put back, and no result changes."""
    rnd = random.Random(3)
    shared = " ".join(f"w{rnd.randrange(50)}" for _ in range(30))
    rows = [(i, " ".join(f"v{rnd.randrange(10**6)}" for _ in range(30)) + " " + shared + " " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(30))) for i in range(300)]
    df = make(rows).repartition(2)
    size, n = text_size(df)
    for anchors in (sd.anchors_of(100, 16), anchors_of(13, 3)):
        found = frequent_anchors(df, anchors, size, n)
        assert found is not None and 0 < found.sum() < 1000
    assert byte_rows(df) == sorted(brute_bytes(rows), key=sort_key)
    assert sorted((tuple(r) for r in substring_dedup(df).collect()), key=sort_key) == sorted(brute_words(rows), key=sort_key)


def test_suffix_dedup_odd_rows(make):
    rows = [r for r in ODD if r[0] != 5] + [(9, "ab" * 300), (10, "ab" * 200 + "c"), (11, "a" * 150)]
    assert byte_rows(make(rows)) == sorted(brute_bytes(rows), key=sort_key)
    twice = sd.suffix_dedup(make([(5, "y" * 99 + "z" * 50), (5, "y" * 99 + "z" * 50)])).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]
    # rows that share a doc_id do not count against each other, but a smaller doc_id does, and each row against itself
    line = "".join(random.Random(8).choices("abcdefgh", k=120))
    got = byte_rows(make([(5, line), (5, line + "!"), (6, line), (7, line + line)]))
    assert [(i, n) for i, _, n, _, _ in got] == [(5, 0), (5, 0), (6, 120), (7, 240)]
    assert [(i, n, k) for i, _, n, k, _ in byte_rows(make([(5, line + "-" + line), (5, line)]))] == [(5, 0, 0), (5, 120, 1)]
    assert sd.suffix_dedup(make([])).count() == 0


def test_very_long_texts(spark):
    """Texts of some megabytes: one that repeats throughout, and one that does not; the time stays in proportion."""
    rnd = np.random.default_rng(4)
    word = ["".join(chr(97 + x) for x in rnd.integers(0, 26, 7)) for _ in range(4000)]
    fresh = " ".join(word[i] for i in rnd.integers(0, 4000, 300_000))
    line = "the same line of words stands here over and over again and nothing else does so far\n"
    again = (line * 30_000)[: 2 << 20]
    df = spark.createDataFrame([(1, fresh), (2, again), (3, fresh[:1_000_000])], "doc_id long, text string")
    size = {1: len(fresh), 2: len(again), 3: 1_000_000}
    got = {r[0]: (r[1], r[2], r[3]) for r in byte_rows(df)}
    assert got == {1: (size[1], 0, 0), 2: (size[2], size[2] - len(line), 1), 3: (size[3], size[3], 1)}
    words = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup(df).collect()}
    assert words[1][1] == 0 and words[2][1] == 0 and words[3][1] >= words[3][0] - 1


@pytest.mark.parametrize("period", [3, 8, 31, 32])
def test_difference_cover(period):
    cover = sd.Cover(period)
    for i in range(period):
        for j in range(period):
            d = int(cover.shift(np.array([i]), np.array([j]))[0])
            assert 0 <= d < period and cover.member[(i + d) % period] and cover.member[(j + d) % period]


@given(st.binary(min_size=1, max_size=400), st.sampled_from([7, 50, 1000]))
@settings(max_examples=40, deadline=None)
def test_blockwise_order(raw, block):
    raw = bytes(b % 3 for b in raw)
    text = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(200, np.uint8)])
    order = np.concatenate(list(sd.blockwise(text, np.arange(len(raw)), 40, 8, block)))
    keys = [bytes(text[i : i + 40]) for i in order]
    assert keys == sorted(keys)


def test_helpers():
    assert [bytes(x) for x in unpack(pack(b"ab", np.array([1, 2], np.uint8)))] == [b"ab", b"\x01\x02"]
    assert sliding_min(np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]
    assert [x.tolist() for x in merged(np.array([5, 0, 2]), np.array([6, 2, 4]))] == [[0, 5], [4, 6]]
    assert [(int(a), int(b)) for a, b in zip(*word_bounds(b" ab\x0bc\xc2\x85d "), strict=True)] == [(1, 3), (4, 8)]


def brute_join(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        return a if root[a] == a else find(root[a])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    top = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            top[find(i)] = min(top.get(find(i), d), d)
    return sorted(((d, top.get(find(i)), n) for i, ((d, _), n) in enumerate(zip(rows, links, strict=True))), key=sort_key)


def join_rows(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_jaccard_join(df).collect()), key=sort_key)


def test_join_odd_rows(make):
    assert join_rows(make(ODD)) == brute_join(ODD)
    assert join_rows(make([])) == []


def test_join_matches_brute_force(make, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    for i in range(LEAF + 60):  # a dense group that no leaf holds, all texts different
        words = base[:]
        for _ in range(rnd.randrange(1, 4)):
            words[rnd.randrange(len(words))] = f"z{rnd.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(words)))
    assert join_rows(make(rows)) == brute_join(rows)


def test_one_of_each_class(make):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, None), (5, "other words in this text here")]
    kept = one_of_each_class(make(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5] and "node" in kept.columns
