"""Jaccard self-join of documents on word n-grams by chosen paths.

Each set has a signature of min-hash tokens. A node of the search tree holds sets that share the tokens on its path. A
small node is compared by brute force; a larger one is split once for each of several sampled tokens, into the sets that
share it. A pair is compared in the first child, in sampling order, that both reach, so each pair counts once however many
runs find it. A node that splitting would not make smaller, since its sets are much alike, is compared in blocks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import GOLDEN, bytes_hash, grouped, keyed, mix, shuffle_partitions, steps

#: Of the pairs at the threshold, so large a part is found at least; those that are more alike are missed less often.
RECALL = 0.99998
#: Levels of the tree; what is still large below them is compared in blocks.
LEVELS = 3
#: Tokens of a signature, more if the runs of all levels need more.
TOKENS = 48
#: Sets that are compared by brute force at a time.
LEAF = 512
#: A node is dense if so large a part of its pairs share a sampled token.
DENSE = 0.3


def word_ids(texts: list[str], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, and how many words each text has. Words end at ASCII white space alone."""
    parts = [x.encode().split() for x in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.fromiter((known[w] for p in parts for w in p), np.int64, int(sizes.sum()))
    return flat, sizes


@dataclass(frozen=True)
class Plan:
    """How often nodes are split, how many tokens a signature has, and how many of them a pair to be verified shares at least."""

    runs: int
    tokens: int
    agree: int


def plan_for(threshold: float, recall: float) -> Plan:
    """Half of the pairs that may be missed go to each of the two choices by chance.

    A pair at the threshold t shares none of a level's sampled tokens with probability (1 - t) ** runs. Of all tokens of its
    signatures it shares a binomial number.
    """
    lost = (1 - recall) / 2
    runs = max(1, math.ceil(math.log(lost / LEVELS) / math.log(1 - threshold))) if threshold < 1 else 1
    tokens = max(TOKENS, LEVELS * runs)
    agree, below = 0, 0.0
    while True:
        below += math.comb(tokens, agree) * threshold**agree * (1 - threshold) ** (tokens - agree)
        if below > lost:
            return Plan(runs, tokens, agree)
        agree += 1


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit values of each text's word n-grams, and how many each has. A shorter text is one n-gram."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    flat, sizes = word_ids(texts, known)
    h = bytes_hash(list(known))[flat] if len(flat) else np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    out = []
    for a, n in zip(first.tolist(), sizes.tolist(), strict=True):
        w = h[a : a + n]
        k = min(width, n)
        if not k:
            out.append(w)
            continue
        g = w[: n - k + 1].copy()
        for j in range(1, k):
            g = g * GOLDEN + w[j : n - k + 1 + j]
        out.append(np.unique(mix(g + np.uint64(k))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.fromiter(map(len, out), np.int64, len(out))


def sketches(width: int, tokens: int):
    """doc_id, fp, the 128-bit name of the shingle set (null if it is empty) and its signature."""
    rng = np.random.default_rng(20240607)
    factor = rng.integers(1, 1 << 63, tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(1, 1 << 63, tokens, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                values, sizes = shingle_sets(part.column("text").to_pylist(), width)
                full = np.flatnonzero(sizes)
                signature = np.zeros((len(sizes), tokens), np.uint32)
                name = np.zeros((len(sizes), 2), np.uint64)
                if len(full):
                    start = (np.cumsum(sizes) - sizes)[full]
                    for t in range(tokens):
                        x = values * factor[t] + offset[t]
                        x ^= x >> np.uint64(32)
                        x *= GOLDEN
                        signature[full, t] = np.minimum.reduceat(x, start) >> np.uint64(16)
                    for k in range(2):
                        name[full, k] = mix(np.add.reduceat(mix(values + np.uint64((2 * k + 1) * int(GOLDEN) % (1 << 64))), start) + sizes[full].astype(np.uint64))
                empty = sizes == 0
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "fp": part.column("fp"),
                    "h1": pa.array(name[:, 0].view(np.int64), mask=empty), "h2": pa.array(name[:, 1].view(np.int64), mask=empty),
                    "sig": pa.array([x.tobytes() for x in signature], pa.binary()),
                })

    return run


def token(level: int, run: Column, runs: int) -> Column:
    """The signature's token number level * runs + run."""
    at = (F.lit(level * runs) + run) * 4 + 1
    return F.hex(F.substring("sig", at, F.lit(4)))


def children(nodes: DataFrame, level: int, runs: int) -> DataFrame:
    """Each row once for each run, in the child that shares the run's token. skip lists the tokens of earlier runs."""
    rows = nodes.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return rows.select(
        F.xxhash64("node", F.lit(level), "run", token(level, F.col("run"), runs)).alias("node"),
        F.concat("skip", F.when(F.col("run") > 0, F.sequence(F.lit(level * runs), F.lit(level * runs) + F.col("run") - 1)).otherwise(F.array().cast("array<int>"))).alias("skip"),
        "h1", "h2", "copies", "sig",
    )


def with_size(nodes: DataFrame) -> DataFrame:
    # written out, so that the join has a plain shuffle on both sides and a node of many rows can be split by Spark
    sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1").checkpoint()
    return nodes.join(sizes, "node")


def leaves(reps: DataFrame, runs: int) -> DataFrame:
    """Rows of the nodes to compare by brute force: leaf, own (pairs within a block count), block, skip, set, signature."""
    root = reps.select(F.lit(0).cast("long").alias("node"), F.array().cast("array<int>").alias("skip"), "h1", "h2", "copies", "sig")
    level, out = with_size(children(root, 0, runs)).checkpoint(), []
    for depth in range(1, LEVELS + 1):
        out.append(level.where(F.col("size") <= LEAF).select(F.col("node").alias("leaf"), F.lit(True).alias("own"), F.lit(0).cast("long").alias("block"), "skip", "h1", "h2", "copies", "sig"))
        large = level.where(F.col("size") > LEAF)
        if large.isEmpty():
            return union(out)
        if depth < LEVELS:
            # pairs that share a token of the next level, from two tokens' counts
            alike = [large.groupBy("node", token(depth, F.lit(run), runs).alias("token")).agg(F.count(F.lit(1)).alias("n")) for run in (0, runs - 1)]
            pairs = union(alike).groupBy("node").agg((F.sum(F.col("n").cast("double") * F.col("n")) / 2).alias("pairs")).checkpoint()
            judged = large.join(pairs, "node").withColumn("dense", F.col("pairs") >= F.lit(DENSE) * F.col("size") * F.col("size"))
            dense, large = judged.where("dense"), judged.where("not dense")
        else:
            dense, large = large, None
        blocks = F.ceil(F.col("size") / F.lit(LEAF)).cast("long")
        dense = dense.withColumn("block", F.pmod(F.xxhash64("h2", F.lit(depth)), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        out.append(dense.select(F.xxhash64("node", F.lit("block"), F.least("block", "other"), F.greatest("block", "other")).alias("leaf"), (F.col("block") == F.col("other")).alias("own"), "block", "skip", "h1", "h2", "copies", "sig"))
        if large is None:
            break
        level = with_size(children(large, depth, runs)).checkpoint()
    return union(out)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def close_pairs(rows: list[dict], plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a leaf that no earlier run brings together and whose signatures do not rule out the threshold."""
    sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(len(rows), plan.tokens)
    n = len(rows)
    agree = np.zeros((n, n), np.uint8)
    ok = np.triu(np.ones((n, n), bool), 1)
    block = np.array([r["block"] for r in rows])
    if not rows[0]["own"]:
        ok &= block[:, None] != block[None, :]
    skip = set(rows[0]["skip"])
    for t in range(plan.tokens):
        same = sig[:, t][:, None] == sig[:, t][None, :]
        agree += same
        if t in skip:
            ok &= ~same
    return np.nonzero(ok & (agree >= plan.agree))


def once(rows: list[dict]) -> list[dict]:
    """A set that stands twice in a leaf, as its document is repeated, counts once."""
    return list({(r["h1"], r["h2"]): r for r in rows}.values())


def candidates(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf, rows in grouped(batches, "leaf"):
            rows = once(rows)
            i, j = close_pairs(rows, plan)
            hit = np.union1d(i, j).tolist()
            if hit:
                yield pa.RecordBatch.from_pydict({"leaf": pa.array([leaf] * len(hit), pa.int64()), "h1": pa.array([rows[k]["h1"] for k in hit], pa.int64()), "h2": pa.array([rows[k]["h2"] for k in hit], pa.int64())})

    return run


def verified(threshold: float, plan: Plan):
    """For each set of a leaf: how many rows its partners stand for, and the least set of its component in this leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "leaf"):
            rows = once(rows)
            left, right = close_pairs(rows, plan)
            if not len(left):
                continue
            sets = [np.frombuffer(r["values"], np.uint64) for r in rows]
            size = np.array([len(s) for s in sets])
            first = np.cumsum(size) - size
            number, flat = np.unique(np.concatenate(sets), return_inverse=True)
            flag = np.zeros(len(number), np.int64)
            copies = np.array([r["copies"] for r in rows])
            links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
            cut = np.flatnonzero(np.diff(left)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(left)], strict=True):
                i, js = int(left[a]), right[a:b]
                flag[flat[first[i] : first[i] + size[i]]] = 1
                if len(js) * 4 < len(rows):
                    both = np.array([flag[flat[first[j] : first[j] + size[j]]].sum() for j in js.tolist()])
                else:
                    both = np.add.reduceat(flag[flat], first)[js]
                flag[flat[first[i] : first[i] + size[i]]] = 0
                js = js[both >= threshold * (size[i] + size[js] - both) - 1e-9]
                links[i] += copies[js].sum()
                links[js] += copies[i]
                if len(js):
                    joined = np.unique(root[np.append(js, i)])
                    root[np.isin(root, joined)] = joined[0]
            hit = np.flatnonzero(links)
            if len(hit):
                names = [(r["h1"], r["h2"]) for r in rows]
                least = {k: min(names[m] for m in np.flatnonzero(root == k).tolist()) for k in np.unique(root[hit]).tolist()}
                top = [least[k] for k in root[hit].tolist()]
                yield pa.RecordBatch.from_pydict({
                    "h1": pa.array([names[k][0] for k in hit.tolist()], pa.int64()), "h2": pa.array([names[k][1] for k in hit.tolist()], pa.int64()),
                    "links": pa.array(links[hit], pa.int64()), "t1": pa.array([x[0] for x in top], pa.int64()), "t2": pa.array([x[1] for x in top], pa.int64()),
                })

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root of each node of edges (u, v); root is the least node that paths lead to.

    Alternating star contractions; each leaves a written table behind, and the driver sees a count and a sum alone.
    """
    state = None
    links = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        links = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct().checkpoint()
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def set_values(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                values, sizes = shingle_sets(part.column("text").to_pylist(), width)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_pydict({"h1": part.column("h1"), "h2": part.column("h2"), "values": pa.array([values[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())})

    return run


def ngram_jaccard_join(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = RECALL) -> DataFrame:
    """doc_id, fp, class_id, class_fp and n_links of every row.

    Words are runs of anything but ASCII white space; texts are alike if the Jaccard similarity of their sets of width
    consecutive words is threshold or more (a text of fewer words is one n-gram). n_links counts the other rows alike to
    this one, copies and repeated rows included. Rows that links connect are one class; class_id is its least doc_id, and
    class_fp the fp of that row. A null or wordless text is in no class: class_id is its own doc_id, and n_links is 0. Rows
    without doc_id take part, and name a class only if all its rows lack one. Runs are repeated until a pair at the threshold
    is found with probability recall at least; copies are never missed.
    """
    plan = plan_for(threshold, recall)
    n = shuffle_partitions(docs.sparkSession)
    base = keyed(docs)
    sketch = base.mapInArrow(sketches(width, plan.tokens), "doc_id long, fp long, h1 long, h2 long, sig binary").checkpoint()
    full = sketch.where("h1 is not null")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    reps = full.groupBy("h1", "h2").agg(F.min(who).alias("who"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")).checkpoint()
    leaf = leaves(reps, plan.runs)
    arranged = lambda df: df.repartition(n, "leaf").sortWithinPartitions("leaf")
    close = arranged(leaf).mapInArrow(candidates(plan), "leaf long, h1 long, h2 long").checkpoint()
    wanted = close.select("h1", "h2").distinct().join(reps.select("h1", "h2", "who"), ["h1", "h2"]).select("h1", "h2", "who.none", F.coalesce("who.doc_id", F.lit(0)).alias("id"), "who.fp")
    source = base.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "fp", "text")
    values = source.join(wanted, ["none", "id", "fp"]).select("h1", "h2", "text").mapInArrow(set_values(width), "h1 long, h2 long, values binary")
    ready = leaf.join(close, ["leaf", "h1", "h2"]).join(values, ["h1", "h2"])
    found = arranged(ready).mapInArrow(verified(threshold, plan), "h1 long, h2 long, links long, t1 long, t2 long").checkpoint()
    edges = found.select(F.struct("h1", "h2").alias("u"), F.struct(F.col("t1").alias("h1"), F.col("t2").alias("h2")).alias("v"))
    roots = components(edges).select("node.h1", "node.h2", "root")
    links = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    member = reps.join(links, ["h1", "h2"], "left").join(roots, ["h1", "h2"], "left").select("h1", "h2", "who", "copies", "links", F.coalesce("root", F.struct("h1", "h2")).alias("root"))
    top = member.groupBy("root").agg(F.min("who").alias("top"))
    named = member.join(top, "root").select("h1", "h2", F.col("top.doc_id").alias("class_id"), F.col("top.fp").alias("class_fp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sketch.select("doc_id", "fp", "h1", "h2").join(named, ["h1", "h2"], "left")
    alone = F.col("n_links").isNull()
    return out.select("doc_id", "fp", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("fp")).otherwise(F.col("class_fp")).alias("class_fp"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each_class(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = RECALL) -> DataFrame:
    """docs, all columns, with the row that names each class alone; of rows equal in doc_id and text one stays."""
    joined = ngram_jaccard_join(docs, threshold, width, recall)
    kept = joined.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("fp") == F.col("class_fp")))
    kept = kept.select(F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("fp").alias("__fp")).distinct()
    source = docs.withColumns({"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__fp": F.xxhash64(F.coalesce("text", F.lit("")))})
    return source.join(kept, ["__none", "__id", "__fp"], "left_semi").dropDuplicates(["__none", "__id", "__fp"]).drop("__none", "__id", "__fp")
