"""What several text operators share: keyed input rows, Arrow batches and packed rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import session

#: Text bytes that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 4 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_checkpoints(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df, after a checkpoint folder is sure to be set."""
    return session.with_checkpoints(df)


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, fp and text of each row; other columns are left out, so their names cannot clash.

    fp tells rows apart that share a doc_id; rows equal in both are the same document twice.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("fp"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *more,
    )


def training_fold(modulus: int, out: int) -> Column:
    """True for rows that labels may be learned from: crc32(doc_id as text) mod modulus is not out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != out


def held_out(modulus: int, out: int) -> Column:
    return F.coalesce(~training_fold(modulus, out), F.lit(False))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def bytes_hash(items: list[bytes]) -> np.ndarray:
    """The same 64-bit value for equal bytes in every process."""
    low = np.fromiter(map(zlib.crc32, items), np.uint64, len(items))
    high = np.fromiter((zlib.crc32(x, 0x5BD1E995) for x in items), np.uint64, len(items))
    sizes = np.fromiter(map(len, items), np.uint64, len(items))
    return mix((high << np.uint64(32) | low) + sizes * GOLDEN)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each piece, one piece after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def steps(batch: pa.RecordBatch, column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about size bytes together."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    lengths = np.asarray(pc.binary_length(texts).fill_null(0))
    groups = np.cumsum(lengths) // size
    at = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(at, at[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed string."""
    parts, head = [], []
    for a in arrays:
        raw = a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes()
        head.append(len(raw))
        parts.append(raw)
    raw = np.array([len(head), *head], np.int64).tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=5).compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[bytes]:
    size = int.from_bytes(blob[:8], "little")
    raw = memoryview(pa.Codec("zstd").decompress(blob[8:], decompressed_size=size, asbytes=True))
    count = int(np.frombuffer(raw[:8], np.int64)[0])
    sizes = np.frombuffer(raw[8 : 8 + 8 * count], np.int64)
    at, out = 8 + 8 * count, []
    for n in sizes.tolist():
        out.append(raw[at : at + n])
        at += n
    return out


def smallest(values: np.ndarray) -> np.ndarray:
    """The values in the narrowest unsigned type that holds them."""
    top = int(values.max()) if len(values) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return values.astype(kind)


def narrow(values: np.ndarray) -> bytes:
    """smallest() with the width in front."""
    small = smallest(values)
    return bytes([small.itemsize]) + small.tobytes()


def wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], np.dtype(f"u{raw[0]}")).astype(np.int64)


def text_size(docs: DataFrame) -> tuple[int, int]:
    """Bytes of all texts, and rows; reads that column alone."""
    found = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("rows")).first()
    return found["size"], found["rows"]


#: Text that is looked at for frequent anchors; and the part of its rows that one must stand in.
ANCHOR_BYTES, ANCHOR_SHARE = 16 << 20, 1 / 200
ANCHOR_BITS = 20


def frequent_anchors(docs: DataFrame, anchors, size: int, rows: int) -> np.ndarray | None:
    """A bitmap of anchors that would make hot buckets, or nothing if there are none.

    anchors gives row and minimiser of each window of a batch. Which anchors are put back is a free choice that changes no
    result, only what bucket a window goes to; so it may come from about ANCHOR_BYTES of the rows. The driver gets at most
    the minimisers of an average row, divided by ANCHOR_SHARE.
    """
    part = min(1.0, ANCHOR_BYTES / max(size, 1))
    drawn = keyed(docs).where((F.pmod(F.xxhash64(F.lit("anchors"), "doc_id", "fp"), F.lit(1 << 30)) / float(1 << 30) < part) & (F.col("text") != ""))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch, size=1 << 21):
                row, h = anchors(piece)
                slot = (h & np.uint64((1 << ANCHOR_BITS) - 1)).astype(np.int64)
                pairs = np.unique(row.astype(np.int64) << ANCHOR_BITS | slot)
                slot, n = np.unique(pairs & (1 << ANCHOR_BITS) - 1, return_counts=True)
                yield pa.RecordBatch.from_pydict({"slot": pa.array(slot[n > 1]), "n": pa.array(n[n > 1], pa.int64())})

    counts = drawn.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(8.0, rows * part * ANCHOR_SHARE)).select("slot").collect()
    if not found:
        return None
    out = np.zeros(1 << ANCHOR_BITS, bool)
    out[[r["slot"] for r in found]] = True
    return out


def put_back(h: np.ndarray, frequent: np.ndarray | None) -> np.ndarray:
    """Hashes of anchors, those of frequent ones above all others."""
    if frequent is None:
        return h
    top = np.uint64(1 << 63)
    return np.where(frequent[(h & np.uint64((1 << ANCHOR_BITS) - 1)).astype(np.int64)], h | top, h & ~top)


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position, as numbers that sort as the bytes do; a view of text."""
    return np.ndarray((len(text) - 7,), ">u8", buffer=text, strides=(1,))


def equal_runs(flat: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether run a[i] and run b[i], of sizes[i] values each, hold the same values."""
    same = flat[ragged(a, sizes)] == flat[ragged(b, sizes)]
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(same)])
    return total[ends] - total[ends - sizes] == sizes


#: Rows of packed strings by bucket, or of marks that are ready; and of marks.
PACKED = "bucket int, payload binary, doc_id long, fp long, start long, end long"
MARKS = "doc_id long, fp long, start long, end long"


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of consecutive equal keys; the input is sorted by key."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != last:
                yield last, rows
                rows = []
            last = row[key]
            rows.append(row)
    if rows:
        yield last, rows


def by_bucket(packed: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt out so that each partition has equally many of the numbered buckets, one after the other."""
    return packed.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as disjoint sorted intervals that do not touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:] - 1, len(ends) - 1)]


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Each row of keyed docs with all its intervals, an array of (start, end), or null."""
    gathered = marks.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.join(gathered, ["doc_id", "fp"], "left").select("doc_id", "text", "spans")


def spans_by_row(spans: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each row the union of its intervals, as disjoint sorted ones."""
    flat = spans.flatten()  # without the places of null rows
    starts, ends = (np.asarray(flat.field(k), np.int64) for k in (0, 1))
    sizes = np.asarray(pc.list_value_length(spans).fill_null(0))
    at = 0
    for n in sizes.tolist():
        yield merged(starts[at : at + n], ends[at : at + n])
        at += n


def mark_rows(doc_id: np.ndarray, fp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Intervals, those of one document that overlap or touch merged."""
    order = np.lexsort((starts, fp, doc_id))
    doc_id, fp, starts, ends = doc_id[order], fp[order], starts[order], ends[order]
    row = np.cumsum(np.concatenate([[False], (doc_id[1:] != doc_id[:-1]) | (fp[1:] != fp[:-1])])) if len(doc_id) else np.zeros(0, np.int64)
    wide_ = int(ends.max(initial=0)) + 2
    starts, ends = merged(starts + row * wide_, ends + row * wide_)
    first = np.searchsorted(row * wide_, starts // wide_ * wide_) if len(starts) else np.zeros(0, np.int64)
    low = starts // wide_ * wide_
    return pa.RecordBatch.from_arrays([pa.array(doc_id[first], pa.int64()), pa.array(fp[first], pa.int64()), pa.array(starts - low, pa.int64()), pa.array(ends - low, pa.int64())], names=["doc_id", "fp", "start", "end"])


def packed_rows(bucket, payload) -> pa.RecordBatch:
    none = [None] * len(bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(payload, pa.binary()), *(pa.array(none, pa.int64()) for _ in range(4))], names=["bucket", "payload", "doc_id", "fp", "start", "end"])


def ready_rows(doc: np.ndarray, fp: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Marks that are ready, dealt out by document to travel with the packed strings."""
    rows = mark_rows(doc, fp, start, end)
    to = (mix(rows.column("doc_id").to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([None] * rows.num_rows, pa.binary()), *rows.columns], names=["bucket", "payload", *rows.schema.names])


def by_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, list[bytes]]]:
    """Marks that are ready, as they come, and the payloads of each bucket; the input is sorted by bucket."""
    last, held = None, []
    for batch in batches:
        ready = batch.column("payload").is_null()
        if pc.any(ready).as_py():
            yield batch.filter(ready).select(["doc_id", "fp", "start", "end"]), []
            batch = batch.filter(pc.invert(ready))
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if bucket != last:
                if held:
                    yield None, held
                last, held = bucket, []
            held.append(payload)
    if held:
        yield None, held
