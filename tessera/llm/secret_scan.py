"""Secret scans with linking of the parts of a credential. DataFrame functions only.

Strong findings stand for themselves. A weak part (a user name, a token-like string, an endpoint) is reported only if a
complementary part is near: an identifier or endpoint needs a secret, a token an identifier or endpoint. One projection
reads each text and gives its matches as rows; these are small and kept as a checkpoint. Places, overlaps and links are
windows and an interval join over the rows: a part lies in all buckets of the width of a scope that it touches and meets
the parts of those and their neighbours. All steps take time in proportion to the text and its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keyed, with_checkpoints
from tessera.llm.quality_rules import let

# Patterns of strong findings, in the order of their kinds. A run is taken whole, so its start is looked for alone.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
#: Characters that the value of an assignment has at least.
ASSIGN_VALUE = 12

# Patterns of weak parts.
NAME = r"""(?i:client_?id|access_?key_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""
TOKEN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}+={0,2}"
ENDPOINT = r"(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9_.:@/?&=%-]{4,}"

KINDS = ("assign", "access", "hex", "link_name", "link_token", "link_endpoint")
ROLES = ("secret", "name", "secret", "name", "secret", "endpoint")
#: Kinds below this one are strong.
WEAK = 3
SPAN = "array<struct<start:int,kind:int,end:int,role:string>>"
KEY = ["none", "id", "fp"]


def matches(text: Column, kind: int, pattern: str, needs: tuple[str, ...] = (), group: int = 0, good=None) -> Column:
    """A row for each match of a pattern, leftmost first: kind, nth, the code points before it since the last one, its own.

    good tells of the match, or its group, whether it counts; one that does not still takes its place. A text without any
    of the strings needed is not searched.
    """
    regex = F.lit(pattern)
    found = F.regexp_extract_all(text, regex, F.lit(0))

    def rows(whole: Column, values: Column) -> Column:
        row = lambda m, i, p: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(F.get(p, i)).alias("before"), F.length(m).alias("own"), (F.lit(True) if good is None else good(F.get(values, i))).alias("good"))
        return let(F.split(text, pattern, -1), lambda p: F.transform(whole, lambda m, i: row(m, i, p)))

    every = let(found, lambda m: let(F.regexp_extract_all(text, regex, F.lit(group)), lambda v: rows(m, v)) if group else rows(m, m))
    may = text.rlike(pattern)
    if needs:
        any_of = F.contains(text, F.lit(needs[0]))
        for x in needs[1:]:
            any_of = any_of | F.contains(text, F.lit(x))
        may = any_of & may
    return F.when(may, every).otherwise(F.array().cast("array<struct<kind:int,nth:int,before:int,own:int,good:boolean>>"))


def found_in(docs: DataFrame) -> DataFrame:
    """none, id, doc_id, fp and the matches of every row, behind one row of kind -1 for the row itself; one pass over the texts."""
    text = F.col("text")
    signs = ("=", ":")
    itself = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("nth"), F.lit(0).alias("before"), F.lit(0).alias("own"), F.lit(False).alias("good")))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    every = F.concat(
        itself, matches(text, 0, ASSIGN, signs, 2, lambda v: F.length(v) >= ASSIGN_VALUE), matches(text, 1, ACCESS, ("AKIA",)), matches(text, 2, HEX),
        matches(text, 3, NAME, signs), matches(text, 4, TOKEN, good=mixed), matches(text, 5, ENDPOINT, ("://",)),
    )
    rows = keyed(docs).select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "doc_id", "fp", F.inline(every))
    return with_checkpoints(docs.sparkSession, rows).checkpoint()


def placed(rows: DataFrame) -> DataFrame:
    """Strong findings, and weak parts that none of them overlaps: none, id, fp, kind, start, end in code points."""
    at = F.sum(F.col("before") + F.col("own")).over(Window.partitionBy(*KEY, "kind").orderBy("nth")).cast("int")
    spans = rows.where("kind >= 0").dropDuplicates([*KEY, "kind", "nth"]).withColumn("end", at).withColumn("start", F.col("end") - F.col("own")).where("good")
    strong = F.col("kind") < WEAK
    # a strong finding that starts before the end of a weak part, and ends behind its start, overlaps it
    upto = Window.partitionBy(*KEY).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("at", F.when(strong, F.col("start")).otherwise(F.col("end") - 1)).withColumn("top", F.max(F.when(strong, F.col("end"))).over(upto))
    return spans.where(strong | (F.coalesce("top", F.lit(0)) <= F.col("start"))).select(*KEY, "kind", "start", "end")


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """Weak parts with a complementary part at most reach code points away in the same row."""
    weak = F.max("kind").over(Window.partitionBy(*KEY)) >= WEAK
    parts = parts.withColumn("weak", weak).where("weak").withColumn("secret", F.col("kind").isin([k for k, r in enumerate(ROLES) if r == "secret"]))
    near = parts.select(*KEY, F.col("start").alias("s"), F.col("end").alias("e"), F.col("secret").alias("with"), F.explode(F.sequence(F.expr(f"start div {reach}") - 1, F.expr(f"(end + {reach}) div {reach}"))).alias("bucket"))
    # a part longer than a bucket meets partners from each bucket that it touches; distinct takes repeats out
    left = parts.where(F.col("kind") >= WEAK).withColumn("bucket", F.explode(F.sequence(F.expr(f"start div {reach}"), F.expr(f"end div {reach}"))))
    both = left.join(near, [*KEY, "bucket"]).where((F.col("secret") != F.col("with")) & (F.col("s") <= F.col("end") + reach) & (F.col("start") <= F.col("e") + reach))
    return both.select(*KEY, "kind", "start", "end").distinct()


def secret_spans(docs: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """(none, id, doc_id, fp) of every row, and (none, id, fp, kind, start, end) of what is found in each different one."""
    rows = found_in(docs)
    parts = placed(rows)
    return rows.where("kind = -1").select("none", "id", "doc_id", "fp"), parts.where(F.col("kind") < WEAK).unionByName(linked(parts, reach))


def secret_scan(docs: DataFrame, reach: int = 256) -> DataFrame:
    """doc_id, fp, base and spans of every row; both are arrays of (start, kind, end, role), sorted, kind an index of KINDS.

    base has the strong findings of each kind (assignments with values of ASSIGN_VALUE characters or more, access ids of 18
    or more, hexadecimal strings of 16 or more); spans has the linked weak parts too. A null text is empty. Repeated rows
    have equal results. reach is the scope: so many code points at most lie between parts of one credential.
    """
    rows, spans = secret_spans(docs, reach)
    span = F.struct("start", "kind", "end", F.get(F.array(*map(F.lit, ROLES)), F.col("kind")).alias("role"))
    every = spans.groupBy(*KEY).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast(SPAN)
    out = rows.join(every, KEY, "left").select("doc_id", "fp", F.coalesce("spans", none).alias("spans"))
    return out.select("doc_id", "fp", F.filter("spans", lambda s: s["kind"] < WEAK).alias("base"), "spans")


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start and then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def merged_spans(spans: DataFrame) -> DataFrame:
    """none, id, fp and its spans, overlapping ones merged, as a sorted array of (start, end)."""
    order = Window.partitionBy(*KEY).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("start") < before, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*KEY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


#: Code points of a text that are cut at a time; a place in a longer piece would be looked for from its start.
PIECE = 1 << 15


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each of its spans, sorted and apart from each other, replaced by mark."""

    def cut(piece: Column, low: Column, mine: Column) -> Column:
        last = lambda i: F.coalesce(F.get(mine, i - 1)["end"] - low, F.lit(0))
        kept = F.transform(mine, lambda s, i: F.concat(F.substring(piece, last(i) + 1, F.greatest(s["start"] - low - last(i), F.lit(0))), F.when(s["start"] >= low, F.lit(mark)).otherwise("")))
        return F.concat(F.array_join(kept, ""), F.substring(piece, last(F.size(mine)) + 1, F.lit(PIECE)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    inside = lambda low: F.filter(spans, lambda s: (s["start"] < low + PIECE) & (s["end"] > low))
    return F.array_join(F.transform(pieces, lambda p, i: let(inside(i * PIECE), lambda mine: cut(p, i * PIECE, mine))), "")


def redact_secrets(docs: DataFrame, reach: int = 256, mark: str = "[secret]") -> DataFrame:
    """docs, all columns, with mark in the place of every span; n_chars, where it is there, follows the new text.

    Endpoints and user names that are linked to a secret are spans too. Rows without spans, null texts included, are as they were.
    """
    spans = merged_spans(secret_spans(docs, reach)[1]).select(*[F.col(k).alias(f"__{k}") for k in KEY], F.col("spans").alias("__spans"))
    source = docs.withColumns({"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__fp": F.xxhash64(F.coalesce("text", F.lit("")))})
    out = source.join(spans, ["__none", "__id", "__fp"], "left").withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("__spans"), mark)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
