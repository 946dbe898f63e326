"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as a pattern that Java and RE2 read alike.
BLANK = r"[\x20\x09-\x0D]+"
# Symbols that are counted, and stop words of the languages served.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in a is that for with as was on are by this at from or an be it not"
    " de la le les et des un une en que est pour dans par sur au qui pas"
    " der die das und den von zu mit sich auf ist im dem nicht ein eine für"
    " el los las del se y por con una su al es lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures must lie between least and most; it holds where the divisor is 0."""

    name: str
    above: str
    below: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Each row is one rule; compile_rules() turns the table into one Boolean expression.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.35),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def repeat_words(words: Column, window: int) -> Column:
    """How many words lie in windows of window words that stand twice or more.

    Sorted (hash of the words, place) pairs bring equal windows together; neighbours of one hash are compared word by word,
    and a second hash keeps different windows of one hash apart. The sorted places of repeated windows give the covered
    words. A text without repeats stops at the comparison of the distinct count.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(window)]))

    def covered(h: Column) -> Column:
        second = lambda i: F.hash(*[F.get(words, i + j) for j in range(window)])
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), second(i).alias("g"), i.alias("i"))))
        window_at = lambda i: F.slice(words, i + 1, window)
        same = lambda s, a, b: F.when(F.get(s, a)["h"] == F.get(s, b)["h"], window_at(F.get(s, a)["i"]) == window_at(F.get(s, b)["i"])).otherwise(F.lit(False))
        twice = lambda s: F.sort_array(F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (same(s, i, i - 1) | same(s, i, i + 1)).alias("r"))), lambda x: x["r"]), lambda x: x["i"]))
        widths = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1), x + window) - x, F.lit(window))), F.lit(0), lambda a, x: a + x)
        return let(let(placed, twice), widths)

    return F.when(n < window, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def measures(text: Column, window: int = 8) -> Column:
    """A struct of what the rules use, as one expression over a text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0)

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeat_words(words, window).cast("long").alias("n_repeat_words"),
        )

    return let(words_of(text), of)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row of measures keeps to every rule."""
    out = F.lit(True)
    for r in rules:
        ratio = F.col(r.above) / F.nullif(F.col(r.below), F.lit(0))
        if r.least is not None:
            out = out & F.coalesce(ratio >= r.least, F.lit(True))
        if r.most is not None:
            out = out & F.coalesce(ratio <= r.most, F.lit(True))
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every row.

    One projection without user functions. A null text has no words and fails. base_failed: fewer than min_words words, or
    over max_repeat_percent of them in repeated 8-word windows. kept: not base_failed, and every rule of the table holds.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measures(text).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"))
