"""Text functions: Unicode folding, cleaning, words and character bigrams.

Functions that take and return Column run in the JVM. Those named *_py are plain Python; the *_udf beside them apply them to
Arrow batches, for what Spark has no built-in for (Unicode normalisation, rules that look at where a match stands).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_PATTERN = r"([\p{L}\p{N}_]+)"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(text: Column) -> Column:
    """Case folding of text that is NFC already; fold_udf() is for any text."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def fold_py(text: str | None) -> str:
    return unicodedata.normalize("NFC", text or "").casefold()


@F.pandas_udf(T.StringType())
def fold_udf(text: pd.Series) -> pd.Series:
    return text.map(fold_py)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def words(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(WORD_PATTERN), F.lit(1))


def word_bigrams(word: Column) -> Column:
    """Character pairs of a word; a one-letter word is its own."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))


def bigrams(text: Column) -> Column:
    """The multiset of character bigrams of all words."""
    return F.flatten(F.transform(words(fold(text)), word_bigrams))


def bigrams_py(text: str) -> list[str]:
    out: list[str] = []
    for w in re.findall(r"\w+", fold_py(text)):
        out += [w[i : i + 2] for i in range(max(len(w) - 1, 1))]
    return out


def compact(text: Column) -> Column:
    """Without white space, folded."""
    return fold(F.regexp_replace(text, r"(?U)\s+", ""))


def filter_key(value: Column) -> Column:
    """Letters and digits alone, folded, with one long form of a city name shortened."""
    return fold(F.regexp_replace(F.regexp_replace(value, "서울특별시", "서울시"), r"[^\p{L}\p{N}]", ""))


# What cleaning replaces, in order. Patterns are Java's; (?U) makes \s cover Unicode spaces.
CLEANING = (
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F-\x{F0000}-\x{10FFFF}]", ""),
    (r"[·.…ㆍ‥․]{5,}", " "),
    (r"(?U)[^\S\n]+", " "),
    (r" *\n *", "\n"),
    (r"(?m)^- ?이 ?하 ?여 ?백 ?-\n?", ""),
    (r"\(?이 ?하 ?여 ?백\)?\n?", ""),
    (r"(?m)^- ?본 ?페이지 *-\n?", ""),
    (r"\[\n+\]", "[ ]"),
    (r"□\n+√", "☑"),
    (r"(?U)Ÿ\s*", "• "),
    (r"(?mU)(^|\s)­ ?", "$1• "),
    (r"­", "-"),
)


def despaced_lines(text: Column) -> Column:
    """A line that is single Hangul syllables with spaces between, three or more, loses the spaces."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike("^(?:[가-힣] ){2,}[가-힣]$"), F.replace(x, F.lit(" "), F.lit(""))).otherwise(x)), "\n")


def despaced_labels(text: Column) -> Column:
    """Labels of two to four spaced syllables before a colon lose their spaces, one length at a time."""
    for n in (4, 3, 2):
        label = " ".join(["([가-힣])"] * n)
        text = F.regexp_replace(text, rf"(?<![가-힣])(?<![가-힣] ){label}(?=\s*[:：])", "".join(f"${i + 1}" for i in range(n)))
    return text


def clean(text: Column) -> Column:
    """Layout cleaning of NFC text: control characters, dot leaders, white space, filler lines, broken glyphs, spaced headings."""
    for pattern, to in CLEANING:
        text = F.regexp_replace(text, pattern, to)
    text = despaced_labels(despaced_lines(text))
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def cell_text(text: Column) -> Column:
    """One line of a table cell: white space collapsed, bars replaced, spaced syllables joined."""
    flat = F.replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), F.lit("|"), F.lit("/"))
    return F.when(flat.rlike("^(?:[가-힣] ){2,}[가-힣]$"), F.replace(flat, F.lit(" "), F.lit(""))).otherwise(flat)


def cell_text_py(text: str | None) -> str:
    flat = " ".join((text or "").split()).replace("|", "/")
    return flat.replace(" ", "") if re.fullmatch("(?:[가-힣] ){2,}[가-힣]", flat) else flat


def citation_brackets(answer: Column) -> Column:
    """Full-width brackets around numbers become plain ones."""
    return F.regexp_replace(answer, r"[【［〔]\s*(\d+)\s*[】］〕]", "[$1]")


def token_estimate(text: Column, instruction: str = "") -> Column:
    """Hangul and Han characters count one each, three others count one, and ten are added."""
    whole = F.concat(F.lit(instruction + "\n"), F.coalesce(text, F.lit("")))
    wide = F.regexp_count(whole, F.lit(r"[ㄱ-ㆎ가-힣一-鿿]"))
    return (wide + F.ceil((F.length(whole) - wide) / 3) + 10).cast("long")


def document_key(filename: Column) -> Column:
    return F.substring(F.sha2(filename, 256), 1, 16)


def text_hash(text: Column) -> Column:
    """SHA-256 of text with line endings normalised."""
    return F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256)


def markdown_cell(value: object) -> str:
    """A value as inline code of a Markdown table."""
    flat = re.sub(r"[\r\n]+", " ", str(value)).replace("|", "&#124;").replace("`", "'")
    return f"`{flat}`"
