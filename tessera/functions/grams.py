"""Character bigrams of many texts at once, as numbers: the two code points of a pair, or the one of a one-letter word.

The same multiset as text.bigrams(), for operators that work on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.functions.text import fold_py

#: Bits of a code point.
BITS = 21
#: Characters that one step works on; a longer text is a step of its own.
STEP = 1 << 20
_WORD: list[np.ndarray] = []


def word_characters() -> np.ndarray:
    """Whether each code point belongs to words: letters, numbers and the underscore."""
    if not _WORD:
        table = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        table[ord("_")] = True
        _WORD.append(table)
    return _WORD[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all bigrams of the texts in order, and the text of each."""
    folded = [fold_py(t) for t in texts]
    flat = np.frombuffer(("\n".join(folded) + "\n").encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(folded)), np.fromiter((len(t) + 1 for t in folded), np.int64, len(folded)))
    word = word_characters()[flat]
    following = np.append(word[1:], False)
    here = np.flatnonzero(word & (following | ~np.append(False, word[:-1])))
    code = flat[here] << BITS
    pair = following[here]
    code[pair] |= flat[here[pair] + 1]
    return code, row[here]


def gram_text(code: int) -> str:
    second = code & (1 << BITS) - 1
    return chr(code >> BITS) + (chr(second) if second else "")


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text number, code and count of each different bigram of each text, in that order, and how many bigrams each text has."""
    code, row = grams(texts)
    kinds, at = np.unique(code, return_inverse=True)
    key, n = np.unique(row * max(len(kinds), 1) + at, return_counts=True)
    return key // max(len(kinds), 1), kinds[key % max(len(kinds), 1)] if len(kinds) else code, n, np.bincount(row, minlength=len(texts))


def steps(batch: pa.RecordBatch, column: str = "text", size: int = STEP) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about size bytes together."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    if not len(lengths):
        return
    at = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1).tolist(), len(lengths)]
    for a, b in zip(at, at[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]
