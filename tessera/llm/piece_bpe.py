"""Encoding and decoding with a SentencePiece BPE model, by the merge-type prefix table.

The encoding of a text by merges has, for each of its prefixes, one last token; and the encoding of the prefix before
that token is the start of the same encoding. So a table of last tokens is filled from left to right: of the vocabulary
items that end at a place (an automaton finds them), one fits behind the last token of what is before it. Whether two
tokens may stand side by side depends on them alone. The ids are read off the table backwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import steps

SPACE = "▁"
#: Encoded words that a worker keeps; it starts anew when there are more.
KEPT_WORDS = 400_000
#: Answers for pairs of tokens that a worker keeps.
KEPT_PAIRS = 1_000_000


def message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message: numbers, or the bytes of strings and inner messages."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return out, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def check_settings(model: bytes) -> None:
    """Refuses a model whose settings this encoder does not follow, as its ids would not be the library's.

    That is any but a BPE model without normalisation, which puts a space in front, keeps all white space, marks it before a
    word and has no pieces defined by a user.
    """
    found = list(message(model))
    trainer, normaliser = ({k: v for raw in (x for f, x in found if f == n) for k, v in message(raw)} for n in (2, 3))
    wrong = {
        "is no BPE model": trainer.get(3, 1) != 2, "marks white space behind words": trainer.get(24, 0) == 1, "normalises its texts": bool(normaliser.get(2, b"")),
        "puts no space in front": normaliser.get(3, 1) != 1, "drops white space": normaliser.get(4, 1) != 0, "does not mark white space": normaliser.get(5, 1) != 1,
        "has pieces defined by a user": any(dict(message(x)).get(3, 1) == 4 for f, x in found if f == 1),
    }
    if any(wrong.values()):
        raise ValueError("the model " + " and ".join(k for k, bad in wrong.items() if bad))


class Vocabulary:
    """What encoding and decoding need of a model: at most a few MB, as large as the vocabulary."""

    def __init__(self, model: bytes):
        import sentencepiece

        check_settings(model)
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.control = [sp.is_control(i) for i in range(size)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(sp.is_byte(i) for i in self.byte_ids)
        self.surface = [b"" if c else p.replace(SPACE, " ").encode() for p, c in zip(pieces, self.control, strict=True)]
        self.surface[self.unk] = " ⁇ ".encode()
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)} if self.has_bytes else {}
        for i, b in self.byte_of.items():
            self.surface[i] = bytes([b])
        words = {p: i for i, p in enumerate(pieces) if not special[i] and p}
        # tokens are numbered by the order of their merges: single characters first, then by falling score
        chars = sorted({c for p in words for c in p})
        merges = sorted((p for p in words if len(p) > 1), key=lambda p: (-sp.get_score(words[p]), words[p]))
        self.tokens = [*chars, *merges]
        self.number = {p: n for n, p in enumerate(self.tokens)}
        self.ids = [words.get(p) for p in self.tokens]
        self.parts: list[tuple[int, int] | None] = [None] * len(self.tokens)
        self.made = [True] * len(self.tokens)
        for p in merges:
            left = self.merge(list(p), self.number[p])
            self.made[self.number[p]] = len(left) == 2
            if len(left) == 2:
                self.parts[self.number[p]] = (self.number[left[0]], self.number[left[1]])
        inner = {c for p in merges for c in p[1:]}
        first = {c for p in merges for c in p[:1]}
        spaces = all(SPACE not in p.lstrip(SPACE) for p in merges)
        breaks = "".join(c for c in "\n\t\r" if c not in inner | first)
        cut = re.escape(SPACE + breaks)
        self.pattern = rf"{SPACE}+[^{cut}]*|[{re.escape(breaks)}]|[^{cut}]+" if spaces and breaks else rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if spaces else r"(?s).+"

    def merge(self, symbols: list[str], below: int) -> list[str]:
        """Merges by rank below a limit, leftmost first."""
        while len(symbols) > 1:
            best = min(((self.number.get(a + b, below), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))), default=(below, 0))
            if best[0] >= below:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for n, p in enumerate(vocabulary.tokens):
            if vocabulary.made[n]:
                self.automaton.add_word(p, (n, len(p)))
        self.automaton.make_automaton()
        self.split = re.compile(vocabulary.pattern).findall
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' text is these two tokens.

        The merges on both sides of the border are undone from the last to the first. It fails if two parts that met
        there would have been merged before one of them was made.
        """
        number, tokens, parts = self.v.number, self.v.tokens, self.v.parts
        limit = len(tokens)  # merges across the border must come before this one to matter
        while True:
            across = number.get(tokens[a] + tokens[b])
            if across is not None and across < limit:
                return False
            # of the two merges the later one is undone; in a tie the right one, as merging goes from left to right
            pa_, pb = parts[a], parts[b]
            if pa_ is None and pb is None:
                return True
            if pb is None or (pa_ is not None and a > b):
                limit, a = a, pa_[1]
            else:
                limit, b = b + 1, pb[0]

    def encode_word(self, word: str) -> bytes:
        v = self.v
        n = len(word)
        last: list[int] = [-1] * (n + 1)  # token that ends each prefix; -1: a character outside the vocabulary
        width = [1] * (n + 1)
        fits, tokens = self.fits, self.v.tokens
        done = 0
        size = len(tokens)
        for end, (token, length) in self.automaton.iter(word):
            end += 1
            if end == done:
                continue
            start = end - length
            before = last[start]
            if start and before >= 0:
                key = before * size + token
                good = fits.get(key)
                if good is None:
                    if len(fits) >= KEPT_PAIRS:
                        fits.clear()
                    good = fits[key] = self.compatible(before, token)
                if not good:
                    continue
            last[end], width[end], done = token, length, end
        out: list[int] = []
        at = n
        while at:
            token = last[at]
            known = v.ids[token] if token >= 0 else None
            if known is not None:
                out.append(known)
            elif v.has_bytes:
                out.extend(v.byte_ids[b] for b in reversed(word[at - 1].encode()))
            elif not out or out[-1] != v.unk or at == n:
                out.append(v.unk)
            at -= width[at]
        out.reverse()
        return b"".join(i.to_bytes(4, "little") for i in out)

    def encode(self, text: str, bos: bool, eos: bool) -> bytes:
        known, out = self.words, [self.v.bos.to_bytes(4, "little")] if bos else []
        if text:
            for word in self.split(SPACE + text.replace(" ", SPACE)):
                ids = known.get(word)
                if ids is None:
                    ids = self.encode_word(word)
                    if len(word) < 64:
                        if len(known) >= KEPT_WORDS:
                            known.clear()
                        known[word] = ids
                out.append(ids)
        if eos:
            out.append(self.v.eos.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        v = self.v
        surface = v.surface
        at = next((k for k, i in enumerate(ids) if not v.control[i]), None)
        if at is None:
            return ""
        raw = b"".join([surface[i] for i in ids[at:]])
        if ids[at] not in v.byte_of and ids[at] != v.unk and raw[:1] == b" ":
            raw = raw[1:]  # the space that encoding put in front
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.decode_broken(ids[at:])

    def decode_broken(self, ids: list[int]) -> str:
        """Byte tokens that are no UTF-8: each such byte becomes a replacement character."""
        out, run = [], bytearray()

        def flush() -> None:
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode())
                        del run[:n]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    del run[:1]

        for k, i in enumerate(ids):
            if i in self.v.byte_of:
                run.append(self.v.byte_of[i])
                continue
            flush()
            piece = self.v.surface[i].decode()
            out.append(piece[1:] if k == 0 and i != self.v.unk and piece[:1] == " " else piece)
        flush()
        return "".join(out)


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """One encoder for each model and worker."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class Shared:
    """A broadcast vocabulary; its size is that of the model file."""

    def __init__(self, spark, vocabulary: Vocabulary):
        self.broadcast = spark.sparkContext.broadcast(vocabulary)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def encode_decode(docs: DataFrame, model_path: str, bos: bool = True, eos: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers, one after the other) and decoded text of every row.

    The ids are those of the sentencepiece library without sampling; decoded is what its decode(ids) gives. A null text is
    empty and has only the begin and end ids. model_path is read on the driver and its vocabulary is broadcast.
    """
    spark = docs.sparkSession
    shared = Shared(spark, Vocabulary(Path(model_path).read_bytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import array

        coder = encoder_of(shared)
        for batch in batches:
            for part in steps(batch):
                ids, decoded = [], []
                for text in part.column("text").to_pylist():
                    raw = coder.encode(text, bos, eos)
                    ids.append(raw)
                    decoded.append(coder.decode(array.array("I", raw).tolist()))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")
