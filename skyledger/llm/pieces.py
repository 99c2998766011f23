"""Encoding texts piece by piece, where white space is a proven boundary of the tokenizer.

Both byte-pair vocabularies cut a text into pre-tokens before any merge, and no pre-token
reaches over a white-space run. A piece between two such cuts therefore has the same ids in
every text, so a worker encodes it once. ``TwoAges`` bounds the memory: entries not used
since the last turnover are dropped and simply encoded anew when they return. Where many
texts come at once, their different pieces are encoded many in a row and not kept.
"""

from __future__ import annotations

import codecs
import functools
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

DOUBLE_SPACE = re.compile(r"\s\s")
#: What Python's patterns and ``split`` take for white space.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTERS = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}"
#: From so many characters on texts are encoded together. Pieces in a row, which is then too long for the tokenizer's own cache, and rows at a time.
TOGETHER_CHARS, ROW_PIECES, ROWS = 1 << 19, 100, 64
LATIN_END, DOTTED_I = 0x180, "İ"


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str, plain_specials: bool = False):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = plain_specials
    return tok


class TwoAges(dict):
    """Computes missing values and keeps what the present or the last age of ``age`` entries used."""

    def __init__(self, make, age: int = 300_000):
        super().__init__()
        self.make, self.age, self.old = make, age, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.age:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


def _byte_chars() -> str:
    """The printable stand-in of each byte in byte-level vocabularies (a fixed, published rule)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(spare)) for b in range(256))


_BYTE_CHARS = _byte_chars()
_BYTES = dict(enumerate(_BYTE_CHARS))
_SPACE = _BYTES[32]


def _model_text(piece: str) -> str:
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)


def _latin_word(piece: str) -> bool:
    return piece.isalpha() and (piece.isascii() or (max(map(ord, piece)) < LATIN_END and DOTTED_I not in piece))


class FieldCounter:
    """Token counts with a tokenizer that drops white space and lower-cases; fields are cached."""

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.counts = TwoAges(self._make)
        self.tails = {c: len(self.tok.encode(c, add_special_tokens=False)) for c in ".,"}

    def _make(self, field: bytes) -> int:
        piece = field.decode()
        if _latin_word(piece):
            return len(self.tok.model.tokenize(_model_text(piece.lower())))
        if piece[-1:] in self.tails and _latin_word(piece[:-1]):
            return self.counts[field[:-1]] + self.tails[piece[-1]]
        return len(self.tok.encode(piece, add_special_tokens=False))

    def count(self, texts: list[str]) -> list[int]:
        get = self.counts.__getitem__
        return [sum(map(get, t.encode().split())) for t in texts]


class ByteLevelEncoder:
    """Ids of a byte-level vocabulary as little-endian bytes of ``width`` each, piece by piece.

    ``plain_specials`` treats the strings of special tokens inside texts as ordinary text.
    """

    def __init__(self, path: str, width: int = 2, plain_specials: bool = False):
        self.tok = load_tokenizer(path, plain_specials)
        self.width, self.code = width, {2: "H", 4: "I"}[width]
        # Words that begin a line are few; both caches live as long as the worker.
        self.first = TwoAges(lambda p: self._make(p, "", self.first), 50_000)
        self.rest = TwoAges(lambda p: self._make(p, " ", self.rest), 200_000)
        self.newline = self._whole("\n")
        self.tails = {c: self._whole(c) for c in ".,"}
        # The vocabulary's merges alone, for words that need no cutting first, and what its tokens begin with and join.
        self.merges = Tokenizer(self.tok.model)
        names = self.tok.get_vocab()
        which = lambda test: np.isin(np.arange(max(names.values()) + 1), [i for x, i in names.items() if test(x)])
        self.begins = {c: which(lambda x, b=_BYTES[ord(c)]: x.startswith(b)) for c in " \n"}
        self.joins = which(lambda x: _SPACE in x[1:] or (len(x) > 1 and not self.tails.keys().isdisjoint(x)))

    def _bytes(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tok.encode(text, add_special_tokens=False).ids)

    def _make(self, piece: str, lead: str, cache: TwoAges) -> bytes:
        if _latin_word(piece):
            start = _SPACE if lead else ""
            return self._bytes([t.id for t in self.tok.model.tokenize(start + _model_text(piece))])
        if piece[-1:] in self.tails and _latin_word(piece[:-1]):
            return cache[piece[:-1]] + self.tails[piece[-1]]
        return self._whole(lead + piece)

    def _row(self, pieces: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces one after another, and where each begins; ``kind`` is what precedes each.

        A piece begins with the one token of its own that begins with the space or line feed. Of words the merges
        alone are taken: one over a space or before a tail would leave a token that joins them, and without such
        a token each was merged by itself.
        """
        if not pieces:
            return np.zeros(0, f"<u{self.width}"), np.zeros(0, "int64")
        lead = "\n" if kind == "line" else " "
        rows = [lead + lead.join(pieces[i : i + ROW_PIECES]) for i in range(0, len(pieces), ROW_PIECES)]
        if kind == "word":
            rows = [codecs.charmap_decode(r.encode(), "strict", _BYTE_CHARS)[0] for r in rows]
        tok, ids = self.merges if kind == "word" else self.tok, []
        for i in range(0, len(rows), ROWS):
            ids += [np.array(e.ids, f"<u{self.width}") for e in tok.encode_batch_fast(rows[i : i + ROWS], add_special_tokens=False)]
        ids = np.concatenate(ids)
        begins = np.flatnonzero(self.begins[lead][ids])
        if len(begins) != len(pieces) or (kind == "word" and self.joins[ids].any()):
            return self._singly([lead + p if kind == "line" else p for p in pieces])
        return ids, begins

    def _singly(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [self.newline + self._whole(p[1:]) if p[:1] == "\n" else self._whole(" " + p) for p in pieces]
        sizes = np.array([len(r) // self.width for r in raw], "int64")
        return np.frombuffer(b"".join(raw), f"<u{self.width}"), np.cumsum(sizes) - sizes

    def _different(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different pieces, in an order of their own, and where those of each begin and how many they are.

        A piece follows a space, or begins with the line feed that it follows.
        """
        said = lambda pattern: np.asarray(pc.match_substring_regex(pieces, pattern).cast("uint8")).astype(bool)
        word, line, single = said(rf"^[{LETTERS}]+[.,]?$"), said(r"^\n"), said(rf"^\n?[^{SPACES}]+$")
        begins, sizes, every, before = np.zeros(len(pieces), "int64"), np.zeros(len(pieces), "int64"), [], 0
        for kind, chosen in (("word", word), ("piece", single & ~word & ~line), ("line", single & line), ("", ~single)):
            named = pieces.filter(pa.array(chosen)).to_pylist()
            if kind:
                ids, at = self._row([p[1:] for p in named] if kind == "line" else named, kind)
            else:
                ids, at = self._singly(named)
            begins[chosen], sizes[chosen] = at + before, np.diff(np.append(at, len(ids)))
            every.append(ids)
            before += len(ids)
        return np.concatenate(every), begins, sizes

    def _together(self, texts: list[str]) -> list[bytes]:
        # Every line is a piece after a space, the first one too, so each text begins with an empty piece and a line feed.
        lines = [" \n" + t.replace("\n", " \n") for t in texts]
        split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        coded = pc.dictionary_encode(split.values)
        ids, begins, sizes = self._different(coded.dictionary)
        codes, edges = np.asarray(coded.indices), np.asarray(split.offsets)
        lengths = sizes[codes]
        lengths[edges[:-1]] = 0
        ends = np.concatenate([[0], np.cumsum(lengths)])
        gathered = ids[np.repeat(begins[codes] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        spots = (ends[edges] * self.width).tolist()
        return [gathered[a + len(self.newline) : b] for a, b in zip(spots, spots[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if sum(map(len, texts)) < TOGETHER_CHARS:
            return self._kept(texts)
        # The byte-level pattern looks ahead in white-space runs, so such a text is encoded whole.
        whole = [DOUBLE_SPACE.search(t) is not None for t in texts]
        together = iter(self._together([t for t, w in zip(texts, whole) if not w]))
        return [self._whole(t) if w else next(together) for t, w in zip(texts, whole)]

    def _kept(self, texts: list[str]) -> list[bytes]:
        """Ids by the caches."""
        start, after = self.first.__getitem__, self.rest.__getitem__
        out = []
        for text in texts:
            if DOUBLE_SPACE.search(text):
                # The byte-level pattern looks ahead in white-space runs, so such a text is encoded whole.
                out.append(self._whole(text))
                continue
            lines = []
            for line in text.split("\n"):
                begin, *rest = line.split(" ")
                lines.append(start(begin) + b"".join(map(after, rest)))
            out.append(self.newline.join(lines))
        return out


@functools.lru_cache(maxsize=1)
def field_counter(path: str) -> FieldCounter:
    """The worker's counter; its cache outlives a task."""
    return FieldCounter(path)


@functools.lru_cache(maxsize=1)
def byte_encoder(path: str, width: int = 2, plain_specials: bool = False) -> ByteLevelEncoder:
    """The worker's encoder; its caches outlive a task."""
    return ByteLevelEncoder(path, width, plain_specials)
