"""SentencePiece models of the merge type: exact encoding by backtracking, and decoding.

A sequence of tokens is what the merges give if and only if merging the text of each two neighbours anew gives these
two: the merges go by (score, place), so the first one to cross a border between two tokens would cross it in the text
of these two alone as well. A text has one such sequence. It is found from left to right: the longest token that
starts at a place (Aho-Corasick over the vocabulary) is tried, then its shorter prefixes, until one is compatible with
the token before it; if none is, that token is taken back and shortened. A bit for each place remembers the dead ends,
so no place is left twice.

Two characters that no token holds side by side are a border that no merge crosses. Texts are cut there, and a task
remembers what the stretches between spaces give.
"""

from __future__ import annotations

import re
import struct
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import with_arrow

#: The sign that stands for a space in a model file. Here tokens hold the space itself, and the sign in a text is one.
SPACE_SIGN = "▁"
#: Kinds of tokens in a model file. Fixed values of the format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Kinds of models in a model file: merges are 2. Fixed value of the format.
MERGES = 2
#: Stretches and pairs of tokens that a task remembers; at this many it starts afresh.
REMEMBERED = 700_000
#: Longer stretches aren't remembered.
LONG = 64


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of an encoded protocol message; values that aren't numbers are bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, message[at : at + size]
            at += size


class Stretches(dict):
    """The packed ids of the stretches that were seen, up to REMEMBERED of up to LONG characters each."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, text: str) -> bytes:
        ids = array("I", self.model.stretch(text))
        if sys.byteorder == "big":
            ids.byteswap()
        packed = ids.tobytes()
        if len(text) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = packed
        return packed


class PieceModel:
    """The vocabulary of a model file. Others than merges with byte fallback over texts as they are (no character map, no tokens of the user, no white space taken out) are refused."""

    def __init__(self, content: bytes):
        trainer, normal = {}, {}
        self.tokens: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for n, value in fields(content):
            if n == 1:
                piece = dict(fields(value))
                self.tokens.append(piece.get(1, b"").decode().replace(SPACE_SIGN, " "))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif n == 2:
                trainer = dict(fields(value))
            elif n == 3:
                normal = dict(fields(value))
        wrong = [trainer.get(3) != MERGES, not trainer.get(35, 0), trainer.get(24, 0), normal.get(2, b""), normal.get(4, 1), not normal.get(3, 1), not normal.get(5, 1), set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}]
        if any(wrong):
            raise ValueError("only models of merges with byte fallback, a space put in front and no other change of the text")
        self.begin, self.end = (int(trainer.get(n, default)) for n, default in ((41, 1), (42, 2)))
        self.score = {t: s for t, s, k in zip(self.tokens, scores, self.kinds) if k == NORMAL}
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.tokens, self.kinds)) if k == NORMAL}
        self.side_by_side = {t[i : i + 2] for t in self.score for i in range(len(t) - 1)}
        if any(c not in self.score for c in {c for t in self.score for c in t}):
            raise ValueError("a character of a token isn't a token itself")
        if any(a != " " and b == " " for a, b in self.side_by_side):
            raise ValueError("a token with a space behind other characters")
        self.byte_ids = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.tokens, self.kinds)) if k == BYTE}
        if len(self.byte_ids) < 256:
            raise ValueError("no token for some byte")
        reachable = {t: self.ids[t] for t in self.score if self.merged(t) == [t]}
        self.length = [len(t) for t in self.tokens]
        #: The longest token that is shorter than one and starts it; -1: none.
        self.shorter = [next((reachable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in reachable), -1) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for t, i in reachable.items():
            self.automaton.add_word(t, (len(t) - 1, i))
        self.automaton.make_automaton()
        self.characters = {t for t in self.score if len(t) == 1}
        self.fitting: dict[int, bool] = {}
        self.known = Stretches(self)
        texts = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.encode() for t, k in zip(self.tokens, self.kinds)]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.kind = np.array(self.kinds, np.int8)

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best score first, the leftmost of equals."""
        symbols, score = list(text), self.score
        while True:
            best, at = -np.inf, -1
            for i, (left, right) in enumerate(zip(symbols, symbols[1:])):
                found = score.get(left + right)
                if found is not None and found > best:
                    best, at = found, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges keep the border between two neighbouring tokens."""
        known = self.fitting.get(left << 32 | right)
        if known is None:
            if len(self.fitting) >= REMEMBERED:
                self.fitting.clear()
            one, two = self.tokens[left], self.tokens[right]
            known = self.fitting[left << 32 | right] = one[-1] + two[0] not in self.side_by_side or self.merged(one + two) == [one, two]
        return known

    def backtracked(self, text: str) -> list[int]:
        """The ids of a text all of whose characters are tokens."""
        n = len(text)
        longest = [-1] * (n + 1)
        for end, (before, token) in self.automaton.iter(text):
            longest[end - before] = token  # ends ascend: the longest of a start comes last
        length, shorter, fits, fitting = self.length, self.shorter, self.fits, self.fitting
        dead, none_dead = bytearray((n >> 3) + 1), True
        out: list[int] = []
        at, last, trial = 0, -1, longest[0]
        while at < n:
            while trial >= 0:
                end = at + length[trial]
                if (none_dead or not dead[end >> 3] >> (end & 7) & 1) and (last < 0 or fitting.get(last << 32 | trial) or fits(last, trial)):
                    break
                trial = shorter[trial]
            if trial >= 0:
                out.append(trial)
                at, last = end, trial
                trial = longest[at]
            else:
                dead[at >> 3] |= 1 << (at & 7)
                none_dead = False
                trial = out.pop()
                at -= length[trial]
                trial = shorter[trial]
                last = out[-1] if out else -1
        return out

    def stretch(self, text: str) -> list[int]:
        """The ids of a stretch: cut at characters without a token, which give bytes, and a long one at borders that no token crosses."""
        plain = self.characters.issuperset(text)
        if plain and len(text) <= LONG:
            return self.backtracked(text)
        out: list[int] = []
        start, beside = 0, self.side_by_side
        for i, c in enumerate(text):
            if c not in self.characters:
                out += self.backtracked(text[start:i])
                out += [self.byte_ids[b] for b in c.encode()]
                start = i + 1
            elif i > start and text[i - 1 : i + 1] not in beside:
                out += self.backtracked(text[start:i])
                start = i
        return out + self.backtracked(text[start:])

    def stretches(self, text: str) -> Iterator[list[str]]:
        """Lists of what stands between the spaces, a run of spaces being in front of what follows it; all of them in a row are the text behind a space."""
        text = " " + text.replace(SPACE_SIGN, " ")
        if len(text) <= 1 << 20:
            yield re.findall(" *[^ ]+| +", text)
            return
        found = re.finditer(" *[^ ]+| +", text)
        while some := [m[0] for m in islice(found, 1 << 16)]:
            yield some

    def encode(self, text: str, begin: bool = False, end: bool = False) -> bytes:
        """The ids as packed little-endian unsigned 32-bit integers; an empty text has none of its own."""
        out = [struct.pack("<I", self.begin)] if begin else []
        for some in self.stretches(text) if text else ():
            out += map(self.known.__getitem__, some)
        return b"".join(out + ([struct.pack("<I", self.end)] if end else []))

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of the text of ids: without the one space in front, a byte that makes no character being U+FFFD."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("no such id")
        shown = ids[self.kind[ids] != CONTROL]
        strip = bool(len(shown)) and self.tokens[shown[0]].startswith(" ") and self.kinds[shown[0]] == NORMAL
        whole = self._bytes(shown)
        if (self.kind[shown] == BYTE).any():
            try:
                whole.decode()
            except UnicodeDecodeError:
                whole = b"".join(self._characters(self._bytes(run)) if self.kind[run[0]] == BYTE else self._bytes(run) for run in np.split(shown, np.flatnonzero(np.diff(self.kind[shown] == BYTE)) + 1))
        return whole[1:] if strip else whole

    def _bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + sizes, sizes)].tobytes()

    @staticmethod
    def _characters(run: bytes) -> bytes:
        """A run of bytes with U+FFFD for each that belongs to no whole character."""
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    run[at : at + n].decode()
                except UnicodeDecodeError:
                    continue
                out.append(run[at : at + n])
                at += n
                break
            else:
                out.append("�".encode())
                at += 1
        return b"".join(out)


@lru_cache(2)
def model_of(content: bytes) -> PieceModel:
    """One model a worker process: later tasks find what it remembers."""
    return PieceModel(content)


def _shared(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))


def piece_encode(df: DataFrame, model_path: str, text: str = "text", out: str = "ids", begin: bool = True, end: bool = True) -> DataFrame:
    """``df`` with ``out``: each whole text's token ids as array<int>, with the begin and end ids if asked for; null and empty texts have no others.

    ``model_path`` is read on the driver and broadcast: its size is that of a vocabulary, not of the data. Characters without a token give the tokens of
    their bytes. Texts may have any length: they are cut into stretches, and one unbroken stretch takes time in proportion to its length. A column of
    ``df`` named like ``out`` is replaced.
    """
    content = _shared(df, model_path)

    def make():
        model = model_of(content.value)
        return lambda batch: [_lists([model.encode(x or "", begin, end) for x in batch.column(text).to_pylist()])]

    return with_arrow(df, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], make)


def piece_decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text of each row's token ids, as the tokens' own library decodes them; a null array gives an empty text."""
    content = _shared(df, model_path)

    def make():
        model = model_of(content.value)
        return lambda batch: [pa.array([model.decode(np.array(x or [], np.int64)).decode() for x in batch.column(ids).to_pylist()], pa.string())]

    return with_arrow(df, ids, [T.StructField(out, T.StringType())], make)


def piece_round_trip(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the ``ids`` of ``piece_encode`` (packed, 4 bytes each, little-endian) and the text that ``piece_decode`` gives for them, in one pass."""
    content = _shared(df, model_path)

    def make():
        model = model_of(content.value)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            packed = [model.encode(x or "", True, True) for x in batch.column(text).to_pylist()]
            return [pa.array(packed, pa.binary()), pa.array([model.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in packed], pa.binary()).cast(pa.string())]

        return step

    return with_arrow(df, text, [T.StructField(ids, T.BinaryType()), T.StructField(out, T.StringType())], make)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 (of the packed ids) and decoded_sha256, in place of the packed ids and the text."""
    return df.withColumns({"n_tokens": (F.octet_length(ids) / 4).cast("long"), "ids_sha256": F.sha2(F.col(ids), 256), "decoded_sha256": F.sha2(F.col(decoded).cast("binary"), 256)}).drop(ids, decoded)
