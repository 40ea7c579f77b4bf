"""Encoding and decoding with a SentencePiece BPE model.

The vocabulary is that of the given model file, of merge type: any two
neighbours whose concatenation is a piece may merge, the best score first. Such
an encoding has two properties that make it a table of prefixes: the last token
of every prefix of a text is unique, and a sequence is the encoding exactly if
each of its neighbouring pairs is the encoding of its own concatenation. So for
every prefix the automaton lists the pieces that end there, and the one that is
compatible with the last token of the prefix before it is stored; ids are then
read from the end backwards.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from patchloom.llm.common import add_columns

SPACE = "▁"
#: Entries after which a worker's memo of segments is turned, and that of pairs emptied. Two turns of segments are kept.
MEMO, PAIRS = 100_000, 450_000
#: The score of what does not merge.
NEVER = float("-inf")


class _Memo(dict):
    """What ``make`` says of texts; those of up to 64 characters are kept until two turns pass without them."""

    def __init__(self, make):
        self.make, self.before = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.before.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= 64:
            self[text] = found
        return found

    def turn(self) -> None:
        """Forget what was not asked for since the last turn."""
        self.before = dict(self)
        self.clear()


class PieceTable:
    """Prefix table encoder and decoder for one model."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in ids]
        ordinary = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {pieces[i]: i for i in ordinary}
        self.score = {pieces[i]: sp.get_score(i) for i in ordinary}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = sp.eos_id()
        self.pieces, self.size, self.lengths = pieces, len(pieces), [*map(len, pieces)]
        self.surface = [p.replace(SPACE, " ").encode() for p in pieces]
        for i in ids:
            if sp.is_control(i):
                self.surface[i] = b""
            elif sp.is_byte(i):
                self.surface[i] = bytes([int(pieces[i][1:-1], 16)])
        self.known = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        self.parts: dict[str, list[str]] = {}
        for piece, i in self.ids.items():
            steps = [*self._merging(piece)]
            if len(steps[-1]) == 1:
                self.automaton.add_word(piece, (i, len(piece)))
                self.parts[piece] = steps[-2] if len(steps) > 1 else []
        self.automaton.make_automaton()
        self.segment = self._segments()
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[str, float]]] = {}
        self.memo = _Memo(self._encode_segment)

    def _segments(self) -> re.Pattern:
        """Segments that no piece reaches across, so that each can be encoded by itself.

        No piece may hold a space mark behind another character. If also none holds
        a letter next to a character that is neither letter nor space mark, segments end there too.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile(r"(?s).+")
        # raised digits, fractions and the like are word characters, but pieces have them beside points
        figures = {c for c in "".join(self.ids) if re.match(r"[^\W\d_]", c) and not c.isalpha()}
        other = r"\d_" + re.escape("".join(sorted(figures)))
        letter = rf"[^\W{other}]"
        mixed = re.compile(rf"{letter}(?!{letter}).|(?!{letter}|{SPACE}).{letter}", re.S)
        if any(mixed.search(p) for p in self.ids):
            return re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(rf"{SPACE}*(?:[A-Za-z]+{letter}*|{letter}+|(?:[^\w{SPACE}]+|[{other}]+)+)|{SPACE}+")

    def _merging(self, text: str):
        """The states of a short text while its best pair is merged again and again."""
        parts = list(text)
        yield parts
        while len(parts) > 1:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            at = scores.index(best)
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
            yield parts

    def _edge(self, piece: int, side: int) -> list[tuple[str, float]]:
        """What stands at one side (0 left, -1 right) of a piece at each step of its merging, and the next merge's score."""
        found = self.edges.get((piece, side))
        if found is None:
            found = self.edges[piece, side] = []
            for parts in self._merging(self.pieces[piece]):
                scores = (self.score.get(a + b, NEVER) for a, b in zip(parts, parts[1:]))
                found.append((parts[side], max(scores, default=NEVER)))
        return found

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two pieces' concatenation is these two; kept for the next time.

        Both are merged side by side, the best score first and left of right, until
        what meets in the middle is due to merge or both are done.
        """
        left, right = iter(self._edge(a, -1)), iter(self._edge(b, 0))
        (x, p), (y, q) = next(left), next(right)
        while not (across := (s := self.score.get(x + y, NEVER)) > p and s >= q) and max(p, q) > NEVER:
            if p >= q:
                x, p = next(left)
            else:
                y, q = next(right)
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a * self.size + b] = not across
        return not across

    def _encode_known(self, text: str) -> list[int]:
        last, pairs, n = [-1] * len(text), self.pairs, self.size
        for end, (piece, size) in self.automaton.iter(text):
            if last[end] < 0:
                if size > end:
                    last[end] = piece
                else:
                    before = last[end - size]
                    fits = pairs.get(before * n + piece)
                    if fits or fits is None and self._compatible(before, piece):
                        last[end] = piece
        out, end = [], len(text)
        while end > 0:
            piece = last[end - 1]
            out.append(piece)
            end -= self.lengths[piece]
        return out[::-1]

    def _encode_segment(self, text: str) -> bytes:
        if self.known.issuperset(text):
            return array("i", self._encode_known(text)).tobytes()
        out = []
        for known, run in groupby(text, self.known.__contains__):
            run = "".join(run)
            out += self._encode_known(run) if known else [self.byte_ids[b] for b in run.encode()]
        return array("i", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text`` with a space mark before it, and the end id."""
        parts = self.segment.findall((SPACE + text).replace(" ", SPACE)) if text else []
        memo = self.memo
        if len(memo) >= MEMO:
            memo.turn()
        found = b"".join(map(memo.__getitem__, parts))
        return np.frombuffer(found + np.int32(self.end).tobytes(), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: one space mark in front is dropped, bytes are put together."""
        text = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        if first is not None and self.pieces[first].startswith(SPACE):
            text = text[1:]
        return text.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _load(digest: bytes, model: bytes) -> PieceTable:
    return PieceTable(model)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int, the end id last) and ``decoded`` (their text).

    Null and empty texts have the end id only and decode to an empty text. The
    model, of fixed size, goes to the workers with the function; every row is
    encoded whole and by itself, in one pass over the table without a shuffle.
    Long texts cost time in proportion to their length.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def start():
        table = _load(blake2b(model.value).digest(), model.value)

        def make(texts):
            found = [table.encode(t or "") for t in texts]
            ends = np.cumsum([0] + [len(x) for x in found])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
            return lists, [table.decode(x.tolist()) for x in found]

        return make

    return add_columns(docs, ["text"], "ids array<int>, decoded string", start, rows=64)
