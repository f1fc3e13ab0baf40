"""Byte-pair encoding of a corpus with a public vocabulary, by prefix dynamic programming.

For every prefix of a piece of bytes exactly one token can be the last one of the
prefix's encoding. It is the token that ends there and may follow the (already
known) last token of the prefix before it. Two tokens may stand side by side if
undoing their merges, newest first, never meets a merge across their border that
the encoder would have done earlier. So one pass from the left, no merging and
no heap, gives the encoding; the stored last tokens also give the encoding of
every prefix, an append goes on where the table ends, and after an edit only the
pieces around it are encoded again.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Pieces kept ready per Python worker; beyond it the store starts anew.
READY = 400_000
#: Ids gathered before a batch of results leaves the worker, so that very long texts do not add up.
FLUSH = 1_000_000

# Fixed value: how byte_bpe_50k cuts text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Tokens of a rank file (``<base64 bytes> <rank>`` a line); ids are merge ranks."""

    def __init__(self, path: str, pattern: str = PIECES):
        self.ids: dict[bytes, int] = {}
        for line in Path(path).read_bytes().splitlines():
            if line:
                token, rank = line.split()
                self.ids[base64.b64decode(token)] = int(rank)
        self.longest = max(map(len, self.ids))
        self.cut = regex.compile(pattern)
        self._token = {i: t for t, i in self.ids.items()}
        self._halves: dict[int, tuple[int, int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._ready: dict[str, tuple[int, ...]] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made ``token``; itself twice for a single byte.

        Of all splits into two tokens it is the one that is itself an encoding under
        the ranks below ``token``: its halves may stand side by side once the merge
        that joins them is set aside.
        """
        found = self._halves.get(token)
        if found is None:
            raw = self._token[token]
            found = (token, token)
            for k in range(1, len(raw)):
                a, b = self.ids.get(raw[:k]), self.ids.get(raw[k:])
                if a is not None and b is not None and a < token and b < token and self._border_holds(a, b, token):
                    found = (a, b)
                    break
            self._halves[token] = found
        return found

    def _border_holds(self, left: int, right: int, below: int) -> bool:
        """Whether no merge under ``below`` crosses the border of two encodings' tokens.

        Take the newer of the two tokens apart, again and again; at each step the
        tokens that touch must not be a merge older than what was just undone.
        """
        joined = self.ids.get(self._token[left] + self._token[right])
        if joined is not None and joined < below:
            return False
        while True:
            if left > right:
                undone = limit = left  # a merge to the left is done before the border's of equal rank
                left = self.halves(left)[1]
            else:
                undone, limit = right, right + 1  # and one to the right after it
                right = self.halves(right)[0]
            if len(self._token[undone]) == 1:
                return True  # single bytes have the lowest ids, so both are single now
            joined = self.ids.get(self._token[left] + self._token[right])
            if joined is not None and joined < limit:
                return False

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``left, right`` is the encoding of their bytes."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            known = self._border_holds(left, right, 1 << 62)
            if len(self._fits) > 4 * READY:
                self._fits.clear()
            self._fits[key] = known
        return known

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Go on with the table of last tokens: ``last[i]`` ends the prefix of ``i + 1`` bytes.

        ``last`` may be empty or belong to a shorter prefix of ``piece``.
        """
        ids = self.ids
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ids.get(piece[start:end])
                if token is None:
                    continue
                if start == 0:
                    if end == 1 or self.halves(token)[0] != token:
                        last.append(token)
                        break
                elif self.may_follow(last[start - 1], token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        last = self.extend(piece, [])
        out, end = [], len(piece)
        while end:
            out.append(last[end - 1])
            end -= len(self._token[last[end - 1]])
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``; text that looks like a special token is ordinary text."""
        out: list[int] = []
        ready = self._ready
        for piece in self.cut.findall(text):
            ids = ready.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8", "replace"))
                if len(ready) >= READY:
                    ready.clear()
                if len(piece) <= 64:
                    ready[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self._token[i] for i in ids).decode("utf-8", "replace")


class Encoded:
    """An encoded text that can be appended to and edited.

    Keeps the pieces with their places and ids. After a change, pieces are cut
    anew from the last piece that ends well before it until a new piece ends
    where an old one did behind the change; only those are encoded.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self._starts: list[int] = []
        self._ids: list[tuple[int, ...]] = []
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for piece in self._ids for i in piece]

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> int:
        """Put ``text`` in the place of ``[start, end)``; returns how many pieces were encoded."""
        self_text = self.text[:start] + text + self.text[end:]
        shift = len(text) - (end - start)
        # Look-ahead and a run of white space reach back over one piece; two are safe.
        first = max(0, bisect_left(self._starts, start) - 2)
        at = self._starts[first] if first < len(self._starts) else 0
        old_after = {s + shift: k for k, s in enumerate(self._starts) if s > end}
        starts, ids, done = self._starts[:first], self._ids[:first], 0
        rest: tuple[list[int], list[tuple[int, ...]]] = ([], [])
        for m in self.vocabulary.cut.finditer(self_text, at):
            k = old_after.get(m.start())
            if k is not None and m.start() > start + len(text):
                rest = ([s + shift for s in self._starts[k:]], self._ids[k:])
                break
            starts.append(m.start())
            ids.append(self.vocabulary.encode_piece(m.group().encode("utf-8", "replace")))
            done += 1
        self.text, self._starts, self._ids = self_text, starts + rest[0], ids + rest[1]
        return done


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> Vocabulary:
    """The vocabulary, loaded once per Python worker."""
    path = str(Path(folder) / f"{name}.tiktoken")
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_column(
    df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = VOCABULARY
) -> DataFrame:
    """``(key, ids)`` of every row: ``ids`` are the token ids of the whole text.

    No special tokens. An empty and a null text have the ids ``[]``. Rows are
    encoded where they lie, without a shuffle; other columns are not read. Repeated
    rows and null keys keep their rows.
    """
    return df.select(F.col(key), F.col(text)).mapInArrow(
        _encoder(folder, name), f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>"
    )


def _encoder(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(folder, name)
        for batch in batches:
            ids, ends, first = array("i"), [0], 0
            for row in range(batch.num_rows):
                t = batch.column(1)[row].as_py()
                if t:
                    ids.extend(words.encode(t))
                ends.append(len(ids))
                if len(ids) >= FLUSH or row + 1 == batch.num_rows:
                    column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, "int32") if ids else [], pa.int32()))
                    keys = batch.column(0).slice(first, len(ends) - 1)
                    yield pa.RecordBatch.from_arrays([keys, column], [batch.schema.names[0], "ids"])
                    ids, ends, first = array("i"), [0], row + 1

    return run


def count_tokens(
    df: DataFrame, keep: list[str], text: str, folder: str = TOKENIZERS, name: str = VOCABULARY
) -> DataFrame:
    """``keep`` columns and ``tokens``, the number of ids of the text (0 for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(folder, name)
        for batch in batches:
            counts = [len(words.encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[: len(keep)], pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "tokens"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, fields + ", tokens long")
