"""Token counts by a public byte-level BPE, at the speed of a dictionary.

A text is cut at places that are token boundaries for certain: before a blank
that a visible character follows, and after a line feed that one follows.  The
parts repeat, so their lengths are remembered and a text costs one split and
one sum; the result equals encoding the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary lies; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts texts for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Remembered parts, and the longest one that is remembered.
CACHE, CACHED_CHARS = 400_000, 48

_CUT = re.compile(r" (?=\S)")
_INNER = re.compile(r"(?<=\n)(?=\S)|(?<=[。！？；，、：])(?=[^\W_])")


class _Lengths(dict):
    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> int:
        n = len(self.encode(" " + part))
        if len(part) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[part] = n
        return n


class Tokens:
    """One vocabulary in one Python worker."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes_of[i] = raw
        self.coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.coder.encode_ordinary
        self._lengths = _Lengths(self.encode)

    def parts(self, text: str) -> list[str]:
        """The text cut before blanks; every part but the first has lost one blank."""
        return _CUT.split(text)

    def count_parts(self, parts: list[str]) -> int:
        return len(self.encode(parts[0])) + sum(map(self._lengths.__getitem__, parts[1:]))

    def count(self, text: str) -> int:
        """Tokens of a text; of an empty one 0."""
        return self.count_parts(_CUT.split(text)) if text else 0

    def open_ended(self, part: str) -> list[int]:
        """Tokens of ``part`` when a visible character follows it: a line feed at its end is a token of its own."""
        if part.endswith("\n"):
            return [*(self.encode(part[:-1]) if len(part) > 1 else []), *self.encode("\n")]
        return self.encode(part)

    def before(self, part: str) -> int:
        """Number of ``open_ended`` tokens."""
        return len(self.open_ended(part))

    def units(self, text: str, longest: int = 64) -> tuple[list[int], list[int]]:
        """Starts and token counts of the text's units, cut before blanks.

        A unit of more than ``longest`` tokens, such as a page without blanks,
        is cut further after line feeds and full stops, and between its tokens
        where a character ends.
        """
        parts = _CUT.split(text)
        sizes = [len(self.encode(parts[0])), *map(self._lengths.__getitem__, parts[1:])]
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1  # the blank before each next part
        starts = [0, *ends[:-1].tolist()]
        if not parts[0] and len(parts) > 1:  # the text opens with a blank
            starts, sizes = starts[1:], sizes[1:]
        if max(sizes) <= longest:
            return starts, sizes
        s2, n2 = [], []
        for a, b, n in zip(starts, starts[1:] + [len(text)], sizes):
            if n <= longest:
                s2.append(a)
                n2.append(n)
            else:
                self._fine(text, a, b, longest, s2, n2)
        return s2, n2

    def _fine(self, text: str, a: int, b: int, longest: int, starts: list[int], sizes: list[int]) -> None:
        at = [a, *(a + m.start() for m in _INNER.finditer(text[a:b]) if m.start())]
        for x, y in zip(at, at[1:] + [b]):
            ids = self.open_ended(text[x:y]) if y < b else self.encode(text[x:y])
            n = len(ids)
            if n <= longest:
                starts.append(x)
                sizes.append(n)
                continue
            pos, k, room = x, 0, b""
            for tok in ids:
                room += self.bytes_of[tok]
                k += 1
                if k >= longest // 4:
                    try:
                        done = len(room.decode())
                    except UnicodeDecodeError:
                        continue
                    starts.append(pos)
                    sizes.append(k)
                    pos, k, room = pos + done, 0, b""
            if k:
                starts.append(pos)
                sizes.append(k)

    def tail(self, text: str, n: int) -> tuple[int, int]:
        """Characters and tokens of the shortest end of ``text`` that has ``n`` tokens or more and starts a character."""
        room, k = b"", 0
        for tok in reversed(self.encode(text)):
            room = self.bytes_of[tok] + room
            k += 1
            if k >= n and room[0] & 0xC0 != 0x80:
                break
        return len(room.decode("utf-8", "ignore")), k


@lru_cache(4)
def tokens(path: str = TOKENIZER) -> Tokens:
    """The vocabulary at ``path``, read once a worker."""
    return Tokens(path)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` of every row; NULL and '' have 0 tokens."""
    schema = df.select(*keep).schema.add("n_tokens", T.LongType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(path)
        for b in batches:
            n = pa.array([t.count(x) if x else 0 for x in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)
