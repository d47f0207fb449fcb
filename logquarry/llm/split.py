"""Problem 9: items over the limit cut into overlapping pieces at natural boundaries.

Recursive bisection: cut at the strongest boundary near the midpoint, go on
with each half that is still over the limit less the overlap, then put the
overlap in front of every piece but the first.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.tokens import TOKENIZER, Tokens, tokens

LIMIT, OVERLAP = 2048, 128
#: Tokens kept free in a piece: a piece that starts inside a word may count a few more on its own.  Doubled until every piece fits.
SLACK = 8
#: Least tokens of a segment: two characters of four tokens, so that any segment over it has a boundary inside.
LEAST = 8
#: Longest unit of a text, where the segments are long enough for it.
UNIT = 64
#: A cut lies in the middle share of a segment.
MIDDLE = 0.25

#: Natural breaks, strongest first.
_BLANK = re.compile(r" (?=\S)")
BREAKS = [
    re.compile(r"\n[^\S\n]*\n\s*(?=\S)"),  # paragraph
    re.compile(r"\n(?=#)"),  # heading
    re.compile(r"\n[^\S\n]*(?=\S)"),  # line
    re.compile(r"[.!?…][\"'”’)\]]* (?=\S)|[。！？](?=[^\W_])"),  # sentence
    re.compile(r"[,;:)\]] (?=\S)|[，；：、](?=[^\W_])"),  # clause
]


def _nearest(text: str, lo: int, hi: int, mid: int) -> int | None:
    """Position of the strongest natural break in (lo, hi), of these the nearest to mid; a blank opens the next piece."""
    for pattern in BREAKS:
        best = None
        for m in pattern.finditer(text, lo, hi):
            at = m.end() - (text[m.end() - 1] == " ")
            if lo < at < hi and (best is None or abs(at - mid) < abs(best - mid)):
                best = at
            elif best is not None and at > mid:
                break
        if best is not None:
            return best
    return None


def cuts(text: str, t: Tokens, core: int) -> list[tuple[int, int]]:
    """Character and token positions of the segments' starts and of the end: bisection until each has ``core`` tokens or fewer.

    Units are at most half a segment, so a segment over ``core`` always has a
    boundary inside; one that has none raises.
    """
    starts, sizes = t.units(text, min(UNIT, core // 2))
    cum = [0, *accumulate(sizes)]
    starts.append(len(text))
    last = len(starts) - 1
    out, stack = [], [((0, 0), (len(text), cum[-1]))]
    while stack:
        a, b = stack.pop()
        total = b[1] - a[1]
        if total <= core:
            out.append(a)
            continue
        mid = a[1] + total / 2
        # the unit nearest to the midpoint is the cut if the middle share has no natural break
        first, end = bisect_right(starts, a[0]), bisect_left(starts, b[0]) - 1
        c = None
        if first <= end:
            u = min(max(bisect_left(cum, mid), first), end)
            if u > first and mid - cum[u - 1] < cum[u] - mid:
                u -= 1
            lo = max(bisect_left(cum, mid - MIDDLE * total / 2), first)
            hi = min(bisect_left(cum, mid + MIDDLE * total / 2), end + 1, last)
            at = _nearest(text, max(starts[lo] - 1, a[0]), min(starts[hi] + 1, b[0]), starts[u]) if hi > lo else None
            if at is not None:
                i = bisect_right(starts, at) - 1
                c = (at, cum[i] + (t.before(text[starts[i] : at]) if at > starts[i] else 0))
            if c is None or not a[1] < c[1] < b[1]:
                c = (starts[u], cum[u])
        if c is None or not a[1] < c[1] < b[1]:
            raise ValueError(f"a segment of {total} tokens has no boundary inside; {core} are the most")
        stack += [(c, b), (a, c)]
    return [*sorted(out), (len(text), cum[-1])]


def _overlapped(text: str, t: Tokens, firsts: list[tuple[int, int]], overlap: int) -> list[tuple[int, int, int, int]]:
    """Segments with their overlaps in front, each with the tokens it has on its own."""
    out: list[tuple[int, int, int, int]] = []
    for i, (a, b) in enumerate(zip(firsts, firsts[1:])):
        start = a[0]
        if i and overlap:
            least = out[-1][0]
            back = next((m.start() for m in _BLANK.finditer(text, max(least, a[0] - 8 * overlap), a[0])), least)
            chars, more = t.tail(text[back : a[0]], overlap)
            if more < overlap and back > least:  # short of tokens: look at all of the piece before
                chars, more = t.tail(text[least : a[0]], overlap)
            start = a[0] - chars
        out.append((start, a[0], b[0], t.count(text[start : b[0]])))
    return out


def split_text(text: str, t: Tokens, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces of a text over the limit as (start, cut, end, tokens): characters start..end, of which start..cut repeat the piece before.

    tokens are those of the piece encoded on its own, never more than
    ``limit``.  The overlap has ``overlap`` tokens or more; only if the whole
    piece before has fewer is it all of that piece.  Raises where the limit
    leaves no room for a segment of LEAST tokens.
    """
    free = min(SLACK, limit - overlap - LEAST)
    while limit - overlap - free >= LEAST and free >= 0:
        got = _overlapped(text, t, cuts(text, t, limit - overlap - free), overlap)
        if all(p[3] <= limit for p in got):
            return got
        free = max(2 * free, 1)
    raise ValueError(f"limit {limit} is too small for an overlap of {overlap}")


def split(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str = TOKENIZER, with_text: bool = True) -> DataFrame:
    """Pieces of every document over ``limit`` tokens, in order.

    (doc_id, piece, start_char, cut_char, end_char, n_tokens[, text]); pieces
    count from 0; n_tokens, those of the piece on its own, is at most
    ``limit``; characters start..cut are the ``overlap`` tokens shared with the
    piece before (up to three more where they would start inside a character).  Documents within the limit, NULL
    and '' give no rows.  A byte-level vocabulary has no more tokens than the
    text has bytes, so texts of at most ``limit`` bytes are never sent to
    Python; nothing is left out by it.  Repeated doc_ids are split each;
    further columns are ignored.
    """
    schema = "doc_id bigint, piece int, start_char int, cut_char int, end_char int, n_tokens int" + (", text string" if with_text else "")
    arrow = pa.schema([("doc_id", pa.int64()), *[(c, pa.int32()) for c in ("piece", "start_char", "cut_char", "end_char", "n_tokens")], *([("text", pa.string())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t.count(text) <= limit:
                    continue
                for i, (s, c, e, n) in enumerate(split_text(text, t, limit, overlap)):
                    rows.append((doc, i, s, c, e, n, text[s:e])[: len(arrow)])
                if len(rows) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.where(F.octet_length("text") > limit).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def found(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id) of the documents that had to be cut."""
    return split(docs, path=path, with_text=False).where("piece = 0").select("doc_id").distinct()
