"""BibTeX text into records, by matching braces; a broken entry does not spoil its neighbours."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: TeX accent commands and the combining mark each stands for.
ACCENTS = {
    "`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304",
    ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a",
}
#: TeX letter commands.
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ"}

_ACCENT = re.compile(r"\\([`'^~\"=.])\s*\{?\\?([A-Za-z])\}?|\\([uvHckr])(?:\s+|\s*\{)\\?([A-Za-z])\}?")
_LETTER = re.compile(r"\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i|j)(?![A-Za-z])\s*(?:\{\})?")
_ENTRY = re.compile(r"@\s*([A-Za-z]+)\s*[{(]", re.ASCII)
_FIELD = re.compile(r"\s*,?\s*([A-Za-z][\w\-:.+]*)\s*=\s*")


def decode_tex(s: str) -> str:
    """Accent and letter commands into composed characters."""
    s = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", (m[2] or m[4]) + ACCENTS[m[1] or m[3]]), s)
    return _LETTER.sub(lambda m: LETTERS[m[1]], s)


def strip_braces(s: str) -> str:
    """All grouping braces out, at any depth, and blanks squeezed."""
    return re.sub(r"\s+", " ", re.sub(r"[{}]", "", s)).strip()


def split_authors(s: str) -> list[str]:
    """Names separated by ' and ', but not where a comma comes before it, as in a corporate name."""
    return [a for a in (x.strip() for x in re.split(r"(?<!,)\s+and\s+", s)) if a]


def _value(t: str, i: int, macros: dict[str, str]) -> tuple[str, int] | None:
    """Value from position i: braces, quotes, a number or a macro, joined by '#'."""
    out = []
    while True:
        while i < len(t) and t[i].isspace():
            i += 1
        if i >= len(t):
            return None
        if t[i] in '{"':
            quote, depth, j = t[i] == '"', 0 if t[i] == '"' else 1, i + 1
            while j < len(t):
                if t[j] == "\\":
                    j += 2
                    continue
                if t[j] == "{":
                    depth += 1
                elif t[j] == "}":
                    depth -= 1
                    if not quote and depth == 0:
                        break
                elif t[j] == '"' and quote and depth <= 0:
                    break
                j += 1
            if j >= len(t):
                return None
            out.append(t[i + 1 : j])
            i = j + 1
        else:
            m = re.compile(r"[^\s,#{}()]+").match(t, i)
            if not m:
                return None
            out.append(macros.get(m[0].lower(), m[0]))
            i = m.end()
        m = re.compile(r"\s*#").match(t, i)
        if not m:
            return "".join(out), i
        i = m.end()


def parse_bibtex(text: str) -> list[dict[str, str]]:
    """Records of a BibTeX text: lower-case field names, decoded values, ``entry_key`` and ``type``.

    String macros are resolved; an entry that cannot be read is left out and
    reading goes on at the next '@'.
    """
    t = text.lstrip("\ufeff")
    macros: dict[str, str] = {}
    out = []
    pos = 0
    while m := _ENTRY.search(t, pos):
        pos = m.end()
        kind = m[1].lower()
        if kind in ("comment", "preamble"):
            continue
        rec: dict[str, str] = {}
        if kind != "string":
            k = re.compile(r"\s*([^,\s{}=\"]*)\s*,").match(t, pos)
            if not k:
                continue
            rec = {"entry_key": k[1], "type": kind}
            pos = k.end()
        good = True
        while f := _FIELD.match(t, pos):
            got = _value(t, f.end(), macros)
            if got is None or "\n@" in got[0]:
                good = False
                break
            rec.setdefault(f[1].lower(), got[0])
            pos = got[1]
        end = re.compile(r"\s*,?\s*[})]").match(t, pos)
        if not good or not end:
            continue
        pos = end.end()
        if kind == "string":
            macros |= {k: v for k, v in rec.items()}
        else:
            out.append({k: strip_braces(decode_tex(v)) if k not in ("entry_key", "type") else v for k, v in rec.items()})
    return out


SCHEMA = "path string, entry_key string, type string, authors array<string>, year int, title string, doi string, venue string"


def scan_bibtex(files: DataFrame) -> DataFrame:
    """Records of ``files(path, text)``; NULL texts and broken entries give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                for r in parse_bibtex(text or ""):
                    y = re.search(r"(1[89]|20)\d\d", r.get("year", ""))
                    rows.append((path, r["entry_key"], r["type"], split_authors(r.get("author", "")), int(y[0]) if y else None, r.get("title"), r.get("doi"), r.get("journal") or r.get("booktitle")))
            yield pd.DataFrame(rows, columns=["path", "entry_key", "type", "authors", "year", "title", "doi", "venue"]).astype({"year": "Int32"})

    return files.select("path", "text").mapInPandas(run, SCHEMA)
