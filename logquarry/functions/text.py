"""Text functions of citations: normal form of titles, extraction, validation; all JVM-side expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words a title comparison leaves out.
STOPWORDS = "a an the of in on at to for with and or but is are was were be been being as by from into about over under above below its this that these those it".split()
#: What stands before an edition marker, in the order in which the markers go.
EDITION_OF = [
    "1st|2nd|3rd|[0-9]+th",
    "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth",
    "revised|updated|expanded|student|international|anniversary",
]
#: An edition marker after one of these, and a revised edition.
EDITION, REVISED = r"(^|\s)({})\s+(edition|ed\.)(\s|$)", r"(^|\s)rev\.?\s+ed\.?(\s|$)"
#: TeX in a title - formulas, commands with an argument, other commands - and what becomes of it, in this order.
TEX = [(r"\$[^$]*\$", ""), (r"\\[A-Za-z]+\{([^{}]*)\}", "$1"), (r"\\[A-Za-z]+", "")]
#: Shape of a surname in a raw citation.
SURNAME = r"^[A-Z][a-zA-Z'-]{2,}$"
#: Shape of a DOI, words that are no surnames.
DOI = r"10\.[0-9]+/[A-Za-z0-9._:;()/-]+"
NO_SURNAMES = ["And", "The", "Of", "In", "With", "For", "From", "To"]


def _accent_table() -> tuple[str, str]:
    """Letters with accents and their plain letters, from the decomposition rule."""
    a, b = [], []
    for cp in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and not unicodedata.combining(d[0]) and all(unicodedata.combining(c) for c in d[1:]):
            a.append(chr(cp))
            b.append(d[0])
    return "".join(a), "".join(b)


_FROM, _TO = _accent_table()


def strip_accents(c: Column) -> Column:
    """Without combining marks, composed or not."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), _FROM, _TO)


def strip_edition(c: Column) -> Column:
    """Edition markers out of a small-letter title, but only after an ordinal or a modifier."""
    for before in EDITION_OF:
        c = F.regexp_replace(c, EDITION.format(before), " ")
    return F.regexp_replace(F.regexp_replace(c, REVISED, " "), " +", " ")


def normalise_title(c: Column) -> Column:
    """Normal form of a title: accents, TeX, case, edition, punctuation and blanks, in this order; NULL stays NULL."""
    c = strip_accents(c)
    for pattern, to in TEX:
        c = F.regexp_replace(c, pattern, to)
    c = strip_edition(F.lower(c))
    c = F.regexp_replace(F.regexp_replace(c, "\x00", ""), r"[^a-zA-Z0-9\s]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")


def meaningful(c: Column) -> Column:
    """Words of a normal form that are no stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(words(c), lambda x: ~F.array_contains(stop, x))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda arr, y: F.size(F.filter(arr, lambda x: x == y))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, y: s + F.least(count(a, y), count(b, y)))


def squeeze(c: Column) -> Column:
    """Control characters out, blanks to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"\s+", " "))


def extract_doi(c: Column) -> Column:
    """First DOI of a text without closing punctuation, or NULL."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, DOI, 0), r"[.,;:)\]]+$", ""), F.lit(""))


def extract_nber(c: Column) -> Column:
    """Working-paper number after 'NBER' or 'w', or NULL."""
    return F.nullif(F.regexp_extract(c, r"(?:[Nn][Bb][Ee][Rr][^0-9]{0,40}|(?:^|[^A-Za-z0-9_])w)([0-9]{3,7})(?:[^0-9A-Za-z_]|$)", 1), F.lit(""))


def extract_arxiv(c: Column) -> Column:
    """arXiv number without its version, not inside other digits, or NULL."""
    return F.nullif(F.regexp_extract(c, r"(?:^|[^0-9./])([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:[^0-9]|$)", 1), F.lit(""))


def extract_year(c: Column) -> Column:
    """Year in parentheses, else any year-like word; a letter suffix is dropped."""
    a = F.regexp_extract(c, r"\(((?:18|19|20)[0-9]{2})[a-z]?\)", 1)
    b = F.regexp_extract(c, r"(?:^|[^0-9A-Za-z.])((?:18|19|20)[0-9]{2})(?:[^0-9A-Za-z]|$)", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))).cast("int")


def extract_surnames(c: Column, chars: int | None = 200, most: int | None = 10) -> Column:
    """Surnames before the year: capitalised words of three letters and more.

    Without a year the first ``chars`` characters are read; the first ``most``
    words are kept; None is no bound.
    """
    year = extract_year(c).cast("string")
    at = F.coalesce(F.instr(c, F.coalesce(year, F.lit("\u0000"))), F.lit(0))
    chunk = F.when(at > 1, F.substring(c, F.lit(1), at - 1)).otherwise(c if chars is None else F.substring(c, 1, chars))
    toks = F.split(F.translate(chunk, ",&", "  "), " +")
    keep = lambda x: x.rlike(SURNAME) & ~x.isin(*NO_SURNAMES)
    names = F.filter(toks, keep)
    return names if most is None else F.slice(names, 1, most)


def extract_title(c: Column, chars: int | None = 500) -> Column:
    """Text after the year up to the first full stop before a capital, without quotes, ``chars`` characters at most (None is no bound); NULL without a year."""
    year = extract_year(c).cast("string")
    after = F.substring(c, F.instr(c, year) + 4, F.length(c))
    after = F.regexp_replace(F.regexp_replace(after, r"^[a-z](?=[).,:;\s])", ""), r"^[).,:;]*\s*", "")
    title = F.regexp_extract(after, r"(?s)^(.*?)(?:\. [A-Z].*)?$", 1)
    title = F.regexp_replace(F.regexp_replace(title, "^[\"'`{]+", ""), "[\"'`}]+$", "")
    return F.when(year.isNotNull(), title if chars is None else F.substring(title, 1, chars))


def doi_valid(c: Column) -> Column:
    """Whether a text is a plain DOI."""
    return F.coalesce(c.rlike(rf"^{DOI}$") & (F.length(c) <= 500) & ~F.contains(c, F.lit("..")), F.lit(False))


def nber_doi(c: Column) -> Column:
    """DOI of a working-paper number, or NULL."""
    n = F.regexp_replace(c, "^[wW]", "")
    return F.when(n.rlike("^[0-9]{1,7}$"), F.concat(F.lit("10.3386/w"), n))


def lookup_route(doi: Column, nber: Column, title: Column) -> Column:
    """How a citation is looked up: doi, nber, search, or insufficient_data."""
    return F.when(F.length(doi) > 0, "doi").when(F.length(nber) > 0, "nber").when(F.length(title) >= 10, "search").otherwise("insufficient_data")


def sanitise(c: Column) -> Column:
    """Control characters and Markdown marks made harmless for a report."""
    c = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1F\x7F]", " "), r"([\\`*_{}\[\]()#+!|<>~])", r"\\$1")
    return F.trim(F.regexp_replace(c, " +", " "))


def percent_encode(c: Column) -> Column:
    """Text as a part of an address: all but letters, digits and -._~ as percent signs and hexadecimal bytes."""
    e = F.url_encode(c)  # a form's encoding: blanks as '+', '*' as it is, '~' encoded
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(e, r"\+", "%20"), r"\*", "%2A"), "%7E", "~")


def merge_objects(a: Column, b: Column) -> Column:
    """JSON object with the members of both, those of ``b`` counting where both have one; NULL if either is none."""
    kind = "map<string, variant>"
    both = F.map_concat(F.map_filter(F.from_json(a, kind), lambda k, _: ~F.array_contains(F.json_object_keys(b), k)), F.from_json(b, kind))
    return F.to_json(both)
