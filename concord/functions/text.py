"""Text functions, Column to Column: normalisation, splitting, token sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise_line(line: Column) -> Column:
    """White space collapsed, page numbers masked, so that running headers of all pages are equal."""
    masked = F.regexp_replace(F.regexp_replace(strip(line), r"\s+", " "), r"(?i)\bPage\s+\d+\b", "Page N")
    return F.regexp_replace(masked, r"\b\d{1,3}\s*/\s*\d{1,3}\b", "N/N")


#: A line of only a page number, in any of four forms.
NOISE_LINE = r"(?i)^\s*(?:Page\s+\d+|\d+\s*/\s*\d+|[-–—]\s*\d+\s*[-–—]?|\d{1,3})\s*$"


def heading(text: Column) -> Column:
    """T4: the first line if it looks like a heading (short; capitals, numbered, or ending with a colon); else null."""
    first = F.trim(F.element_at(F.split(strip(text), "\n"), 1))
    capitals = (F.upper(first) == first) & (F.lower(first) != first)
    return F.when((F.length(first) < 60) & (capitals | first.rlike(r"^\d+[.\d]*\s+\w") | first.endswith(":")), first)


def low_information(text: Column) -> Column:
    """Cover pages, tables of contents and remnants."""
    own = strip(F.coalesce(text, F.lit("")))
    upper = F.length(F.regexp_replace(own, r"[^\p{Lu}]", "")) / F.greatest(F.lit(1), F.length(own))
    contents = F.regexp_count(own, F.lit(r"(?im)(?:table of contents|^\s*\d+\.\s+[A-Z][^\n]{3,60}\s*\.{3,}\s*\d+\s*$)"))
    return (F.length(own) < 200) | (F.regexp_count(own, F.lit(r"[A-Z][^.!?]{15,}[.!?]")) < 2) | (contents >= 3) | ((upper > 0.35) & (F.regexp_count(own, F.lit("[.!?;:]")) < 5))


def is_meta(sentence: Column) -> Column:
    """A sentence about the document itself."""
    return sentence.rlike("(?i)" + "|".join(lexicons.META))


def statements(text: Column, least: int = 20, meta: bool = False) -> Column:
    """Soft-wrapped lines joined, heading lines removed, split after sentence ends; short and meta sentences dropped."""
    joined = F.regexp_replace(text, r"(?<![.!?:])[ ]*\n(?=[a-z])", " ")
    bare = F.regexp_replace(joined, r"(?m)^\d+[.\d]*\s+[A-Z][^\n]{3,60}$", "")
    parts = F.transform(F.split(bare, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(F.regexp_replace(strip(s), "\n", " "), r"\s{2,}", " "))
    return F.filter(parts, lambda s: (F.length(s) >= least) & (F.lit(meta) | ~is_meta(s)))


def sentences(text: Column, least: int = 20) -> Column:
    """The splitter of the numeric path: only before capitals and opening brackets."""
    joined = strip(F.regexp_replace(text, r"\s*\n\s*", " "))
    return F.filter(F.transform(F.split(joined, r"(?<=[.!?])\s+(?=[A-Z(])"), strip), lambda s: F.length(s) >= least)


def _without(tokens: Column, words: list[str]) -> Column:
    return F.array_except(tokens, F.lit(list(words)))


def bm25_tokens(text: Column) -> Column:
    """Lower-cased words without stop words, repeats kept, punctuation attached."""
    stop = F.lit(lexicons.BM25_STOPWORDS)
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def keywords(text: Column) -> Column:
    """T14."""
    return _without(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)), lexicons.KEYWORD_STOPWORDS)


def _singular(token: Column) -> Column:
    return F.regexp_replace(token, "s+$", "")


def concept_tokens(text: Column) -> Column:
    """Words of four letters, numbers, dollar figures; every final s removed."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z]{4,}|\d+(?:[.,]\d+)*%?|\$[\d.,]+[BMK]?"), F.lit(0))
    return _without(F.transform(found, lambda t: _singular(F.lower(t))), lexicons.CONCEPT_STOPWORDS)


def content_tokens(text: Column) -> Column:
    """T16."""
    return content_stems(F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z-]{3,}"), F.lit(0)), _singular))


def content_stems(stems: Column) -> Column:
    """T16, of words without their final s."""
    return _without(F.filter(stems, lambda t: F.length(t) >= 4), lexicons.CONTENT_STOPWORDS)


def polarity_tokens(text: Column) -> Column:
    """Words in order, lower-cased; hyphens part words."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0)), F.lower)


def pair_key(text: Column) -> Column:
    """T18."""
    return F.regexp_replace(F.lower(strip(text)), r"\s+", " ")
