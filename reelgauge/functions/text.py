"""Text cleaning, tokenising and n-gram expressions.

Java's ``\\s`` and ``\\w`` are ASCII-only, so the patterns spell out the Unicode
classes.  Nothing here is a UDF: every function builds a Column.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
BRACKET_TIME = r"\[\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?\]"
# (?U) makes \b see accented letters as word characters
BARE_TIME = r"(?U)\b\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?\b"
URL = rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
ALPHABETIC = r"^\p{L}+$"
#: punctuation a tagger would split off the ends of a word
EDGE_PUNCTUATION = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: punctuation between two letters at which a tagger splits a word; a hyphen is none
INNER_PUNCTUATION = r"(?<=\p{L})[,/:<>=](?=\p{L})"


# --- whitespace, times, links -------------------------------------------------

def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse_space(c: Column) -> Column:
    """Runs of Unicode whitespace become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def is_blank(c: Column) -> Column:
    # the search ends at the first character that is no space
    return ~c.rlike(NOT_SPACE)


def newlines_to_space(c: Column) -> Column:
    return F.translate(c, "\n\r", "  ")


def drop_bracket_times(c: Column, repl: str = " ") -> Column:
    """Remove ``[m:ss]`` and ``[h:mm:ss]`` marks of at most two leading digits."""
    return F.regexp_replace(c, BRACKET_TIME, repl)


def drop_bare_times(c: Column) -> Column:
    return F.regexp_replace(c, BARE_TIME, "")


def drop_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def clean_basic(c: Column) -> Column:
    """Pre-clean used before lemmatising: newlines, times, links, case, spaces."""
    step = newlines_to_space(text_or_empty(c))
    return collapse_space(F.lower(drop_urls(drop_bracket_times(step))))


def clean_export(c: Column) -> Column:
    """Pre-clean of the export job: both kinds of times go, case is kept."""
    step = drop_bare_times(drop_bracket_times(text_or_empty(c), ""))
    return collapse_space(newlines_to_space(step))


# --- words and stopwords ------------------------------------------------------

def words(c: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def _in(c: Column, stopwords: Iterable[str]) -> Column:
    # a literal list becomes a hash lookup (InSet), unlike array_contains
    return c.isin(list(stopwords))


def remove_stopwords(c: Column, stopwords: Iterable[str]) -> Column:
    """Drop the words whose lower-case form is a stopword; keep the others as is."""
    stop = list(stopwords)
    return F.array_join(F.filter(words(c), lambda w: ~_in(F.lower(w), stop)), " ")


def remove_stopwords_strict(c: Column, stopwords: Iterable[str]) -> Column:
    """Lower-case, delete square brackets and digits, then drop stopwords."""
    stop = list(stopwords)
    bare = F.regexp_replace(F.translate(F.lower(c), "[]", ""), r"\p{Nd}+", "")
    return F.array_join(F.filter(words(bare), lambda w: ~_in(w, stop)), " ")


def tokenize(c: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def drop_stop_tokens(tokens: Column, stopwords: Iterable[str]) -> Column:
    stop = list(stopwords)
    return F.filter(tokens, lambda t: ~_in(t, stop))


def content_tokens(c: Column, stopwords: Iterable[str]) -> Column:
    """Tokens of a text after stopword removal at word and at token level."""
    stop = list(stopwords)
    return drop_stop_tokens(tokenize(remove_stopwords(c, stop)), stop)


def bigrams(tokens: Column) -> Column:
    """Adjacent token pairs joined by a space; none for fewer than two tokens."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), n),
        F.slice(tokens, F.lit(2), n),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def bigrams_without_stopwords(tokens: Column, stopwords: Iterable[str]) -> Column:
    """Pairs adjacent in the *unfiltered* tokens, kept if neither is a stopword.

    This is the second attempt for a corpus whose filtered vocabulary is empty.
    """
    stop = list(stopwords)
    return F.filter(
        bigrams(tokens),
        lambda b: ~_in(F.split_part(b, F.lit(" "), F.lit(1)), stop)
        & ~_in(F.split_part(b, F.lit(" "), F.lit(2)), stop),
    )


# --- token filters of the cleaning job ---------------------------------------

def word_pieces(c: Column) -> Column:
    """Words, also those joined by inner punctuation, with the punctuation at either end split off."""
    apart = F.regexp_replace(c, INNER_PUNCTUATION, " ")
    return F.transform(words(apart), lambda w: F.regexp_replace(w, EDGE_PUNCTUATION, ""))


def is_alphabetic(c: Column) -> Column:
    return c.rlike(ALPHABETIC)


@lru_cache(maxsize=1)
def _latin_folding() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition of the Latin blocks, worked out from Unicode data."""
    source, target, longer = [], [], {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]:
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif len(plain) > 1:
            longer[char] = plain
    return "".join(source), "".join(target), longer


def strip_accents(c: Column) -> Column:
    """Latin letters to their ASCII base; characters without one are dropped."""
    source, target, longer = _latin_folding()
    spelled = c
    for char, plain in longer.items():
        spelled = F.replace(spelled, F.lit(char), F.lit(plain))
    has_longer = c.rlike("[" + "".join(longer) + "]")
    folded = F.translate(F.when(has_longer, spelled).otherwise(c), source, target)
    return F.regexp_replace(folded, r"[^\x00-\x7f]", "")


def is_content_lemma(lemma: Column, stopwords: Iterable[str]) -> Column:
    """Longer than two characters and no stopword, with or without its accents."""
    stop = list(stopwords)
    return (
        (F.length(lemma) > 2)
        & ~_in(lemma, stop)
        & ~_in(strip_accents(lemma), stop)
    )


# --- names and excerpts -------------------------------------------------------

def safe_name(c: Column) -> Column:
    """Entity name as it may appear in a file path."""
    return F.translate(c, " /", "_-")


def excerpt(c: Column, length: int = 200) -> Column:
    return F.concat(F.substring(c, 1, length), F.lit("..."))


def thousands(c: Column) -> Column:
    """Integer part with thousands separators, as shown beside each topic."""
    return F.format_number(c.cast("long"), 0)
