"""Text cleaning, file-name years and tokens as column expressions.

``unicode=True`` uses Unicode classes for white space, digits and words;
``unicode=False`` uses explicit ASCII classes, which other SQL engines share.
Null in gives null out everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the removals of the page cleaner, in order, each replaced by nothing
OCR_REMOVALS = (
    r"\b{D}+\b(?:{S}*\|{S}*{D}+)*",
    r"\b(Figure|Table){S}*{D}+",
    r"http[s]?://(?:[a-zA-Z0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+",
    r"[{W}.-]+@[{W}.-]+\.[{W}]+",
)
# fixed values: the removals of the corpus cleaner, in order, each replaced by a blank
CORPUS_REMOVALS = (
    r"ISBN-: ----", r"AID-OAA-A--", r"{S}{2,}", r"\.{3,}", r"\([^)]*\)", r"{D}+\.{D}+\.{D}+", r"^{S}*{D}+\.", r"Figure {D}+", r"Table {D}+",
)
YEAR_IN_NAME = r"document_([0-9]{4})-"


def classes(pattern: str, unicode: bool) -> str:
    """A pattern with its classes {S} white space, {D} digits and {W} word characters filled in."""
    space, digit, word = (r"\s", r"\d", r"\w") if unicode else (r"[ \t\r\n]", "[0-9]", "A-Za-z0-9_")
    return ("(?U)" if unicode else "") + pattern.replace("{S}", space).replace("{D}", digit).replace("{W}", word)


def collapse(text: Column, unicode: bool = True) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, classes(r"{S}+", unicode), " "))


def ocr_clean(text: Column, unicode: bool = True) -> Column:
    """Bare numbers first, then figure and table numbers, addresses of the web and of mail; the order matters."""
    for pattern in OCR_REMOVALS:
        text = F.regexp_replace(text, classes(pattern, unicode), "")
    return collapse(text, unicode)


def corpus_clean(text: Column, unicode: bool = True) -> Column:
    """May leave the empty string; such rows stay."""
    for pattern in CORPUS_REMOVALS:
        text = F.regexp_replace(text, classes(pattern, unicode), " ")
    return collapse(text, unicode)


def year_from_filename(filename: Column) -> Column:
    """The four digits after ``document_``, or the empty string."""
    return F.regexp_extract(filename, YEAR_IN_NAME, 1)


def parse_year(year: Column, bad_year: str = "drop") -> Column:
    """A year column of strings as int: ``drop`` makes what is no year null, ``fail`` raises.

    A decimal spelling of a whole year counts as the year.
    """
    number = F.try_to_number(F.trim(year), F.lit("9999999.99")).cast("double")
    whole = F.when(number == F.floor(number), number.cast("int"))
    if bad_year == "fail":
        return F.when(whole.isNotNull(), whole).otherwise(F.raise_error(F.concat(F.lit("no year: "), F.coalesce(year, F.lit("null")))).cast("int"))
    return whole


_IN_WORD = r"[\p{L}\p{N}\p{M}_]"
_JOIN = r"[-./'’]"
_ENDING = rf"['’](?:s|re|ve|ll|d|m)(?!{_IN_WORD}|{_JOIN}{_IN_WORD})"


def letter_tokens(text: Column, min_length: int = 3) -> Column:
    """The words of the lower-cased text that are letters only and at least ``min_length`` long.

    A word joined to another by a hyphen, dot, slash or apostrophe is one token
    with it and so none ("covid-19", "and/or"); a contracted ending is parted
    from its word first ("ministry's").
    """
    pattern = rf"(?<!{_IN_WORD})(?<!{_IN_WORD}{_JOIN})\p{{L}}{{{min_length},}}+(?!{_IN_WORD})(?:(?={_ENDING})|(?!{_JOIN}{_IN_WORD}))"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def short_label(topic: Column, name: Column, width: int = 30) -> Column:
    """``topic: name``, the name cut to ``width`` with three dots."""
    cut = F.when(F.length(name) > width, F.concat(F.substring(name, 1, width), F.lit("..."))).otherwise(name)
    return F.concat(topic.cast("string"), F.lit(": "), cut)


def label_words(name: Column) -> Column:
    """The words of a topic name after its number, split at underscores; a name of one part falls back to its blanks."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) > 2, F.slice(parts, 2, F.size(parts))).otherwise(F.split(F.element_at(F.split(name, "_", 2), -1), " "))
