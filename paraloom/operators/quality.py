"""Paragraphs out of pages, and the rules that reject them.

The first rule that applies gives the reason; a null reason keeps the
paragraph.  One CASE expression serves as filter and as counter.  White space
and digits are those of Unicode, or with ``unicode=False`` those of ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraloom.functions.language import Detector
from paraloom.functions.text import classes

# fixed values: the reasons in the order of the rules, and languages that are not wanted
REASONS = ("table_of_contents", "acronyms", "non_latin", "short_paragraph", "too_many_numbers", "all_caps", "references", "unwanted_language")
UNWANTED_LANGUAGES = ("id", "fr", "es", "ar", "th")
DOTS = 147
REFERENCES = r"^({D}+\.|[A-Z][a-z]+{S}*,|et al\.)"
_ASCII_SPACE = r"[ \t\r\n\x0b\x0c]"


def _space(unicode: bool) -> str:
    return r"(?U)\s" if unicode else _ASCII_SPACE


def trimmed(text: Column, unicode: bool = True) -> Column:
    space = r"[\s\x1c-\x1f]" if unicode else _ASCII_SPACE
    return F.regexp_replace(text, ("(?U)" if unicode else "") + f"^{space}+|{space}+$", "")


def paragraphs(df: DataFrame, text: str = "text", separator: str = "\n\n", unicode: bool = True) -> DataFrame:
    """Adds ``para_idx`` and ``paragraph``: the trimmed, non-empty pieces of every text; null texts give none."""
    pieces = df.where(F.col(text).isNotNull()).select("*", F.posexplode(F.split(F.col(text), separator)).alias("para_idx", "_p"))
    return pieces.withColumn("paragraph", trimmed(F.col("_p"), unicode)).drop("_p").where(F.col("paragraph") != "")


def skip_reason(p: Column, language: Column | None = None, min_words: int = 10, unicode: bool = True) -> Column:
    """Name of the first rule that rejects ``p``, or null."""
    words = F.size(F.split(trimmed(p, unicode), _space(unicode) + "+"))
    rules = [
        F.contains(p, F.lit("." * DOTS)),
        F.contains(p, F.lit("ACRONYMS AND ABBREVIATIONS")),
        p.rlike("[\u0e00-\u0e7f\u0600-\u06ff]"),
        words < min_words,
        F.regexp_count(p, F.lit(r"(?U)\d" if unicode else "[0-9]")) / F.length(p) > 0.2,
        (F.upper(p) == p) & (F.lower(p) != p),
        p.rlike(classes(REFERENCES, unicode)),
    ]
    if language is not None:
        rules.append(language.isin(*UNWANTED_LANGUAGES))
    out = F.lit(None).cast("string")
    for rule, reason in reversed(list(zip(rules, REASONS))):
        out = F.when(rule, F.lit(reason)).otherwise(out)
    return out


def with_reason(df: DataFrame, language: str | Detector | None = None, min_words: int = 10, unicode: bool = True) -> DataFrame:
    """Adds ``skip_reason``; ``language`` is a column of labels or a detector that reads the paragraph."""
    told = language(F.col("paragraph")) if callable(language) else F.col(language) if language else None
    return df.withColumn("skip_reason", skip_reason(F.col("paragraph"), told, min_words, unicode))


def skip_counts(df: DataFrame) -> DataFrame:
    """All eight reasons with their counts, zeros too."""
    dim = df.sparkSession.createDataFrame([(r,) for r in REASONS], "skip_reason string")
    counts = df.where(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "skip_reason", "left").select("skip_reason", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
