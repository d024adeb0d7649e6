"""A language for every text, as a column expression: scripts first, then function words.

It stands in wherever no label is delivered and no better detector is given;
any function from a text column to a language column can replace it.  Null and
texts that tell nothing give null, which no rule rejects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Detector = Callable[[Column], Column]
# fixed values: scripts that tell the language, and frequent words of the others
SCRIPTS = {"th": "[\u0e00-\u0e7f]", "ar": "[\u0600-\u06ff]"}
WORDS = {
    "en": "the of and to in is that for was with are this from were have has which their been not".split(),
    "fr": "le la les des et est dans une que pour qui sur pas par avec sont cette aux ont ses".split(),
    "es": "el los las del una por con para que se es en como más fue son sus esta este y".split(),
    "pt": "os das dos uma não com para que em ao pela pelo são foi mais seus também à às e".split(),
    "id": "yang dan di dengan untuk dari pada ini itu tidak dalam adalah akan oleh ke telah kepada juga sebagai para".split(),
    "de": "der die das und ist von mit den für nicht auf ein eine dem des sich als auch wird zu".split(),
}
LEAST_HITS = 2


def detect_language(text: Column, least_hits: int = LEAST_HITS) -> Column:
    """The script that covers over a quarter of the letters, else the language with most different frequent words; ties by its order."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))
    votes = F.array(*[
        F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, listed)))).alias("n"), F.lit(-i).alias("at"), F.lit(lang).alias("lang"))
        for i, (lang, listed) in enumerate(WORDS.items())])
    best = F.array_max(votes)
    out = F.when(best["n"] >= least_hits, best["lang"])
    for lang, script in reversed(SCRIPTS.items()):
        out = F.when(F.regexp_count(text, F.lit(script)) * 4 > letters, F.lit(lang)).otherwise(out)
    return F.when(letters > 0, out)
