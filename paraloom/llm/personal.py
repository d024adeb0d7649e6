"""Problem 10: personal information in free text, and its replacement.

Numbers, mail addresses and street addresses are found by their formats and the
words before them.  For names, the given names and the endings of family names
are learnt from the whole corpus: words that stand after titles and other cues,
weighed with how often they stand anywhere.  Tasks sum their own sightings and
only the sums are shuffled.  A name is then a learnt given name or an initial
beside a family name, in either order, or anything of that shape after a cue.

What was found is replaced by typed placeholders, numbered by entity within
the text, or by surrogates: keyed replacements of the same type, gender, case
and format.  Digits and letters of numbers go through keyed permutations, so
different ones stay different everywhere.  Words of names, mail and street
addresses become made-up words by keyed hash; the words of all texts are checked
against each other and the few that would meet get another (``fit_surrogates``),
so that over the whole corpus one word has one replacement and no two share one.

Defined results: null texts stay null and empty ones empty, with nothing found;
a value that occurs twice in a text is reported once; repeated rows each count.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.session import materialize

LEAST_SEEN = 2  # sightings after cues before a name or an ending is taken for one elsewhere
CUED_SHARE = 0.02  # of all its occurrences, so many at least stand after cues
COMMON_ENDING = 0.002  # an ending of so many of the cued names needs no such share
FLUSH = 300_000  # sums of a task before they are passed on

CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*"
PLACE = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)*"
STREET = r"(?i:Road|Street|Close|Crescent|Lane|Avenue|Way|Drive|Square|Terrace|Court|Gardens|Hill|Boulevard|Rd|St|Ave)"
UNIT = r"(?i:Flat|Suite|Apt|Apartment|Unit|Room|Floor)\.?\s+\d+[A-Za-z]?"
END_PLACE = rf"(?:,\s*{PLACE}(?:\s+\d{{5}}(?![\d]|[.,]\d))?|[ \t]*\r?\n[ \t]*{PLACE}(?:[ \t]+\d{{5}}(?!\d)|(?=[ \t]*(?:[.\r\n]|$))))"

ADDRESS = re.compile(
    rf"(?:{UNIT},\s+)?(?<![\w.,/-])\d{{1,4}}[A-Za-z]?\s+{PLACE}(?:\s+{PLACE})?\s+{STREET}\b(?:,\s*{UNIT})?(?:{END_PLACE})?"
    rf"|(?<![\w.,/-])\d{{1,4}}(?:\s*bis)?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s+(?:(?:de\s+la|de\s+l['’]|des|du|de|d['’])\s*)?{PLACE}(?:[\s-]+{PLACE})?(?:,\s*(?:\d{{5}}\s+)?{PLACE})?"
    rf"|\b(?:Calle|Avenida|Plaza|Paseo|Carrera|Rua|Travessa|Jalan|Jl\.)\s+(?:(?:de|del|la|las|los|do|da|dos|das)\s+)*{PLACE}(?:\s+{PLACE}){{0,2}}(?:,)?\s+(?:n\.?\s?[º°]\s*|No\.?\s*)?\d{{1,4}}(?:,\s*(?:\d{{5}}\s+)?{PLACE}(?:\s+\d{{5}})?)?"
)
MAIL = re.compile(
    r"[A-Za-z0-9](?:[\w.+-]*[\w+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
    r"|[A-Za-z0-9](?:[\w.+-]*[\w+-])?\s*(?:\s@\s?|\s?@\s|@|[\[({]\s*at\s*[\])}]|\s(?:at|AT|arroba)\s)\s*[A-Za-z0-9][A-Za-z0-9-]*(?:\s*\.[A-Za-z0-9][A-Za-z0-9-]*)*(?:\s*(?:[\[({]\s*dot\s*[\])}]|\s(?:dot|DOT|punto|ponto|point)\s)\s*[A-Za-z0-9][A-Za-z0-9-]*)+"
    r"|[A-Za-z0-9](?:[\w.+-]*[\w+-])?\s(?:at|AT|arroba)\s[a-z0-9][a-z0-9-]*(?:\.[a-z][a-z-]*)*\.[a-z]{2,}(?![\w+@-]|\.\w|\s*(?:@|[\[({]\s*(?:at|dot)\b|\b(?:at|dot)\s))"
    r"|[A-Za-z0-9](?:[\w.+-]*[\w+-])?\s*(?:\s@\s?|\s?@\s|[\[({]\s*at\s*[\])}])\s*[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z][A-Za-z0-9-]*)+"
)
PHONE = re.compile(
    r"""(?<![\w.,/+(-])(?:
    \+\d{10,14}
    |\+\d{1,3}[ \-.](?:\(0?\d{1,4}\)|\d{2,4})(?:[ \-./]\d{2,4}){1,4}
    |\+\d{2,3}[ ]\d{3,5}[ ]\d{5,6}
    |\+\d{1,3}\s\d{2,4}(?:\s\d{3,4}){2}
    |00\d{2,3}[ ]?\d{1,4}/\d{5,8}
    |00\d{2,3}(?:[ \-]\d{2,4}){2,4}
    |0\d{4}\s\d{3}\s\d{3}
    |0\d{4}\s\d{6}
    |0\d{2,3}\s\d{3,4}\s\d{4}
    |\(0?\d{2,4}\)\s?\d{3,4}[-\s]\d{3,4}
    |\d{3}[.]\d{3}[.]\d{4}
    |\d{3}-\d{3}-\d{4}
    )(?![\w/]|[-.]\d)""", re.X)
MOBILE = re.compile(r"(?<![\w.,/+(-])\+\d{2}\s\d{4}\s\d{6}(?!\d)")
ID_FORM = r"\d{6}/\d{4,5}|\d{3}-\d{2}-\d{4}|\d{4}[\s-]\d{4}[\s-]\d{4}|[A-Z]{1,3}-\d{5,8}(?:-[A-Z0-9])?|[A-Z]{1,2}\d{6,9}[A-Z]?|\d{8,13}[A-Z]?"
ID = re.compile(
    r"(?:\b(?:ID|I\.D\.|(?i:passports?|passeport|pasaporte|passaporte|paspor|identity(?:\s+card)?|social\s+security|insurance|cédula|cedula"
    r"|carte\s+d['’]identité|identité|DNI|CPF|SSN|NIK|KTP|bilhete|identidade|identidad)))"
    r"(?:\s+(?i:card|number|numbers|no|nr|num|número|numéro|nomor|n))*\.?\s*(?:[º°]\s*)?[:#(]?\s*"
    rf"({ID_FORM})(?![\w/]|-\w)")


def _starting(words: Iterable[str], before: str) -> str:
    """The words as alternatives by first letter, told by that letter first and only after ``before``; quick to search for."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?<{before}{c})(?:{'|'.join(rest)})" for c, rest in by_first.items())


# what must stand in a text for a pattern to be tried there, and what a match is made of
_STREET_WORDS = "Road Street Close Crescent Lane Avenue Way Drive Square Terrace Court Gardens Hill Boulevard Rd St Ave".split()
MAIL_GATE = re.compile(r"@|[\[({]\s*(?:at|dot)\s*[\])}]|" + _starting(
    [*(w + r"\s" for w in "dot DOT punto ponto point".split()), *(w + r"\s[a-z0-9-]+\.[a-z]" for w in "at AT arroba".split())], r"=\s"))
MAIL_RUN = re.compile(r"[\w.+\-@\s\[\](){}]+")  # a match lies in one such run
ID_GATE = re.compile(r"[0-9](?:[\d/-]{4}|\d{3}\s\d{4}\s)")
ADDRESS_GATE = re.compile(
    "(?:" + _starting([*_STREET_WORDS, *map(str.upper, _STREET_WORDS), *"rue avenue boulevard place chemin allée impasse quai".split()], r"=\s")
    + "|" + _starting("Calle Avenida Plaza Paseo Carrera Rua Travessa Jalan Jl".split(), r"!\w") + r")\b")
PHONE_RUN = re.compile(r"[+(0-9][0-9+()./\-\s]{8,}")


def _mails(text: str) -> list[re.Match]:
    if not MAIL_GATE.search(text):
        return []
    return [m for run in MAIL_RUN.finditer(text) if MAIL_GATE.search(run.group()) for m in MAIL.finditer(text, run.start(), run.end())]


def _phones(text: str) -> list[re.Match]:
    return [m for run in PHONE_RUN.finditer(text) for m in PHONE.finditer(text, run.start(), run.end() + 2) if 9 <= sum(map(str.isdigit, m.group())) <= 15]


_TITLES = "Mrs Mr Ms Miss Dr Prof Mme Mlle M Sr Sra Srta Dra Bapak Ibu Pak Bu".split()
_LABELS = r"Name Nom Nombre Nome Nama Prepared\s+by Contact Contacto Contato Atención Atenção Attention Attn Author Patient".split()
_LEADS = (r"said", r"write\s+to", r"kept\s+by", r"The\s+patient,", r"the\s+patient,", r"escriba\s+a", r"écrire\s+à", r"Expediente\s+de", r"expediente\s+de",
          r"Dossier\s+de", r"dossier\s+de", "Reimburse", "reimburse")
#: What stands before a name: a label or a lead with or without a title, or a title alone.
CUE = re.compile(
    _starting([*(rf"{w}\s*:\s*(?:(?:{'|'.join(_TITLES)})\.?\s+)?" for w in _LABELS), *(rf"{w}\s+(?:(?:{'|'.join(_TITLES)})\.?\s+)?" for w in _LEADS),
               *(rf"{w}\b\.?\s+" for w in "Mrs Mr Ms Dr Prof Mme Mlle Sra Dra".split())], r"!\w"))
#: A capitalised word, or an initial with its dot.
TOKEN = re.compile(r"[A-ZÀ-ÖØ-Þ](?<![\w@.'’-][A-ZÀ-ÖØ-Þ])(?:\.(?=\s)|[^\W\d_]*(?:['’-][^\W\d_]+)*(?![\w@]))")
# fixed values: capitalised words that begin sentences or name offices and places, never persons
NOT_NAMES = frozenset(
    "the a an in on at for of by and since after before because among women men young people without according only few progress interviews lessons "
    "heavy rains where stock records transport costs between plans minutes name id phone address email contact call follow read version award isbn ward lot "
    "coordinates upper lower street road avenue close crescent lane way suite flat health fair clinic hospital bay centre center school desk unit bureau "
    "mission secretariat university ministry committee her his she he they we it is was as to from with her passport social security deliver send please "
    "reimburse prepared january february march april may june july august september october november december monday tuesday wednesday thursday friday "
    "saturday sunday il elle les la le des en el los las se un una por para según hacia más data dari di untuk os as um uma até depois segundo".split())


@dataclass
class NameModel:
    given: frozenset
    endings: frozenset

    def family(self, word: str) -> bool:
        low = word.lower()
        return len(low) >= 4 and low[-3:] in self.endings and low not in NOT_NAMES


def _token(m: re.Match) -> tuple[int, int, str, bool]:
    """(start, end, word, is an initial)."""
    word = m.group()
    return m.start(), m.end(), word, len(word) == 1 or word[-1] == "."


def _pair(text: str, tokens, i: int):
    """A name from token i on by shape: given [initial] family, initial family, or family, given."""
    s, e, w, initial = tokens[i]
    if i + 1 >= len(tokens):
        return None
    s2, e2, w2, initial2 = tokens[i + 1]
    gap = text[e:s2]
    if gap.isspace():
        if not initial2:
            return (w, w2, s, e2, initial)
        if i + 2 < len(tokens) and not initial:
            s3, e3, w3, initial3 = tokens[i + 2]
            if text[e2:s3].isspace() and not initial3:
                return (w, w3, s, e3, False)
    elif gap.strip() == "," and not initial and gap[0] == ",":
        if initial2:
            return (w2, w, s, s2 + 2 if text[s2 + 1:s2 + 2] == "." else e2, True)
        return (w2, w, s, e2, False)
    return None


def _sightings(texts: Iterable[str], anywhere: Counter, cued: Counter) -> None:
    """Adds capitalised words to ``anywhere``, and to ``cued`` what stands after cues: (kind, term), kind given or ending."""
    for text in texts:
        anywhere.update(map(str.lower, TOKEN.findall(text)))
        for m in CUE.finditer(text):
            tokens = list(map(_token, itertools.islice(TOKEN.finditer(text, m.end()), 3)))
            got = _pair(text, tokens, 0) if tokens and tokens[0][0] == m.end() else None
            if not got or got[0].lower() in NOT_NAMES or got[1].lower() in NOT_NAMES:
                continue
            if not got[4] and len(got[0]) > 1:
                cued["given", got[0].lower()] += 1
            cued["ending", got[1].lower()[-3:]] += 1


def _summed(anywhere: Counter, cued: Counter) -> dict[tuple[str, str, bool], int]:
    """(kind, term, cued) with its number; an ending stands where a word ends in it."""
    out = {(kind, term, True): n for (kind, term), n in cued.items()}
    for word, n in anywhere.items():
        if len(word) > 1 and word[-1] != ".":
            out["given", word, False] = n
            if len(word) > 2:
                ending = ("ending", word[-3:], False)
                out[ending] = out.get(ending, 0) + n
    return out


def _learnt(rows: Iterable[tuple[str, str, int, int]], cues: int) -> NameModel:
    """From (kind, term, sightings after cues, occurrences anywhere)."""
    known = {"given": set(), "ending": set()}
    for kind, term, n, anywhere in rows:
        if n >= LEAST_SEEN and (n >= CUED_SHARE * anywhere or kind == "ending" and n >= COMMON_ENDING * cues) and (kind == "given" or len(term) == 3):
            known[kind].add(term)
    return NameModel(frozenset(known["given"]), frozenset(known["ending"]))


def learn_names(texts: list[str]) -> NameModel:
    """Given names and family endings that stand after cues and titles."""
    anywhere, cued = Counter(), Counter()
    _sightings(texts, anywhere, cued)
    seen = _summed(anywhere, cued)
    rows = [(kind, term, n, seen.get((kind, term, False), 0)) for (kind, term, after), n in seen.items() if after]
    return _learnt(rows, sum(n for kind, _, n, _ in rows if kind == "ending"))


def _count_sightings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anywhere, cued = Counter(), Counter()

    def flush():
        seen = _summed(anywhere, cued)
        kinds, terms, after = zip(*seen) if seen else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(terms, pa.string()), pa.array(after, pa.bool_()), pa.array(list(seen.values()), pa.int64())],
            names=["kind", "term", "cued", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            _sightings([text], anywhere, cued)
            if len(anywhere) + len(cued) > FLUSH:
                yield flush()
                anywhere.clear()
                cued.clear()
    if anywhere or cued:
        yield flush()


def fit(df: DataFrame, text: str = "text") -> NameModel:
    """The names of all texts; what reaches the driver is what stands after cues at least ``LEAST_SEEN`` times."""
    counted = df.where(F.col(text).isNotNull()).select(text).mapInArrow(_count_sightings, "kind string, term string, cued boolean, n bigint")
    n = lambda cued: F.coalesce(F.sum(F.when(F.col("cued") == cued, F.col("n"))), F.lit(0))
    summed = materialize(counted.groupBy("kind", "term").agg(n(True).alias("n"), n(False).alias("anywhere")).where("n > 0"), "sightings")
    cues = summed.where("kind = 'ending'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = summed.where(F.col("n") >= LEAST_SEEN).toArrow()
    return _learnt(zip(*(top.column(c).to_pylist() for c in ("kind", "term", "n", "anywhere"))), cues)


def find(text: str, model: NameModel) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind), in order."""
    spans: list[tuple[int, int, str]] = [(m.start(), m.end(), "email") for m in _mails(text)]
    if ID_GATE.search(text):
        spans += [(m.start(1), m.end(1), "id") for m in ID.finditer(text)]
    spans += [(m.start(), m.end(), "phone") for m in _phones(text)]
    if ADDRESS_GATE.search(text):
        spans += [(m.start(), m.end(), "addr") for m in ADDRESS.finditer(text)]
    spans += _names(text, model)
    rank = {"email": 0, "id": 1, "addr": 2, "phone": 3, "name": 4}
    spans.sort(key=lambda x: (rank[x[2]], x[0], -x[1]))
    taken: list[tuple[int, int, str]] = []
    for s in spans:
        at = bisect(taken, s)
        if (at == 0 or taken[at - 1][1] <= s[0]) and (at == len(taken) or s[1] <= taken[at][0]):
            taken.insert(at, s)
    return taken


def _names(text: str, model: NameModel) -> list[tuple[int, int, str]]:
    tokens = list(map(_token, TOKEN.finditer(text)))
    given = model.given
    known = [word.lower() in given for _, _, word, _ in tokens]
    after_cue = {m.end() for m in CUE.finditer(text)}
    out, i = [], 0
    while i < len(tokens):
        step = 1
        start, end, _, single = tokens[i]
        cued = start in after_cue
        got = _pair(text, tokens, i) if single or known[i] or cued or i + 1 < len(tokens) and (known[i + 1] or tokens[i + 1][3]) else None
        if got:
            first, family, s, e, initial = got
            low, last = first.lower(), family.lower()
            blocked = last in NOT_NAMES or (not initial and low in NOT_NAMES)
            after_comma = text[end:end + 1] == ","
            ok = not blocked and (
                (not initial and low in given and last not in given and (not after_comma or model.family(family)))
                or (initial and model.family(family))
                or (cued and (model.family(family) or not after_comma and not initial)))
            if ok:
                out.append((s, e, "name"))
                step = sum(1 for t in tokens[i:i + 3] if t[0] < e)
        i += step
    return out


ENTITIES = "start int, end int, kind string, val string"


def entities(df: DataFrame, model: NameModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, kind, val): every stretch that is replaced, where it stands; one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, a, b, kind, t[a:b]) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for a, b, kind in find(t, model)]
            columns = list(zip(*rows)) or [[]] * 5
            types = (batch.schema.types[0], pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, types)], names=["key", "start", "end", "kind", "val"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, {ENTITIES}").withColumnRenamed("key", key)


def found_values(df: DataFrame, model: NameModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, val): each value of a row once, by its first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    rows += [(k, kind, val) for kind, val in dict.fromkeys((kind, t[a:b]) for a, b, kind in find(t, model))]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, (pa.int64(), pa.string(), pa.string()))], names=["key", "kind", "val"])

    return df.select(F.col(key).cast("bigint"), text).mapInArrow(run, "key bigint, kind string, val string").withColumnRenamed("key", key)


def placeholders(text: str, model: NameModel) -> str:
    """Typed placeholders, the same number for the same value (names and mails without regard to case)."""
    out, last, numbers = [], 0, {}
    for a, b, kind in find(text, model):
        entity = (kind, " ".join(text[a:b].split()).lower())
        n = numbers.setdefault(entity, sum(k[0] == kind for k in numbers) + 1)
        out += [text[last:a], f"[{kind.upper()}_{n}]"]
        last = b
    return "".join([*out, text[last:]])


def _prf(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest()[:8], "big")


def permute_digits(digits: str, key: bytes, rounds: int = 8) -> str:
    """A keyed permutation of the numbers of one length (an unbalanced Feistel network): different in, different out."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + _prf(key, "digit")) % 10) if digits else digits
    a = n // 2
    left, right = digits[:a], digits[a:]
    for r in range(rounds):
        if r % 2:
            right = str((int(right) + _prf(key, str(r), str(n), left)) % 10 ** len(right)).zfill(len(right))
        else:
            left = str((int(left) + _prf(key, str(r), str(n), right)) % 10 ** len(left)).zfill(len(left))
    return left + right


_ONSETS, _VOWELS, _CODAS = "b d f g k l m n p r s t v z br dr kl st tr".split(), "a e i o u".split(), "n r s l m".split()
LETTERS = re.compile(r"[^\W\d_]+")
MAIL_SIGN = re.compile(r"\s*(?:@|[\[({]\s*at\s*[\])}]|\s(?:at|AT|arroba)\s)\s*")
MAIL_DOT = re.compile(r"\.|[\[({]\s*dot\s*[\])}]|\s(?:dot|DOT|punto|ponto|point)\s")
# fixed values: words of an address that say what it is and stay
KEPT = re.compile(rf"{STREET}|(?i:flat|suite|apt|apartment|unit|room|floor|bis|rue|avenue|boulevard|place|chemin|allée|impasse|quai|calle|avenida|plaza|paseo|carrera"
                  r"|rua|travessa|jalan|jl|de|du|des|del|da|do|dos|das|la|las|los|le|l|d|no|n)")
SYLLABLES, MOST_CLASHES = 4, 100_000


@dataclass
class Surrogates:
    """Keyed replacements; ``salts`` holds the words whose first replacement was another's."""

    key: bytes
    given: frozenset
    syllables: int = SYLLABLES
    salts: dict = field(default_factory=dict)
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": {}}

    def word(self, low: str) -> str:
        """The replacement of a lower-cased word: a given name keeps the gender its ending suggests; one letter stays one letter."""
        new = self._made.get(low)
        if new is None:
            if len(low) == 1:
                new = chr(97 + (ord(low) - 97 + _prf(self.key, "initial")) % 26) if low.isascii() else low
            else:
                h = _prf(self.key, "word", low, str(self.salts.get(low, 0)))
                new = ""
                for _ in range(self.syllables):
                    h, at = divmod(h, len(_ONSETS) * len(_VOWELS))
                    new += _ONSETS[at // len(_VOWELS)] + _VOWELS[at % len(_VOWELS)]
                if low in self.given:
                    new = new[:-1] + ("a" if low.endswith("a") else "o" + _CODAS[h % len(_CODAS)])
            if len(self._made) < 400_000:
                self._made[low] = new
        return new

    def words(self, text: str) -> str:
        return LETTERS.sub(lambda m: _cased(self.word(m.group().lower()), m.group()), text)

    def digits(self, text: str) -> str:
        return re.sub(r"\d+", lambda m: permute_digits(m.group(), self.key), text)

    def of(self, kind: str, value: str) -> str:
        if kind in ("phone", "id"):
            made = iter(permute_digits("".join(c for c in value if c.isdigit()), self.key))
            at = itertools.count()
            shifted = re.sub(r"[A-Z]", lambda m: chr(65 + (ord(m.group()) - 65 + _prf(self.key, "letter", str(next(at)))) % 26), value)
            return re.sub(r"\d", lambda _: next(made), shifted)
        if kind == "email":
            m = MAIL_SIGN.search(value)
            dots = list(MAIL_DOT.finditer(value, m.end())) if m else []
            end = dots[-1].start() if dots else len(value)  # the last part of a domain says what it is and stays
            inside = value[m.end():end] if m else ""
            spelt = [x for d in MAIL_DOT.finditer(inside) for x in d.span()]
            cuts = [0, *spelt, len(inside)]
            domain = "".join(self.digits(self.words(part)) if i % 2 == 0 else part for i, part in enumerate(inside[a:b] for a, b in zip(cuts, cuts[1:])))
            head = value[:m.start()] if m else value
            return self.digits(self.words(head)) + (value[m.start():m.end()] + domain + value[end:] if m else "")
        if kind == "addr":
            return self.digits(LETTERS.sub(lambda m: m.group() if KEPT.fullmatch(m.group()) else self.words(m.group()), value))
        return self.words(value)


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() else word.capitalize() if like[:1].isupper() else word


def _replaced_words(model: NameModel):
    """The lower-cased words of all entities that become made-up words, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            fresh = {w.lower() for t in batch.column(0).to_pylist() if t for a, b, kind in find(t, model) if kind in ("name", "email", "addr")
                     for w in LETTERS.findall(t[a:b]) if len(w) > 1} - seen
            if len(seen) < 1_000_000:
                seen |= fresh
            yield pa.RecordBatch.from_arrays([pa.array(sorted(fresh), pa.string())], names=["word"])

    return run


def fit_surrogates(df: DataFrame, model: NameModel, secret: str, text: str = "text") -> Surrogates:
    """Replacements under which no two words of the corpus meet, and none becomes another word of it.

    The words are compared as a table by what they become; only those that meet
    reach the driver and take the next salt, until none meet.  Where more than
    ``MOST_CLASHES`` would, the made-up words get a syllable more.
    """
    words = materialize(df.where(F.col(text).isNotNull()).select(text).mapInArrow(_replaced_words(model), "word string").distinct(), "replaced-words")
    made = Surrogates(secret.encode(), model.given)
    while True:
        new = F.pandas_udf(lambda s: s.map(made.word), "string")
        both = words.select("word", new("word").alias("new")).unionByName(words.select(F.lit(None).cast("string").alias("word"), F.col("word").alias("new")))
        met = both.groupBy("new").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("word").isNull()).alias("taken"), F.min("word").alias("first")).where("n > 1")
        again = words.select("word", new("word").alias("new")).join(met, "new").where(F.col("taken") | (F.col("word") != F.col("first")))
        clashes = [r["word"] for r in again.select("word").limit(MOST_CLASHES + 1).collect()]
        if not clashes:
            return made
        if len(clashes) + len(made.salts) > MOST_CLASHES:
            made = Surrogates(made.key, made.given, made.syllables + 1)
        else:
            made = Surrogates(made.key, made.given, made.syllables, made.salts | {w: made.salts.get(w, 0) + 1 for w in clashes})


def with_surrogates(text: str, model: NameModel, surrogates: Surrogates) -> str:
    out, last = [], 0
    for a, b, kind in find(text, model):
        out += [text[last:a], surrogates.of(kind, text[a:b])]
        last = b
    return "".join([*out, text[last:]])


def replaced(df: DataFrame, model: NameModel, key: str = "doc_id", text: str = "text", surrogates: Surrogates | None = None) -> DataFrame:
    """(key, text): with typed placeholders, or with surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and (placeholders(t, model) if surrogates is None else with_surrogates(t, model, surrogates)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
