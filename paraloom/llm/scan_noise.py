"""Problem 1: noise in texts from scanned pages, and its repair.

The vocabulary of the whole collection is counted, and so is which words stand
near the ``CONTEXT_WORDS`` most frequent ones.  From these sums skip-gram vectors
with negative sampling are trained: those of the context words together on the
driver, those of every rarer word by itself in the tasks.  A rare word is linked to the
frequent words that plausible glyph edits lead to.  Where it stands, the odds that
it is one of them misread are those of the counts, of a misreading, and of the
words beside it under the two words' vectors; at even odds and better it is
corrected.  So a clear misreading is told by its counts, and a word that may be
right itself by what it stands among.  A line break after
a hyphen splits a word if the joined word is commoner in the collection than
the hyphenated one.  Lines that give a page number go first, then running
headers (interior lines that repeat the file's title), and the rest is reflowed.

Defined results: null, empty and blank texts have no noise and stay as they
are; lists, tables and junk are left as they are; a file without a title has no
headers; titles given twice count once; repeated rows are each repaired.
"""

from __future__ import annotations

import difflib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.llm import text_quality
from paraloom.llm.boilerplate import line_key, source_of
from paraloom.session import materialize

# fixed values: what a scan makes of letters, as (true, seen)
GLYPHS = (
    ("e", "c"), ("c", "e"), ("i", "1"), ("l", "1"), ("a", "ã"), ("o", "0"), ("s", "5"), ("n", "ri"), ("d", "cl"), ("cl", "d"),
    ("t", "†"), ("u", "ii"), ("g", "q"), ("g", "9"), ("h", "li"), ("li", "h"), ("m", "rn"), ("rn", "m"), ("in", "m"), ("y", "v"),
    ("w", "vv"), ("ll", "||"), ("l", "|"), ("l", "i"), ("i", "l"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("b", "8"), ("b", "6"),
    ("l", "!"), ("e", "€"), ("o", "c"), ("f", "t"), ("nn", "rm"), ("ti", "h"),
)
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
VOCABULARY = 200_000  # most frequent words that are kept; rarer ones are what is repaired
CONTEXT_WORDS, DIMENSIONS = 4_000, 24  # words that vectors are learnt from; every frequent word gets one
WINDOW, NEGATIVES, STEP, ROUNDS = 3, 4, 0.05, 60
ROWS_AT_ONCE, WORDS_AT_ONCE = 256, 2_000_000  # rows of the dense sums, words of a task's texts
MISREAD = 1 / 12  # of a word's occurrences, so many at most are one misreading of it
LEAST_RATIO = 4  # a true word is at least so many times as frequent, whatever its context says
PRIOR = 30  # neighbours as drawn anywhere that every word is given beside its own, so that few tell little
WEIGHT = 0.5  # of the evidence of the words beside, which do not tell independently of each other
MAX_EDITS, LONG_WORD = 3, 32  # words with more letters are tried with one edit

WORD, ASCII_WORD = re.compile(r"[^\W\d_]+"), re.compile(r"[a-z]+")
TERM, ASCII_TERM = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*"), re.compile(r"[a-z]+(?:-[a-z]+)*")
ASCII_TOKEN = re.compile(r"[a-z0-9](?:[a-z0-9_|!]*[a-z0-9_|!])?|\|[a-z0-9_|!]+")  # of lower-cased text
TOKEN = re.compile(r"[^\W_](?:[\w†‡|!€]*[\w†|!])?|[†|][\w†|!]+")
SOFT = "¬\xad"
BREAK = re.compile(r"(?<![^\W\d_])([^\W\d_]+(?:[-‐][^\W\d_]+)*)([-‐¬\xad])[ \t]*\r?\n\s*([^\W\d_][\w†|!]*)")
HYPHEN_END = re.compile(r"[-‐¬\xad][ \t]*\r?\n")
PAGE = re.compile(
    r"""\s*(?:
    [-–—\[(|]*\s*(?:\d{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})\s*[-–—\])|]*
    |(?:page|pag|pages|p|pg|página|pág|page|halaman|hal|seite|صفحة|หน้า)\s*\.?\s*[\[(]?\d{1,4}[\])]?(?:\s*(?:of|/|de|sur|dari|von)\s*\d{1,4})?
    |\d{1,4}\s*(?:/|of|de|sur|dari)\s*\d{1,4}
    |\d{1,4}\s*\|\s*p\s*a\s*g\s*e
    |p\s*a\s*g\s*e\s*\|?\s*\d{1,4}
    )\s*""", re.X | re.I)


@dataclass
class NoiseModel:
    counts: dict[str, int]
    rows: dict[str, int]  # words with vectors
    inner: np.ndarray
    outer: np.ndarray
    frequent: int
    most: int  # count of the most frequent word
    _cache: dict = field(default_factory=dict, repr=False)
    _plain: set = field(default_factory=set, repr=False)
    _longest: int | None = field(default=None, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"_cache": {}, "_plain": set(), "_longest": None}

    def _reach(self) -> int:
        if self._longest is None:
            self._longest = max(map(len, self.counts), default=0) + MAX_EDITS
        return self._longest

    def suspicious(self, word: str) -> bool:
        """Whether a lower-cased word may be a misreading of a more frequent one."""
        if word in self._plain:
            return False
        doubtful = (len(word) > 1 and not word.isdigit() and any(map(str.isalpha, word))
                    # no word is frequent enough to be the truth behind the commonest
                    and self.counts.get(word, 0) * LEAST_RATIO <= self.most and bool(self.candidates(word)))
        if not doubtful and len(self._plain) < 400_000:
            self._plain.add(word)
        return doubtful

    def candidates(self, word: str) -> list[str]:
        """Frequent words that plausible glyph edits of ``word`` lead to, the fewest edits first."""
        found = self._cache.get(word)
        if found is None:
            # an edit changes a word's length by one at most
            near = () if len(word) > self._reach() else glyph_neighbours(word, self.counts, max(self.frequent, LEAST_RATIO * self.counts.get(word, 0)))
            # a misreading that is frequent itself leads on to what it is one of; letters in another order are a slip of typing
            truths = dict.fromkeys(t for c in near for t in self.candidates(c) or [c])
            found = [t for t in truths if sorted(t) != sorted(word)]
            if len(self._cache) < 200_000:
                self._cache[word] = found
        return found

    def evidence(self, word: str, context: list[str]) -> float:
        """How much likelier its neighbours are beside ``word`` than anywhere (a logarithm); 0 where nothing is known."""
        row = self.rows.get(word)
        known = len(self.outer)
        near = [r for r in (self.rows.get(c, known) for c in context) if r < known]
        if row is None or not near:
            return 0.0
        return WEIGHT * float((self.outer[near] @ self.inner[row]).sum() + len(near) * math.log(NEGATIVES))

    def correct(self, word: str, context: list[str]) -> str | None:
        """The true word behind a rare one, or None."""
        options = self.candidates(word)
        if not options:
            return None
        odds = {c: math.log(self.counts[c] * MISREAD) + self.evidence(c, context) for c in options}
        best = max(odds, key=odds.get)
        itself = math.log(max(self.counts.get(word, 0), 1)) + self.evidence(word, context)
        return best if odds[best] >= itself else None


_BY_SEEN: dict[str, list[str]] = {}
for _true, _seen in GLYPHS:
    _BY_SEEN.setdefault(_seen, []).append(_true)


def glyph_neighbours(word: str, counts: dict[str, int], least: int) -> list[str]:
    """Words of ``counts`` with at least ``least`` occurrences, as few glyph edits away as possible.

    One to three edits at different places, at most one for every two letters;
    words over ``LONG_WORD`` letters are tried with one.
    """
    sites = [(i, i + k, true) for i in range(len(word)) for k in (1, 2) if i + k <= len(word) for true in _BY_SEEN.get(word[i:i + k], ())]
    for edits in range(1, (1 if len(word) > LONG_WORD else min(MAX_EDITS, max(1, len(word) // 2))) + 1):
        found = []
        for chosen in itertools.combinations(sites, edits):
            if any(x[1] > y[0] for x, y in zip(chosen, chosen[1:])):
                continue
            v, at = "", 0
            for start, end, true in chosen:
                v += word[at:start] + true
                at = end
            v += word[at:]
            # letters in another order are a slip of typing
            if counts.get(v, 0) >= least and sorted(v) != sorted(word):
                found.append(v)
        if found:
            return found
    return []


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            low = text.lower()
            total.update((ASCII_TERM if low.isascii() else TERM).findall(low))
        if len(total) > 300_000:
            yield flush()
            total.clear()
    if total:
        yield flush()


def term_table(df: DataFrame, text: str = "text", keep: int = VOCABULARY) -> dict[str, int]:
    """The most frequent words and hyphenated words with their counts over all rows, at most ``keep``.

    The least count is read off a histogram of counts, so that what reaches the
    driver is the histogram and these words, however large the vocabulary is.
    """
    counted = df.where(F.col(text).isNotNull()).select(text).mapInArrow(_count_terms, "term string, n bigint")
    summed = materialize(counted.groupBy("term").agg(F.sum("n").alias("n")).where("n >= 2"), "terms")
    step = F.floor(16 * F.log2("n")).cast("int")
    words, cut = 0, 0
    for row in summed.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        words += row["words"]
        if words > keep:
            cut = row["step"] + 1
            break
    top = summed.where(step >= cut).toArrow()
    counts = dict(zip(top.column("term").to_pylist(), top.column("n").to_pylist()))
    for term, n in list(counts.items()):  # the parts of hyphenated words are words too
        if "-" in term:
            for part in term.split("-"):
                counts[part] = counts.get(part, 0) + n
    return counts


def _words_with_vectors(counts: dict[str, int], least: int) -> dict[str, int]:
    """Row of every word that may be taken for the truth, the most frequent first."""
    words = sorted((w for w, n in counts.items() if n >= least and "-" not in w), key=lambda w: (-counts[w], w))
    return {w: i for i, w in enumerate(words)}


def _ids_of(text: str, rows: dict[str, int]) -> list[int]:
    low = text.lower()
    return [i for i in map(rows.get, (ASCII_WORD if low.isascii() else WORD).findall(low)) if i is not None]


def _apart(texts: pa.ListArray) -> np.ndarray:
    """The rows of all texts one after another, with a window of -1 before, between and after them."""
    values, width = texts.flatten().to_numpy(zero_copy_only=False), np.diff(texts.offsets.to_numpy())
    flat = np.full(len(values) + WINDOW * (len(texts) + 1), -1, np.int64)
    flat[np.arange(len(values)) + WINDOW * (1 + np.repeat(np.arange(len(texts)), width))] = values
    return flat


def _neighbours(texts: pa.ListArray, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, number) of the words within the window of each other, each pair once, the context being the more frequent."""
    flat = _apart(texts)
    keys = []
    for d in range(1, WINDOW + 1):
        a, b = flat[:-d], flat[d:]
        low = np.minimum(a, b)
        near = (low >= 0) & (low < contexts)
        keys.append(np.maximum(a, b)[near] << 32 | low[near])
    keys, n = np.unique(np.concatenate(keys), return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, n


def _both_ways(word: np.ndarray, context: np.ndarray, n: np.ndarray, words: int, noise: np.ndarray) -> np.ndarray:
    """Shares of the neighbours of each word, from pairs told once."""
    sums = np.zeros((words, len(noise)), np.float32)
    sums[word, context] = n
    square = sums[:len(noise)]
    square += square.T.copy()
    return _shares(sums, noise)


def _dense(word: np.ndarray, context: np.ndarray, n: np.ndarray, words: int, noise: np.ndarray) -> np.ndarray:
    sums = np.zeros((words, len(noise)), np.float32)
    sums[word, context] = n
    return _shares(sums, noise)


def _shares(sums: np.ndarray, noise: np.ndarray) -> np.ndarray:
    total = sums.sum(1, keepdims=True) + PRIOR
    sums += PRIOR * noise
    sums /= total
    return sums


def _pull(share: np.ndarray, noise: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gradient of the skip-gram objective by logit: how often a pair was seen, against ``NEGATIVES`` drawn pairs."""
    p = 1 / (1 + np.exp(-np.clip(v @ u.T, -30, 30)))
    return share * (1 - p) - NEGATIVES * noise * p


class _Adam:
    def __init__(self, x: np.ndarray):
        self.x, self.m, self.s, self.t = x, np.zeros_like(x), np.zeros_like(x), 0

    def climb(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.s += 0.01 * (g * g - self.s)
        self.x += 2 * STEP * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.s / (1 - 0.99 ** self.t)) + 1e-8)


def train(share: np.ndarray, weight: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(inner, outer) of the context words; a row of ``share`` has the shares of a word's neighbours, ``weight`` how often it stands."""
    rng = np.random.default_rng(seed)
    n = len(weight)
    inner = rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32)
    outer = np.zeros_like(inner)
    noise = _noise(weight)
    mass = (weight / weight.sum()).astype(np.float32)[:, None]
    a, b = _Adam(inner), _Adam(outer)
    for _ in range(ROUNDS):
        to_inner, to_outer = np.empty_like(inner), np.zeros_like(outer)
        for s in range(0, n, ROWS_AT_ONCE):
            at = slice(s, s + ROWS_AT_ONCE)
            g = _pull(share[at], noise, inner[at], outer)
            to_inner[at] = g @ outer
            to_outer += (g * mass[at]).T @ inner[at]
        a.climb(to_inner)
        b.climb(to_outer)
    return inner, outer


def _noise(weight: np.ndarray) -> np.ndarray:
    drawn = weight.astype(float) ** 0.75
    return (drawn / drawn.sum()).astype(np.float32)


def fold(share: np.ndarray, noise: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Inner vectors of further words, each from its own neighbours under the same objective."""
    inner = np.zeros((len(share), DIMENSIONS), np.float32)
    step = _Adam(inner)
    for _ in range(ROUNDS):
        step.climb(_pull(share, noise, inner, outer) @ outer)
    return inner


def skip_grams(texts: list[str], counts: dict[str, int], seed: int = 3):
    """Skip-gram vectors with negative sampling of a few texts: (row of each word, inner, outer)."""
    rows = _words_with_vectors(counts, 1)
    contexts = min(len(rows), CONTEXT_WORDS)
    ids = pa.array([_ids_of(t, rows) for t in texts], pa.list_(pa.int32()))
    weight = np.array([counts[w] for w in rows], float)
    noise = _noise(weight[:contexts])
    share = _both_ways(*_neighbours(ids, contexts), len(rows), noise)
    inner, outer = train(share[:contexts], weight[:contexts], seed)
    return rows, np.concatenate([inner, fold(share[contexts:], noise, outer)]), outer


def _vectors(texts: DataFrame, rows: dict[str, int], counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(inner, outer) from the sums of neighbours over all texts; tasks sum their own."""
    contexts = min(len(rows), CONTEXT_WORDS)
    weight = np.array([counts[w] for w in itertools.islice(rows, contexts)], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(pa.array([_ids_of(t, rows) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())))
            size += len(held[-1].flatten())
            if size >= WORDS_AT_ONCE:
                yield summed(held)
                held, size = [], 0
        if held:
            yield summed(held)

    def summed(held):
        columns = _neighbours(pa.concat_arrays(held), contexts)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], names=["word", "context", "n"])

    cells = materialize(texts.mapInArrow(run, "word int, context int, n bigint").groupBy("word", "context").agg(F.sum("n").alias("n")), "neighbours")
    top = cells.where(F.col("word") < contexts).toArrow()
    noise = _noise(weight)
    share = _both_ways(*(top.column(c).to_numpy() for c in ("word", "context", "n")), contexts, noise)
    inner, outer = train(share, weight)
    if len(rows) > contexts:

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(s, ROWS_AT_ONCE).to_pylist()
                    at = np.repeat(np.arange(len(part)), [len(r["cells"]) for r in part])
                    flat = [(c["context"], c["n"]) for r in part for c in r["cells"]]
                    got = fold(_dense(at, *np.array(flat).T, len(part), noise), noise, outer)
                    yield pa.RecordBatch.from_arrays([pa.array([r["word"] for r in part], pa.int32()), pa.array(list(got), pa.list_(pa.float32()))], names=["word", "vector"])

        grouped = cells.where(F.col("word") >= contexts).groupBy("word").agg(F.collect_list(F.struct("context", "n")).alias("cells"))
        got = grouped.mapInArrow(rest, "word int, vector array<float>").toArrow()
        inner = np.concatenate([inner, np.zeros((len(rows) - contexts, DIMENSIONS), np.float32)])
        if got.num_rows:
            inner[got.column("word").to_numpy()] = np.array(got.column("vector").to_pylist(), np.float32)
    return inner, outer


def fit(df: DataFrame, text: str = "text") -> NoiseModel:
    """Everything is learnt from all texts."""
    texts = df.where(F.col(text).isNotNull()).select(text)
    counts = term_table(df, text)
    frequent = max(4, round(sum(counts.values()) * 2e-6))
    rows = _words_with_vectors(counts, frequent)
    inner, outer = _vectors(texts, rows, counts) if rows else (np.zeros((1, DIMENSIONS), np.float32),) * 2
    return NoiseModel(counts, rows, inner, outer, frequent, max(counts.values(), default=0))


def belongs(left: str, right: str, sign: str, model: NoiseModel) -> bool:
    """Whether a hyphen at a line end is part of the word."""
    if sign in SOFT:
        return False
    left, right = left.lower().replace("‐", "-"), right.lower()
    tail = left.rsplit("-", 1)[-1]
    counts = model.counts
    joined, hyphenated = counts.get(tail + right, 0), counts.get(f"{tail}-{right}", 0)
    if not joined and not hyphenated:  # either side may be misread
        if model.candidates(tail + right):
            return False
        hyphenated = max((counts.get(f"{t}-{r}", 0) for t in (tail, *model.candidates(tail)) for r in (right, *model.candidates(right))), default=0)
    if joined or hyphenated:
        return hyphenated >= joined
    if counts.get(tail, 0) >= model.frequent and counts.get(right, 0) >= model.frequent and len(tail) > 2 and len(right) > 2:
        return True
    return False


def is_page_line(line: str) -> bool:
    return bool(line.strip()) and bool(PAGE.fullmatch(line))


def looks_like_header(line: str) -> bool:
    words = re.findall(r"[^\W\d_][\w'’-]*", line)
    if not 2 <= len(words) <= 16 or re.search(r"[,;:?!]\s|[^.]\.\s*$", line):
        return False
    long = [w for w in words if len(w) > 3]
    return bool(long) and sum(w[0].isupper() for w in long) >= 0.7 * len(long)


@dataclass
class Reading:
    text: str
    kinds: set
    headers: list


def read(text: str, model: NoiseModel, titles: set[int] | None = None) -> Reading:
    """Repair one text.  ``titles``: numbers of the lines known to be headers; None keeps header-like lines out of words only."""
    kinds: set[str] = set()
    lines = text.split("\n")
    kept, headers, filled = [], [], [i for i, x in enumerate(lines) if x.strip()]
    for i, line in enumerate(lines):
        if len(filled) > 1 and is_page_line(line) and (filled[0] < i < filled[-1] or not line.strip().isdigit() or len(line.strip()) < 4):
            kinds.add("pageno")
        elif len(filled) > 2 and filled[0] < i < filled[-1] and looks_like_header(line):
            headers.append(i)
            if titles is not None and i not in titles:
                kept.append(line)
        else:
            kept.append(line)
    body = "\n".join(kept)
    if "\n" in body:
        body = _join(body, kinds, model)
    body, misread = _respell(body, model)
    if misread:
        kinds.add("chars")
    return Reading(body, kinds, headers)


def _join(body: str, kinds: set, model: NoiseModel) -> str:
    def mend(m: re.Match) -> str:
        left, sign, right = m.groups()
        if belongs(left, right, sign, model):
            return f"{left}-{right}"
        kinds.add("hyphen")
        return left + right

    before = None
    while before != body and HYPHEN_END.search(body):
        before, body = body, BREAK.sub(mend, body)
    return body


def _respell(body: str, model: NoiseModel) -> tuple[str, int]:
    low = body.lower()
    found = (ASCII_TOKEN if low.isascii() else TOKEN).findall(low)
    if model._plain.issuperset(found):
        return body, 0
    doubtful = {w for w in set(found) - model._plain if model.suspicious(w)}
    if not doubtful:
        return body, 0
    out, last, fixed = [], 0, 0
    matches = list(TOKEN.finditer(body))
    words = [m.group().lower() for m in matches]
    for i, word in enumerate(words):
        if word not in doubtful:
            continue
        true = model.correct(word, words[max(0, i - WINDOW):i] + words[i + 1:i + 1 + WINDOW])
        if true is None or true == word:
            continue
        fixed += 1
        seen = matches[i].group()
        out.append(body[last:matches[i].start()])
        out.append(true.upper() if seen.isupper() and len(seen) > 2 else true.capitalize() if seen[0].isupper() else true)
        last = matches[i].end()
    out.append(body[last:])
    return "".join(out), fixed


def reflow(text: str) -> str:
    """Lines of one paragraph run on; blank lines part paragraphs where a sentence ended."""
    parts = re.split(r"\n\s*\n", text.replace("\r", ""))
    joined: list[str] = []
    for part in (" ".join(p.split()) for p in parts):
        if part and joined and not re.search(r"[.!?:؟]['\"”’)]*$", joined[-1]):
            joined[-1] += " " + part
        elif part:
            joined.append(part)
    return "\n\n".join(joined)


SIGNS = "para_id bigint, filename string, kind string, line_no int, line string"


def signs(df: DataFrame, model: NoiseModel) -> DataFrame:
    """(para_id, filename, kind, line_no, line): the noise of every prose text; kind ``maybe_header`` still needs the title."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for para, name, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not text or not text.strip() or text_quality.kind_of(text) != "prose":
                    continue
                got = read(text, model)
                rows += [(para, name, k, None, None) for k in sorted(got.kinds)]
                lines = text.split("\n") if got.headers else []
                rows += [(para, name, "maybe_header", i, lines[i]) for i in got.headers]
            columns = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["para_id", "filename", "kind", "line_no", "line"])

    return df.select(F.col("para_id").cast("bigint"), "filename", "text").mapInArrow(run, SIGNS)


def repeats_title(line: str, title: str) -> bool:
    """The line gives the title, or the beginning or another part of it, besides numbers and codes."""
    letters = lambda x: " ".join(re.findall(r"[^\W\d_]+", x.lower()))
    a, b = letters(line), letters(title)
    if len(a.split()) < 2 or not b:
        return False
    a_short = letters(re.sub(r"\|.*$|^.*\|\s*(?=\w+ \w+)", "", line)) or a
    for x in {a, a_short}:
        if f" {x} " in f" {b} " or f" {b} " in f" {x} " or len(x) >= 12 and x in b:
            return True
        m = difflib.SequenceMatcher(None, x, b, autojunk=False)
        if sum(t.size for t in m.get_matching_blocks() if t.size > 2) >= 0.85 * len(x):
            return True
    return False


def _titled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [repeats_title(x, t) for x, t in zip(batch.column("line").to_pylist(), batch.column("title").to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_()))


HOT_FILES = 1_000


def headers(found: DataFrame, files: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(para_id, filename, line_no, line): header-like lines that repeat their file's title and are no line repeated across the source."""
    titles = files.where(F.col("title").isNotNull()).select("filename", "title").distinct()
    maybe = found.where("kind = 'maybe_header'").select("para_id", "filename", "line_no", "line")
    # files with more than a thousandth of these lines, of which there are less than a thousand, meet their titles where they are
    hot = maybe.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_FILES > F.lit(maybe.count())).select("filename")
    hot_titles = F.broadcast(titles.join(F.broadcast(hot), "filename", "left_semi"))
    crowded = maybe.join(F.broadcast(hot), "filename", "left_semi").join(hot_titles, "filename")
    others = maybe.join(F.broadcast(hot), "filename", "left_anti").join(titles, "filename")
    both = [x.select("para_id", "filename", "line_no", "line", "title") for x in (crowded, others)]
    matched = both[0].unionByName(both[1]).mapInArrow(_titled, "para_id bigint, filename string, line_no int, line string, title string")
    matched = materialize(matched.drop("title").distinct(), "headers")
    keyed = matched.select("filename", source_of(F.col("filename")).alias("source"), line_key(F.col("line")).alias("key"))
    long = keyed.where(F.size(F.split("key", " ")) >= 5).distinct().groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    all_files = paragraphs.select("filename").distinct().groupBy(source_of(F.col("filename")).alias("source")).agg(F.count(F.lit(1)).alias("files"))
    repeated = long.join(all_files, "source").where("n >= files * 0.2").select("source", "key")
    return matched.withColumns({"source": source_of(F.col("filename")), "key": line_key(F.col("line"))}).join(repeated, ["source", "key"], "left_anti").drop("source", "key")


def repaired(df: DataFrame, model: NoiseModel, header_lines: DataFrame) -> DataFrame:
    """(para_id, text, kinds): every text as continuous prose."""
    drop = header_lines.groupBy("para_id").agg(F.collect_set("line_no").alias("drop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = [], []
            for text, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not text or not text.strip() or text_quality.kind_of(text) != "prose":
                    texts.append(text)
                    kinds.append([])
                    continue
                got = read(text, model, set(lines or ()))
                texts.append(reflow(got.text))
                kinds.append(sorted(got.kinds | ({"header"} if lines else set())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["para_id", "text", "kinds"])

    return df.select("para_id", "text").join(drop, "para_id", "left").mapInArrow(run, "para_id bigint, text string, kinds array<string>")
