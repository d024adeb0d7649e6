"""Problem 4: the language of every text, and of every stretch of one language in it.

A sentence is the average of hashed subword embeddings under a linear softmax,
trained by stochastic gradient descent in numpy.  The classifier is fitted on a
bounded sample of the delivered labels (``PER_LANGUAGE`` rows of each language,
chosen by hash over the whole table); since these labels are partly wrong,
sentences whose function words contradict the label are left out, the first fit
drops those it contradicts itself, and the second fit is the one kept.
Confidences are calibrated by a temperature on held-out sentences, which neither
fit has seen or chosen, and a sentence under the calibrated limit is ``und``.

As the classifier is linear, the logits of a sentence are the mean of its
words' logits, so each task keeps a table of word logits and touches no subword
of a word it has seen.

Defined results: null, empty and blank texts have no stretches; texts without
letters are ``und``; repeated rows give rows each; nothing is cut off long texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraloom.llm import text_quality
from paraloom.llm.words import FUNCTION_WORDS, LETTERS

LANGUAGES = tuple(FUNCTION_WORDS)
# fixed values: the ways a label names each language, lower-cased and without region
NAMES = {
    "en": "en eng english", "fr": "fr fra fre french", "es": "es spa spanish", "pt": "pt por portuguese",
    "id": "id ind indonesian", "ar": "ar ara arabic", "th": "th tha thai",
}
BUCKETS, DIMENSIONS = 1 << 15, 16
PER_LANGUAGE = 250
LONGEST_SAMPLE = 100_000  # characters of a text that may be in the sample
EPOCHS, RATE, BATCH = 5, 0.5, 16
WORDS_KEPT = 300_000
#: Characters of a sentence where none is marked, as long as fewer than ``LEAST_STRETCHES`` stretches tell it.
UNMARKED, LEAST_STRETCHES = 80.0, 25

SENTENCE_END = re.compile(r"[.!?؟]+[\"'”’)\]]*(?=\s)")
THAI = re.compile(r"[฀-๿]")
LATIN_RUN = re.compile(r"(?:[^\s฀-๿]+\s+){3,}[^\s฀-๿]+")


def label_language(label: Column) -> Column:
    """The language a label names, or null (null, empty, ``und`` and unknown names)."""
    base = F.lower(F.trim(F.regexp_extract(label, r"^\s*([A-Za-z]+)", 1)))
    names = {name: lang for lang, all_names in NAMES.items() for name in all_names.split()}
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(mapping, base)


def subwords(word: str) -> list[int]:
    marked = f"<{word}>"
    grams = {marked, *(marked[i:i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1))}
    return [zlib.crc32(g.encode()) % BUCKETS for g in sorted(grams)]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Sentences as spans; line breaks do not end one, a change out of or into Thai does."""
    spans, start = [], 0
    for m in SENTENCE_END.finditer(text):
        if m.end() - start > 1:
            spans.append((start, m.end()))
            start = m.end()
    if text[start:].strip():
        spans.append((start, len(text)))
    if not THAI.search(text):
        return spans
    cut = []
    for a, b in spans:
        part = text[a:b]
        if not THAI.search(part):
            cut.append((a, b))
            continue
        at = 0
        for m in LATIN_RUN.finditer(part):
            if part[at:m.start()].strip():
                cut.append((a + at, a + m.start()))
            cut.append((a + m.start(), a + m.end()))
            at = m.end()
        if part[at:].strip():
            cut.append((a + at, b))
    return cut


@dataclass
class LanguageModel:
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.5
    accuracy: float = 0.0
    unmarked: float = UNMARKED
    _ids: dict = field(default_factory=dict, repr=False)
    _logits: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"_ids": {}, "_logits": []}

    def word_logits(self, word: str) -> np.ndarray:
        return self.embeddings[subwords(word)].mean(0) @ self.weights

    def probabilities(self, sentences: list[list[str]]) -> np.ndarray:
        """One row of calibrated probabilities for each sentence, given as its words."""
        if len(self._ids) > WORDS_KEPT:
            self._ids, self._logits = {}, []
        ids, known = [], self._ids
        for words in sentences:
            for w in words:
                i = known.get(w)
                if i is None:
                    i = known[w] = len(self._logits)
                    self._logits.append(self.word_logits(w))
                ids.append(i)
        lengths = np.array([len(w) for w in sentences])
        out = np.zeros((len(sentences), len(LANGUAGES)))
        if ids:
            table = np.asarray(self._logits)
            full = lengths > 0
            starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
            out[full] = np.add.reduceat(table[ids], starts, axis=0) / lengths[full, None] + self.bias
        z = out / self.temperature
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)


def _sgd(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int):
    """Plain SGD on (subword ids, their shares) rows.

    An embedding takes the gradient of the sentence whole instead of its share
    of it; otherwise the thousands of rows that occur once or twice would not move.
    """
    rng = np.random.default_rng(seed)
    k = len(LANGUAGES)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = rng.normal(0, 0.3, (DIMENSIONS, k)).astype(np.float32), np.zeros(k, np.float32)
    counts = np.bincount(labels, minlength=k)
    class_weight = np.minimum(len(labels) / (k * np.maximum(counts, 1)), 5).astype(np.float32)
    steps, step = EPOCHS * (len(labels) // BATCH + 1), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for s in range(0, len(order), BATCH):
            pick = order[s:s + BATCH]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            ids = np.concatenate([features[i][0] for i in pick])
            share = np.concatenate([features[i][1] for i in pick])[:, None]
            n = np.array([len(features[i][0]) for i in pick])
            h = np.add.reduceat(emb[ids] * share, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
            z = h @ w + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            g = (p * class_weight[labels[pick], None]).astype(np.float32)
            dh = g @ w.T
            w -= rate * (h.T @ g)
            b -= rate * 0.1 * g.sum(0)
            np.subtract.at(emb, ids, np.repeat(rate * 0.2 * dh, n, axis=0))
    return emb, w, b


_GRAMMAR = {lang: frozenset(w for word in words.split() for w in LETTERS.findall(word)) for lang, words in FUNCTION_WORDS.items()}


def supported(words: list[str], lang: str) -> bool:
    """No other language's function words speak louder than those of the label.

    Wrong labels are few among all rows, but among the rows of a rare language
    they can be half; this is the filter that keeps them out of the first fit.
    """
    hits = {x: sum(w in g for w in words) for x, g in _GRAMMAR.items()}
    return hits[lang] > 0 and hits[lang] == max(hits.values())


def unmarked_length(texts: list[str]) -> float:
    """The length of a sentence in a script that marks none: whole stretches of it come in multiples of that length.

    It is the one under which their lengths lie nearest to multiples, by its own measure.
    """
    lengths = []
    for text in texts:
        run = 0
        for a, b in [*sentence_spans(text), (0, 0)]:
            if THAI.search(text[a:b]):
                run += len(text[a:b].strip())
            elif run:
                lengths.append(run)
                run = 0
    if len(lengths) < LEAST_STRETCHES:
        return UNMARKED
    x = np.array(lengths, float)
    tried = np.arange(30.0, min(300.0, x.max()) + 1)
    share = x[:, None] / tried
    return float(tried[np.abs(share - np.maximum(np.round(share), 1)).mean(0).argmin()])


def fit(rows: list[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """Train on (language, text) rows; the function words of each language are added as a seed."""
    sentences, labels = [], []
    for lang, text in sorted(rows):
        for a, b in sentence_spans(text):
            words = [w.lower() for w in LETTERS.findall(text[a:b])]
            if len(words) >= 3 and supported(words, lang):
                sentences.append(words)
                labels.append(LANGUAGES.index(lang))
    for lang, words in FUNCTION_WORDS.items():
        listed = words.split()
        for i in range(0, len(listed), 8):
            sentences.append(listed[i:i + 8])
            labels.append(LANGUAGES.index(lang))
    y = np.array(labels)
    cache: dict[str, list[int]] = {}
    features = []
    for words in sentences:
        parts = [cache[w] if w in cache else cache.setdefault(w, subwords(w)) for w in words]
        share = np.repeat([1 / (len(p) * len(parts)) for p in parts], [len(p) for p in parts]).astype(np.float32)
        features.append((np.array([i for p in parts for i in p], np.int64), share))
    held = np.random.default_rng(seed).random(len(y)) < 0.15
    train = np.flatnonzero(~held)
    model = LanguageModel(*_sgd([features[i] for i in train], y[train], seed))
    p = model.probabilities(sentences)
    keep = p[np.arange(len(y)), y] > 0.3  # labels that the rest of the sample contradicts are left out
    train, test = np.flatnonzero(~held & keep), np.flatnonzero(held)  # no model has chosen what is held out
    model = LanguageModel(*_sgd([features[i] for i in train], y[train], seed + 1))
    if len(test):
        def loss(t):
            model.temperature = t
            q = model.probabilities([sentences[i] for i in test])
            return -np.log(np.maximum(q[np.arange(len(test)), y[test]], 1e-12)).mean()

        model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
        q = model.probabilities([sentences[i] for i in test])
        right = q.argmax(1) == y[test]
        model.accuracy = float(right.mean())
        top = q.max(1)
        for limit in (0.35, 0.4, 0.5, 0.6, 0.7, 0.8):
            model.limit = limit
            if (top >= limit).any() and right[top >= limit].mean() >= 0.998:
                break
    model.unmarked = unmarked_length([text for _, text in rows if THAI.search(text)])
    return model


def training_rows(paragraphs: DataFrame, labels: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each language, the first by hash of the key over all labels."""
    named = labels.select("para_id", label_language(F.col("lang_label")).alias("lang")).where("lang is not null").distinct()
    # first within slices of the keys, so that no task ranks all rows of a common language
    digest = F.xxhash64("para_id")
    sliced = named.withColumn("_slice", F.pmod(digest, F.lit(64)))
    inner = Window.partitionBy("lang", "_slice").orderBy(digest, "para_id")
    outer = Window.partitionBy("lang").orderBy(digest, "para_id")
    first = sliced.withColumn("_n", F.row_number().over(inner)).where(F.col("_n") <= per_language)
    chosen = first.withColumn("_n", F.row_number().over(outer)).where(F.col("_n") <= per_language).select("para_id", "lang")
    # bounded: languages x per_language rows
    got = paragraphs.select("para_id", "text").where(F.length("text").between(1, LONGEST_SAMPLE)).join(F.broadcast(chosen), "para_id").select("lang", "text")
    return [(r["lang"], r["text"]) for r in got.collect()]


def stretches(text: str, spans, labels: list[str], confidences: list[float], words: list[int], unmarked: float = UNMARKED):
    """Sentences of one language in a row: (lang, start, end, sentences, confidence)."""
    out = []
    for (a, b), lang, conf, n in zip(spans, labels, confidences, words):
        if n < 3 and out:  # too short to tell: it belongs to what it follows
            lang = out[-1][0]
        if out and out[-1][0] == lang:
            last = out[-1]
            last[2] = b
            last[3] += n >= 3
            last[4].append(conf)
        else:
            out.append([lang, a, b, int(n >= 3), [conf]])
    for s in out:
        if s[0] == "th":
            s[3] = max(s[3], 1, round(len(text[s[1]:s[2]].strip()) / unmarked))
        s[4] = float(np.mean(s[4]))
    return out


SEGMENTS = "lang string, start int, end int, sentences int, confidence double, kind string"


def language_stretches(df: DataFrame, model: LanguageModel, key: str = "para_id", text: str = "text") -> DataFrame:
    """(key, lang, start, end, sentences, confidence, kind): one row per stretch, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [sentence_spans(t) if t and t.strip() else [] for t in texts]
            words = [[w.lower() for w in LETTERS.findall(t[a:b])] for t, s in zip(texts, spans) for a, b in s]
            p = model.probabilities(words) if words else np.zeros((0, len(LANGUAGES)))
            best, conf = (p.argmax(1), p.max(1)) if words else ([], [])
            rows, at = [], 0
            for key_, t, s in zip(batch.column(0).to_pylist(), texts, spans):
                if not s:
                    continue
                part = range(at, at + len(s))
                at += len(s)
                langs = [LANGUAGES[best[i]] if words[i] and conf[i] >= model.limit else "und" for i in part]
                kind = text_quality.kind_of(t)
                rows += [(key_, *x, kind) for x in stretches(t, s, langs, [float(conf[i]) for i in part], [len(words[i]) for i in part], model.unmarked)]
            columns = list(zip(*rows)) or [[]] * 7
            types = [batch.schema.types[0], pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, types)],
                                             names=[key, "lang", "start", "end", "sentences", "confidence", "kind"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {SEGMENTS}")


def unnamed_languages(segments: DataFrame, labels: DataFrame, key: str = "para_id") -> DataFrame:
    """(key, lang): languages with two sentences in a row that no label of the text names."""
    present = segments.where((F.col("sentences") >= 2) & (F.col("lang") != "und") & (F.col("kind") == "prose")).select(key, "lang").distinct()
    named = labels.select(key, label_language(F.col("lang_label")).alias("lang")).where("lang is not null").distinct()
    return present.join(named, [key, "lang"], "left_anti")
