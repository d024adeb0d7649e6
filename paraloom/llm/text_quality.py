"""Problem 2: statistics of every text, and whether it is prose, a list, a table or junk.

Lists and tables are told by their layout and by nothing else.  The rows of a
text are its lines; where these were run together, they are found again at wide
gaps, at repeated markers or at leaders.  Then the rows are compared with each
other: delimiters at like counts or columns and cells of figures make a table;
signs that stand in one column (markers, labels, leaders, abbreviations), or
indentation that returns at one distance, with the autocorrelation of the rows'
lengths at it, make a list.  Where signs repeat in more than four of five lines
nothing else is asked; else the shares of common words and of ended sentences
must agree.  What has no layout is prose or, by its words and symbols, junk.

Defined results: null, empty and blank texts get zeros and the kind ``none``;
repeated rows give a row each; nothing is cut off long texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.llm.words import ALL_FUNCTION_WORDS, LETTERS

SCHEMA = ("n_chars bigint, n_words bigint, mean_word_length double, symbol_ratio double, digit_ratio double, "
          "figure_share double, common_share double, punctuated_lines double, n_lines bigint, alignment double, "
          "marker_share double, length_autocorrelation double, indentation double, kind string")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

FIGURE = re.compile(r"[-–—]|n/a|[(]?[-+$€£]?\d[\d.,:/]*\d*%?[)]?,?", re.I)
MARKER = re.compile(r"\s*(?:([-–—•*▪◦·‣●o➢»>])|(\(?\d{1,3}[.)])|(\(?[A-Za-z][.)])|(\(?[ivxIVX]{1,5}[.)])|(\d{1,2}(?:\.\d{1,2})+\.?))\s+\S")
BULLET_DASH = re.compile(r"\s*[-–—]\s+[^\W\d_]")
INLINE = re.compile(r"(?:(?<=\s)|^)(?:[-–—•*▪◦·‣●]|o(?=\s+[A-Z])|\(?\d{1,3}[.)]|\(?[a-z][.)]|\(?[ivx]{1,5}[.)])\s+(?=\S)")
LEADER = re.compile(r"(?:\.\s?){4,}|…{2,}|_{4,}")
ABBREVIATION = re.compile(r"(?:^|(?<=\n)|(?<=[;\n ]))[A-Z][A-Z0-9&/-]{1,7}(?:\t+| {2,}| ?[-–—:=] ?)[A-Z][\w-]+")
LABELLED = re.compile(r"\s*[^\W\d_][\w'’-]*(?: [^\W\d_][\w'’-]*)?\s*[:=]\s+\S")
SENTENCE_END = re.compile(r"(?<![^\W_])[^\W_]{2,}[.!?؟][\"'”’)]*(?=\s|$)")
DIGIT = re.compile(r"\d")
SCRIPT = re.compile(r"[؀-ۿ฀-๿]")
ASCII_LETTERS = re.compile(r"[a-z]+")
_COMMON = frozenset(w for w in ALL_FUNCTION_WORDS if len(w) > 1)
DELIMITERS = ("\t", "|", ";", ",", "  ")
CELL = re.compile(r"\t+|[ ]*[|;,][ ]*|[ ]{2,}")
COLUMN = re.compile(r"\S(?:\t+|[ ]{2,}|[ ]*[|;][ ]*)(?=\S)")
GAP = re.compile(r" {2,}")
LED = re.compile(rf"(?:{LEADER.pattern})\s*[\divxlc]*")  # a leader and the number it leads to
LONGEST_PERIOD = 8  # lines of one entry
MIXED = re.compile(r"(?=\S*\d)(?=\S*[A-Za-z])[A-Za-z0-9~^]+")
VOWEL = re.compile("[aeiouyà-öø-ÿ]", re.I)
ESCAPE = re.compile(r"\(cid:\d+\)|\\x[0-9a-fA-F]{2}|%[0-9A-F]{2}(?![0-9A-Za-z])|�|&#?\w+;")


def _autocorrelation(lengths: list[int]) -> float:
    n = len(lengths)
    if n < 3:
        return 0.0
    mean = sum(lengths) / n
    dev = [x - mean for x in lengths]
    var = sum(d * d for d in dev)
    return sum(a * b for a, b in zip(dev, dev[1:])) / var if var else 1.0


def _periodicity(values: list[int]) -> tuple[float, int]:
    """The greatest autocorrelation over distances of one to ``LONGEST_PERIOD`` lines, with its distance; 0 where nothing varies."""
    n = len(values)
    mean = sum(values) / n if n else 0.0
    dev = [x - mean for x in values]
    var = sum(d * d for d in dev) / n if n else 0.0
    if not var:
        return 0.0, 0
    return max(((round(sum(a * b for a, b in zip(dev, dev[p:])) / (n - p) / var, 9), -p) for p in range(1, min(LONGEST_PERIOD, n // 2) + 1)), default=(0.0, 0))


def _lag(values: list[int], lag: int) -> float:
    n = len(values)
    mean = sum(values) / n
    var = sum((x - mean) ** 2 for x in values) / n
    return sum((a - mean) * (b - mean) for a, b in zip(values, values[lag:])) / (n - lag) / var if var else 1.0


def _depths(lines: list[str]) -> list[int]:
    depths = [len(x) - len(x.lstrip()) for x in map(str.expandtabs, lines)]
    least = min(depths, default=0)
    return [d - least for d in depths]


def _alignment(rows: list[str], delimiters: tuple[str, ...] = DELIMITERS) -> float:
    """Share of rows that have the commonest number of one delimiter, if that is one or more, or a cell at the commonest column."""
    if len(rows) < 2:
        return 0.0
    best = 0.0
    for d in delimiters:
        counts = Counter(row.count(d) for row in rows)
        counts.pop(0, None)
        if counts:
            best = max(best, max(counts.values()) / len(rows))
    columns = Counter(m.end() for row in rows for m in COLUMN.finditer(row))
    return max(best, max(columns.values(), default=0) / len(rows))


def _sign(row: str) -> str | None:
    """What stands at the head or the end of an entry."""
    m = MARKER.match(row)
    if m:
        return f"marker {m.lastindex}"
    if LEADER.search(row):
        return "leader"
    if ABBREVIATION.match(row.strip()):
        return "abbreviation"
    return "label" if LABELLED.match(row) else None


def _rows_run_together(text: str) -> list[list[str]]:
    """The rows of a text without lines of its own, in several ways: parted at wide gaps, at names after figures, before markers, after leaders."""
    whole = " ".join(text.split("\n"))
    named: list[list[str]] = [[]]
    figure = False
    for word in whole.split():
        was, figure = figure, word in "|;" or FIGURE.fullmatch(word) is not None
        if was and not figure:
            named.append([])
        named[-1].append(word)
    at = [m.start() for m in INLINE.finditer(whole)]
    marked = [whole[a:b] for a, b in zip(at, [*at[1:], len(whole)])]
    ends = [0, *(m.end() for m in LED.finditer(whole))]
    led = [whole[a:b] for a, b in zip(ends, ends[1:])]
    return [[x for x in GAP.split(whole) if x.strip()], [" ".join(x) for x in named], marked, led]


def _is_table(rows: list[str], alike: float) -> bool:
    """Rows of cells, mostly figures, as many in one as in the next: in a share of ``alike`` of the rows where cells may be missing."""
    if len(rows) < 3:
        return False
    cells = [CELL.split(x.strip())[1:] for x in rows]
    filled = [sum(1 for c in row if not c or FIGURE.fullmatch(c)) for row in cells]
    if sum(map(bool, filled)) >= 0.6 * len(rows) and sum(filled) >= 0.5 * sum(map(len, cells)) and _alignment(rows) >= 0.8:
        return True
    # cells parted by single blanks: a name and figures, row after row
    words = [[w for w in x.split() if w not in "|;"] for x in rows]
    told = [sum(1 for w in row[1:] if FIGURE.fullmatch(w)) for row in words]
    counts = Counter(filter(None, told))
    return (sum(told) >= 0.5 * sum(len(row) - 1 for row in words) and sum(map(bool, told)) >= 0.6 * len(rows)
            and max(counts.values(), default=0) >= alike * sum(counts.values()))


def _clear(lines: list[str]) -> str | None:
    """``list`` or ``table`` where the lines alone tell it, whatever words they hold."""
    n = len(lines)
    if n < 3:
        return None
    marks = [MARKER.match(x) is not None for x in lines]
    marked = sum(marks)
    if marked >= 0.8 * n:
        return "list"
    depths = _depths(lines)
    hanging = sum(1 for d, m in zip(depths, marks) if d and not m)
    if marked >= 3 and (marked + hanging >= 0.8 * n and marks[0] or _periodicity(marks)[0] >= 0.8):
        return "list"
    entries = depths.count(0)
    if entries >= 3 and n - entries >= 3 and not depths[0]:
        # every entry goes on in deeper lines: they return at one distance, and the lengths with them
        regular, at = _periodicity(depths)
        if at and regular + 0.25 * max(0.0, _lag([len(x) for x in lines], -at)) >= 0.9:
            return "list"
    cells = [CELL.split(x.strip())[1:] for x in lines]
    filled = [sum(1 for c in row if not c or FIGURE.fullmatch(c)) for row in cells]
    if sum(map(bool, filled)) >= 0.6 * n and sum(filled) >= 0.6 * sum(map(len, cells)) and _alignment(lines) >= 0.8:
        return "table"
    return None


def _layout(text: str, lines: list[str], common_share: float) -> str | None:
    """``list`` or ``table`` where the rows, few common words and few ended sentences tell it together."""
    if common_share >= 0.26:
        return None
    n = len(lines)
    ways = [lines] if n >= 3 else _rows_run_together(text)
    if common_share < 0.15 and any(_is_table(rows, 0.25 if n >= 3 else 0.4) for rows in ways):
        return "table"
    ended = sum(1 for m in SENTENCE_END.finditer(text) if not text[m.start():m.end() - 1].isdigit())
    for rows in ways:
        signs = Counter(filter(None, map(_sign, rows)))
        if (ended <= 1 or ended < 0.34 * len(rows)) and max(signs.values(), default=0) >= max(0.6 * len(rows), 2 if signs["leader"] else 3):
            return "list"
    # entries without any sign: short lines whose lengths tell nothing of each other, as those of wrapped prose do
    lengths = [len(x) for x in lines]
    if n >= 3 and common_share < 0.12 and not ended and len(text.split()) >= 8 and max(lengths) < 80 and _lag(lengths, 1) < 0.5:
        return "list"
    return None


def statistics(text: str | None) -> tuple:
    if text is None or not text.strip():
        return (len(text or ""), 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, "none")
    n = len(text)
    lines = [x for x in text.replace("\r", "").split("\n") if x.strip()]
    tokens = text.split()
    words = LETTERS.findall(text)
    n_words = len(words)
    letters = sum(map(len, words))
    digits = len(DIGIT.findall(text))
    symbols = n - letters - digits - (n - sum(map(len, tokens)))
    script = 0 if text.isascii() else len(SCRIPT.findall(text))
    lowered = [w.lower() for w in words]
    common = sum(1 for w in lowered if len(w) > 1 and w in ALL_FUNCTION_WORDS)
    common_share = common / n_words if n_words else 0.0
    figures = sum(1 for t in tokens if FIGURE.fullmatch(t) or t == "|" or t == ";")
    figures -= sum(1 for x in lines if BULLET_DASH.match(x))  # a dash before a word is no empty cell
    if figures < 0.3 * len(tokens) and common_share < 0.15 and "," in text:
        cells = re.split(r",|\n|\s\s+", text)
        cell_figures = sum(1 for c in cells if FIGURE.fullmatch(c.strip()) or not c.strip())
        figure_share = max(figures / len(tokens), cell_figures / len(cells) if len(cells) > 5 else 0.0)
    else:
        figure_share = figures / len(tokens)
    punctuated = sum(1 for x in lines if x.rstrip()[-1] in ".!?;:؟。…\"'”’)") / len(lines)
    markers = sum(1 for x in lines if MARKER.match(x))
    labelled = sum(1 for x in lines if LABELLED.match(x))
    marker_share = max(markers, labelled) / len(lines)
    alignment = _alignment(lines)
    stats = (n, n_words, letters / n_words if n_words else 0.0, symbols / n, digits / n, figure_share, common_share, punctuated,
             len(lines), alignment, marker_share, _autocorrelation([len(x) for x in lines]), _periodicity(_depths(lines))[0])
    return (*stats, _kind(text, lines, tokens, words, lowered, stats, script))


def _kind(text, lines, tokens, words, lowered, stats, script) -> str:
    n_words, figure_share, common_share = stats[1], stats[5], stats[6]
    visible = sum(map(len, tokens))
    told = _clear(lines)
    if told:
        return told
    if script > 0.25 * visible and figure_share < 0.4 or common_share >= 0.3:
        return "prose"
    told = _layout(text, lines, common_share)
    if told:
        return told
    # junk: nothing that reads as words
    mixed = sum(1 for t in tokens if MIXED.fullmatch(t))
    if mixed > 0.25 * len(tokens) and common_share < 0.1 or len(ESCAPE.findall(text)) >= 0.3 * len(tokens):
        return "junk"
    readable = [w for w in words if len(w) >= 3 and (w.isascii() or w[1:].islower() or w.isupper()) and VOWEL.search(w)]
    if figure_share < 0.3 and (sum(map(len, words)) < 0.45 * visible or len(readable) < 0.35 * n_words):
        return "junk"
    if n_words >= 6 and common_share < 0.05 and len(set(lowered)) <= max(2, 0.5 * n_words) and figure_share < 0.3 and not any(w[0].isupper() for w in words):
        return "junk"
    if n_words >= 8 and common_share < 0.05 and len(readable) < 0.6 * n_words:
        return "junk"
    return "prose"


def kind_of(text: str | None) -> str:
    """The kind alone; prose whose lines show no clear layout is told by its common words."""
    if text is None or not text.strip():
        return "none"
    if text.count("\n") > 1:
        told = _clear([x for x in text.replace("\r", "").split("\n") if x.strip()])
        if told:
            return told
    low = text.lower()
    words = (ASCII_LETTERS if low.isascii() else LETTERS).findall(low)
    if words and len(list(filter(_COMMON.__contains__, words))) >= 0.3 * len(words):
        return "prose"
    return statistics(text)[-1]


def text_statistics(df: DataFrame, key: str = "para_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, statistics..., kind): one row for every row of ``df``, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(statistics, batch.column(batch.num_columns - 1).to_pylist()))) or [[]] * len(NAMES)
            types = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
            arrays = [pa.array(c, types[spec.split()[1]]) for spec, c in zip(SCHEMA.split(", "), columns)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + arrays, names=[*batch.schema.names[:-1], *NAMES])

    source = df.select(F.col(key), *carry, F.col(text))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{head}, {SCHEMA}")
