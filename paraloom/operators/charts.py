"""The data behind each chart, and a self-contained chart file."""

from __future__ import annotations

import json
import struct
import zlib
from html import escape
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.operators.trends import top_topics


def unpivoted(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(measure, value): one row per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.measure", "p.value")


def grouped_bars(df: DataFrame, label: str, columns: tuple[str, ...], by: str, n: int) -> DataFrame:
    """(label, series, value) of the top ``n`` rows."""
    top = df.orderBy(F.desc(by), label).limit(n)
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in columns])
    return top.select(F.col(label).alias("label"), F.explode(pairs).alias("p")).select("label", "p.series", "p.value")


def with_markers(df: DataFrame, x: str, dates: tuple[str, ...]) -> DataFrame:
    """Adds ``era``: how many of the marker dates lie at or before the row."""
    era = sum((F.when(F.col(x) >= F.lit(d).cast("date"), 1).otherwise(0) for d in dates), F.lit(0))
    return df.withColumn("era", era.cast("int"))


def top_lines(over_time: DataFrame, n: int = 10) -> DataFrame:
    """The rows of the ``n`` most frequent topics, for a line each."""
    return over_time.join(top_topics(over_time, n), "topic", "left_semi")


MOST_ROWS = 5_000
WIDTH, HEIGHT, MARGIN = 960, 540, 90
# fixed values: colours told apart by most eyes, in the order of the series
COLOURS = "#4269d0 #efb118 #ff725c #6cc5b0 #3ca951 #ff8ab7 #a463f2 #97bbf5 #9c6b4e #9498a0".split()


def _rows(df: DataFrame) -> list[dict]:
    """Chart data is aggregated; more than ``MOST_ROWS`` fail."""
    rows = [r.asDict() for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows are no chart data; aggregate first")
    return rows


class _Scale:
    """Places of values on an axis: numbers by size, anything else in order of appearance."""

    def __init__(self, values: list, start: float, end: float, zero: bool = False):
        self.start, self.end = start, end
        self.numbers = bool(values) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
        if self.numbers:
            low, high = min(values), max(values)
            self.low, self.high = (min(low, 0) if zero else low), (max(high, 0) if zero else high)
        else:
            self.names = {v: i for i, v in enumerate(dict.fromkeys(map(str, values)))}

    def at(self, value) -> float:
        if self.numbers:
            return self.start + (self.end - self.start) * ((value - self.low) / ((self.high - self.low) or 1))
        return self.start + (self.end - self.start) * (self.names[str(value)] + 0.5) / len(self.names)

    def ticks(self) -> list[tuple[float, str]]:
        if self.numbers:
            return [(self.at(v), f"{v:.4g}") for v in (self.low + (self.high - self.low) * i / 4 for i in range(5))]
        step = max(1, len(self.names) // 24)
        return [(self.at(v), v[:24]) for i, v in enumerate(self.names) if not i % step]


def drawing(rows: list[dict], mark: str, x: str, y: str, color: str | None = None, title: str = "") -> str:
    """An SVG picture: ``bar``, ``line``, ``point`` or ``cell`` (a heat map, shaded by ``color``); rows without a value are left out."""
    rows = [r for r in rows if r[x] is not None and r[y] is not None]
    across = _Scale([r[x] for r in rows], MARGIN, WIDTH - MARGIN)
    up = _Scale([r[y] for r in rows], HEIGHT - MARGIN, MARGIN / 2, zero=mark == "bar")
    series = list(dict.fromkeys(str(r[color]) for r in rows)) if color and mark != "cell" else [""]
    shade = lambda r: COLOURS[series.index(str(r[color])) % len(COLOURS)] if color and mark != "cell" else COLOURS[0]
    parts = [f'<text x="{WIDTH / 2}" y="24" text-anchor="middle">{escape(title)}</text>']
    parts += [f'<text x="{a:.1f}" y="{HEIGHT - MARGIN + 14}" transform="rotate(35 {a:.1f} {HEIGHT - MARGIN + 14})">{escape(t)}</text>' for a, t in (across.ticks() if rows else [])]
    parts += [f'<text x="{MARGIN - 6}" y="{a:.1f}" text-anchor="end">{escape(t)}</text>' for a, t in (up.ticks() if rows else [])]
    width = (WIDTH - 2 * MARGIN) / max(1, len({str(r[x]) for r in rows})) * 0.8
    if mark == "line":
        for name in series:
            own = sorted((r for r in rows if not color or str(r[color]) == name), key=lambda r: across.at(r[x]))
            points = " ".join(f"{across.at(r[x]):.1f},{up.at(r[y]):.1f}" for r in own)
            parts.append(f'<polyline fill="none" stroke="{shade(own[0]) if own else COLOURS[0]}" stroke-width="2" points="{points}"/>')
    for r in rows if mark != "line" else ():
        a, b = across.at(r[x]), up.at(r[y])
        told = escape(", ".join(f"{k}: {v}" for k, v in r.items()))
        if mark == "bar":
            floor = up.at(0) if up.numbers else HEIGHT - MARGIN
            left = a - width / 2 + width / len(series) * (series.index(str(r[color])) if color else 0)
            shape = f'<rect x="{left:.1f}" y="{min(b, floor):.1f}" width="{max(width / len(series), 1):.1f}" height="{abs(b - floor):.1f}" fill="{shade(r)}">'
        elif mark == "cell":
            most = max((abs(q[color] or 0) for q in rows), default=0) or 1
            tall = (HEIGHT - 1.5 * MARGIN) / max(1, len({str(q[y]) for q in rows}))
            shape = f'<rect x="{a - width / 1.6:.1f}" y="{b - tall / 2:.1f}" width="{width / 0.8:.1f}" height="{tall:.1f}" fill="{COLOURS[0]}" fill-opacity="{abs(r[color] or 0) / most:.3f}">'
        else:
            shape = f'<circle cx="{a:.1f}" cy="{b:.1f}" r="4" fill="{shade(r)}" fill-opacity="0.7">'
        parts.append(f"{shape}<title>{told}</title></{shape[1:].split(' ')[0]}>")
    parts += [f'<text x="{WIDTH - MARGIN + 6}" y="{MARGIN / 2 + 16 * i}" fill="{COLOURS[i % len(COLOURS)]}">{escape(n[:16])}</text>' for i, n in enumerate(series) if n]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif" font-size="11">{"".join(parts)}</svg>'


def write_html(df: DataFrame, path: str, mark: str, x: str, y: str, color: str | None = None, title: str = "") -> None:
    """A page that shows the chart and holds its rows; nothing is loaded from elsewhere."""
    rows = _rows(df)
    body = json.dumps(rows, default=str, ensure_ascii=False).replace("</", "<\\/")
    Path(path).write_text(f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title>{drawing(rows, mark, x, y, color, title)}'
                          f'<script type="application/json" id="rows">{body}</script>', encoding="utf-8")


def write_png(df: DataFrame, path: str, x: str, y: str) -> bool:
    """A picture of bars (``x`` in order, ``y`` their heights) as PNG, without letters; no rows, no file."""
    rows = [r for r in _rows(df.orderBy(x)) if r[y] is not None]
    if not rows:
        return False
    picture = np.full((HEIGHT, WIDTH, 3), 255, np.uint8)
    up = _Scale([float(r[y]) for r in rows], HEIGHT - MARGIN, MARGIN / 2, zero=True)
    step = (WIDTH - 2 * MARGIN) / len(rows)
    floor = round(up.at(0))
    for i, r in enumerate(rows):
        top, left = round(up.at(float(r[y]))), round(MARGIN + i * step)
        picture[min(top, floor):max(top, floor), left:max(left + 1, round(left + 0.8 * step))] = [int(COLOURS[0][k:k + 2], 16) for k in (1, 3, 5)]
    picture[floor, MARGIN:WIDTH - MARGIN] = 0
    raw = b"".join(b"\0" + line.tobytes() for line in picture)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, HEIGHT, 8, 2, 0, 0, 0))
                           + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b""))
    return True
