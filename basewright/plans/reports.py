"""Text reports and figures from small results (a row, 101 rows, or a row for each place in a read)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

COLOURS = {"a": "#2b83ba", "t": "#d7191c", "g": "#1a9641", "c": "#fdae61", "n": "#7f7f7f"}


def summary_text(summary: DataFrame) -> str:
    x = summary.first().asDict()
    pct = lambda k: f"{x[f'{k}_pct'] or 0:.2f}%"
    lines = [f"read average length:\t{x['mean_length'] or 0:.0f}", f"read min length:\t{x['min_length'] or 0}", f"read max length:\t{x['max_length'] or 0}", f"total gc content(%):\t{x['gc_pct'] or 0:.2f}", f"total read count:\t{x['reads']}", f"total base count:\t{x['bases']}", ""]
    lines += [f"base {b} count:\t{x[b.lower()]}\t({pct(b.lower())})" for b in "ATGCN"] + [""]
    lines += [f"Number of base calls with quality value of {q} or higher (Q{q}+) (%)\t{x[f'q{q}']}\t({pct(f'q{q}')})" for q in (5, 10, 15, 20, 30)]
    return "\n".join(lines) + "\n"


def size_text(size: DataFrame) -> str:
    x = size.first()
    return "\t".join(f"{k}:{x[k.lower()]}" for k in ("reads", "bases", *"ATGCN")) + "\n"


def _table(header: Iterable[str], rows: Iterable[Iterable]) -> str:
    return "".join("\t".join(map(str, r)) + "\n" for r in [header, *rows])


def length_text(lengths: DataFrame, descending: bool = False) -> str:
    rows = sorted(lengths.collect(), reverse=descending)
    return _table(("lenth", "count"), rows)  # the report's header is spelled so


def gc_text(histogram: DataFrame | list[Row]) -> str:
    rows = histogram if isinstance(histogram, list) else histogram.collect()
    return _table(("GC(%)", "Reads", "Ratio(%)"), sorted(rows))


def cycle_text(bases: DataFrame, qualities: DataFrame) -> str:
    counts: dict[int, dict[int, int]] = {}
    for x in qualities.collect():
        counts.setdefault(x.cycle, {})[x.q] = x.n
    top = max((q for c in counts.values() for q in c), default=-1)
    rows = [[f"cyc{x.cycle}", *(f"{x[b]}:({x[f'{b}_pct'] or 0:.2f}%)" for b in "atgcn"), *(counts.get(x.cycle, {}).get(q, 0) for q in range(top + 1))] for x in sorted(bases.collect())]
    return _table(["cycle", *"ATGCN", *range(top + 1)], rows)


def svg_lines(series: dict[str, list[float]], width: int = 960, height: int = 540, ylim: float = 100.0, title: str = "", first: int = 1) -> str:
    """A line for each series over its places (from `first`), from 0 to ylim."""
    check_figure("svg", ylim)
    n = max((len(v) for v in series.values()), default=1)
    left, top, w, h = 60, 40, width - 90, height - 90
    x = lambda i: left + w * i / max(1, n - 1)
    y = lambda v: top + h * (1 - min(v, ylim) / ylim)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">', '<rect width="100%" height="100%" fill="white"/>', f'<text x="{left}" y="24" font-size="16">{title}</text>']
    for k in range(6):
        out.append(f'<line x1="{left}" x2="{left + w}" y1="{y(ylim * k / 5):.1f}" y2="{y(ylim * k / 5):.1f}" stroke="#dddddd"/><text x="{left - 8}" y="{y(ylim * k / 5) + 4:.1f}" text-anchor="end">{ylim * k / 5:g}</text>')
    for i in range(0, n, max(1, n // 10)):
        out.append(f'<text x="{x(i):.1f}" y="{top + h + 18}" text-anchor="middle">{i + first}</text>')
    for k, (name, values) in enumerate(series.items()):
        colour = COLOURS.get(name.lower(), "#2b83ba")
        points = " ".join(f"{x(i):.1f},{y(v):.1f}" for i, v in enumerate(values))
        out.append(f'<polyline points="{points}" fill="none" stroke="{colour}" stroke-width="1.5"/><text x="{left + w - 20}" y="{top + 14 * (k + 1)}" fill="{colour}">{name}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"


def check_figure(kind: str, ylim: float) -> str:
    if kind not in ("png", "svg"):
        raise ValueError("the figure's type must be png or svg")
    if not 0 < ylim <= 100:
        raise ValueError("ylim must be above 0 and at most 100")
    return kind


def png_lines(series: dict[str, list[float]], width: int = 960, height: int = 540, ylim: float = 100.0, title: str = "") -> bytes:
    """The same lines as an image of width by height; the title goes into the file's text."""
    image = np.full((height, width, 3), 255, np.uint8)
    n = max((len(v) for v in series.values()), default=1)
    left, top, w, h = 60, 40, width - 90, height - 90
    for k in range(6):
        image[top + h * k // 5, left : left + w] = 221
    for name, values in series.items():
        colour = [int(COLOURS.get(name.lower(), "#2b83ba")[i : i + 2], 16) for i in (1, 3, 5)]
        x = left + w * np.arange(len(values)) / max(1, n - 1)
        y = top + h * (1 - np.minimum(np.array(values, float), ylim) / ylim)
        at = np.linspace(x[0], x[-1], 4 * width) if len(values) else np.empty(0)
        on = np.interp(at, x, y).round().astype(int) if len(values) else np.empty(0, int)
        column = np.clip(at.round().astype(int), 0, width - 1)
        steps = np.abs(np.diff(on, prepend=on[:1])).max(initial=0) + 2
        for k in range(steps):  # steep parts are drawn as upright strokes
            lower, upper = np.minimum(on, np.roll(on, 1)), np.maximum(on, np.roll(on, 1))
            if len(on):
                lower[0] = upper[0] = on[0]
            image[np.clip(np.minimum(lower + k, upper + 1), 0, height - 1), column] = colour
    rows = b"".join(b"\0" + x.tobytes() for x in image)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"Title\0" + title.encode("latin-1", "replace")) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def figure(series: dict[str, list[float]], kind: str, width: int, height: int, ylim: float, title: str, first: int = 1) -> bytes:
    check_figure(kind, ylim)
    return png_lines(series, width, height, ylim, title) if kind == "png" else svg_lines(series, width, height, ylim, title, first).encode()


def terminal_chart(series: dict[str, list[float]], ylim: float = 100.0, columns: int = 100, lines: int = 20) -> str:
    """The lines as letters: each series by the first letter of its name."""
    grid = [[" "] * columns for _ in range(lines)]
    for name, values in series.items():
        for i, v in enumerate(values):
            grid[lines - 1 - int(min(v, ylim) / ylim * (lines - 1))][i * columns // max(1, len(values))] = name[0].upper()
    return "".join(f"{ylim * (lines - 1 - k) / (lines - 1):6.1f} |{''.join(row)}\n" for k, row in enumerate(grid))


def read_cycles(spark: SparkSession, path: str) -> dict[str, list[float]]:
    """Percentages of the five letters by place from a cycle report, as `cycle_text` writes it."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\n")).alias("line")).where("line LIKE 'cyc%:(%'").collect()  # a row for each place in a read
    rows = sorted((int(x[0][3:]), [float(y.split("(")[1].rstrip("%)")) for y in x[1:6]]) for x in (r.line.split("\t") for r in lines))
    return {b: [x[1][i] for x in rows] for i, b in enumerate("ATGCN")}


def plot_cycles(bases: DataFrame, **options) -> str:
    rows = sorted(bases.collect())
    return svg_lines({b.upper(): [x[f"{b}_pct"] or 0.0 for x in rows] for b in "atgcn"}, title="Bases by place (%)", **options)


def plot_gc(histogram: DataFrame, **options) -> str:
    return svg_lines({"reads": [x.ratio for x in sorted(histogram.collect())]}, title="Reads by GC content (%)", **options)
