"""Charts as SVG elements. The element tree escapes every text; a chart is described for those who can't see it.

Each kind is a generator of elements over unit coordinates: a bar or bin is a span, a share is an arc, a value is a place
between the ends of its axis. What the kinds have in common (names to the left, values, hints) is in Sheet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING
from xml.etree import ElementTree as E

from tablepulse.functions.text import shorten

if TYPE_CHECKING:
    from tablepulse.operators.charts import Chart, Mark

WIDTH, LINE, NAMES, AXIS = 640, 24, 230, 330
PALETTE = ("#2b6cb0", "#c05621", "#2f855a", "#6b46c1", "#b83280", "#975a16", "#2c7a7b", "#4a5568", "#9b2c2c", "#5a67d8")
INK, PALE, ALARM = "#4a5568", "#e2e8f0", "#9b2c2c"


def plain(v: float | None) -> str:
    if v is None:
        return "n/a"
    return f"{v:,.0f}" if v == int(v) and abs(v) < 1e15 else f"{v:.4g}"


def hue(k: int) -> str:
    return PALETTE[k % len(PALETTE)]


class Sheet:
    """An SVG element to which marks are added; it grows to what lies lowest."""

    def __init__(self, label: str) -> None:
        self.root, self.bottom = E.Element("svg", {"role": "img", "aria-label": label}), 0.0

    def put(self, tag: str, text: str = "", hint: str = "", low: float = 0, **attributes: object) -> None:
        shown = {k.replace("_", "-"): f"{v:.2f}" if isinstance(v, float) else str(v) for k, v in attributes.items()}
        element = E.SubElement(self.root, tag, shown)
        element.text = text
        if hint:
            E.SubElement(element, "title").text = hint
        self.bottom = max(self.bottom, low, float(attributes.get("y", 0)) + float(attributes.get("height", 8)))

    def say(self, x: float, y: float, text: str, anchor: str = "start", **more: object) -> None:
        self.put("text", text, x=float(x), y=float(y), text_anchor=anchor, font_size=12, fill="currentColor", **more)

    def fill(self, x: float, y: float, width: float, height: float, colour: str, hint: str = "", opacity: float = 1.0) -> None:
        self.put("rect", "", hint, x=float(x), y=float(y), width=max(float(width), 0.0), height=float(height), fill=colour, fill_opacity=float(opacity))

    def stroke(self, x: float, y: float, to_x: float, to_y: float) -> None:
        self.put("line", low=max(y, to_y), x1=float(x), y1=float(y), x2=float(to_x), y2=float(to_y), stroke=INK)

    def arc(self, share: float, begin: float, colour: str) -> None:
        """A part of a ring, begin and share being parts of the whole."""
        whole = 2 * math.pi * 60
        self.put("circle", low=170, cx=100, cy=90, r=60, fill="none", stroke=colour, stroke_width=18, stroke_dasharray=f"{share * whole:.2f} {whole:.2f}", stroke_dashoffset=-begin * whole, transform="rotate(-90 100 90)")

    def shape(self, points: Sequence[tuple[float, float]], **more: object) -> None:
        self.put("polygon", low=max(y for _, y in points), points=" ".join(f"{x:.1f},{y:.1f}" for x, y in points), **more)

    def markup(self) -> str:
        self.root.set("viewBox", f"0 0 {WIDTH} {self.bottom + 14:.0f}")
        return E.tostring(self.root, encoding="unicode")


def between(values: Sequence[float]) -> Callable[[float], float]:
    """Where a value stands between the least (0) and the greatest (1); in the middle if all are equal. Nothing overflows."""
    low, high = min(values), max(values)
    unit = max(abs(low), abs(high), 1.0)
    wide = high / unit - low / unit
    return lambda v: (v / unit - low / unit) / wide if wide else 0.5


def bars(s: Sheet, marks: Sequence[Mark], top: float | None) -> None:
    top = top or max((m.value or 0 for m in marks), default=0) or 1
    for k, m in enumerate(marks):
        s.say(NAMES - 10, k * LINE + 18, shorten(m.label), "end")
        s.fill(NAMES, k * LINE + 6, AXIS * min(1, (m.value or 0) / top), 15, hue(0), f"{m.label}: {m.detail}")
        s.say(NAMES + AXIS + 10, k * LINE + 18, plain(m.value))


def share(s: Sheet, marks: Sequence[Mark], top: float | None) -> None:
    s.arc(1, 0, PALE)
    s.arc(min(1, max(0, (marks[0].value or 0) / (top or 100))), 0, hue(0))
    s.say(100, 95, plain(marks[0].value), "middle")
    s.say(200, 95, f"{marks[0].label}: {marks[0].detail}")


def ring(s: Sheet, marks: Sequence[Mark], top: float | None) -> None:
    total, begin = sum(m.value or 0 for m in marks) or 1, 0.0
    for k, m in enumerate(marks):
        part = (m.value or 0) / total
        s.arc(part, begin, hue(k))
        s.fill(200, 12 + k * 20, 12, 12, hue(k))
        s.say(218, 23 + k * 20, f"{m.label}: {plain(m.value)}")
        begin += part


def radar(s: Sheet, marks: Sequence[Mark], top: float | None) -> None:
    turn = [2 * math.pi * k / len(marks) for k in range(len(marks))]
    at = lambda angle, r: (250 + r * math.sin(angle), 150 - r * math.cos(angle))
    for level in (25, 50, 75, 100):
        s.shape([at(x, level) for x in turn], fill="none", stroke=PALE)
    s.shape([at(x, 100 * (m.value or 0) / (top or 100)) for x, m in zip(turn, marks, strict=True)], fill=hue(0), fill_opacity=0.3, stroke=hue(0))
    for x, m in zip(turn, marks, strict=True):
        s.say(*at(x, 118), f"{shorten(m.label, 24)} {plain(m.value)}", "middle")


def grid(s: Sheet, marks: Sequence[Mark], top: float | None) -> None:
    across, down = ({name: k for k, name in enumerate(dict.fromkeys(names))} for names in ((m.label for m in marks), (m.grp for m in marks)))
    side = max(14, min(60, (WIDTH - NAMES - 20) // len(across)))
    for name, k in across.items():
        s.put("text", shorten(name, 18), transform=f"translate({NAMES + k * side + 10},70) rotate(-45)", font_size=11, fill="currentColor")
    for name, k in down.items():
        s.say(NAMES - 10, 92 + k * 16, shorten(name), "end")
    for m in marks:
        x, y, part = NAMES + across[m.label] * side, 80 + down[m.grp] * 16, (m.value or 0) / (top or 1)
        s.fill(x, y, side - 1, 15, ALARM if part else PALE, f"{m.grp}, {m.label}: {m.detail}", 0.25 + 0.75 * part if part else 1)
        s.say(x + side / 2, y + 12, m.detail[:1] if top == 1 else plain(m.value) if m.value else "", "middle")


def columns(s: Sheet, marks: Sequence[Mark], top: float | None) -> None:
    top, step = max(m.value or 0 for m in marks) or 1, (WIDTH - 60) / len(marks)
    for k, m in enumerate(marks):
        tall = 140 * (m.value or 0) / top
        s.fill(30 + k * step, 160 - tall, step - 1, tall, hue(0), f"{plain(m.coordinates[0])} to {plain(m.coordinates[1])}: {plain(m.value)}")
    s.say(30, 178, plain(marks[0].coordinates[0]))
    s.say(WIDTH - 30, 178, plain(marks[-1].coordinates[1]), "end")


def boxes(s: Sheet, marks: Sequence[Mark], top: float | None) -> None:
    place = between([v for m in marks for v in m.coordinates])
    for k, m in enumerate(marks):
        y, (low, left, middle, right, high) = 24 + k * 34, (NAMES + (AXIS + 60) * place(v) for v in m.coordinates)
        s.say(NAMES - 12, y + 4, shorten(m.label), "end")
        s.stroke(low, y, high, y)
        s.fill(left, y - 10, right - left, 20, hue(0), m.detail, 0.5)
        s.stroke(middle, y - 10, middle, y + 10)


def points(s: Sheet, marks: Sequence[Mark], top: float | None) -> None:
    x, y = between([m.value or 0.0 for m in marks]), between([m.coordinates[0] for m in marks])
    groups = {g: k for k, g in enumerate(dict.fromkeys(m.grp for m in marks))}
    for m in marks:
        s.put("circle", low=266, cx=30 + (WIDTH - 60) * x(m.value or 0.0), cy=260 - 240 * y(m.coordinates[0]), r=3, fill=hue(groups[m.grp]), fill_opacity=0.6)


DRAW = {"bar": bars, "donut": share, "ring": ring, "radar": radar, "heatmap": grid, "histogram": columns, "box": boxes, "scatter": points}


def render(chart: Chart) -> str:
    figure = E.Element("figure")
    caption = E.SubElement(figure, "figcaption")
    E.SubElement(caption, "strong").text = chart.title
    if chart.caption:
        E.SubElement(caption, "p").text = chart.caption
    if not chart.marks:
        E.SubElement(figure, "p").text = chart.empty
        return E.tostring(figure, encoding="unicode")
    sheet = Sheet(f"{chart.title}: " + "; ".join(f"{m.label} {plain(m.value)}" for m in chart.marks[:12]))
    DRAW[chart.kind](sheet, chart.marks, chart.maximum)
    return E.tostring(figure, encoding="unicode").replace("</figure>", f"{sheet.markup()}</figure>")


def document(chart: Chart, dark: bool = False) -> str:
    colours = "background:#1a202c;color:#edf2f7" if dark else "background:#fff;color:#1a202c"
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><style>body{{font-family:sans-serif;{colours}}}svg{{max-width:100%}}</style></head><body>{render(chart)}</body></html>'
