"""Plain SVG pictures of small results, without scripts or links."""

from __future__ import annotations

import math
from html import escape

WIDTH, HEIGHT, LEFT, BOTTOM, TOP, RIGHT = 680, 280, 64, 44, 30, 150
COLOURS = ("#0b6e99", "#b4371d", "#4f7a28", "#7a4fa0", "#8a6d00", "#333333", "#00796b")


class Plane:
    """Data coordinates on a drawing, each axis linear or logarithmic."""

    def __init__(self, xs: list[float], ys: list[float], log_x: bool = False, log_y: bool = False):
        self.scale_x, self.scale_y = (math.log10 if log else float for log in (log_x, log_y))
        self.x0, self.x1 = min(map(self.scale_x, xs)), max(map(self.scale_x, xs))
        self.y0, self.y1 = min(map(self.scale_y, ys)), max(map(self.scale_y, ys))
        self.parts: list[str] = []

    def x(self, v: float) -> float:
        return LEFT + (self.scale_x(v) - self.x0) / ((self.x1 - self.x0) or 1) * (WIDTH - LEFT - RIGHT)

    def y(self, v: float) -> float:
        return HEIGHT - BOTTOM - (self.scale_y(v) - self.y0) / ((self.y1 - self.y0) or 1) * (HEIGHT - BOTTOM - TOP)

    def text(self, x: float, y: float, what: object, anchor: str = "middle", colour: str = "#333333") -> None:
        self.parts.append(f'<text x="{x:.1f}" y="{y:.1f}" font-size="11" text-anchor="{anchor}" fill="{colour}">{escape(str(what))}</text>')

    def level(self, v: float, label: str, colour: str = "#b4371d") -> None:
        """A dashed line across at a height."""
        self.parts.append(f'<line x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{self.y(v):.1f}" y2="{self.y(v):.1f}" stroke="{colour}" stroke-dasharray="4 3"/>')
        self.text(WIDTH - RIGHT + 6, self.y(v) + 4, label, "start", colour)

    def series(self, name: str, points: list[tuple[float, float]], i: int) -> None:
        colour = COLOURS[i % len(COLOURS)]
        path = " ".join(f"{self.x(a):.1f},{self.y(b):.1f}" for a, b in points)
        self.parts.append(f'<polyline fill="none" stroke="{colour}" stroke-width="2" points="{path}"/>')
        self.parts += [f'<circle cx="{self.x(a):.1f}" cy="{self.y(b):.1f}" r="3" fill="{colour}"/>' for a, b in points]
        self.text(WIDTH - RIGHT + 6, TOP + 14 * (i + 1), name, "start", colour)

    def ticks(self, xs: list[float], ys: list[float], x_name: str, y_name: str) -> None:
        for v in xs:
            self.text(self.x(v), HEIGHT - BOTTOM + 16, f"{v:g}")
        for v in ys:
            self.parts.append(f'<line x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{self.y(v):.1f}" y2="{self.y(v):.1f}" stroke="#dddddd"/>')
            self.text(LEFT - 6, self.y(v) + 4, f"{v:g}", "end")
        self.text((LEFT + WIDTH - RIGHT) / 2, HEIGHT - 8, x_name)
        self.text(LEFT, TOP - 12, y_name, "start")

    def svg(self, title: str) -> str:
        return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" role="img" aria-label="{escape(title)}"><title>{escape(title)}</title>{"".join(self.parts)}</svg>'


def leak_chart(rows: list[dict]) -> str:
    """Characters leaked, and characters before the first one is sent, by lookback; the buffered answer as a level."""
    streamed = [r for r in rows if r["lookback"] is not None]
    whole = [r["first_emit_at_char"] for r in rows if r["lookback"] is None and r["first_emit_at_char"] is not None]
    if not streamed:
        return ""
    heights = [0, *(r["leaked_chars"] for r in streamed), *(r["first_emit_at_char"] or 0 for r in streamed), *whole]
    looks = [float(r["lookback"]) for r in streamed]
    p = Plane([*looks, max(looks) + 1], [*map(float, heights), 1.0])
    p.ticks(looks, [0, max(heights) / 2, max(heights)], "lookback, characters", "characters")
    p.series("leaked", [(r["lookback"], r["leaked_chars"]) for r in streamed], 1)
    p.series("before the first", [(r["lookback"], r["first_emit_at_char"]) for r in streamed if r["first_emit_at_char"] is not None] or [(looks[0], 0)], 0)
    for v in whole[:1]:
        p.level(v, "buffered", "#555555")
    return p.svg("leaks and waiting by lookback")


def precision_chart(series: dict[str, list[tuple[float, float]]], floor: float = 0.5) -> str:
    """Precision by prevalence on a logarithmic axis, with the floor that a block needs."""
    points = [x for s in series.values() for x in s]
    if not points:
        return ""
    at = sorted({a for a, _ in points})
    p = Plane(at, [0.0, 1.0], log_x=True)
    p.ticks(at, [0, 0.25, 0.5, 0.75, 1], "prevalence (log)", "precision")
    p.level(floor, f"floor {floor:g}")
    for i, (name, s) in enumerate(sorted(series.items())):
        p.series(name, sorted(s), i)
    return p.svg("precision by prevalence")


def redos_chart(points: list[tuple[int, float]], budget_ms: float) -> str:
    """Time of a pattern by length on a logarithmic axis, with the budget of a detector."""
    if not points:
        return ""
    rows = [(float(n), max(ms, 1e-4)) for n, ms in sorted(points)]
    low, high = (f(math.log10(v)) for f, v in ((math.floor, min(budget_ms, *(b for _, b in rows))), (math.ceil, max(budget_ms, *(b for _, b in rows)))))
    p = Plane([a for a, _ in rows], [10.0**low, 10.0**high], log_y=True)
    p.ticks([a for a, _ in rows], [10.0**i for i in range(low, high + 1, max(1, (high - low) // 4))], "characters", "ms (log)")
    p.level(budget_ms, f"budget {budget_ms:g} ms")
    p.series("time", rows, 0)
    return p.svg("time by length")
