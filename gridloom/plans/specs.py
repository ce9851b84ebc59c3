"""Charts as plain data for libraries in browsers: traces and layouts, or series and axes."""

from __future__ import annotations

from datetime import date, timedelta

from gridloom.errors import DataValidationError

#: Groups of a histogram, and values that a group needs.
MOST_GROUPS, LEAST_VALUES = 10, 5


def _layout(title: str, x: str = "", y: str = "", **more) -> dict:
    return {"title": {"text": title}, "xaxis": {"title": {"text": x}}, "yaxis": {"title": {"text": y}}} | more


def histogram(bins: list[tuple[float, float, int]], title: str = "", groups: dict[str, list[tuple[float, float, int]]] | None = None) -> dict:
    """Bars of (low, high, count); with ``groups`` bars of each, laid over each other."""
    groups = {title: bins} if groups is None else {g: b for g, b in groups.items() if sum(n for *_, n in b) >= LEAST_VALUES}
    if len(groups) > MOST_GROUPS:
        raise DataValidationError(f"at most {MOST_GROUPS} groups")
    bar = lambda b: {"x": [(lo + hi) / 2 for lo, hi, _ in b], "width": [hi - lo for lo, hi, _ in b], "y": [n for *_, n in b]}
    return {"data": [{"type": "bar", "name": g, "opacity": 0.6} | bar(b) for g, b in groups.items()], "layout": _layout(title, y="count", barmode="overlay")}


def bars(categories: list, values: dict[str, list[float]], title: str = "", order: list | None = None, lines: dict[str, list[float]] | None = None, percent: bool = False) -> dict:
    """Bars of each series by category, in a given order, with lines against a second axis."""
    at = sorted(range(len(categories)), key=lambda i: order.index(categories[i]) if order and categories[i] in order else len(categories) + i)
    names = [categories[i] for i in at]
    data = [{"type": "bar", "name": n, "x": names, "y": [v[i] for i in at]} for n, v in values.items()]
    data += [{"type": "scatter", "mode": "lines+markers", "name": n, "x": names, "y": [v[i] for i in at], "yaxis": "y2"} for n, v in (lines or {}).items()]
    layout = _layout(title) | ({"yaxis2": {"overlaying": "y", "side": "right"}} if lines else {})
    layout["yaxis"] |= {"tickformat": ".0%"} if percent else {}
    return {"data": data, "layout": layout}


def lines(dates: list, series: dict[str, list[float | None]], title: str = "", stacked: bool = False, suffix: str = "") -> dict:
    """Lines by date, or areas that are stacked."""
    trace = lambda n, y: {"type": "scatter", "mode": "lines", "name": n, "x": [str(d) for d in dates], "y": y} | ({"stackgroup": "all"} if stacked else {})
    layout = _layout(title)
    layout["yaxis"] |= {"ticksuffix": suffix}
    return {"data": [trace(n, y) for n, y in series.items()], "layout": layout}


def index_lines(labels: list, series: dict[str, list[float]], title: str = "", baseline: float = 100.0, dashed: tuple[str, ...] = ()) -> dict:
    """Series as multiples of their mean times the baseline, which is drawn as a line."""
    data = []
    for n, y in series.items():
        mean = sum(y) / len(y) if y else 0
        data.append({"type": "scatter", "mode": "lines", "name": n, "x": labels, "y": [v / mean * baseline if mean else 0.0 for v in y], "line": {"dash": "dash" if n in dashed else "solid"}})
    mark = {"type": "line", "xref": "paper", "x0": 0, "x1": 1, "y0": baseline, "y1": baseline, "line": {"dash": "dot"}}
    return {"data": data, "layout": _layout(title, shapes=[mark])}


def stacked_comparison(labels: list, left: dict[str, list[float]], right: dict[str, list[float]], titles: tuple[str, str] = ("", ""), title: str = "") -> dict:
    """Two areas of shares of 100 side by side, with one colour for each category."""
    data = []
    for side, (table, axis) in enumerate(((left, ""), (right, "2"))):
        totals = [sum(column) for column in zip(*table.values())]
        for n, y in table.items():
            shares = [100 * v / t if t > 0 else 0.0 for v, t in zip(y, totals)]
            data.append({"type": "scatter", "mode": "lines", "name": n, "x": labels, "y": shares, "stackgroup": f"s{side}", "xaxis": f"x{axis}", "yaxis": f"y{axis}", "legendgroup": n, "showlegend": side == 0})
    layout = {"title": {"text": title}, "grid": {"rows": 1, "columns": 2, "pattern": "independent"}, "xaxis": {"title": {"text": titles[0]}}, "xaxis2": {"title": {"text": titles[1]}}}
    return {"data": data, "layout": layout}


def streamgraph(dates: list, series: dict[str, list[float]], title: str = "", notes: dict[str, str] | None = None, area: bool = False) -> dict:
    """Layers around a symmetric axis, or stacked areas, with notes at dates."""
    at = {str(d): i for i, d in enumerate(dates)}
    labels = [{"point": {"xAxis": 0, "yAxis": 0, "x": at[d], "y": 0}, "text": t} for d, t in (notes or {}).items() if d in at]
    plot = {"area": {"stacking": "normal"}} if area else {}
    return {
        "chart": {"type": "area" if area else "streamgraph"}, "title": {"text": title}, "xAxis": {"categories": [str(d) for d in dates]}, "yAxis": {"visible": area},
        "plotOptions": plot, "series": [{"name": n, "data": y} for n, y in series.items()], "annotations": [{"labels": labels}],
    }


def calendar_heatmap(days: dict[str, float], title: str = "", low: float | None = None, high: float | None = None) -> dict:
    """A value for each day of the span, null where there is none: weeks as columns, ISO weekdays as rows."""
    if not days:
        return {"chart": {"type": "heatmap"}, "title": {"text": title}, "series": [{"data": []}]}
    day, last, cells = date.fromisoformat(min(days)), date.fromisoformat(max(days)), []
    start = day - timedelta(days=day.weekday())
    while day <= last:
        cells.append({"x": (day - start).days // 7, "y": day.weekday(), "value": days.get(day.isoformat()), "date": day.isoformat()})
        day += timedelta(days=1)
    known = [v for v in days.values() if v is not None]
    axis = {"min": min(known, default=0) if low is None else low, "max": max(known, default=1) if high is None else high}
    return {"chart": {"type": "heatmap"}, "title": {"text": title}, "colorAxis": axis, "yAxis": {"categories": ["Mo", "Tu", "We", "Th", "Fr", "Sa", "Su"], "reversed": True}, "series": [{"data": cells}]}


def calendar_gantt(tasks: dict[str, list[tuple[str, str, str]]], title: str = "", first: str | None = None, last: str | None = None) -> dict:
    """(name, first day, last day) of tasks by group, as milliseconds since 1970."""
    ms = lambda d: (date.fromisoformat(d) - date(1970, 1, 1)).days * 86_400_000
    series = [{"name": g, "data": [{"name": n, "start": ms(a), "end": ms(z) + 86_400_000} for n, a, z in rows]} for g, rows in tasks.items()]
    axis = {k: ms(v) for k, v in (("min", first), ("max", last)) if v}
    return {"chart": {"type": "gantt"}, "title": {"text": title}, "xAxis": axis, "series": series}
