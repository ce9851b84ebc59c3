"""Charts as SVG from small collected rows; the numbers come prepared from ``operators.charts``."""

from __future__ import annotations

import html
import math
from collections import defaultdict

from gridloom.operators.charts import convex_hull

PALETTE = ("#4e79a7", "#f28e2b", "#59a14f", "#e15759", "#76b7b2", "#edc948", "#b07aa1", "#9c755f")
W, H, PAD = 640, 400, 40


def esc(v) -> str:
    return html.escape(str(v))


def svg(body: str, w: int = W, h: int = H) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w} {h}" width="{w}" height="{h}">{body}</svg>'


def colour(i: int) -> str:
    return PALETTE[i % len(PALETTE)]


def _text(x: float, y: float, s, anchor: str = "middle", size: int = 11) -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" text-anchor="{anchor}">{esc(s)}</text>'


def _rect(x: float, y: float, w: float, h: float, fill: str, title="") -> str:
    return f'<rect x="{x:.1f}" y="{y:.1f}" width="{max(w, 0):.1f}" height="{max(h, 0):.1f}" fill="{fill}"><title>{esc(title)}</title></rect>'


def _path(points, fill: str = "none", stroke: str = "none", close: bool = False) -> str:
    d = "M" + "L".join(f"{x:.1f},{y:.1f}" for x, y in points) + ("Z" if close else "")
    return f'<path d="{d}" fill="{fill}" stroke="{stroke}" stroke-width="1.5"/>'


def _scale(lo: float, hi: float, a: float, b: float):
    span = (hi - lo) or 1.0
    return lambda v: a + (v - lo) / span * (b - a)


def _arc(cx: float, cy: float, r0: float, r1: float, a0: float, a1: float, fill: str, title="") -> str:
    a1 = min(a1, a0 + 2 * math.pi - 1e-4)
    big = int(a1 - a0 > math.pi)
    p = lambda r, a: f"{cx + r * math.sin(a):.1f},{cy - r * math.cos(a):.1f}"
    inner = f"L{p(r0, a1)}A{r0},{r0} 0 {big} 0 {p(r0, a0)}Z" if r0 else f"L{cx},{cy}Z"
    return f'<path d="M{p(r1, a0)}A{r1},{r1} 0 {big} 1 {p(r1, a1)}{inner}" fill="{fill}" stroke="white"><title>{esc(title)}</title></path>'


def bars(categories: list, values: list[float]) -> str:
    return stacked_bars(categories, {"": values})


def multi_bars(categories: list, groups: dict[str, list[float]]) -> str:
    y = _scale(min(0.0, *(v for g in groups.values() for v in g)), max(0.0, *(v for g in groups.values() for v in g)), H - PAD, PAD)
    step, n, out = (W - 2 * PAD) / max(len(categories), 1), len(groups), []
    for i, c in enumerate(categories):
        for k, (name, values) in enumerate(groups.items()):
            x, w = PAD + i * step + k * step * 0.8 / n, step * 0.8 / n
            out.append(_rect(x, min(y(values[i]), y(0)), w, abs(y(values[i]) - y(0)), colour(k), f"{c} {name} {values[i]}"))
        out.append(_text(PAD + (i + 0.4) * step, H - PAD / 2, c))
    return svg("".join(out))


def stacked_bars(categories: list, groups: dict[str, list[float]]) -> str:
    totals = [sum(g[i] for g in groups.values()) for i in range(len(categories))]
    y = _scale(0, max(totals, default=1) or 1, 0, H - 2 * PAD)
    step, out = (W - 2 * PAD) / max(len(categories), 1), []
    for i, c in enumerate(categories):
        top = H - PAD
        for k, (name, values) in enumerate(groups.items()):
            top -= y(values[i])
            out.append(_rect(PAD + i * step, top, step * 0.8, y(values[i]), colour(k), f"{c} {name} {values[i]}"))
        out.append(_text(PAD + (i + 0.4) * step, H - PAD / 2, c))
    return svg("".join(out))


def pie(labels: list, values: list[float]) -> str:
    total, at, out = sum(values) or 1, 0.0, []
    for i, (name, v) in enumerate(zip(labels, values)):
        to = at + v / total * 2 * math.pi
        out.append(_arc(W / 2, H / 2, 0, H / 2 - PAD, at, to, colour(i), f"{name} {v}"))
        at = to
    return svg("".join(out))


def radar(axes: list, series: dict[str, list[float]]) -> str:
    top, n, r = max((v for s in series.values() for v in s), default=1) or 1, len(axes), H / 2 - PAD
    p = lambda i, v: (W / 2 + r * v / top * math.sin(2 * math.pi * i / n), H / 2 - r * v / top * math.cos(2 * math.pi * i / n))
    out = [_path([p(i, v) for i, v in enumerate(s)], colour(k) + "40", colour(k), True) for k, s in enumerate(series.values())]
    return svg("".join(out + [_text(*p(i, top * 1.1), a) for i, a in enumerate(axes)]))


def lines(xs: list, series: dict[str, list[float]]) -> str:
    flat = [v for s in series.values() for v in s if v is not None] or [0]
    x, y = _scale(0, max(len(xs) - 1, 1), PAD, W - PAD), _scale(min(flat), max(flat), H - PAD, PAD)
    out = [_path([(x(i), y(v)) for i, v in enumerate(s) if v is not None], stroke=colour(k)) for k, s in enumerate(series.values()) if any(v is not None for v in s)]
    return svg("".join(out + [_text(x(i), H - PAD / 2, xs[i]) for i in sorted({0, len(xs) - 1}) if xs]))


slope = bump = lines


def layers(xs: list, bands: dict[str, list[tuple[float, float]]]) -> str:
    """Areas between (y0, y1), as of ``stream_layers``."""
    flat = [v for s in bands.values() for p in s for v in p] or [0, 1]
    x, y = _scale(0, max(len(xs) - 1, 1), PAD, W - PAD), _scale(min(flat), max(flat), H - PAD, PAD)
    out = []
    for k, s in enumerate(bands.values()):
        edge = [(x(i), y(b)) for i, (_, b) in enumerate(s)] + [(x(i), y(a)) for i, (a, _) in reversed(list(enumerate(s)))]
        out.append(_path(edge, colour(k), close=True))
    return svg("".join(out))


def horizon(rows: list[tuple[int, int, float, float]]) -> str:
    """(pos, band, positive, negative) of ``horizon_bands``; deeper bands are darker."""
    top = max((max(p, n) for *_, p, n in rows), default=1) or 1
    xs = sorted({r[0] for r in rows})
    at, w = {p: i for i, p in enumerate(xs)}, (W - 2 * PAD) / max(len(xs), 1)
    out = []
    for pos, band, p, n in rows:
        for v, c in ((p, "#4e79a7"), (n, "#e15759")):
            h = v / top * (H - 2 * PAD)
            out.append(f'<rect x="{PAD + at[pos] * w:.1f}" y="{H - PAD - h:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{c}" fill-opacity="{0.3 + 0.2 * band:.1f}"/>')
    return svg("".join(out))


def gantt(tasks: list[tuple[str, float, float]]) -> str:
    x = _scale(min((t[1] for t in tasks), default=0), max((t[2] for t in tasks), default=1), 120, W - PAD)
    h = (H - 2 * PAD) / max(len(tasks), 1)
    return svg("".join(_rect(x(a), PAD + i * h, x(b) - x(a), h * 0.8, colour(i), name) + _text(110, PAD + (i + 0.5) * h, name, "end") for i, (name, a, b) in enumerate(tasks)))


def boxes(stats: list[tuple[str, float, float, float, float, float]]) -> str:
    """(name, low, q1, median, q3, high)."""
    y = _scale(min((s[1] for s in stats), default=0), max((s[5] for s in stats), default=1), H - PAD, PAD)
    step, out = (W - 2 * PAD) / max(len(stats), 1), []
    for i, (name, low, q1, med, q3, high) in enumerate(stats):
        x = PAD + (i + 0.5) * step
        out += [_path([(x, y(low)), (x, y(high))], stroke="#333"), _rect(x - step / 4, y(q3), step / 2, y(q1) - y(q3), colour(i), name)]
        out += [_path([(x - step / 4, y(med)), (x + step / 4, y(med))], stroke="#000"), _text(x, H - PAD / 2, name)]
    return svg("".join(out))


def violins(curves: dict[str, list[tuple[float, float]]]) -> str:
    flat = [x for c in curves.values() for x, _ in c] or [0, 1]
    y, step, out = _scale(min(flat), max(flat), H - PAD, PAD), (W - 2 * PAD) / max(len(curves), 1), []
    for i, (name, c) in enumerate(curves.items()):
        top, mid = max((d for _, d in c), default=1) or 1, PAD + (i + 0.5) * step
        side = [(mid + d / top * step / 2.5, y(x)) for x, d in c]
        out.append(_path(side + [(2 * mid - a, b) for a, b in reversed(side)], colour(i), close=True) + _text(mid, H - PAD / 2, name))
    return svg("".join(out))


def points(xs: list[float], ys: list[float], sizes: list[float] | None = None, labels: list | None = None) -> str:
    x, y = _scale(min(xs, default=0), max(xs, default=1), PAD, W - PAD), _scale(min(ys, default=0), max(ys, default=1), H - PAD, PAD)
    r = [math.sqrt(max(s, 0) / math.pi) for s in sizes] if sizes else [3] * len(xs)
    return svg("".join(f'<circle cx="{x(a):.1f}" cy="{y(b):.1f}" r="{min(r[i], 40):.1f}" fill="{colour(i)}" fill-opacity=".6"><title>{esc(labels[i] if labels else i)}</title></circle>' for i, (a, b) in enumerate(zip(xs, ys))))


def beeswarm(groups: dict[str, list[float]]) -> str:
    """Jitter follows from the value itself, so the picture is the same every time."""
    xs, ys = [], []
    for k, values in enumerate(groups.values()):
        for i, v in enumerate(values):
            xs.append(k + ((i * 0.618034) % 1 - 0.5) * 0.6)
            ys.append(v)
    return points(xs, ys)


def hexagons(cells: list[tuple[float, float, int]]) -> str:
    top = max((n for *_, n in cells), default=1)
    x, y = _scale(min((c[0] for c in cells), default=0), max((c[0] for c in cells), default=1), PAD, W - PAD), _scale(min((c[1] for c in cells), default=0), max((c[1] for c in cells), default=1), H - PAD, PAD)
    hexa = lambda cx, cy: [(cx + 14 * math.sin(a), cy + 14 * math.cos(a)) for a in (k * math.pi / 3 for k in range(6))]
    return svg("".join(f'<g fill-opacity="{0.15 + 0.85 * n / top:.2f}">{_path(hexa(x(a), y(b)), PALETTE[0], close=True)}</g>' for a, b, n in cells))


def matrix(values: list[list[float]], rows: list, columns: list) -> str:
    flat = [abs(v) for r in values for v in r if v is not None] or [1]
    top, w, h, out = max(flat) or 1, (W - 120) / max(len(columns), 1), (H - 2 * PAD) / max(len(rows), 1), []
    for i, r in enumerate(values):
        out.append(_text(110, PAD + (i + 0.6) * h, rows[i], "end"))
        out += [f'<g fill-opacity="{abs(v or 0) / top:.2f}">{_rect(120 + j * w, PAD + i * h, w, h, PALETTE[0] if (v or 0) >= 0 else PALETTE[3], v)}</g>' for j, v in enumerate(r)]
    return svg("".join(out + [_text(120 + (j + 0.5) * w, PAD - 8, c) for j, c in enumerate(columns)]))


def contour(grid: list[list[float]]) -> str:
    return matrix(grid, [""] * len(grid), [""] * (len(grid[0]) if grid else 0))


def parallel(axes: list, rows: list[list[float]]) -> str:
    """Rows already scaled to 0 to 1."""
    x = _scale(0, max(len(axes) - 1, 1), PAD, W - PAD)
    out = [_path([(x(i), H - PAD - v * (H - 2 * PAD)) for i, v in enumerate(r)], stroke=colour(k)) for k, r in enumerate(rows)]
    return svg("".join(out + [_text(x(i), H - PAD / 2, a) for i, a in enumerate(axes)]))


def hulls(groups: dict[str, tuple[list[float], list[float]]]) -> str:
    flat_x, flat_y = [v for x, _ in groups.values() for v in x], [v for _, y in groups.values() for v in y]
    x, y = _scale(min(flat_x, default=0), max(flat_x, default=1), PAD, W - PAD), _scale(min(flat_y, default=0), max(flat_y, default=1), H - PAD, PAD)
    return svg("".join(_path([(x(a), y(b)) for a, b in convex_hull(*g)], colour(k) + "40", colour(k), True) for k, g in enumerate(groups.values()) if len(set(zip(*g))) >= 3))


def tree(rows: list[tuple[str, float]]) -> dict:
    """(path, value) of ``roll_up`` as nested nodes; the root's path is empty."""
    nodes = {"": {"name": "", "value": 0.0, "children": []}}
    for path, value in sorted(rows, key=lambda r: (r[0].count("/"), r[0])):
        if not path:
            nodes[""]["value"] = value
            continue
        up, _, name = path.rpartition("/")
        nodes[path] = {"name": name, "value": value, "children": []}
        nodes[up]["children"].append(nodes[path])
    return nodes[""]


def treemap(root: dict) -> str:
    out: list[str] = []

    def split(items: list[dict], x: float, y: float, w: float, h: float, depth: int) -> None:
        total = sum(i["value"] for i in items)
        if not items or total <= 0:
            return
        if len(items) == 1:
            node = items[0]
            out.append(_rect(x, y, w, h, colour(depth + len(out)), f"{node['name']} {node['value']}"))
            split(node["children"], x + 3, y + 14, w - 6, h - 17, depth + 1)
            if w > 40 and h > 14:
                out.append(_text(x + 4, y + 11, node["name"], "start"))
            return
        items = sorted(items, key=lambda i: -i["value"])
        half, k = items[0]["value"], 1
        while k < len(items) - 1 and half + items[k]["value"] <= total / 2:
            half, k = half + items[k]["value"], k + 1
        part = half / total
        if w >= h:
            split(items[:k], x, y, w * part, h, depth)
            split(items[k:], x + w * part, y, w * (1 - part), h, depth)
        else:
            split(items[:k], x, y, w, h * part, depth)
            split(items[k:], x, y + h * part, w, h * (1 - part), depth)

    split(root["children"], 0, 0, W, H, 0)
    return svg("".join(out))


def sunburst(root: dict) -> str:
    out: list[str] = []
    deep = lambda n: 1 + max(map(deep, n["children"]), default=0)
    ring = (H / 2 - 10) / max(deep(root), 1)

    def walk(node: dict, a: float, b: float, depth: int) -> None:
        total = sum(c["value"] for c in node["children"]) or 1
        for c in node["children"]:
            to = a + (b - a) * c["value"] / total if c is not node["children"][-1] else b
            out.append(_arc(W / 2, H / 2, ring * depth, ring * (depth + 1), a, to, colour(depth + len(out)), f"{c['name']} {c['value']}"))
            walk(c, a, to, depth + 1)
            a = to

    walk(root, 0, 2 * math.pi, 1)
    return svg("".join(out))


def packed(root: dict) -> str:
    """Circles of leaf areas on a spiral, largest first."""
    leaves: list[dict] = []
    todo = [root]
    while todo:
        n = todo.pop()
        todo += n["children"]
        leaves += [] if n["children"] else [n]
    scale = 0.3 * W * H / (sum(n["value"] for n in leaves) or 1)
    placed: list[tuple[float, float, float]] = []
    out = []
    for i, n in enumerate(sorted(leaves, key=lambda n: -n["value"])):
        r, t = math.sqrt(max(n["value"], 0) * scale / math.pi), 0.0
        while True:
            x, y = W / 2 + 2 * t * math.cos(t), H / 2 + 2 * t * math.sin(t)
            if all((x - a) ** 2 + (y - b) ** 2 >= (r + c) ** 2 for a, b, c in placed):
                break
            t += 0.2
        placed.append((x, y, r))
        out.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{r:.1f}" fill="{colour(i)}"><title>{esc(n["name"])} {n["value"]}</title></circle>')
    return svg("".join(out))


def dendrogram(root: dict, circular: bool = False) -> str:
    out, leaf = [], [0]
    count = lambda n: sum(map(count, n["children"])) or 1
    total, deep = count(root), lambda n: 1 + max(map(deep, n["children"]), default=0)
    levels = max(deep(root) - 1, 1)

    def at(pos: float, depth: int) -> tuple[float, float]:
        if circular:
            a, r = 2 * math.pi * pos / total, (H / 2 - PAD) * depth / levels
            return W / 2 + r * math.sin(a), H / 2 - r * math.cos(a)
        return PAD + (W - 2 * PAD - 60) * depth / levels, PAD + (H - 2 * PAD) * (pos + 0.5) / total

    def walk(n: dict, depth: int) -> float:
        if not n["children"]:
            leaf[0] += 1
            out.append(_text(*at(leaf[0] - 1, depth), n["name"], "start", 9))
            return leaf[0] - 1
        pos = [walk(c, depth + 1) for c in n["children"]]
        mid = sum(pos) / len(pos)
        out.extend(_path([at(mid, depth), at(p, depth), at(p, depth + 1)], stroke="#666") for p in pos)
        return mid

    walk(root, 0)
    return svg("".join(out))


def layers_of(links: list[tuple[str, str, float]]) -> dict[str, int]:
    """Longest-path column of each node of an acyclic flow; nodes on a cycle keep the bound."""
    nodes = {n for a, b, _ in links for n in (a, b)}
    depth = dict.fromkeys(nodes, 0)
    for _ in range(len(nodes)):
        moved = False
        for a, b, _ in links:
            if a != b and depth[b] < depth[a] + 1 <= len(nodes):
                depth[b], moved = depth[a] + 1, True
        if not moved:
            break
    return depth


def sankey(links: list[tuple[str, str, float]]) -> str:
    depth = layers_of(links)
    out_sum, in_sum = defaultdict(float), defaultdict(float)
    for a, b, v in links:
        out_sum[a] += v
        in_sum[b] += v
    size = {n: max(out_sum[n], in_sum[n]) for n in depth}
    columns = defaultdict(list)
    for n in sorted(depth):
        columns[depth[n]].append(n)
    tallest = max((sum(size[n] for n in c) for c in columns.values()), default=1) or 1
    x, scale = _scale(0, max(columns, default=1) or 1, PAD, W - PAD - 60), (H - 2 * PAD) * 0.8 / tallest
    top, body = {}, []
    for k, c in columns.items():
        y = PAD
        for n in c:
            top[n] = [y, y]
            body.append(_rect(x(k), y, 12, size[n] * scale, colour(len(top)), f"{n} {size[n]}") + _text(x(k) + 16, y + 10, n, "start"))
            y += size[n] * scale + 8
    bands = []
    for i, (a, b, v) in enumerate(links):
        y0, y1, h = top[a][0], top[b][1], v * scale
        top[a][0] += h
        top[b][1] += h
        xa, xb = x(depth[a]) + 12, x(depth[b])
        m = (xa + xb) / 2
        bands.append(f'<path d="M{xa:.1f},{y0:.1f}C{m:.1f},{y0:.1f} {m:.1f},{y1:.1f} {xb:.1f},{y1:.1f}V{y1 + h:.1f}C{m:.1f},{y1 + h:.1f} {m:.1f},{y0 + h:.1f} {xa:.1f},{y0 + h:.1f}Z" fill="{colour(i)}" fill-opacity=".4"/>')
    return svg("".join(bands + body))


alluvial = sankey


def arcs(nodes: list, links: list[tuple[str, str, float]]) -> str:
    x, top = {n: PAD + i * (W - 2 * PAD) / max(len(nodes) - 1, 1) for i, n in enumerate(nodes)}, max((v for *_, v in links), default=1) or 1
    out = [f'<path d="M{x[a]:.1f},{H - PAD}A{abs(x[b] - x[a]) / 2 or 1:.1f},{abs(x[b] - x[a]) / 2 or 1:.1f} 0 0 1 {x[b]:.1f},{H - PAD}" fill="none" stroke="#4e79a7" stroke-width="{6 * v / top:.1f}"/>' for a, b, v in ((min(a, b, key=x.get), max(a, b, key=x.get), v) for a, b, v in links)]
    return svg("".join(out + [_text(x[n], H - PAD / 2, n) for n in nodes]))


def chord(labels: list, table: list[list[float]]) -> str:
    sizes = [sum(r) + sum(table[j][i] for j in range(len(table))) for i, r in enumerate(table)]
    total, at, mid, out = sum(sizes) or 1, 0.0, [], []
    for i, s in enumerate(sizes):
        to = at + 2 * math.pi * s / total
        out.append(_arc(W / 2, H / 2, H / 2 - PAD - 10, H / 2 - PAD, at, to, colour(i), f"{labels[i]} {s}"))
        mid.append((at + to) / 2)
        at = to
    r, top = H / 2 - PAD - 12, max((v for row in table for v in row), default=1) or 1
    p = lambda a: f"{W / 2 + r * math.sin(a):.1f},{H / 2 - r * math.cos(a):.1f}"
    out += [f'<path d="M{p(mid[i])}Q{W / 2},{H / 2} {p(mid[j])}" fill="none" stroke="{colour(i)}" stroke-opacity=".5" stroke-width="{10 * v / top:.1f}"/>' for i, row in enumerate(table) for j, v in enumerate(row) if v]
    return svg("".join(out))


def voronoi(pts: list[tuple[float, float]], labels: list | None = None) -> str:
    """Cells by clipping the frame with the bisectors to all other points; for small n."""
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    fx, fy = _scale(min(xs, default=0), max(xs, default=1), PAD, W - PAD), _scale(min(ys, default=0), max(ys, default=1), H - PAD, PAD)
    places, out = [(fx(a), fy(b)) for a, b in pts], []
    for i, (px, py) in enumerate(places):
        cell = [(0.0, 0.0), (W, 0.0), (W, H), (0.0, H)]
        for j, (qx, qy) in enumerate(places):
            if i == j or (px, py) == (qx, qy):
                continue
            side = lambda v: (v[0] - (px + qx) / 2) * (qx - px) + (v[1] - (py + qy) / 2) * (qy - py)  # noqa: B023, E731
            kept = []
            for k, v in enumerate(cell):
                u = cell[k - 1]
                a, b = side(u), side(v)
                if (a <= 0) != (b <= 0):
                    t = a / (a - b)
                    kept.append((u[0] + t * (v[0] - u[0]), u[1] + t * (v[1] - u[1])))
                if b <= 0:
                    kept.append(v)
            cell = kept
        out.append(_path(cell, colour(i) + "80", "white", True) if cell else "")
        out.append(_text(px, py, labels[i] if labels else ""))
    return svg("".join(out))


Polygon = list[tuple[float, float]]


def _area(cell: Polygon) -> float:
    return abs(sum(x * v - u * y for (x, y), (u, v) in zip(cell, cell[1:] + cell[:1]))) / 2


def _middle(cell: Polygon) -> tuple[float, float]:
    """The centre of a polygon's area."""
    total = cx = cy = 0.0
    for (x, y), (u, v) in zip(cell, cell[1:] + cell[:1]):
        cross = x * v - u * y
        total, cx, cy = total + cross, cx + (x + u) * cross, cy + (y + v) * cross
    return (cx / (3 * total), cy / (3 * total)) if total else cell[0]


def _clipped(cell: Polygon, a: float, b: float, c: float) -> Polygon:
    """The part of a convex polygon where a * x + b * y <= c."""
    out: Polygon = []
    for k, v in enumerate(cell):
        u = cell[k - 1]
        p, q = a * u[0] + b * u[1] - c, a * v[0] + b * v[1] - c
        if (p <= 0) != (q <= 0):
            t = p / (p - q)
            out.append((u[0] + t * (v[0] - u[0]), u[1] + t * (v[1] - u[1])))
        if q <= 0:
            out.append(v)
    return out


def power_cells(frame: Polygon, sites: list[tuple[float, float]], weights: list[float]) -> list[Polygon]:
    """Where each site is nearest by squared distance less its weight."""
    cells = []
    for i, (x, y) in enumerate(sites):
        cell = frame
        for j, (u, v) in enumerate(sites):
            if i != j and cell:
                cell = _clipped(cell, 2 * (u - x), 2 * (v - y), u * u + v * v - weights[j] - x * x - y * y + weights[i])
        cells.append(cell)
    return cells


def shares_of(frame: Polygon, values: list[float], rounds: int = 200) -> list[Polygon]:
    """A convex polygon cut into convex cells whose areas are as the values.

    Sites move to their cells' centres while weights grow for cells that are too small.
    """
    if len(values) == 1:
        return [frame]
    whole, total = _area(frame), sum(values)
    cx, cy = _middle(frame)
    reach = 0.5 * math.sqrt(whole / math.pi)
    sites = [(cx + reach * math.sqrt((i + 0.5) / len(values)) * math.cos(i * 2.399963), cy + reach * math.sqrt((i + 0.5) / len(values)) * math.sin(i * 2.399963)) for i in range(len(values))]
    weights, best = [0.0] * len(values), (math.inf, [frame])
    for _ in range(rounds):
        cells = power_cells(frame, sites, weights)
        areas = [_area(cell) if len(cell) > 2 else 0.0 for cell in cells]
        gap = max(abs(a / whole - v / total) for a, v in zip(areas, values))
        if all(areas) and gap < best[0]:
            best = (gap, cells)
        if gap < 0.002 and all(areas):
            break
        sites = [_middle(cell) if a else site for cell, a, site in zip(cells, areas, sites)]
        weights = [w + 0.5 * (whole * v / total - a) / math.pi for w, a, v in zip(weights, areas, values)]
    return best[1] if len(best[1]) == len(values) else cells


def voronoi_treemap(root: dict) -> str:
    """Convex cells with areas as the values, at every depth within the cell of the node above."""
    out: list[str] = []

    def draw(node: dict, frame: Polygon, shade: int, depth: int) -> None:
        children = [n for n in sorted(node["children"], key=lambda n: -n["value"]) if n["value"] > 0]
        if not children:
            out.append(_path(frame, colour(shade) + "80", "white", True))
            out.append(_text(*_middle(frame), node["name"]))
            return
        for i, (child, cell) in enumerate(zip(children, shares_of(frame, [n["value"] for n in children]))):
            if len(cell) > 2:
                draw(child, cell, i if depth == 0 else shade, depth + 1)
        out.append(_path(frame, "none", "white", True))

    draw(root, [(float(PAD), float(PAD)), (float(W - PAD), float(PAD)), (float(W - PAD), float(H - PAD)), (float(PAD), float(H - PAD))], 0, 0)
    return svg("".join(out))


def plot_spec(kind: str, x: list, series: dict[str, list], title: str = "", stacked: bool = False) -> dict:
    """A declarative chart for browser libraries: traces and layout as plain data."""
    trace = lambda name, y: {"type": kind, "name": name, "x": x, "y": y} | ({"stackgroup": "one"} if stacked else {})
    return {"data": [trace(n, y) for n, y in series.items()], "layout": {"title": {"text": title}}}


def calendar_spec(days: dict[str, float], title: str = "") -> dict:
    """A day-by-value calendar as plain data: weeks as columns, ISO weekdays as rows."""
    from datetime import date

    cells = []
    for day, value in sorted(days.items()):
        year, week, weekday = date.fromisoformat(day).isocalendar()
        cells.append({"date": day, "year": year, "week": week, "weekday": weekday, "value": value})
    return {"chart": {"type": "heatmap"}, "title": {"text": title}, "series": [{"data": cells}]}
