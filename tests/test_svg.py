import math
import random

import pytest

from gridloom.operators.charts import convex_hull
from gridloom.plans import specs
from gridloom.plans import svg as s

ROOT = s.tree([("", 10), ("a", 6), ("b", 4), ("a/x", 4), ("a/y", 2)])
RNG = random.Random(1)
XS, YS = ([RNG.random() for _ in range(30)] for _ in range(2))

CASES = {
    "bars": lambda: s.bars(["a", "<b>"], [1, 2]),
    "multi_bars": lambda: s.multi_bars(["a", "b"], {"u": [1, -2], "v": [3, 4]}),
    "stacked_bars": lambda: s.stacked_bars(["a", "b"], {"u": [1, 2], "v": [3, 4]}),
    "pie": lambda: s.pie(["a"], [1]),
    "radar": lambda: s.radar(list("abc"), {"u": [1, 2, 3]}),
    "lines": lambda: s.lines([1, 2, 3], {"u": [1, None, 3]}),
    "slope": lambda: s.slope(["before", "after"], {"u": [1, 2]}),
    "bump": lambda: s.bump([1, 2], {"u": [1, 2], "v": [2, 1]}),
    "layers": lambda: s.layers([1, 2], {"u": [(0, 1), (0, 2)]}),
    "horizon": lambda: s.horizon([(0, 0, 1.0, 0.0), (1, 0, 0.0, 1.0)]),
    "gantt": lambda: s.gantt([("t", 0, 3), ("u", 2, 5)]),
    "boxes": lambda: s.boxes([("a", 0, 1, 2, 3, 4)]),
    "violins": lambda: s.violins({"a": [(0, 0.1), (1, 0.5)]}),
    "points": lambda: s.points(XS, YS, [100] * 30),
    "beeswarm": lambda: s.beeswarm({"a": XS}),
    "hexagons": lambda: s.hexagons([(0, 0, 1), (1, 1, 3)]),
    "matrix": lambda: s.matrix([[1, -1], [0, None]], ["a", "b"], ["c", "d"]),
    "contour": lambda: s.contour([[1, 2], [3, 4]]),
    "parallel": lambda: s.parallel(["a", "b"], [[0, 1], [1, 0]]),
    "hulls": lambda: s.hulls({"a": (XS, YS)}),
    "treemap": lambda: s.treemap(ROOT),
    "sunburst": lambda: s.sunburst(ROOT),
    "packed": lambda: s.packed(ROOT),
    "dendrogram": lambda: s.dendrogram(ROOT),
    "circular_dendrogram": lambda: s.dendrogram(ROOT, circular=True),
    "sankey": lambda: s.sankey([("a", "b", 2), ("b", "c", 1), ("a", "c", 1)]),
    "alluvial": lambda: s.alluvial([("a", "b", 2)]),
    "arcs": lambda: s.arcs(list("abc"), [("a", "c", 2)]),
    "chord": lambda: s.chord(list("abc"), [[0, 5, 3], [5, 0, 4], [3, 4, 0]]),
    "voronoi": lambda: s.voronoi(list(zip(XS, YS))),
    "voronoi_treemap": lambda: s.voronoi_treemap(ROOT),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_charts_are_svg(name):
    from xml.dom.minidom import parseString

    text = CASES[name]()
    assert text.startswith("<svg") and "nan" not in text
    parseString(text)


def test_layouts():
    assert s.layers_of([("a", "b", 1), ("b", "c", 1), ("a", "c", 1)]) == {"a": 0, "b": 1, "c": 2}
    assert s.layers_of([("a", "b", 1), ("b", "a", 1)]).keys() == {"a", "b"}
    corners = convex_hull([0, 1, 1, 0, 0.5], [0, 0, 1, 1, 0.5])
    assert sorted(corners) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert ROOT["value"] == 10 and [c["name"] for c in ROOT["children"]] == ["a", "b"]
    spec = s.plot_spec("bar", [1], {"u": [2]}, "t")
    assert spec["data"][0]["y"] == [2] and s.calendar_spec({"2024-01-01": 3.0})["series"][0]["data"][0]["weekday"] == 1
    assert math.isfinite(s._scale(1, 1, 0, 1)(1))


def test_treemap_cells_are_as_large_as_their_values():
    frame = [(0.0, 0.0), (400.0, 0.0), (400.0, 300.0), (0.0, 300.0)]
    for values in ([1.0], [5.0, 3.0], [8.0, 5.0, 3.0, 2.0, 1.0, 1.0], [10.0] * 7):
        areas = [s._area(c) for c in s.shares_of(frame, values)]
        assert sum(areas) == pytest.approx(120_000, rel=1e-6)
        assert all(a / 120_000 == pytest.approx(v / sum(values), abs=0.02) for a, v in zip(areas, values))
    assert s.voronoi_treemap(ROOT).count("<text") == 3  # the leaves: x, y and b


def test_specs_are_plain_data():
    import json

    found = [
        specs.histogram([(0, 1, 3), (1, 2, 9)]), specs.histogram([], groups={"a": [(0, 1, 7)], "b": [(0, 1, 2)]}),
        specs.bars(["x", "y"], {"u": [1, 2]}, order=["y", "x"], lines={"v": [3, 4]}, percent=True), specs.lines(["2024-01-01"], {"u": [1]}, stacked=True),
        specs.index_lines([1, 2], {"u": [1, 3], "z": [0, 0]}), specs.stacked_comparison([1, 2], {"u": [1, 0], "v": [3, 0]}, {"u": [1, 1], "v": [1, 1]}),
        specs.streamgraph(["a", "b"], {"u": [1, 2]}, notes={"b": "here", "q": "no"}), specs.calendar_heatmap({"2024-01-01": 3.0, "2024-01-09": 1.0}),
        specs.calendar_gantt({"g": [("t", "2024-01-01", "2024-01-02")]}, first="2024-01-01"),
    ]
    json.dumps(found)
    assert len(found[1]["data"]) == 1 and found[2]["data"][0]["x"] == ["y", "x"] and found[2]["data"][0]["y"] == [2, 1]
    assert found[4]["data"][0]["y"] == [50, 150] and found[4]["data"][1]["y"] == [0, 0]
    assert found[5]["data"][1]["y"] == [75, 0] and len(found[6]["annotations"][0]["labels"]) == 1
    assert len(found[7]["series"][0]["data"]) == 9 and found[7]["series"][0]["data"][-1]["x"] == 1
    assert found[8]["series"][0]["data"][0]["end"] - found[8]["series"][0]["data"][0]["start"] == 2 * 86_400_000
    with pytest.raises(Exception, match="groups"):
        specs.histogram([], groups={str(i): [(0, 1, 9)] for i in range(11)})
