"""Reports in HTML: sections, tables, cards and charts, every value escaped."""

from __future__ import annotations

import html
import json
from difflib import unified_diff

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import DataValidationError
from gridloom.plans.chain import Step

MOST_ROWS = 2000
_STYLE = (
    "body{font:15px/1.5 sans-serif;max-width:1100px;margin:2em auto;padding:0 1em}table{border-collapse:collapse}"
    "td,th{border:1px solid #ccc;padding:.3em .6em}.good{background:#e3f5e1}.warn{background:#fff3cd}.bad{background:#f9d7d7}"
    ".cards{display:flex;gap:1em;flex-wrap:wrap}.card{border:1px solid #ccc;border-radius:6px;padding:.8em 1.2em}pre{overflow:auto;background:#f6f6f6;padding:1em}"
    "body.dark{background:#1b1b1b;color:#eee}body.dark pre,body.dark .card{background:#2a2a2a}"
)


def esc(value) -> str:
    return html.escape("" if value is None else str(value))


def shade(value, good: float, warn: float, higher_is_better: bool = True) -> str:
    """Class of a cell: good, warn or bad against two limits; none for null."""
    if value is None:
        return ""
    v, g, w = (value, good, warn) if higher_is_better else (-value, -good, -warn)
    return "good" if v >= g else "warn" if v >= w else "bad"


def shade_column(value: str, good: float, warn: float, higher_is_better: bool = True) -> Column:
    """``shade`` as an expression."""
    v, sign = F.col(value), 1 if higher_is_better else -1
    return F.when(v.isNull(), "").when(v * sign >= good * sign, "good").when(v * sign >= warn * sign, "warn").otherwise("bad")


class Report:
    """Appends fragments; ``save`` writes one file."""

    def __init__(self, title: str, language: str = "en"):
        self.title, self.language, self.parts = title, language, []

    def add(self, fragment: str) -> Report:
        self.parts.append(fragment)
        return self

    def section(self, title: str) -> Report:
        return self.add(f"<h2>{esc(title)}</h2>")

    def text(self, content: str) -> Report:
        return self.add(f"<p>{esc(content)}</p>")

    def table(self, df: DataFrame, title: str = "", limits: dict[str, tuple[float, float]] | None = None) -> Report:
        """A small table; one of more than 2000 rows is refused before it is collected."""
        rows = df.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise DataValidationError(f"a report's table has at most {MOST_ROWS} rows")
        head = "".join(f"<th>{esc(c)}</th>" for c in df.columns)
        cell = lambda c, v: f'<td class="{shade(v, *limits[c])}">{esc(v)}</td>' if limits and c in limits else f"<td>{esc(v)}</td>"
        body = "".join("<tr>" + "".join(cell(c, r[c]) for c in df.columns) + "</tr>" for r in rows)
        caption = f"<caption>{esc(title)}</caption>" if title else ""
        return self.add(f"<table>{caption}<thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")

    def cards(self, values: dict[str, object]) -> Report:
        return self.add('<div class="cards">' + "".join(f'<div class="card"><b>{esc(v)}</b><br>{esc(k)}</div>' for k, v in values.items()) + "</div>")

    def tabs(self, panes: dict[str, str]) -> Report:
        return self.add("".join(f"<details><summary>{esc(k)}</summary>{v}</details>" for k, v in panes.items()))

    def chart(self, svg: str, title: str = "") -> Report:
        if not svg.lstrip().startswith("<svg"):
            raise DataValidationError("a chart is an SVG element")
        return self.add(f"<figure>{svg}<figcaption>{esc(title)}</figcaption></figure>")

    def spec(self, spec: dict, title: str = "") -> Report:
        text = json.dumps(spec).replace("</", "<\\/")
        return self.add(f'<script type="application/json" data-title="{esc(title)}">{text}</script>')

    def code(self, source: str, language: str = "python", output: str | None = None) -> Report:
        out = f"<pre>{esc(output)}</pre>" if output is not None else ""
        return self.add(f'<pre><code class="language-{esc(language)}">{esc(source)}</code></pre>{out}')

    def diff(self, old: str, new: str, labels: tuple[str, str] = ("before", "after")) -> Report:
        lines = unified_diff(old.splitlines(), new.splitlines(), *labels, lineterm="")
        return self.add("<pre>" + "\n".join(f'<span class="{"good" if x[:1] == "+" else "bad" if x[:1] == "-" else ""}">{esc(x)}</span>' for x in lines) + "</pre>")

    def mermaid(self, diagram: str) -> Report:
        return self.add(f'<pre class="mermaid">{esc(diagram)}</pre>')

    def terminal(self, lines: list[str]) -> Report:
        return self.add('<pre class="terminal">' + "\n".join(map(esc, lines)) + "</pre>")

    def dark_toggle(self) -> Report:
        return self.add("<button onclick=\"document.body.classList.toggle('dark')\">Dark</button>")

    def render(self) -> str:
        head = f'<meta charset="utf-8"><title>{esc(self.title)}</title><style>{_STYLE}</style>'
        return f'<!DOCTYPE html><html lang="{esc(self.language)}"><head>{head}</head><body><h1>{esc(self.title)}</h1>{"".join(self.parts)}</body></html>'

    def save(self, path: str) -> str:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.render())
        return path


class ReportStep(Step):
    """A call of one of Report's methods: ``ReportStep("section", "Title") >> ReportStep("save", path)``."""

    kind = "report"

    def __init__(self, method: str, *args, **options):
        if method.startswith("_") or not callable(getattr(Report, method, None)):
            raise TypeError(f"a report has no {method!r}")
        self.method, self.args, self.options = method, args, options

    def run(self, state: Report | None) -> Report:
        report = Report("Report") if state is None else state
        getattr(report, self.method)(*self.args, **self.options)
        return report
