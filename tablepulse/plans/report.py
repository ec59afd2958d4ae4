"""An analysis as one HTML file: bounded, self-contained, every text escaped, no raw rows. And results as JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, is_dataclass
from html import escape
from math import isfinite
from pathlib import PurePath

from tablepulse.functions.svg import render
from tablepulse.operators.charts import charts, report_charts, titled
from tablepulse.plans.analysis import Analysis

#: How much a report shows.
MOST_COLUMNS, MOST_FINDINGS, MOST_RECOMMENDATIONS, MOST_CORRELATIONS, MOST_INSIGHTS = 50, 100, 100, 20, 8
STYLE = "body{font-family:sans-serif;max-width:1000px;margin:2em auto;color:#1a202c}table{border-collapse:collapse;width:100%}td,th{border:1px solid #cbd5e0;padding:4px 8px;text-align:left}.scroll{overflow-x:auto}svg{max-width:100%}"


def report_filename(source_name: str) -> str:
    stem = PurePath(source_name.replace("\\", "/")).stem
    return f"tablepulse_report_{re.sub(r'[^A-Za-z0-9._-]+', '_', stem).strip('._-') or 'dataset'}.html"


def _table(heads: Iterable[str], rows: Iterable[Iterable[object]], none: str) -> str:
    heads, body = list(heads), "".join("<tr>" + "".join(f"<td>{escape(_text(v))}</td>" for v in r) + "</tr>" for r in rows)
    body = body or f'<tr><td colspan="{len(heads)}">{escape(none)}</td></tr>'
    return f'<div class="scroll" role="region" tabindex="0"><table><thead><tr>{"".join(f"<th>{escape(h)}</th>" for h in heads)}</tr></thead><tbody>{body}</tbody></table></div>'


def _text(v: object) -> str:
    return "n/a" if v is None else f"{v:.4g}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


def _omitted(n: int, most: int, what: str) -> str:
    return f"<p>{n - most} more {what} are not shown.</p>" if n > most else ""


def _numbers(c) -> str:  # noqa: ANN001
    shown = (("n", "finite_count"), ("mean", "mean"), ("median", "median"), ("sd", "standard_deviation"), ("min", "minimum"), ("max", "maximum"), ("Q1", "first_quartile"), ("Q3", "third_quartile"), ("IQR", "interquartile_range"), ("skew", "skewness"), ("kurtosis", "kurtosis"))
    return "; ".join(f"{k}: {_text(c.statistics[f])}" for k, f in shown if c.statistics.get(f) is not None) if c.kind == "numeric" else ""


def html_report(a: Analysis) -> str:
    s, found, r = a.profile.summary, a.quality.findings, a.readiness
    score = lambda v: "Not evaluated" if v is None else f"{v:.1f} / 100"
    sections = {
        "Dataset overview": f"<p>Rows: {s['row_count']:,} · Columns: {s['column_count']:,} · Cells: {s['cell_count']:,} · Missing cells: {s['missing_cell_count']:,} · Repeated rows: {_text(s['duplicate_row_count'])}</p>"
        + _table(("Semantic type", "Columns"), a.profile.type_counts, "No columns."),
        "Data health": f"<p><strong>{score(a.health.overall)}</strong> {escape(titled(a.health.band or 'not evaluated'))}</p>" + _table(("Dimension", "Score"), ((titled(d.dimension), score(d.score)) for d in a.health.dimensions), "None."),
        "Quality findings": _table(("Dimension", "Severity", "Scope", "Finding", "Affected %"), ((titled(f.dimension), f.severity, f.target.column_name or "Dataset", f.message, f.affected_percentage) for f in found[:MOST_FINDINGS]), "No findings.") + _omitted(len(found), MOST_FINDINGS, "findings"),
        "Readiness": f"<p><strong>{score(r.overall)}</strong> {escape(titled(r.band))}</p>" + _table(("Dimension", "Score", "Measured"), ((titled(d.name), score(d.score), d.measurement) for d in r.dimensions), "None.") + "".join(f"<p>{k}: {escape('; '.join(v) or 'none')}</p>" for k, v in (("Blockers", r.blockers), ("Warnings", r.warnings), ("Strengths", r.strengths))),
        "Missing data": _table(("Column", "Missing", "Missing %"), ((c.column_name, c.null_count, c.missing_percentage) for c in a.profile.columns if c.null_count), "Nothing is missing."),
        "Statistics": _table(("Column", "Outliers", "Outlier %", "Skew"), ((n.column_name, n.outlier_count, n.outlier_percentage, n.skew) for n in a.analytics.numeric[:MOST_COLUMNS]), "No numeric columns."),
        "Relations": _table(("Left", "Right", "Pearson", "Rows"), ((p.left, p.right, p.coefficient, p.observation_count) for p in a.analytics.correlations[:MOST_CORRELATIONS]), "No correlations.") + "<p>Moving together is no cause.</p>",
        "Columns": _table(("Column", "Type", "Physical type", "Missing", "Distinct", "Numbers"), ((c.column_name, c.effective_type, c.dtype, f"{c.null_count:,} ({c.missing_percentage:.1f}%)", c.distinct_count, _numbers(c)) for c in a.profile.columns[:MOST_COLUMNS]), "No columns.") + _omitted(len(a.profile.columns), MOST_COLUMNS, "columns"),
        "Insights": "<ul>" + ("".join(f"<li><strong>{escape(i.title)}</strong>: {escape(i.message)}</li>" for i in a.insights[:MOST_INSIGHTS]) or "<li>None.</li>") + "</ul>",
        "Recommendations": _table(("Priority", "Recommendation", "Dimension", "Scope", "Detail"), ((x.priority, x.title, titled(x.dimension), x.column_name or "Dataset", x.message) for x in a.recommendations[:MOST_RECOMMENDATIONS]), "None.") + _omitted(len(a.recommendations), MOST_RECOMMENDATIONS, "recommendations"),
        "Method and limits": "<p>All figures are exact and deterministic. Readiness is no forecast of a model, and findings want judging by those who know the data.</p>",
        "Charts": "".join(map(render, charts(a, report_charts(a)))),
    }
    body = "".join(f"<section><h2>{escape(k)}</h2>{v}</section>" for k, v in sections.items())
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Data report</title><style>{STYLE}</style></head><body><h1>Data health and readiness</h1><p>Dataset: {escape(a.source_name)}</p>{body}</body></html>'


def _plain(v: object) -> object:
    if is_dataclass(v) and not isinstance(v, type):
        return _plain(asdict(v))
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, list | tuple | set):
        return [_plain(x) for x in v]
    if isinstance(v, float) and not isfinite(v):
        return None
    return v if v is None or isinstance(v, str | int | float | bool) else str(v)


def to_json(a: Analysis) -> str:
    """All results; never NaN or infinity."""
    parts = {"source": a.source_name, "summary": a.profile.summary, "columns": a.profile.columns, "types": a.profile.types, "executions": a.quality.executions, "run": a.quality.run_reference, "health": a.health, "recommendations": a.recommendations, "analytics": a.analytics, "readiness": a.readiness, "insights": a.insights}
    return json.dumps(_plain(parts), sort_keys=True, allow_nan=False)
