"""Chart data: a table of specifications, each a SELECT over result frames that gives marks.

A mark has a label, a value (null: not evaluated), a detail, a group and coordinates. Frames of results have a row for each
column, finding, dimension or action; those over the table's own rows are bounded by the operators that make them. No chart
holds a record as it stands in the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepulse.operators import numeric, samples
from tablepulse.operators.quality import DIMENSIONS, SEVERITIES
from tablepulse.plans.analysis import Analysis

#: Bounds of charts.
HEAT_ROWS, HEAT_COLUMNS, SCATTER_POINTS, CATEGORIES, ISSUE_COLUMNS, ACTION_LINKS, TOP_CORRELATIONS, OVERVIEW_COLUMNS = 60, 20, 400, 10, 20, 100, 10, 5
KINDS = ("bar", "donut", "radar", "heatmap", "histogram", "box", "scatter", "ring")
MARK = "label string, value double, detail string, grp string, coordinates array<double>"


def titled(name: str) -> str:
    return name.replace("_", " ").title()


def _title(expression: str) -> str:
    return f"initcap(replace({expression}, '_', ' '))"


def _names(values: Iterable[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


#: Result frames: schema, and rows from an analysis.
RESULTS: dict[str, tuple[str, Callable[[Analysis], list[tuple]]]] = {
    "scores": ("what string, score double, band string", lambda a: [("health", a.health.overall, a.health.band), ("readiness", a.readiness.overall, a.readiness.band)]),
    "quality": ("place int, dimension string, score double", lambda a: [(k, d.dimension, d.score) for k, d in enumerate(a.health.dimensions)]),
    "prepared": ("place int, dimension string, score double, measured string", lambda a: [(k, d.name, d.score, d.measurement) for k, d in enumerate(a.readiness.dimensions)]),
    "findings": ("finding_id string, dimension string, severity string, message string, affected double, columns array<string>", lambda a: [(f.finding_id, f.dimension, f.severity, f.message, f.affected_percentage, list(f.target.columns)) for f in a.quality.findings]),
    "actions": (
        "place int, action_id string, priority string, title string, message string, dimension string, column_name string, finding_ids array<string>",
        lambda a: [(k, r.recommendation_id, r.priority, r.title, r.message, r.dimension, r.column_name, list(r.finding_ids)) for k, r in enumerate(a.recommendations)],
    ),
    "columns": ("place int, column_name string, missing double, null_count long, present_count long", lambda a: [(c.position, c.column_name, c.missing_percentage, c.null_count, c.non_null_count) for c in a.profile.columns]),
    "types": ("place int, type string, n long", lambda a: [(k, *x) for k, x in enumerate(a.profile.type_counts)]),
    "pairs": ("left string, right string, r double, n long", lambda a: [(p.left, p.right, p.coefficient, p.observation_count) for p in a.analytics.correlations]),
}

_RANK = f"array_position({_names(SEVERITIES)}, severity)"
#: Columns with findings, the worst first.
_AFFECTED = f"""
each AS (SELECT c AS column_name, dimension, {_RANK} AS rank FROM {{findings}} LATERAL VIEW explode(columns) AS c {{where}}),
affected AS (SELECT column_name, max(rank) AS worst, count(*) AS n, row_number() OVER (ORDER BY max(rank) DESC, count(*) DESC, column_name) AS place FROM each GROUP BY column_name)
"""
_LINKED = "WHERE array_contains((SELECT coalesce(array_distinct(flatten(collect_list(finding_ids))), array()) FROM {actions}), finding_id)"


def _by_dimension(counted: str) -> str:
    """How many rows of counted, which has a column dimension, each dimension has."""
    return f"SELECT {_title('d.name')} AS label, count(x.dimension) AS value FROM (SELECT posexplode({_names(DIMENSIONS)}) AS (place, name)) d LEFT JOIN ({counted}) x ON x.dimension = d.name GROUP BY d.place, d.name ORDER BY d.place"


@dataclass(frozen=True)
class Spec:
    """What to draw: select gives marks (columns that it leaves out are empty), in order."""

    title: str
    kind: str
    select: str
    maximum: float | None = None
    caption: str = ""
    empty: str = "There is nothing to show."
    #: Another kind, if the marks allow it.
    rather: tuple[str, Callable[[list], bool]] | None = None


def _score(what: str) -> str:
    return f"SELECT if(what = 'health', 'Data health', 'Readiness') AS label, score AS value, coalesce({_title('band')}, 'Not Evaluated') AS detail FROM {{scores}} WHERE what = '{what}'"


_QUALITY = f"SELECT {_title('dimension')} AS label, score AS value, if(score IS NULL, 'Not evaluated', '') AS detail FROM {{quality}} ORDER BY place"
_SHARES = "n AS value, format_string('%.1f%%', 100 * n / sum(n) OVER ()) AS detail FROM {top} ORDER BY rank"
_BOXES = "array(lower_whisker, first_quartile, median, third_quartile, upper_whisker) AS coordinates FROM {boxes}"

SPECS = {
    "health": Spec("Data health", "donut", _score("health"), 100),
    "readiness": Spec("Readiness", "donut", _score("readiness"), 100, "How prepared the data are; no forecast of a model."),
    "quality": Spec("Quality by dimension", "bar", _QUALITY, 100),
    "quality_overview": Spec("Quality by dimension", "bar", _QUALITY, 100, rather=("radar", lambda marks: all(m.value is not None for m in marks))),
    "prepared": Spec("Readiness by dimension", "bar", f"SELECT {_title('dimension')} AS label, score AS value, measured AS detail FROM {{prepared}} ORDER BY place", 100, rather=("radar", lambda marks: len(marks) >= 3)),
    "missing_map": Spec(
        "Missing values", "heatmap",
        "SELECT column_name AS label, double(x.missing) AS value, if(x.missing, 'Missing', 'Present') AS detail, concat('Row ', row_number) AS grp FROM {cells} x JOIN {columns} c USING (column_name) ORDER BY row_number, c.missing DESC, place",
        1, f"Up to {HEAT_ROWS} evenly spaced rows and {HEAT_COLUMNS} columns, those that miss most.",
    ),
    "issues": Spec(
        "Findings by column and dimension", "heatmap",
        f"WITH {_AFFECTED.replace('{where}', '')} SELECT {_title('a.name')} AS label, coalesce(max(rank), 0) AS value, if(count(rank) > 0, concat(count(rank), ' findings; ', get({_names(SEVERITIES)}, int(max(rank)) - 1)), 'No finding') AS detail, a.column_name AS grp "
        f"FROM (SELECT * FROM affected LATERAL VIEW posexplode({_names(DIMENSIONS)}) d AS k, name WHERE place <= {ISSUE_COLUMNS}) AS a LEFT JOIN each e ON e.column_name = a.column_name AND e.dimension = a.name GROUP BY a.place, a.column_name, a.k, a.name ORDER BY a.place, a.k",
        4, f"Up to {ISSUE_COLUMNS} columns, those with the worst findings first.",
    ),
    "histogram": Spec("Distribution", "histogram", "SELECT string(bin + 1) AS label, count AS value, array(low, high) AS coordinates FROM {bins} ORDER BY bin", caption="Equal-width bins of finite values.", empty="There are no finite numbers."),
    "categories": Spec("Categories", "bar", f"SELECT label, {_SHARES}", caption=f"The {CATEGORIES} most frequent categories and all others."),
    "classes": Spec("Classes", "bar", f"SELECT if(rank <= {CATEGORIES}, concat('Category ', rank), label) AS label, {_SHARES}", caption=f"The {CATEGORIES} most frequent classes and all others."),
    "present": Spec("Present and missing", "bar", "SELECT label, n AS value, format_string('%.1f%%', share) AS detail FROM (SELECT stack(2, 'Present', present_count, 100 - missing, 'Missing', null_count, missing) AS (label, n, share) FROM {columns} WHERE column_name = :column) ORDER BY label DESC"),
    "box": Spec("Outliers", "box", f"SELECT column_name AS label, outlier_count AS value, format_string('%d outliers (%.1f%%)', outlier_count, outlier_percentage) AS detail, {_BOXES} WHERE lower_whisker IS NOT NULL", empty="There are no finite quartiles."),
    "boxes": Spec("Values by class", "box", f"SELECT class AS label, outlier_count AS value, format_string('n=%d; %d outliers', n, outlier_count) AS detail, {_BOXES} ORDER BY n DESC, class"),
    "points": Spec("Relation", "scatter", "SELECT 'Row' AS label, x AS value, coalesce(concat('Class ', class_number), '') AS grp, array(y) AS coordinates FROM {points} ORDER BY _pos", empty="Two different numeric columns are needed."),
    "column_findings": Spec("Findings of the column", "bar", _by_dimension("SELECT dimension FROM {findings} WHERE array_contains(columns, :column)")),
    "action_dimensions": Spec("Recommendations by dimension", "bar", _by_dimension("SELECT dimension FROM {actions}")),
    "affected": Spec("Affected columns", "bar", f"WITH {_AFFECTED.replace('{where}', _LINKED)} SELECT column_name AS label, n AS value, concat('Worst: ', get({_names(SEVERITIES)}, int(worst) - 1)) AS detail FROM affected WHERE place <= {ISSUE_COLUMNS} ORDER BY place"),
    "actions": Spec("Actions by priority", "bar", f"SELECT concat({_title('priority')}, ' · ', title) AS label, size(array_distinct(finding_ids)) AS value, concat(coalesce(column_name, 'Dataset'), '; ', dimension) AS detail FROM {{actions}} WHERE place < {ISSUE_COLUMNS} ORDER BY place"),
    "correlations": Spec("Strongest correlations", "bar", f"SELECT concat(left, ' / ', right) AS label, abs(r) AS value, format_string('r=%.3f; n=%d', r, n) AS detail FROM {{pairs}} ORDER BY abs(r) DESC, left, right LIMIT {TOP_CORRELATIONS}", 1, "Moving together is no cause."),
    "severities": Spec("Findings by severity", "bar", f"SELECT {_title('s.name')} AS label, count(severity) AS value, s.name AS grp FROM (SELECT posexplode({_names(reversed(SEVERITIES))}) AS (place, name)) s LEFT JOIN {{findings}} ON severity = s.name GROUP BY s.place, s.name ORDER BY s.place"),
    "types": Spec("Semantic types", "ring", f"SELECT {_title('type')} AS label, n AS value FROM {{types}} ORDER BY place"),
    "missing_most": Spec("Columns that miss most", "bar", f"SELECT column_name AS label, missing AS value, concat(format_number(null_count, 0), ' missing') AS detail FROM {{columns}} ORDER BY missing DESC, place LIMIT {OVERVIEW_COLUMNS}", 100),
}


@dataclass(frozen=True)
class Wanted:
    """A chart to be made: a specification, and the columns that it is about."""

    spec: str
    column: str | None = None
    other: str | None = None
    target: str | None = None
    title: str | None = None
    order: tuple[str, ...] = ()


@dataclass(frozen=True)
class Mark:
    label: str
    value: float | None
    detail: str
    grp: str
    coordinates: tuple[float, ...]


@dataclass(frozen=True)
class Chart:
    title: str
    kind: str
    marks: tuple[Mark, ...]
    caption: str
    maximum: float | None
    empty: str


def _own_frame(a: Analysis, w: Wanted) -> dict[str, DataFrame] | None:
    """The frame over the table's rows that a specification reads; None where its columns don't fit."""
    numbers = {c.column_name for c in a.profile.columns if c.kind == "numeric"}
    if w.spec == "missing_map":
        return {"cells": samples.missing_map(a.table, HEAT_ROWS, HEAT_COLUMNS, w.order)}
    if w.spec == "histogram":
        return {"bins": numeric.histogram(a.table, w.column)}
    if w.spec in ("categories", "classes"):
        return {"top": samples.top_and_other(a.table, w.column, CATEGORIES)}
    if w.spec in ("box", "boxes"):
        if w.column not in numbers:
            return None
        return {"boxes": numeric.single_box(a.table, w.column) if w.spec == "box" else numeric.grouped_boxes(a.table, w.column, w.target, CATEGORIES)}
    if w.spec == "points":
        return {"points": samples.scatter(a.table, w.column, w.other, w.target, SCATTER_POINTS, w.order)} if w.column != w.other and {w.column, w.other} <= numbers else None
    return {}


def marks(a: Analysis, w: Wanted) -> DataFrame:
    """(ord, label, value, detail, grp, coordinates) of one chart."""
    spark, own = a.table.df.sparkSession, _own_frame(a, w)
    if own is None:
        return spark.createDataFrame([], "ord long, " + MARK)
    select = SPECS[w.spec].select
    frames = own | {name: spark.createDataFrame(rows(a), schema) for name, (schema, rows) in RESULTS.items() if f"{{{name}}}" in select}
    found = spark.sql(select, args={"column": w.column} if ":column" in select else None, **frames)
    kinds = dict(part.split(" ") for part in MARK.split(", "))
    absent = {"detail": F.lit(""), "grp": F.lit(""), "coordinates": F.array()}
    return found.coalesce(1).select(F.monotonically_increasing_id().alias("ord"), *((F.col(c) if c in found.columns else absent[c]).cast(kind).alias(c) for c, kind in kinds.items()))


def marks_frame(a: Analysis, wanted: list[Wanted]) -> DataFrame:
    """The marks of several charts in one frame, with the chart's number and title."""
    return reduce(DataFrame.unionByName, (marks(a, w).select(F.lit(k).alias("chart"), F.lit(w.title or SPECS[w.spec].title).alias("title"), "*") for k, w in enumerate(wanted)))


def charts(a: Analysis, wanted: list[Wanted]) -> list[Chart]:
    """The charts, whose marks come to the driver in one job."""
    found: dict[int, list] = {k: [] for k in range(len(wanted))}
    for r in sorted(marks_frame(a, wanted).collect(), key=lambda r: (r.chart, r.ord)):
        found[r.chart].append(Mark(r.label, r.value, r.detail, r.grp, tuple(r.coordinates)))
    out = []
    for k, w in enumerate(wanted):
        spec = SPECS[w.spec]
        kind = spec.rather[0] if spec.rather and spec.rather[1](found[k]) else spec.kind
        caption = f"{w.column}: {spec.caption}" if w.column and spec.caption else spec.caption
        if w.spec == "points" and not w.target:
            caption = next((f"Pearson r = {p.coefficient:.3f}, n = {p.observation_count}." for p in a.analytics.correlations if {p.left, p.right} == {w.column, w.other}), "")
        out.append(Chart(w.title or spec.title, kind, tuple(found[k]), caption, spec.maximum, spec.empty))
    return out


def report_charts(a: Analysis) -> list[Wanted]:
    """What a report shows."""
    out = [Wanted(x) for x in ("health", "quality", "missing_map", "issues", "readiness", "prepared")]
    out += [Wanted("histogram", c.column_name, title="First numeric column") for c in a.profile.columns if c.kind == "numeric"][:1]
    out += [Wanted("correlations")] * bool(a.analytics.correlations)
    if t := a.readiness.target:
        out.append(Wanted("histogram" if t.kind == "regression_candidate" else "classes", t.target, title="Target"))
    return out + [Wanted("action_dimensions"), Wanted("actions")]


def overview() -> list[Wanted]:
    """What a first look shows."""
    return [Wanted(x) for x in ("quality_overview", "severities", "types", "missing_most")]


def action_links(a: Analysis, most: int = ACTION_LINKS) -> tuple[DataFrame, int]:
    """(the first pairs of finding and action, how many there are)."""
    spark = a.table.df.sparkSession
    frames = {name: spark.createDataFrame(RESULTS[name][1](a), RESULTS[name][0]) for name in ("actions", "findings")}
    pairs = spark.sql(
        "SELECT r.place, k, r.priority, r.message AS action, coalesce(f.message, 'The finding is not available') AS issue, coalesce(nullif(array_join(f.columns, ', '), ''), 'Dataset') AS scope, id AS finding_id, r.action_id AS recommendation_id, f.affected AS affected_percentage "
        "FROM (SELECT * FROM {actions} LATERAL VIEW posexplode(finding_ids) AS k, id) r LEFT JOIN {findings} f ON f.finding_id = r.id",
        **frames,
    )
    return pairs.orderBy("place", "k").limit(most).drop("place", "k"), sum(len(r.finding_ids) for r in a.recommendations)
