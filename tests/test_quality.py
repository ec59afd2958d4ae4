import json
import math

import pytest

from tablepulse.config import CheckThresholds, FrameworkConfig, ScoreConfig
from tablepulse.functions.svg import document, render
from tablepulse.operators import assess, charts
from tablepulse.operators import quality as Q
from tablepulse.operators.profile import ProfileError, profile_table
from tablepulse.operators.semantic import infer_types
from tablepulse.plans.analysis import analyze_table
from tablepulse.plans.report import html_report, report_filename, to_json


@pytest.fixture(scope="module")
def chain(spark):
    return analyze_table(spark.createDataFrame([("secret-id", 1.0, " A ", 1), ("secret-id", math.inf, "a", 1), (None, 2.0, "B", 1)], "id string, value double, category string, constant bigint"))


def test_worked_examples(spark):
    clean = spark.createDataFrame([(f"4f2f1c9e-8a37-4b0e-9a35-0d7f2c1d1a0{i}", 30 + i % 2, "ab"[i % 2], f"2024-01-0{i + 1}") for i in range(3)], "customer_id string, age bigint, segment string, signup_date string")
    a = analyze_table(clean)
    assert not a.quality.findings and a.health.overall == pytest.approx(100) and a.health.band == "excellent" and a.readiness.overall == 86.045 and a.readiness.band == "ready"
    u = "4f2f1c9e-8a37-4b0e-9a35-0d7f2c1d1a0"
    bad = spark.createDataFrame([(u + "1", 31.0, "Consumer", None), (u + "1", None, " consumer", None), (u + "3", math.inf, "CONSUMER", None)], "customer_id string, age double, segment string, legacy_code string")
    b = analyze_table(bad)
    assert b.health.overall == pytest.approx(70.375) and b.health.band == "needs_attention" and b.readiness.overall == 61.878 and b.readiness.blockers == ("feature_usability",)
    assert sorted((f.check_id.split("_", 2)[2], f.severity) for f in b.quality.findings) == [("COLUMN_MISSINGNESS", "high"), ("DATASET_MISSINGNESS", "high"), ("EMPTY_COLUMN", "high"), ("IDENTIFIER_VALUES", "high"), ("NONFINITE_NUMERIC", "high")]


def test_privacy_and_repetition(chain, spark):
    text = to_json(chain) + html_report(chain)
    assert "secret-id" not in json.dumps([r.__dict__ for r in chain.recommendations]) and "secret-id" not in "".join(f.message for f in chain.quality.findings)
    assert 0 <= chain.health.overall <= 100 and "NaN" not in to_json(chain) and "<script" not in text
    again = analyze_table(chain.table.df.repartition(5).toDF("id", "value", "category", "constant"))
    assert [f.finding_id for f in again.quality.findings] == [f.finding_id for f in chain.quality.findings] and again.health.overall == chain.health.overall


def test_one_penalty_for_one_cause(spark):
    rows = [(None,)] + [("4f2f1c9e-8a37-4b0e-9a35-%012d" % i,) for i in range(19)]
    a = analyze_table(spark.createDataFrame(rows, "identifier string"))
    penalties = [p for d in a.health.dimensions for p in d.penalties if p.group == "identifier_missingness"]
    assert len(penalties) == 2 and sum(p.applied for p in penalties) == 1 and {p.linked_to for p in penalties if not p.applied} == {p.finding.finding_id for p in penalties if p.applied}


def test_policies(spark):
    a = analyze_table(spark.createDataFrame([(1.0, None), (math.inf, None), (3.0, None)], "number double, empty string"))
    assert {(f.family, f.target.column_name) for f in a.quality.findings} >= {("nonfinite_numeric", "number"), ("empty_column", "empty")}
    assert not any(f.family == "completeness_missingness" and f.target.column_name == "empty" for f in a.quality.findings)
    for rows, schema in (([(None,), (None,)], "x string"), ([("a",), ("b",)], "id string"), ([(1,)], "x bigint")):
        assert not any(f.family == "constant_column" for f in analyze_table(spark.createDataFrame(rows, schema)).quality.findings)
    high = analyze_table(spark.createDataFrame([(f"v{i % 18}",) for i in range(20)], "segment string"), confirmed={"segment": "categorical"})
    assert [f.family for f in high.quality.findings if f.target.column_name] == ["high_cardinality"]


def test_penalties_grow():
    table = [[assess.penalty(s, p) for p in (0, 0.1, 0.5, 1)] for s in Q.SEVERITIES]
    assert all(a < b for row in table for a, b in zip(row, row[1:], strict=False)) and all(a < b for r, s in zip(table, table[1:], strict=False) for a, b in zip(r, s, strict=True))
    assert assess.penalty("medium", None) == 40 and CheckThresholds().severity(5) == "low" and CheckThresholds().severity(40.1) == "critical" and CheckThresholds().severity(0) is None


class Own:
    def __init__(self, check_id="X_OWN", scope="column", error=None, drafts=(), **more):
        self.definition = Q.Definition(check_id, "own", "validity", scope, "own", **more)
        self.error, self.drafts = error, drafts

    def configure(self, parameters):
        if parameters.get("bad"):
            raise ValueError("bad parameter")

    def targets(self, context):
        return context.targets(self.definition.scope)

    def applies(self, context, target):
        return "TOO_SHORT" if target.column_name == "category" else None

    def evaluate(self, context, target, parameters):
        if self.error:
            raise self.error
        return self.drafts


def test_runner_states(chain):
    context = Q.Context(chain.table, chain.profile)
    for error, status, code in ((Q.PrerequisiteMissing(), "skipped", "MISSING_PREREQUISITE"), (Q.ResourceExceeded(), "skipped", "RESOURCE_LIMIT"), (Q.DataUnsupported(), "not_applicable", "DATA_UNSUPPORTED"), (RuntimeError("secret"), "error", "CHECK_ERROR")):
        run = Q.run_checks(context, Q.Registry([Own(error=error)]))
        assert {(e.status, e.code) for e in run.executions if e.target.column_name != "category"} == {(status, code)} and "secret" not in str(run)
    with pytest.raises(RuntimeError):
        Q.run_checks(context, Q.Registry([Own(error=RuntimeError())]), FrameworkConfig(fail_fast=True))
    draft = Q.Draft("low", "m", "k", 1, "own", Q.Population(1, 3, "total_rows"))
    run = Q.run_checks(context, Q.Registry([Own(drafts=[draft]), Own("A_OFF", default_enabled=False), Own("B_PRE", prerequisites=("ingestion_metadata",)), Own("C_SET", "dataset")]))
    assert run.summary["total"] == {"total": 7, "executed": 4, "passed": 1, "failed": 3, "skipped": 2, "not_applicable": 1, "errors": 0, "finding_count": 3}
    assert [e.check_id for e in run.executions] == ["A_OFF", "B_PRE", "C_SET"] + ["X_OWN"] * 4
    assert Q.run_checks(context, Q.Registry([Own()]), FrameworkConfig(disabled=("X_OWN",))).executions[0].code == "CHECK_DISABLED"
    assert Q.run_checks(context, Q.Registry([Own()]), FrameworkConfig(dimensions=("integrity",))).executions[0].code == "DIMENSION_FILTERED"
    for config, error in ((FrameworkConfig(enabled=("NO",)), Q.ConfigurationError), (FrameworkConfig(parameters={"X_OWN": {"bad": 1}}), Q.ConfigurationError), (FrameworkConfig(most_targets=1), Q.BudgetError), (FrameworkConfig(most_executions=2), Q.BudgetError)):
        with pytest.raises(error):
            Q.run_checks(context, Q.Registry([Own()]), config)
    for bad in (lambda: Q.Registry([Own(), Own()]), lambda: Q.Registry([]).get("x"), lambda: FrameworkConfig(enabled=("a",), disabled=("a",)), lambda: FrameworkConfig(enabled=("a", "a")), lambda: Q.Target("column"), lambda: Q.Population(2, 1, "total_rows"), lambda: Q.Draft("informational", "", "", 0, ""), lambda: ScoreConfig((("validity", 0.5),))):
        with pytest.raises(ValueError):
            bad()
    assert len(Q.default_registry()) == 11 and Q.default_registry().fingerprint == Q.default_registry().fingerprint


def test_facts_of_another_table_are_refused(chain, spark):
    other = spark.createDataFrame([("x", 1.0, "b", 2)], "id string, value double, category string, constants bigint")
    from tablepulse.operators.frame import Table

    with pytest.raises(Q.ContextError) as caught:
        Q.run_checks(Q.Context(Table.of(other), chain.profile))
    assert caught.value.code == "QUALITY_CONTEXT_COLUMN_MISMATCH"
    with pytest.raises(ProfileError):
        profile_table(other, infer_types(chain.table))


def test_analytics_targets_and_insights(spark):
    df = spark.createDataFrame([(f"k{i}", float(x), 2.0 * x, "ab"[i % 2]) for i, x in enumerate([1, 2, 3, 100])], "id string, x double, y double, segment string")
    a = analyze_table(df, target="segment")
    assert a.analytics.numeric[0].outlier_count == 1 and a.analytics.correlations[0].coefficient > 0.99 and {"outliers", "correlation"} <= {i.family for i in a.insights}
    assert a.with_target("x").readiness.target.identifier_like and a.with_target(None).readiness.target is None
    constant = analyze_table(df.selectExpr("1 AS c", "x"), target="c")
    assert "the target is constant" in constant.readiness.blockers and not constant.analytics.correlations
    with pytest.raises(ValueError):
        a.with_target("nowhere")
    assert assess.band(None, assess.HEALTH_BANDS, "critical") is None and assess.band(39, assess.HEALTH_BANDS, "critical") == "critical"


def test_charts_and_report(spark):
    df = spark.createDataFrame([(None if i % 8 == 0 else float(i), float(i % 5), "AB"[i % 2], "<b>&" if i % 3 else "East", None, 7) for i in range(80)], "measure double, outcome double, class string, region string, empty string, constant bigint").withColumnRenamed("measure", "measure <&>")
    a = analyze_table(df, "up/../load<.csv", target="class")
    W, x = charts.Wanted, "measure <&>"
    more = [W("box", x), W("boxes", x, target="class"), W("points", x, "outcome"), W("points", x, "outcome", target="class"), W("points", "outcome", "outcome"), W("categories", "region"), W("present", "empty"), W("column_findings", "empty"), W("affected"), W("missing_map"), W("box", "region")]
    wanted = charts.report_charts(a) + charts.overview() + more
    every = charts.charts(a, wanted)
    assert {c.kind for c in every} == set(charts.KINDS)
    for c in every:
        svg = render(c)
        assert "<&>" not in svg and "<b>" not in svg and document(c, True).startswith("<!doctype")
    of = {w.spec: c for w, c in zip(wanted, every, strict=True)}
    said = lambda name: [(m.label, m.value, m.detail, m.grp) for m in of[name].marks]
    assert sum(m.value for m in of["histogram"].marks) == 70 and len(of["missing_map"].marks) == 60 * 6
    assert said("classes") == [("Category 1", 40.0, "50.0%", ""), ("Category 2", 40.0, "50.0%", "")] and said("present") == [("Present", 0.0, "0.0%", ""), ("Missing", 80.0, "100.0%", "")]
    assert said("types") == [(charts.titled(t), float(n), "", "") for t, n in a.profile.type_counts] and said("missing_most")[:3] == [("empty", 100.0, "80 missing", ""), ("measure <&>", 12.5, "10 missing", ""), ("outcome", 0.0, "0 missing", "")]
    found = [(c, charts.SEVERITIES.index(f.severity) + 1, f.dimension) for f in a.quality.findings for c in f.target.columns]
    columns = sorted({c for c, *_ in found}, key=lambda c: (-max(r for d, r, _ in found if d == c), -sum(d == c for d, *_ in found), c))
    assert [(m.grp, m.label, m.value) for m in of["issues"].marks] == [(c, charts.titled(d), float(max((r for x, r, y in found if (x, y) == (c, d)), default=0))) for c in columns for d in charts.DIMENSIONS]
    assert [m.label for m in of["affected"].marks] == [c for c in columns if any(set(r.finding_ids) & {f.finding_id for f in a.quality.findings if c in f.target.columns} for r in a.recommendations)]
    assert [m.value for m in of["column_findings"].marks] == [float(sum(x == "empty" and y == d for x, _, y in found)) for d in charts.DIMENSIONS]
    assert [m.value for m in of["severities"].marks] == [float(sum(f.severity == s for f in a.quality.findings)) for s in reversed(charts.SEVERITIES)]
    assert not of["points"].marks and not of["box"].marks  # the last of each: columns that don't fit
    links, n = charts.action_links(a)
    assert n == sum(len(r.finding_ids) for r in a.recommendations) == links.count()
    report = html_report(a)
    assert report.count("<section>") == 12 and "<b>" not in report and "measure &lt;&amp;&gt;" in report
    assert report_filename("../x y/é<.csv") == "tablepulse_report_dataset.html" and report_filename("a b.csv") == "tablepulse_report_a_b.html"
    assert charts.marks_frame(a, wanted).count() == sum(len(c.marks) for c in every)
