"""The whole analysis of a table, step by step, each result computed once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from tablepulse.config import CheckThresholds, FrameworkConfig, ProfileConfig, ScoreConfig, SemanticConfig
from tablepulse.operators import assess
from tablepulse.operators.frame import Table
from tablepulse.operators.jobs import together
from tablepulse.operators.profile import DatasetProfile, profile_table
from tablepulse.operators.quality import Context, QualityRun, Registry, default_registry, run_checks
from tablepulse.operators.semantic import infer_types


@dataclass(frozen=True)
class Analysis:
    source_name: str
    table: Table
    profile: DatasetProfile
    quality: QualityRun
    health: assess.Health
    recommendations: list[assess.Recommendation]
    analytics: assess.Analytics
    readiness: assess.Readiness
    insights: list[assess.Insight]
    ingestion: object = None

    def with_target(self, name: str | None) -> Analysis:
        """The same with another target: only readiness and insights are made anew."""
        target = assess.analyze_target(self.table, name) if name else None
        readiness = assess.assess_readiness(self.profile, self.analytics, target)
        return replace(self, readiness=readiness, insights=assess.insights(self.quality, readiness, self.analytics))


def analyze_table(
    df: DataFrame | Table,
    source_name: str = "dataset",
    target: str | None = None,
    confirmed: dict[str, str] | None = None,
    semantic: SemanticConfig | None = None,
    profile: ProfileConfig | None = None,
    registry: Registry | None = None,
    framework: FrameworkConfig | None = None,
    thresholds: CheckThresholds | None = None,
    score: ScoreConfig | None = None,
    ingestion: object = None,
) -> Analysis:
    """confirmed: types that the user has chosen, by column name."""
    table = Table.of(df)
    types = infer_types(table, semantic)
    types = [t.confirmed(confirmed[t.column_name]) if confirmed and t.column_name in confirmed else t for t in types]
    facts = profile_table(table, types, profile)
    run, analytics, aim = together(
        table.df.sparkSession,
        lambda: run_checks(Context(table, facts, ingestion), registry if registry is not None else default_registry(thresholds), framework),
        lambda: assess.analyze(table, facts),
        lambda: assess.analyze_target(table, target) if target else None,
    )
    readiness = assess.assess_readiness(facts, analytics, aim)
    return Analysis(source_name, table, facts, run, assess.score_health(run, score), assess.recommend(run), analytics, readiness, assess.insights(run, readiness, analytics), ingestion)
