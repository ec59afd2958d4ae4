"""The scoring rules as Spark expressions, for findings of any number (many tables, many runs) as one DataFrame.

findings: run, finding_id, check_id, dimension, target, severity, affected_percentage (null: structural), family, root_cause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.config import ScoreConfig
from tablepulse.operators.assess import ACTIONS, BASE_PENALTY, HEALTH_BANDS, OTHER_ACTION, PRIORITIES, READINESS_BANDS
from tablepulse.operators.quality import SEVERITIES


def lookup(c: Column, values: dict, default: object = None) -> Column:
    out = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[c]
    return out if default is None else F.coalesce(out, F.lit(default))


def banded(score: Column, bands: tuple, lowest: str) -> Column:
    out = F.when(score.isNull(), None)
    for least, name in bands:
        out = out.when(score >= least, name)
    return out.otherwise(lowest)


def penalty_points(findings: DataFrame) -> DataFrame:
    """findings with penalty_group, prevalence, points, applied and linked_to: of one group and target only the dearest counts."""
    share = F.col("affected_percentage") / 100
    prevalence = F.when(share.isNull(), 1.0).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    points = F.least(F.lit(100.0), lookup(F.col("severity"), BASE_PENALTY) * (F.lit(0.25) + F.lit(0.75) * prevalence) * 100)
    priced = findings.select("*", F.coalesce("root_cause", "family").alias("penalty_group"), prevalence.alias("prevalence"), points.alias("points"))
    group = Window.partitionBy("run", "penalty_group", "target").orderBy(F.desc("points"), F.desc("finding_id"))
    return priced.withColumn("first", F.first("finding_id").over(group)).select("*", (F.col("finding_id") == F.col("first")).alias("applied"), F.when(F.col("finding_id") != F.col("first"), F.col("first")).alias("linked_to")).drop("first")


def dimension_scores(penalties: DataFrame, executions: DataFrame, config: ScoreConfig | None = None) -> DataFrame:
    """(run, dimension, checks, score, weight) of each run and dimension; score null where nothing was evaluated."""
    weights = dict((config or ScoreConfig()).weights)
    dimensions = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(w).alias("w")) for d, w in weights.items()))
    every = executions.select("run").distinct().select("run", F.explode(dimensions).alias("x")).select("run", "x.*")
    ran = executions.where("outcome <> 'not_evaluated'").groupBy("run", "dimension").agg(F.count("*").alias("checks"))
    lost = penalties.where("applied").groupBy("run", "dimension").agg(F.sum("points").alias("lost"))
    joined = every.join(ran, ["run", "dimension"], "left").join(lost, ["run", "dimension"], "left")
    evaluated = F.col("checks").isNotNull()
    share = F.when(evaluated, F.col("w") / F.sum(F.when(evaluated, F.col("w"))).over(Window.partitionBy("run")))  # six rows a run
    return joined.select("run", "dimension", F.coalesce("checks", F.lit(0)).alias("checks"), F.when(evaluated, F.greatest(F.lit(0.0), 100 - F.coalesce("lost", F.lit(0.0)))).alias("score"), share.alias("weight"))


def overall_health(scores: DataFrame) -> DataFrame:
    total = scores.groupBy("run").agg(F.sum(F.col("score") * F.col("weight")).alias("overall"))
    return total.withColumn("band", banded(F.col("overall"), HEALTH_BANDS, "critical"))


def recommendations(findings: DataFrame) -> DataFrame:
    """(run, family, target, dimension, priority, action, title, source_findings, recommendation_id) of each group of findings."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    groups = findings.groupBy("run", "family", "target", "dimension").agg(F.max(F.struct(rank.alias("rank"), "severity"))["severity"].alias("worst"), F.sort_array(F.collect_list("finding_id")).alias("ids"))
    part = lambda k: lookup(F.col("family"), {f: a[k] for f, a in ACTIONS.items()}, OTHER_ACTION[k])
    digest = F.concat(F.lit("REC_"), F.substring(F.sha2(F.array_join("ids", "|"), 256), 1, 16))
    return groups.select("run", "family", "target", "dimension", lookup(F.col("worst"), PRIORITIES).alias("priority"), part(0).alias("action"), part(1).alias("title"), F.size("ids").cast("long").alias("source_findings"), digest.alias("recommendation_id"))


def readiness_band(score: Column) -> Column:
    return banded(score, READINESS_BANDS, "not_ready")


def issue_matrix(findings: DataFrame, most: int = 20) -> DataFrame:
    """(column_name, dimension, severity_rank, n): findings of the most columns worst off, for each dimension (0: none)."""
    from tablepulse.operators.quality import DIMENSIONS

    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("long")
    own = findings.where("column_name is not null").withColumn("severity_rank", rank)
    worst = affected_columns(findings, most).select("column_name")
    every = worst.select("column_name", F.explode(F.array(*map(F.lit, DIMENSIONS))).alias("dimension"))
    counted = own.groupBy("column_name", "dimension").agg(F.max("severity_rank").alias("severity_rank"), F.count("*").alias("n"))
    return every.join(counted, ["column_name", "dimension"], "left").na.fill(0, ["severity_rank", "n"])


def affected_columns(findings: DataFrame, most: int = 20) -> DataFrame:
    """(column_name, severity_rank, n): columns by worst severity, number of findings, name."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("long")
    counted = findings.where("column_name is not null").groupBy("column_name").agg(F.max(rank).alias("severity_rank"), F.count("*").alias("n"))
    return counted.orderBy(F.desc("severity_rank"), F.desc("n"), "column_name").limit(most)
