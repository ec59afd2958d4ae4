"""The quality framework: checks, their registry and the runner, and the eleven checks that come with it.

Checks judge facts that are computed once; only the category check counts anything of its own. A check that a user adds gets
the table too and may run any Spark job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame

from tablepulse.config import CheckThresholds, FrameworkConfig, fingerprint
from tablepulse.operators import categorical
from tablepulse.operators.frame import Table
from tablepulse.operators.profile import ColumnProfile, DatasetProfile

VERSION = "1.0.0"
#: Dimensions and severities in their order.
DIMENSIONS = ("completeness", "uniqueness", "validity", "consistency", "integrity", "analytical_readiness")
SEVERITIES = ("low", "medium", "high", "critical")
SCOPES = ("dataset", "column", "multi_column")
BASES = ("total_rows", "non_null_rows", "total_cells", "distinct_values", "applicable_values", "custom")


class RegistryError(ValueError):
    pass


class ConfigurationError(ValueError):
    pass


class BudgetError(ValueError):
    pass


class ContextError(ValueError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class PrerequisiteMissing(Exception):
    """Raised by a check that can't run here: skipped."""


class ResourceExceeded(Exception):
    """Raised by a check that would need more than its budget: skipped."""


class DataUnsupported(Exception):
    """Raised by a check that these data are nothing for: not applicable."""


@dataclass(frozen=True)
class Definition:
    check_id: str
    name: str
    dimension: str
    scope: str
    description: str
    types: tuple[str, ...] = ()
    version: str = VERSION
    default_enabled: bool = True
    prerequisites: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.dimension not in DIMENSIONS or self.scope not in SCOPES:
            raise ConfigurationError("unknown dimension or scope")


@dataclass(frozen=True)
class Target:
    scope: str
    position: int | None = None
    column_name: str | None = None
    positions: tuple[int, ...] = ()
    column_names: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        shapes = {"dataset": self.position is None and not self.positions, "column": self.position is not None and not self.positions, "multi_column": self.position is None and len(self.positions) > 1}
        if not shapes.get(self.scope, False):
            raise ConfigurationError("the target doesn't fit its scope")

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column_name,) if self.column_name is not None else self.column_names

    @property
    def order(self) -> tuple:
        return SCOPES.index(self.scope), self.position if self.position is not None else -1, self.positions


@dataclass(frozen=True)
class Population:
    affected: int
    total: int
    basis: str
    description: str | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.affected <= self.total or self.basis not in BASES or (self.basis == "custom") != (self.description is not None):
            raise ValueError("the affected population is inconsistent")

    @property
    def percentage(self) -> float | None:
        return self.affected * 100 / self.total if self.total else None


@dataclass(frozen=True)
class Draft:
    """What a check says of a target."""

    severity: str
    message: str
    metric: str
    observed: float
    family: str
    population: Population | None = None
    root_cause: str | None = None

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError("a finding's severity is low, medium, high or critical")


@dataclass(frozen=True)
class Finding:
    finding_id: str
    check_id: str
    dimension: str
    target: Target
    draft: Draft

    severity = property(lambda self: self.draft.severity)
    message = property(lambda self: self.draft.message)
    family = property(lambda self: self.draft.family)

    @property
    def affected_percentage(self) -> float | None:
        return self.draft.population.percentage if self.draft.population else None


@dataclass(frozen=True)
class Execution:
    check_id: str
    dimension: str
    scope: str
    target: Target | None
    status: str  # executed, skipped, not_applicable, error
    outcome: str  # pass, fail, not_evaluated
    code: str | None = None
    message: str | None = None
    findings: tuple[Finding, ...] = ()

    def __post_init__(self) -> None:
        if (self.outcome == "fail") != bool(self.findings) or (self.status == "executed") == (self.outcome == "not_evaluated"):
            raise ValueError("status, outcome and findings don't fit")


@dataclass(frozen=True)
class Context:
    table: Table
    profile: DatasetProfile
    ingestion: Any = None
    _cache: dict = field(default_factory=dict, compare=False)

    def targets(self, scope: str) -> list[Target]:
        if scope == "dataset":
            return [Target("dataset")]
        return [Target("column", c.position, c.column_name) for c in self.profile.columns]

    def column(self, target: Target) -> ColumnProfile:
        return self.profile.columns[target.position]

    @property
    def collisions(self) -> dict[int, Any]:
        """Collisions of all categorical columns, counted once for all."""
        if "collisions" not in self._cache:
            by_position = Table(self.table.df, tuple(f"_c{i}" for i in range(len(self.table))))
            names = [f"_c{c.position}" for c in self.profile.columns if c.effective_type == "categorical"]
            self._cache["collisions"] = {int(r.column_name[2:]): r for r in categorical.collisions(by_position, *names).collect()}
        return self._cache["collisions"]

    def validate(self) -> None:
        """Facts of another table are refused."""
        p, n = self.profile, len(self.table)
        if len(p.columns) != n or len(p.types) != n:
            raise ContextError("QUALITY_CONTEXT_SHAPE_MISMATCH", "the profile has another number of columns")
        for i, (c, t) in enumerate(zip(p.columns, p.types, strict=True)):
            if c.column_name != self.table.names[i] or t.column_name != self.table.names[i] or c.dtype != self.table.dtype(i):
                raise ContextError("QUALITY_CONTEXT_COLUMN_MISMATCH", f"column {i} is another one")
            if (c.null_count, c.distinct_count, c.row_count) != (t.null_count, t.distinct_count, t.row_count):
                raise ContextError("QUALITY_CONTEXT_COUNT_MISMATCH", f"column {i} has other counts in profile and types")
        if sum(c.null_count for c in p.columns) != p.summary["missing_cell_count"]:
            raise ContextError("QUALITY_CONTEXT_COUNT_MISMATCH", "missing cells don't add up")


class Check(Protocol):
    """What a check must offer; any object with these can be registered."""

    definition: Definition

    def configure(self, parameters: dict) -> None: ...

    def targets(self, context: Context) -> Iterable[Target]: ...

    def applies(self, context: Context, target: Target) -> str | None: ...

    def evaluate(self, context: Context, target: Target, parameters: dict) -> Iterable[Draft]: ...


@dataclass(frozen=True)
class FactCheck:
    """A check whose verdict is a function of context, target and thresholds."""

    definition: Definition
    judge: Callable[[Context, Target, CheckThresholds], Draft | None]
    thresholds: CheckThresholds = CheckThresholds()

    def configure(self, parameters: dict) -> None:
        return None

    def targets(self, context: Context) -> Iterable[Target]:
        return context.targets(self.definition.scope)

    def applies(self, context: Context, target: Target) -> str | None:
        """None, or the code of the reason why not."""
        if target.scope == "column" and self.definition.types and context.column(target).effective_type not in self.definition.types:
            return "UNSUPPORTED_SEMANTIC_TYPE"
        return None

    def evaluate(self, context: Context, target: Target, parameters: dict) -> Iterable[Draft]:
        draft = self.judge(context, target, self.thresholds)
        return [draft] if draft else []


def _share(thresholds: CheckThresholds, part: int, whole: int) -> str | None:
    return thresholds.severity(part * 100 / whole if whole else 0.0) if part else None


def missing_cells(context: Context, target: Target, t: CheckThresholds) -> Draft | None:
    part, whole = context.profile.summary["missing_cell_count"], context.profile.summary["cell_count"]
    severity = _share(t, part, whole)
    return severity and Draft(severity, f"{part * 100 / whole:.2f}% of all cells are missing.", "missing_cell_count", part, "completeness_missingness", Population(part, whole, "total_cells"))


def missing_values(context: Context, target: Target, t: CheckThresholds) -> Draft | None:
    """A wholly missing column is left to the check for empty ones."""
    c = context.column(target)
    severity = None if c.null_count == c.row_count else _share(t, c.null_count, c.row_count)
    root = "identifier_missingness" if c.effective_type == "identifier" else None
    return severity and Draft(severity, f"{c.missing_percentage:.2f}% of the column's values are missing.", "missing_row_count", c.null_count, "completeness_missingness", Population(c.null_count, c.row_count, "total_rows"), root)


def empty_column(context: Context, target: Target, t: CheckThresholds) -> Draft | None:
    c = context.column(target)
    return None if c.non_null_count else Draft("high", "The column holds no values.", "observed_value_count", 0, "empty_column", Population(c.row_count, c.row_count, "total_rows"))


def repeated_rows(context: Context, target: Target, t: CheckThresholds) -> Draft | None:
    if context.profile.summary["duplicate_row_count"] is None:
        raise DataUnsupported("rows with nested values can't be compared")
    part, whole = context.profile.summary["duplicate_row_count"], context.profile.summary["row_count"]
    return Draft(_share(t, part, whole) or "low", f"{part} row(s) repeat an earlier one.", "duplicate_row_count", part, "duplicate_rows", Population(part, whole, "total_rows")) if part else None


def repeated_identifiers(context: Context, target: Target, t: CheckThresholds) -> Draft | None:
    c = context.column(target)
    part = c.non_null_count - (c.distinct_count or 0)
    return Draft(_share(t, part, c.non_null_count) or "low", "Identifiers repeat.", "duplicate_identifier_count", part, "identifier_uniqueness", Population(part, c.non_null_count, "non_null_rows")) if part else None


def infinite_numbers(context: Context, target: Target, t: CheckThresholds) -> Draft | None:
    c = context.column(target)
    part = c.statistics.get("positive_infinity_count", 0) + c.statistics.get("negative_infinity_count", 0)
    return Draft(_share(t, part, c.row_count) or "low", "The column holds infinite numbers.", "nonfinite_numeric_count", part, "nonfinite_numeric", Population(part, c.row_count, "custom", "numeric cells")) if part else None


def padded_names(context: Context, target: Target, t: CheckThresholds) -> Draft | None:
    names = context.table.names
    part = sum(n != n.strip() for n in names)
    return Draft("medium", f"{part} column name(s) begin or end with white space.", "whitespace_column_count", part, "column_label_consistency", Population(part, len(names), "custom", "column labels")) if part else None


def colliding_categories(context: Context, target: Target, t: CheckThresholds) -> Draft | None:
    r = context.collisions[target.position]
    return Draft("low", "Categories differ only in case or outer white space.", "affected_category_row_count", r.affected_rows, "category_consistency", Population(r.affected_rows, r.non_null_count, "non_null_rows")) if r.collision_groups else None


def missing_identifiers(context: Context, target: Target, t: CheckThresholds) -> Draft | None:
    c = context.column(target)
    return Draft(_share(t, c.null_count, c.row_count) or "low", "Identifiers are missing.", "missing_identifier_count", c.null_count, "identifier_missingness", Population(c.null_count, c.row_count, "total_rows"), "identifier_missingness") if c.null_count else None


def constant_column(context: Context, target: Target, t: CheckThresholds) -> Draft | None:
    c = context.column(target)
    flat = c.row_count > 1 and c.non_null_count and c.effective_type != "identifier" and (c.non_null_count == 1 or (c.distinct_count is not None and c.distinct_count <= 1))
    return Draft("medium", "The column has one value only.", "distinct_value_count", c.distinct_count or 0, "constant_column") if flat else None


def high_cardinality(context: Context, target: Target, t: CheckThresholds) -> Draft | None:
    c = context.column(target)
    if c.effective_type == "identifier" or c.non_null_count < t.cardinality_values or c.distinct_count is None:
        return None
    ratio = c.distinct_count / c.non_null_count
    return Draft("medium", "Nearly every value is a category of its own.", "cardinality_ratio", ratio, "high_cardinality") if ratio >= t.cardinality_ratio else None


def uncertain_type(context: Context, target: Target, t: CheckThresholds) -> Draft | None:
    return Draft("low", "What the column means is uncertain.", "semantic_confidence_low", 1, "semantic_readiness") if context.column(target).effective_type == "unknown" else None


NUMBERS = ("numeric_continuous", "numeric_discrete")
#: The checks' names, dimensions, scopes and types.
CATALOGUE = (
    ("DQ_COMPLETENESS_DATASET_MISSINGNESS", "Missing cells", "completeness", "dataset", (), missing_cells),
    ("DQ_COMPLETENESS_COLUMN_MISSINGNESS", "Missing values", "completeness", "column", (), missing_values),
    ("DQ_COMPLETENESS_EMPTY_COLUMN", "Empty column", "completeness", "column", (), empty_column),
    ("DQ_UNIQUENESS_DUPLICATE_ROWS", "Duplicate rows", "uniqueness", "dataset", (), repeated_rows),
    ("DQ_UNIQUENESS_IDENTIFIER_VALUES", "Repeated identifiers", "uniqueness", "column", ("identifier",), repeated_identifiers),
    ("DQ_VALIDITY_NONFINITE_NUMERIC", "Infinite numbers", "validity", "column", NUMBERS, infinite_numbers),
    ("DQ_CONSISTENCY_COLUMN_NAME_WHITESPACE", "Padded column names", "consistency", "dataset", (), padded_names),
    ("DQ_CONSISTENCY_CATEGORY_NORMALIZATION", "Colliding categories", "consistency", "column", ("categorical",), colliding_categories),
    ("DQ_INTEGRITY_IDENTIFIER_MISSINGNESS", "Missing identifiers", "integrity", "column", ("identifier",), missing_identifiers),
    ("DQ_READINESS_CONSTANT_COLUMN", "Constant column", "analytical_readiness", "column", (), constant_column),
    ("DQ_READINESS_HIGH_CARDINALITY", "High cardinality", "analytical_readiness", "column", ("categorical",), high_cardinality),
)


class Registry:
    """Checks by id; the definitions are taken at registration."""

    def __init__(self, checks: Iterable[Check] = ()) -> None:
        self._checks: dict[str, tuple[Definition, Check]] = {}
        for check in checks:
            if check.definition.check_id in self._checks:
                raise RegistryError(f"{check.definition.check_id} is registered twice")
            self._checks[check.definition.check_id] = (check.definition, check)
        self._checks = dict(sorted(self._checks.items()))

    def __len__(self) -> int:
        return len(self._checks)

    def __iter__(self):
        return iter(self._checks.values())

    def definitions(self, dimension: str | None = None, scope: str | None = None) -> list[Definition]:
        return [d for d, _ in self if dimension in (None, d.dimension) and scope in (None, d.scope)]

    def get(self, check_id: str) -> Check:
        if check_id not in self._checks:
            raise RegistryError(f"{check_id} is not registered")
        return self._checks[check_id][1]

    @property
    def fingerprint(self) -> str:
        return fingerprint([asdict(d) for d, _ in self])


def default_registry(thresholds: CheckThresholds | None = None) -> Registry:
    thresholds = thresholds or CheckThresholds()
    return Registry(FactCheck(Definition(i, name, dimension, scope, judge.__doc__ or name, types, tags=("production",)), judge, thresholds) for i, name, dimension, scope, types, judge in CATALOGUE)


@dataclass(frozen=True)
class QualityRun:
    run_reference: str
    executions: tuple[Execution, ...]

    @property
    def findings(self) -> list[Finding]:
        return [f for e in self.executions for f in e.findings]

    def counts(self, dimension: str | None = None) -> dict[str, int]:
        some = [e for e in self.executions if dimension in (None, e.dimension)]
        status = lambda s: sum(e.status == s for e in some)
        outcome = lambda o: sum(e.outcome == o for e in some)
        return {
            "total": len(some), "executed": status("executed"), "passed": outcome("pass"), "failed": outcome("fail"), "skipped": status("skipped"), "not_applicable": status("not_applicable"),
            "errors": status("error"), "finding_count": sum(len(e.findings) for e in some),
        }

    @property
    def summary(self) -> dict[str, dict[str, int]]:
        return {"total": self.counts()} | {d: self.counts(d) for d in DIMENSIONS}


def run_checks(context: Context, registry: Registry | None = None, config: FrameworkConfig | None = None) -> QualityRun:
    """Every check on each of its targets, in the order of ids and positions."""
    registry, config = registry if registry is not None else default_registry(), config or FrameworkConfig()
    context.validate()
    known = {d.check_id for d in registry.definitions()}
    if strange := (set(config.enabled) | set(config.disabled) | set(config.parameters)) - known:
        raise ConfigurationError(f"unknown checks: {', '.join(sorted(strange))}")
    if len(registry) > config.most_checks:
        raise BudgetError("too many checks are registered")
    reference = fingerprint([registry.fingerprint, config.fingerprint, [asdict(t) for t in context.profile.types], context.profile.summary])
    out: list[Execution] = []
    for definition, check in registry:
        enabled, code = _enabled(definition, config)
        parameters = config.parameters.get(definition.check_id, {})

        def note(status: str, code: str, message: str, target: Target | None = None, d: Definition = definition) -> Execution:
            return Execution(d.check_id, d.dimension, d.scope, target, status, "not_evaluated", code, message)

        if not enabled:
            out.append(note("skipped", code, "The check is not enabled."))
            continue
        try:
            check.configure(parameters)
        except Exception as error:
            raise ConfigurationError(f"{definition.check_id}: {error}") from error
        if "ingestion_metadata" in definition.prerequisites and context.ingestion is None:
            out.append(note("skipped", "MISSING_PREREQUISITE", "The source's metadata are needed."))
            continue
        targets = _validated(definition, list(check.targets(context)), context)
        if len(targets) > config.most_targets or len(out) + len(targets) > config.most_executions:
            raise BudgetError(f"{definition.check_id} has too many targets")
        for target in targets:
            if reason := check.applies(context, target):
                out.append(note("not_applicable", reason, "The check is nothing for this column.", target))
                continue
            try:
                drafts = list(check.evaluate(context, target, parameters))
            except (PrerequisiteMissing, ResourceExceeded) as error:
                out.append(note("skipped", "MISSING_PREREQUISITE" if isinstance(error, PrerequisiteMissing) else "RESOURCE_LIMIT", "The check could not run here.", target))
                continue
            except DataUnsupported:
                out.append(note("not_applicable", "DATA_UNSUPPORTED", "The check is nothing for these data.", target))
                continue
            except (RegistryError, ConfigurationError, BudgetError, ContextError):
                raise
            except Exception:
                if config.fail_fast:
                    raise
                out.append(note("error", "CHECK_ERROR", "The check failed; no details of the data are told.", target))
                continue
            found = tuple(Finding(fingerprint([reference, definition.check_id, definition.version, asdict(target), asdict(d), parameters, k]), definition.check_id, definition.dimension, target, d) for k, d in enumerate(drafts))
            out.append(Execution(definition.check_id, definition.dimension, definition.scope, target, "executed", "fail" if found else "pass", findings=found))
    return QualityRun(reference, tuple(out))


def _enabled(definition: Definition, config: FrameworkConfig) -> tuple[bool, str]:
    if definition.check_id in config.disabled:
        return False, "CHECK_DISABLED"
    if config.dimensions and definition.dimension not in config.dimensions:
        return False, "DIMENSION_FILTERED"
    return definition.check_id in config.enabled or definition.default_enabled, "CHECK_DISABLED"


def _validated(definition: Definition, targets: list[Target], context: Context) -> list[Target]:
    for t in targets:
        places = t.positions or ((t.position,) if t.position is not None else ())
        if t.scope != definition.scope or any(not 0 <= p < len(context.table) for p in places):
            raise ConfigurationError(f"{definition.check_id} has a target out of scope")
        if t.position is not None and t.column_name != context.table.names[t.position]:
            raise ConfigurationError(f"{definition.check_id} has a target of another name")
    if len(set(targets)) != len(targets):
        raise ConfigurationError(f"{definition.check_id} has a target twice")
    return sorted(targets, key=lambda t: t.order)


EXECUTIONS = "check_id string, dimension string, scope string, column_name string, position int, status string, outcome string, code string, finding_count int"
FINDINGS = "finding_id string, check_id string, dimension string, column_name string, position int, severity string, message string, metric string, observed double, affected long, population long, basis string, affected_percentage double, family string, root_cause string"


def executions_frame(df: DataFrame | Table, run: QualityRun) -> DataFrame:
    rows = [(e.check_id, e.dimension, e.scope, e.target and e.target.column_name, e.target and e.target.position, e.status, e.outcome, e.code, len(e.findings)) for e in run.executions]
    return Table.of(df).df.sparkSession.createDataFrame(rows, EXECUTIONS)


def findings_frame(df: DataFrame | Table, run: QualityRun) -> DataFrame:
    rows = []
    for f in run.findings:
        p = f.draft.population
        rows.append((f.finding_id, f.check_id, f.dimension, f.target.column_name, f.target.position, f.severity, f.message, f.draft.metric, float(f.draft.observed), p and p.affected, p and p.total, p and p.basis, f.affected_percentage, f.family, f.draft.root_cause))
    return Table.of(df).df.sparkSession.createDataFrame(rows, FINDINGS)
