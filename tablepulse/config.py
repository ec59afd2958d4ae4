"""Settings. Their values are fixed by the rules that this engine follows; each can be set otherwise."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from hashlib import sha256
from json import dumps
from os import environ


def fingerprint(value: object) -> str:
    """SHA-256 of canonical JSON."""
    return sha256(dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class SemanticConfig:
    categorical_most_distinct: int = 20
    categorical_most_ratio: float = 0.05
    identifier_strong_ratio: float = 0.98
    identifier_candidate_ratio: float = 0.80
    identifier_least_values: int = 4
    discrete_most_distinct: int = 20
    discrete_most_ratio: float = 0.05
    free_text_average_length: float = 40.0
    free_text_distinct_ratio: float = 0.50
    free_text_structure_share: float = 0.50
    datetime_parse_rate: float = 0.90
    confident_values: int = 10
    inspected_values: int = 10_000

    def __post_init__(self) -> None:
        if self.identifier_candidate_ratio > self.identifier_strong_ratio:
            raise ValueError("identifier_candidate_ratio must not exceed identifier_strong_ratio")
        if self.inspected_values < 2:
            raise ValueError("inspected_values must be 2 or more")


@dataclass(frozen=True)
class ProfileConfig:
    """Row, column and cell limits are those of uploads; None leaves a DataFrame of any size to the cluster."""

    most_rows: int | None = None
    most_columns: int | None = None
    most_cells: int | None = None
    top_values: int = 10
    display_length: int = 200
    ddof: int = 1
    interpolation: str = "linear"

    def __post_init__(self) -> None:
        if self.interpolation not in ("linear", "lower", "higher", "midpoint", "nearest"):
            raise ValueError("unknown interpolation")
        if self.ddof not in (0, 1) or not 1 <= self.top_values <= 100 or not 16 <= self.display_length <= 4096:
            raise ValueError("ddof is 0 or 1, top_values 1 to 100, display_length 16 to 4096")

    @classmethod
    def upload(cls, **more: object) -> ProfileConfig:
        return cls(most_rows=100_000, most_columns=1_000, most_cells=10_000_000, **more)


@dataclass(frozen=True)
class CheckThresholds:
    low: float = 5.0
    medium: float = 20.0
    high: float = 40.0
    cardinality_ratio: float = 0.90
    cardinality_values: int = 10

    def __post_init__(self) -> None:
        if not 0 < self.low < self.medium < self.high <= 100:
            raise ValueError("thresholds must grow within 0 to 100")

    def severity(self, percent: float) -> str | None:
        if percent <= 0:
            return None
        return "low" if percent <= self.low else "medium" if percent <= self.medium else "high" if percent <= self.high else "critical"


@dataclass(frozen=True)
class FrameworkConfig:
    enabled: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    parameters: dict[str, dict] = field(default_factory=dict)
    fail_fast: bool = False
    most_checks: int = 1_000
    most_targets: int = 10_000
    most_executions: int = 100_000
    # declared for checks to honour; the framework itself doesn't enforce these three
    most_rows_per_check: int = 100_000
    most_pattern_evaluations: int = 10_000
    most_combinations: int = 10_000

    def __post_init__(self) -> None:
        for name in ("enabled", "disabled", "dimensions"):
            values = getattr(self, name)
            if len(set(values)) != len(values):
                raise ValueError(f"{name} repeats a value")
            object.__setattr__(self, name, tuple(sorted(values)))
        if set(self.enabled) & set(self.disabled):
            raise ValueError("a check can't be both enabled and disabled")

    @property
    def fingerprint(self) -> str:
        return fingerprint(asdict(self))


@dataclass(frozen=True)
class ScoreConfig:
    #: by dimension
    weights: tuple[tuple[str, float], ...] = (("completeness", 0.20), ("uniqueness", 0.15), ("validity", 0.20), ("consistency", 0.15), ("integrity", 0.20), ("analytical_readiness", 0.10))

    def __post_init__(self) -> None:
        if abs(sum(w for _, w in self.weights) - 1) > 1e-9 or any(w < 0 for _, w in self.weights):
            raise ValueError("weights must be positive and add up to 1")

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.weights)


@dataclass(frozen=True)
class ResourceLimits:
    """What a source may hold; each limit is inclusive, and beyond it a source is refused, never cut."""

    source_bytes: int = 10 * 1024 * 1024
    rows: int = 100_000
    columns: int = 1_000
    archive_entries: int = 1_000
    uncompressed_bytes: int = 100 * 1024 * 1024
    compression_ratio: int = 200
    worksheets: int = 100
    workbook_cells: int = 1_000_000
    parquet_metadata_bytes: int = 8 * 1024 * 1024
    parquet_row_groups: int = 1_000

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            if value < 1:
                raise ValueError(f"{name} must be positive")

    @classmethod
    def from_environment(cls, prefix: str = "TABLEPULSE_") -> ResourceLimits:
        names = {n: environ[prefix + n.upper()] for n in cls.__dataclass_fields__ if prefix + n.upper() in environ}
        return cls(**{n: int(v) for n, v in names.items()})
