"""Semantic types of columns: ordered rules over exact counts and a bounded, evenly spaced sample of values.

Counts come from the distributed facts. Rules about content look at all values of a column with up to inspected_values of
them, else at a sample of that size, spread evenly over the scan order with both ends; only that reaches the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.config import SemanticConfig
from tablepulse.functions.dates import date_share
from tablepulse.functions.text import PUNCTUATION, STRUCTURED_CODE, UUID, name_tokens
from tablepulse.operators.facts import column_facts
from tablepulse.operators.frame import Table
from tablepulse.operators.picks import picked_values

#: The semantic types in their order.
TYPES = ("numeric_continuous", "numeric_discrete", "categorical", "boolean", "datetime", "identifier", "free_text", "constant", "empty", "unknown")

#: Name tokens that speak for a type.
STRONG_IDENTIFIER = frozenset("id uuid".split())
CONTEXTUAL_IDENTIFIER = frozenset("account code key no number reference".split())
ENTITY = frozenset("account asset customer device employee invoice loan member order phone product record reference transaction user vendor".split())
MEASUREMENT = frozenset("age amount balance cost children count income measure measurement percent percentage price quantity rate revenue salary score total value".split())
CATEGORY = frozenset("area category class grade group label level postal region segment status type zip".split())
CONTINUOUS = frozenset("amount balance cost income measure measurement percent percentage price rate revenue salary score total value".split())
BOOLEAN = frozenset("active can enabled flag has is should valid".split())
DATETIME = frozenset("date datetime day month time timestamp year".split())
FREE_TEXT = frozenset("comment comments description message note notes review text".split())
#: Pairs of words that stand for true and false.
BOOLEAN_WORDS = ({"true", "false"}, {"yes", "no"}, {"y", "n"})

_UUID, _CODE, _PUNCTUATION = re.compile(UUID, re.ASCII), re.compile(STRUCTURED_CODE), re.compile(PUNCTUATION)


@dataclass(frozen=True)
class Evidence:
    code: str
    observed: float | None = None
    threshold: float | None = None


@dataclass(frozen=True)
class ColumnType:
    column_name: str
    position: int
    dtype: str
    semantic_type: str
    confidence: str
    evidence: tuple[Evidence, ...]
    warnings: tuple[str, ...]
    alternatives: tuple[tuple[str, str, str], ...]
    row_count: int
    null_count: int
    distinct_count: int | None
    sample_count: int
    sampled: bool
    user_confirmed_type: str | None = None

    @property
    def effective_type(self) -> str:
        return self.user_confirmed_type or self.semantic_type

    @property
    def non_null_count(self) -> int:
        return self.row_count - self.null_count

    def confirmed(self, semantic_type: str | None) -> ColumnType:
        """The same with a type that the user has chosen; every later step goes by it."""
        if semantic_type is not None and semantic_type not in TYPES:
            raise ValueError(f"Unknown semantic type: {semantic_type}")
        return replace(self, user_confirmed_type=semantic_type)


@dataclass
class _Column:
    """What the rules look at."""

    name: str
    kind: T.DataType
    non_null: int
    distinct: int
    values: list[Any]
    sampled: bool
    config: SemanticConfig

    def __post_init__(self) -> None:
        self.tokens = name_tokens(self.name)
        self.ratio = self.distinct / self.non_null
        self.texts = self.values if isinstance(self.kind, T.StringType) else None
        self.numeric = isinstance(self.kind, T.NumericType)
        self.whole = self.numeric and all(math.isfinite(float(v)) and float(v).is_integer() for v in self.values)
        self.zero_one = self.whole and self.distinct == 2 and {int(v) for v in self.values} == {0, 1}

    def lower(self, confidence: str) -> str:
        """One step down below the number of values that allows confidence."""
        if self.non_null >= self.config.confident_values:
            return confidence
        return "medium" if confidence == "high" else "low"


Verdict = tuple[str, str, list[Evidence], list[str], list[tuple[str, str, str]]]


def _boolean(c: _Column) -> Verdict | None:
    if isinstance(c.kind, T.BooleanType):
        return "boolean", c.lower("high"), [Evidence("NATIVE_BOOLEAN_DTYPE")], [], []
    if c.texts is None or c.distinct != 2:
        return None
    words = {v.strip().casefold() for v in c.texts}
    hint = [Evidence("BOOLEAN_NAME_HINT")] if c.tokens & BOOLEAN else []
    if words in BOOLEAN_WORDS:
        sure = words == BOOLEAN_WORDS[0] and not c.sampled
        return "boolean", c.lower("high" if sure else "medium"), [Evidence("BOOLEAN_VALUE_SET"), *hint], [], []
    if words == {"0", "1"}:
        if hint:
            return "boolean", c.lower("high"), [Evidence("BINARY_TEXT_SET"), *hint], [], [("categorical", "low", "LOW_CARDINALITY")]
        few = Evidence("LOW_CARDINALITY", c.distinct, c.config.categorical_most_distinct)
        return "categorical", c.lower("medium"), [Evidence("BINARY_TEXT_SET"), few], ["BINARY_TEXT_AMBIGUITY"], [("boolean", "low", "BINARY_TEXT_SET")]
    return None


def _temporal(c: _Column) -> Verdict | None:
    if isinstance(c.kind, T.TimestampType | T.TimestampNTZType):
        return "datetime", c.lower("high"), [Evidence("NATIVE_DATETIME_DTYPE")], [], []
    if isinstance(c.kind, T.DateType):
        return "datetime", c.lower("medium" if c.sampled else "high"), [Evidence("PYTHON_DATE_VALUES")], [], []
    return None


def _uuid(c: _Column) -> Verdict | None:
    if c.texts is None or not all(_UUID.fullmatch(v.strip()) for v in c.texts):
        return None
    if c.ratio >= c.config.identifier_strong_ratio:
        return "identifier", c.lower("medium" if c.sampled else "high"), [Evidence("UUID_PATTERN"), Evidence("HIGH_UNIQUENESS", c.ratio, c.config.identifier_strong_ratio)], [], []
    return "identifier", "medium", [Evidence("UUID_PATTERN")], ["DUPLICATE_IDENTIFIER_VALUES"], [("categorical", "low", "LOW_CARDINALITY")]


def _date_text(c: _Column) -> Verdict | None:
    if c.texts is None or (c.tokens & (STRONG_IDENTIFIER | CONTEXTUAL_IDENTIFIER) and not c.tokens & DATETIME):
        return None
    share = date_share(c.texts)
    if not share.date_like or share.parse_rate < c.config.datetime_parse_rate:
        return None
    evidence = [Evidence("DATE_LIKE_PATTERN"), Evidence("DATE_PARSE_RATE", share.parse_rate, c.config.datetime_parse_rate)]
    if share.ambiguous:
        return "datetime", "low", [*evidence, Evidence("AMBIGUOUS_DATE_FORMAT")], ["AMBIGUOUS_DATE_ORDER"], [("categorical", "low", "AMBIGUOUS_DATE_FORMAT")]
    if share.parse_rate < 1:
        return "datetime", "medium", evidence, ["PARTIAL_DATE_PARSE"], []
    return "datetime", c.lower("medium" if c.sampled else "high"), evidence, [], []


def _zero_one_flag(c: _Column) -> Verdict | None:
    if c.zero_one and c.tokens & BOOLEAN:
        return "boolean", c.lower("high"), [Evidence("BINARY_NUMERIC_SET"), Evidence("BOOLEAN_NAME_HINT")], [], [("numeric_discrete", "low", "NUMERIC_INTEGER_ONLY")]
    return None


def _number_type(c: _Column) -> str:
    if c.tokens & CONTINUOUS or not c.whole:
        return "numeric_continuous"
    few = c.distinct <= c.config.discrete_most_distinct or (c.ratio <= c.config.discrete_most_ratio and c.tokens & CATEGORY)
    return "numeric_discrete" if few else "numeric_continuous"


def _identifier(c: _Column) -> Verdict | None:
    strong = c.tokens & STRONG_IDENTIFIER
    if not strong and not c.tokens & CONTEXTUAL_IDENTIFIER or c.non_null < c.config.identifier_least_values or c.ratio < c.config.identifier_candidate_ratio:
        return None
    numbers = [int(v) for v in c.values] if c.whole else []
    rising = c.whole and all(a < b for a, b in zip(numbers, numbers[1:], strict=False))
    coded = c.texts is not None and all(_CODE.fullmatch(v.strip()) for v in c.texts)
    if not strong:
        entities = c.tokens & ENTITY
        if c.tokens & (MEASUREMENT | CATEGORY) or not entities or (entities == {"reference"} and not (rising or coded)):
            return None
    repeats = c.ratio < c.config.identifier_strong_ratio
    unique = Evidence("IDENTIFIER_CANDIDATE_UNIQUENESS", c.ratio, c.config.identifier_candidate_ratio) if repeats else Evidence("HIGH_UNIQUENESS", c.ratio, c.config.identifier_strong_ratio)
    evidence = [Evidence("NAME_HINT_IDENTIFIER"), unique] + [Evidence("MONOTONIC_INTEGER_SEQUENCE")] * rising + [Evidence("STRUCTURED_CODE_PATTERN")] * coded
    structured = rising or coded
    confidence = "high" if structured and not repeats and not c.sampled else "low" if repeats and not structured else "medium"
    other = (_number_type(c), "medium", "NATIVE_NUMERIC_DTYPE") if c.numeric else ("categorical", "medium", "HIGH_CARDINALITY")
    return "identifier", c.lower(confidence), evidence, ["MULTIPLE_PLAUSIBLE_TYPES"] + ["DUPLICATE_IDENTIFIER_VALUES"] * repeats, [other]


def _number(c: _Column) -> Verdict | None:
    if not c.numeric:
        return None
    kind = _number_type(c)
    evidence = [Evidence("NATIVE_NUMERIC_DTYPE"), Evidence("NUMERIC_INTEGER_ONLY" if c.whole else "NUMERIC_FRACTIONAL_VALUES")]
    if kind == "numeric_discrete":
        if c.distinct <= c.config.discrete_most_distinct:
            evidence.append(Evidence("LOW_CARDINALITY", c.distinct, c.config.discrete_most_distinct))
        else:
            evidence += [Evidence("LOW_CARDINALITY", c.ratio, c.config.discrete_most_ratio), Evidence("NAME_HINT_CATEGORICAL")]
    if c.zero_one:
        return kind, "medium", [*evidence, Evidence("BINARY_NUMERIC_SET")], ["BINARY_NUMERIC_AMBIGUITY"], [("boolean", "low", "BINARY_NUMERIC_SET")]
    return kind, c.lower("medium" if c.whole or c.sampled else "high"), evidence, [], []


def _text(c: _Column) -> Verdict | None:
    if c.texts is None:
        return None
    cfg, n = c.config, len(c.texts)
    length = sum(map(len, c.texts)) / n
    spaced = sum(any(ch.isspace() for ch in v) for v in c.texts) / n
    marked = sum(_PUNCTUATION.search(v) is not None for v in c.texts) / n
    long, hinted, unique = length >= cfg.free_text_average_length, bool(c.tokens & FREE_TEXT), c.ratio >= cfg.free_text_distinct_ratio
    structured = max(spaced, marked) >= cfg.free_text_structure_share
    if (long and (unique or structured)) or (hinted and length >= cfg.free_text_average_length / 2 and structured):
        said = (
            (long, Evidence("LONG_TEXT", length, cfg.free_text_average_length)),
            (hinted, Evidence("NAME_HINT_FREE_TEXT")),
            (unique, Evidence("HIGH_TEXT_UNIQUENESS", c.ratio, cfg.free_text_distinct_ratio)),
            (spaced >= cfg.free_text_structure_share, Evidence("TEXT_WHITESPACE", spaced, cfg.free_text_structure_share)),
        )
        return "free_text", c.lower("medium"), [e for holds, e in said if holds], [], []
    if c.distinct < c.non_null and c.distinct <= cfg.categorical_most_distinct:
        return "categorical", c.lower("medium"), [Evidence("LOW_CARDINALITY", c.distinct, cfg.categorical_most_distinct)], [], []
    if c.distinct < c.non_null and c.ratio <= cfg.categorical_most_ratio and c.tokens & CATEGORY:
        return "categorical", c.lower("medium"), [Evidence("LOW_CARDINALITY", c.ratio, cfg.categorical_most_ratio), Evidence("NAME_HINT_CATEGORICAL")], [], []
    return "unknown", "low", [Evidence("HIGH_CARDINALITY", c.ratio, cfg.categorical_most_ratio)], [], [("categorical", "low", "HIGH_CARDINALITY")]


#: The first rule with a verdict decides.
RULES = (_boolean, _temporal, _uuid, _date_text, _zero_one_flag, _identifier, _number, _text)


def decide(name: str, position: int, dtype: str, kind: T.DataType, rows: int, nulls: int, distinct: int | None, values: list[Any], sampled: bool, config: SemanticConfig) -> ColumnType:
    present = rows - nulls
    common = ([Evidence("NULL_VALUES_PRESENT", nulls)] if nulls else []) + ([Evidence("DETERMINISTIC_SAMPLE", len(values), config.inspected_values)] if sampled else [])
    verdict: Verdict
    if not present:
        verdict = ("empty", "high", [Evidence("ALL_NULL")], [], [])
    elif distinct is None:
        verdict = ("unknown", "low", [Evidence("INFERENCE_ERROR")], ["UNSUPPORTED_VALUES"], [])
    elif distinct == 1:
        verdict = ("constant", "high", [Evidence("CONSTANT_VALUE")], [], [])
    else:
        column = _Column(name, kind, present, distinct, values, sampled, config)
        try:
            verdict = next((v for rule in RULES if (v := rule(column))), ("unknown", "low", [Evidence("MIXED_VALUE_TYPES")], ["UNSUPPORTED_VALUES"], []))
        except Exception:  # one odd column doesn't stop the others, and nothing of its values is told
            verdict = ("unknown", "low", [Evidence("INFERENCE_ERROR")], ["COLUMN_INFERENCE_FAILED"], [])
    found, confidence, evidence, warnings, others = verdict
    if present and present < config.confident_values and found not in ("empty", "constant"):
        warnings = [*warnings, "INSUFFICIENT_OBSERVATIONS"]
    return ColumnType(name, position, dtype, found, confidence, (*evidence, *common), tuple(warnings), tuple(others), rows, nulls, distinct, len(values), sampled)


def _samples(table: Table, present: list[int], config: SemanticConfig) -> list[tuple[list[Any], bool]]:
    """The inspected values of each column, and whether they are a sample. All columns together take a count and a scan."""
    limit = config.inspected_values
    unread = T.ArrayType | T.MapType | T.StructType | T.BinaryType | T.VariantType
    found = picked_values(table, {i: n for i, n in enumerate(present) if n and not isinstance(table.kind(i), unread)}, limit)
    return [(found.get(i, []), n > limit) for i, n in enumerate(present)]


def infer_types(df: DataFrame | Table, config: SemanticConfig | None = None, facts: list | None = None) -> list[ColumnType]:
    """Semantic type of each column, in order. facts: rows of column_facts, if they are known."""
    table, config = Table.of(df), config or SemanticConfig()
    facts = facts or sorted(column_facts(table).collect(), key=lambda r: r.position)
    samples = _samples(table, [f.non_null_count if f.distinct_count is not None else 0 for f in facts], config)
    return [decide(f.column_name, f.position, f.dtype, table.kind(f.position), f.row_count, f.null_count, f.distinct_count, values, sampled, config) for f, (values, sampled) in zip(facts, samples, strict=True)]


SCHEMA = (
    "position int, column_name string, dtype string, semantic_type string, effective_type string, confidence string, evidence array<struct<code:string,observed:double,threshold:double>>, warnings array<string>, "
    "alternatives array<struct<semantic_type:string,confidence:string,evidence:string>>, row_count long, null_count long, non_null_count long, distinct_count long, sample_count int, sampled boolean"
)


def types_frame(df: DataFrame | Table, types: list[ColumnType]) -> DataFrame:
    table = Table.of(df)
    number = lambda x: None if x is None else float(x)
    rows = [(t.position, t.column_name, t.dtype, t.semantic_type, t.effective_type, t.confidence, [(e.code, number(e.observed), number(e.threshold)) for e in t.evidence], list(t.warnings), list(t.alternatives), t.row_count, t.null_count, t.non_null_count, t.distinct_count, t.sample_count, t.sampled) for t in types]
    return table.df.sparkSession.createDataFrame(rows, SCHEMA)
