"""Statistics of numbers: moments, quartiles and other order statistics, histograms, correlations, outliers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import batched, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tablepulse.operators.facts import percent, union
from tablepulse.operators.frame import Table
from tablepulse.operators.heavy import most_frequent

#: Beyond this magnitude sums of squares may overflow, so values are divided by the largest one first.
LARGE = 1e150
#: Columns whose moments are taken in one aggregate.
MOMENT_COLUMNS = 10
#: Values around a wanted place that are taken one by one; with more of them the bracket is narrowed first.
LOOKED_AT = 20_000
#: Size of a quantile sketch (KLL), and the part of the values by which its ranks err in one case of a hundred at most.
SKETCH = 8192
SKETCH_ERROR = 2.296 / SKETCH**0.9723
#: Columns, or brackets, that one aggregate works on.
SKETCHED = 60


def undefined_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def moments(df: DataFrame | Table, names: list[str] | None = None, ddof: int = 1) -> DataFrame:
    """A row per numeric column: counts of finite, infinite, non-numeric, zero, positive and negative values, extremes, mean,
    variance, standard_deviation, bias-corrected skewness (from 3 values) and excess kurtosis (from 4); constants have 0 for both.

    One pass over all columns. Columns with a value beyond LARGE get a second one, with their values divided by the largest first."""
    table = Table.of(df)
    chosen = [table.position(n) for n in names] if names else [i for i in range(len(table)) if table.is_numeric(i)]
    rows = _moment_rows(table, dict.fromkeys(chosen, 1.0), ddof)
    top = {r.position: max(abs(r.minimum or 0), abs(r.maximum or 0)) for r in rows}
    if large := {i: x for i, x in top.items() if x > LARGE}:
        again = {r.position: r for r in _moment_rows(table, large, ddof)}
        rows = [again.get(r.position, r) for r in rows]
    return table.df.sparkSession.createDataFrame(rows, MOMENTS)


MOMENTS = "position int, column_name string, finite_count long, non_numeric_count long, positive_infinity_count long, negative_infinity_count long, zero_count long, positive_count long, negative_count long, minimum double, maximum double, mean double, variance double, standard_deviation double, skewness double, kurtosis double"


MOMENT_NAMES = [f.split()[0] for f in MOMENTS.split(", ")]


def _moment_rows(table: Table, scales: dict[int, float], ddof: int) -> list[Row]:
    """One row a column. Spark gives sums and population moments; the corrections of these few numbers are made here."""
    inf, kind = "double('infinity')", "samp" if ddof else "pop"
    values = table.df.select(*(c for i in scales for c in (table.number(i).alias(f"n{i}"), table.missing(i).alias(f"m{i}"))))
    values = values.selectExpr("*", *(f"CASE WHEN abs(n{i}) < {inf} THEN n{i} END AS f{i}" for i in scales))
    wanted = [
        f"struct({i} AS position, count(f{i}) AS n, count_if(NOT m{i}) - count(n{i}) AS text, count_if(n{i} = {inf}) AS up, count_if(n{i} = -{inf}) AS down, count_if(f{i} = 0) AS zero, count_if(f{i} > 0) AS plus, count_if(f{i} < 0) AS minus, "
        f"min(f{i}) AS low, max(f{i}) AS high, avg(f{i} / {x!r}D) AS mean, var_{kind}(f{i} / {x!r}D) AS var, stddev_{kind}(f{i} / {x!r}D) AS dev, skewness(f{i} / {x!r}D) AS g1, kurtosis(f{i} / {x!r}D) AS g2)"
        for i, x in scales.items()
    ]
    out = []
    for k in range(0, len(wanted), MOMENT_COLUMNS):  # a few columns at a time keep the generated code small enough to be compiled
        for r in values.agg(F.expr(f"array({', '.join(wanted[k : k + MOMENT_COLUMNS])})").alias("all")).first()["all"]:
            n, scale, flat = r.n, scales[r.position], r.low == r.high
            skew = None if n < 3 else 0.0 if flat else r.g1 and r.g1 * math.sqrt(n * (n - 1)) / (n - 2)
            kurt = None if n < 4 else 0.0 if flat else r.g2 and (n - 1) * ((n + 1) * r.g2 + 6) / ((n - 2) * (n - 3))
            if n >= 3 and not flat and r.g1 is None:  # no deviation is left of values that differ in their last places only
                skew, kurt = 0.0, 0.0 if n >= 4 else None
            mean, dev, var = (None if v is None else v * f for v, f in ((r.mean, scale), (r.dev, scale), (r.var, scale)))
            var = None if var is None else var * scale
            out.append(Row(r.position, table.names[r.position], n, r.text, r.up, r.down, r.zero, r.plus, r.minus, r.low, r.high, *(v if v is not None and math.isfinite(v) else None for v in (mean, var, dev, skew, kurt))))
    return [Row(**dict(zip(MOMENT_NAMES, r, strict=True))) for r in out]


@dataclass(frozen=True)
class Bracket:
    """Values of column k from low to high, of which so many are expected between the ends, and the wanted places among all of the column's."""

    k: int
    low: float
    high: float
    expected: float
    places: tuple[int, ...]


def order_statistics(df: DataFrame, columns: list[Column], shares: tuple[float, ...], looked_at: int = LOOKED_AT) -> list[tuple[int, dict[int, float]]]:
    """For each column of doubles, the number of values (not null) and the values at (n - 1) * share, rounded down, and after, in sorted order.

    The first scan makes one mergeable quantile sketch for each column; its error in rank bounds where each share's values lie. The second
    counts what is below and at the ends of these brackets and takes the values between. Counts are exact, so a sketch that errs further
    than it should is noticed, and its places are looked for beyond the bracket. Brackets that hold more than looked_at values get a
    sketch of their own instead, and another scan. All columns go together, nothing is sorted as a whole, and no task holds a column."""
    names = [f"v{k}" for k in range(len(columns))]
    rows = df.select(*(c.alias(n) for c, n in zip(columns, names, strict=True)))
    out: list[tuple[int, dict[int, float]]] = []
    open_: list[Bracket] = []
    for some in batched(range(len(columns)), SKETCHED):
        sketched = rows.agg(*(x for k in some for x in (F.count(f"v{k}").alias(f"n{k}"), F.min(f"v{k}").alias(f"low{k}"), F.max(f"v{k}").alias(f"high{k}"), F.kll_sketch_agg_double(f"v{k}", F.lit(SKETCH)).alias(f"s{k}"))))
        ends = [min(1.0, max(0.0, share + sign * 3 * SKETCH_ERROR)) for share in shares for sign in (-1, 1)]
        edges = [F.when(F.col(f"n{k}") > 0, F.array(*(F.kll_sketch_get_quantile_double(f"s{k}", F.lit(x)) for x in ends))).alias(f"e{k}") for k in some]
        found = sketched.select(*(f"{x}{k}" for k in some for x in ("n", "low", "high")), *edges).first()
        for k in some:
            n, low, high, edge = (found[f"{x}{k}"] for x in ("n", "low", "high", "e"))
            out.append((n, {}))
            for j, share in enumerate(shares if n else ()):
                p = int((n - 1) * share)
                whole = n <= looked_at  # all of them are taken
                from_, to = (low, high) if whole else (low if ends[2 * j] == 0 else edge[2 * j], high if ends[2 * j + 1] == 1 else edge[2 * j + 1])
                open_.append(Bracket(k, from_, to, n if whole else 6 * SKETCH_ERROR * n, tuple(sorted({p, min(p + 1, n - 1)}))))
    while open_:
        again: list[Bracket] = []
        for some in batched(_merged(open_), SKETCHED):
            again += _looked_up(rows, list(some), out, looked_at)
        open_ = again
    return out


def _merged(brackets: list[Bracket]) -> list[Bracket]:
    """Equal brackets as one."""
    same: dict[tuple, list[Bracket]] = {}
    for b in brackets:
        same.setdefault((b.k, b.low, b.high), []).append(b)
    return [replace(some[0], expected=max(b.expected for b in some), places=tuple(sorted({p for b in some for p in b.places}))) for some in same.values()]


def _looked_up(rows: DataFrame, brackets: list[Bracket], out: list[tuple[int, dict[int, float]]], looked_at: int) -> list[Bracket]:
    """Values at the brackets' places go to out; what has to be looked for further comes back."""
    wanted = []
    for j, b in enumerate(brackets):
        v, between = F.col(f"v{b.k}"), (F.col(f"v{b.k}") > b.low) & (F.col(f"v{b.k}") < b.high)
        wanted += [F.count_if(v < b.low).alias(f"below{j}"), F.count_if(v == b.low).alias(f"low{j}"), F.count_if((v == b.high) & (v != b.low)).alias(f"high{j}")]
        if b.low == b.high:
            continue
        if b.expected <= looked_at:
            wanted.append(F.sort_array(F.collect_list(F.when(between, v))).alias(f"values{j}"))
        else:
            wanted += [F.count_if(between).alias(f"n{j}"), F.kll_sketch_agg_double(F.when(between, v), F.lit(SKETCH)).alias(f"sketch{j}")]
    found = rows.agg(*wanted).first()
    again: list[Bracket] = []
    for j, b in enumerate(brackets):
        n, values = out[b.k]
        below, low, high = (found[f"{x}{j}"] for x in ("below", "low", "high"))
        flat, listed = b.low == b.high, b.expected <= looked_at
        inside = 0 if flat else len(found[f"values{j}"]) if listed else found[f"n{j}"]
        deeper = []
        for p in b.places:
            at = p - below
            if at < 0:
                again.append(Bracket(b.k, -math.inf, b.low, math.inf, (p,)))
            elif at < low:
                values[p] = b.low
            elif at < low + inside:
                if listed:
                    values[p] = found[f"values{j}"][at - low]
                else:
                    deeper.append(p)
            elif at < low + inside + high:
                values[p] = b.high
            else:
                again.append(Bracket(b.k, b.high, math.inf, math.inf, (p,)))
        for group in _neighbours(deeper):
            again.append(_within(rows, found[f"sketch{j}"], b, group, below + low, inside))
    return again


def _within(rows: DataFrame, sketch: bytes, b: Bracket, places: list[int], before: int, n: int) -> Bracket:
    """The part of a bracket, n values after before others, where a sketch of them has these places."""
    m = 3 * SKETCH_ERROR + 2 / n
    shares = [max(0.0, (places[0] - before) / n - m), min(1.0, (places[-1] - before + 1) / n + m)]
    held = rows.sparkSession.createDataFrame([(bytearray(sketch),)], "s binary")
    low, high = held.select(*(F.kll_sketch_get_quantile_double("s", F.lit(x)).alias(f"q{i}") for i, x in enumerate(shares))).first()
    return Bracket(b.k, low, high, (shares[1] - shares[0]) * n, tuple(places))


def _neighbours(places: list[int]) -> list[list[int]]:
    """places in groups of consecutive ones."""
    out: list[list[int]] = []
    for p in places:
        if out and p == out[-1][-1] + 1:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def interpolated(n: int, found: dict[int, float], shares: tuple[float, ...], interpolation: str) -> list[float | None]:
    """Values at h = (n - 1) * share, by one of five interpolations."""
    out: list[float | None] = []
    for share in shares:
        if not n:
            out.append(None)
            continue
        h = (n - 1) * share
        low, part = int(h), h - int(h)
        a, b = found[low], found[min(low + 1, n - 1)]
        if interpolation == "lower" or part == 0:
            out.append(a)
        elif interpolation == "higher":
            out.append(b)
        elif interpolation == "midpoint":
            out.append(a / 2 + b / 2)
        elif interpolation == "nearest":
            out.append(b if part > 0.5 or (part == 0.5 and low % 2) else a)
        else:
            out.append(a * (1 - part) + b * part)
    return out


QUARTERS = (0.25, 0.5, 0.75)


def quantiles_of(df: DataFrame, columns: list[Column], shares: tuple[float, ...] = QUARTERS, interpolation: str = "linear", looked_at: int = LOOKED_AT) -> list[list[float | None]]:
    """Exact quantiles of several columns of doubles together; null where a column has no value."""
    if not columns:
        return []
    return [interpolated(n, found, shares, interpolation) for n, found in order_statistics(df, columns, shares, looked_at)]


def quantiles(df: DataFrame | Table, name: str, shares: tuple[float, ...] = QUARTERS, interpolation: str = "linear", limit: int = LOOKED_AT) -> list[float | None]:
    """Exact quantiles of a column's finite values."""
    table = Table.of(df)
    return quantiles_of(table.df, [table.finite(table.position(name))], shares, interpolation, limit)[0]


def quartiles(df: DataFrame | Table, names: list[str] | None = None, interpolation: str = "linear") -> DataFrame:
    """(column_name, first_quartile, median, third_quartile, interquartile_range) of numeric columns, all together."""
    table = Table.of(df)
    chosen = [table.position(n) for n in names] if names else [i for i in range(len(table)) if table.is_numeric(i)]
    wide = lambda a, c: None if a is None else (c / 2 - a / 2) * 2
    found = quantiles_of(table.df, [table.finite(i) for i in chosen], interpolation=interpolation)
    shown = [(table.names[i], a, m, c, wide(a, c)) for i, (a, m, c) in zip(chosen, found, strict=True)]
    return undefined(table.df.sparkSession.createDataFrame(shown, "column_name string, first_quartile double, median double, third_quartile double, interquartile_range double"), "interquartile_range")


def undefined(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, undefined_to_null(F.col(name)))


SKEW_BOUNDS = (0.5, 1.0)


def skew_label(skew: Column) -> Column:
    return F.when(skew.isNull(), "undefined").when(F.abs(skew) < SKEW_BOUNDS[0], "approximately symmetric").when(F.abs(skew) < SKEW_BOUNDS[1], "moderately skewed").otherwise("strongly skewed")


def outliers(df: DataFrame | Table, names: list[str] | None = None, interpolation: str = "linear") -> DataFrame:
    """(column_name, finite_count, lower_bound, upper_bound, outlier_count, outlier_percentage): values beyond 1.5 interquartile
    ranges from the quartiles, counted for all columns in one pass."""
    table = Table.of(df)
    bounds = [(r.column_name, r.first_quartile, r.third_quartile, r.interquartile_range) for r in quartiles(table, names, interpolation).collect()]
    counted = []
    for name, q1, q3, iqr in bounds:
        v = table.finite(table.position(name))
        low, high = (None, None) if iqr is None else (q1 - 1.5 * iqr, q3 + 1.5 * iqr)
        beyond = F.count_if((v < low) | (v > high)) if low is not None else F.lit(0).cast("long")
        n = F.count(v)
        counted.append(F.struct(F.lit(name).alias("column_name"), n.alias("finite_count"), F.lit(low).cast("double").alias("lower_bound"), F.lit(high).cast("double").alias("upper_bound"), beyond.alias("outlier_count"), percent(beyond, n).alias("outlier_percentage")))
    if not counted:
        return table.df.sparkSession.createDataFrame([], "column_name string, finite_count long, lower_bound double, upper_bound double, outlier_count long, outlier_percentage double")
    return table.df.agg(F.array(*counted).alias("all")).select(F.explode("all").alias("x")).select("x.*")


CORRELATION_COLUMNS, STRONG = 40, 0.8


def correlations(df: DataFrame | Table, names: list[str], limit: int = CORRELATION_COLUMNS) -> DataFrame:
    """(left, right, coefficient, observation_count): Pearson over rows where both are finite, for each pair of the first limit
    columns; pairs without two rows or with a constant side have none."""
    table = Table.of(df)
    pairs = list(combinations(names[:limit], 2))
    if not pairs:
        return table.df.sparkSession.createDataFrame([], CORRELATIONS)
    return (_few_pairs(table, pairs) if len(pairs) <= EXPRESSION_PAIRS else _many_pairs(table, names[:limit])).where("coefficient is not null")


#: Up to so many pairs are aggregate expressions; more are matrix products in Python, of which each task sends one row a pair.
EXPRESSION_PAIRS = 10
CORRELATIONS = "left string, right string, coefficient double, observation_count long"


def _few_pairs(table: Table, pairs: list[tuple[str, str]]) -> DataFrame:
    aggregates = []
    for a, b in pairs:
        x, y = table.finite(table.position(a)), table.finite(table.position(b))
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        varied = (F.count(x) >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        aggregates.append(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.when(varied, undefined_to_null(r)).alias("coefficient"), F.count(x).alias("observation_count")))
    rows = [table.df.agg(F.array(*aggregates[k : k + 20]).alias("all")).select(F.explode("all").alias("x")).select("x.*") for k in range(0, len(aggregates), 20)]
    return union(rows)


def _many_pairs(table: Table, names: list[str]) -> DataFrame:
    """Sums of products over rows where both columns are finite, centred and scaled by the columns' own mean and deviation first."""
    values = [table.finite(table.position(n)) for n in names]
    facts = table.df.agg(*(F.struct(F.max(F.abs(v)).alias("top"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("dev")).alias(f"s{k}") for k, v in enumerate(values))).first()
    usable = lambda x: x is not None and np.isfinite(x)
    shift = np.array([f.mean if usable(f.mean) else 0.0 for f in facts])
    scale = np.array([f.dev if usable(f.dev) and f.dev > 0 else max(f.top or 0.0, 1.0) for f in facts])
    n = len(names)
    upper = np.triu_indices(n, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, n, n))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            known = np.isfinite(x)
            x = np.where(known, (np.where(known, x, 0.0) - shift) / scale, 0.0)
            m = known.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()) for a in upper] + [pa.array(t[upper]) for t in total], names=["i", "j", *"abcdef"])

    parts = table.df.select(*(v.alias(f"v{k}") for k, v in enumerate(values))).mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in "abcdef"))
    s = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in "abcdef"))
    vx, vy = F.col("d") - F.col("b") * F.col("b") / F.col("a"), F.col("e") - F.col("c") * F.col("c") / F.col("a")
    # what is left of a constant side is rounding
    varied = (F.col("a") >= 2) & (vx > 1e-14 * (F.col("d") + 1e-14)) & (vy > 1e-14 * (F.col("e") + 1e-14))
    r = F.when(F.col("a") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("f") - F.col("b") * F.col("c") / F.col("a"), F.sqrt(F.when(vx > 0, vx)) * F.sqrt(F.when(vy > 0, vy))))))
    name = F.array(*map(F.lit, names))
    return s.where("a > 0").select(F.get(name, F.col("i")).alias("left"), F.get(name, F.col("j")).alias("right"), F.when(varied, r).alias("coefficient"), F.col("a").cast("long").alias("observation_count"))


def strongest(pairs: DataFrame, n: int = 10) -> DataFrame:
    return pairs.withColumn("size", F.abs("coefficient")).orderBy(F.desc("size"), "left", "right").limit(n).drop("size")


BINS = 24


def histogram(df: DataFrame | Table, name: str, most: int = BINS) -> DataFrame:
    """(bin, count, low, high): equal-width bins over a column's finite values, empty ones too; the last includes its end."""
    table = Table.of(df)
    v = table.finite(table.position(name))
    n, low, high = table.df.agg(F.count(v), F.min(v), F.max(v)).first()
    spark = table.df.sparkSession
    if not n:
        return spark.createDataFrame([], "bin int, count long, low double, high double")
    scale = max(abs(low), abs(high), 1.0)
    a, b = low / scale, high / scale
    root = int(n**0.5)
    while root * root < n:
        root += 1
    bins = min(most, max(1, root)) if a != b else 1
    width = (b - a) / bins
    if not width and a != b:
        bins, width = 1, b - a
    index = F.least(F.lit(bins - 1), F.floor((v / scale - a) / width).cast("int")) if width else F.lit(0)
    counts = table.df.where(v.isNotNull()).select(index.alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))
    edges = spark.createDataFrame([(i, (a + i * width) * scale, min(b, a + (i + 1) * width) * scale) for i in range(bins)], "bin int, low double, high double")
    return edges.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"), "low", "high").orderBy("bin")


def top_classes(table: Table, i: int, n: int = 10) -> DataFrame:
    """(value, n, text, class_number): the most frequent values, ties by their text."""
    return most_frequent(table, i, n).withColumn("class_number", F.row_number().over(Window.orderBy(F.desc("n"), "text")))  # n rows


def grouped_boxes(df: DataFrame | Table, name: str, target: str, classes: int = 10) -> DataFrame:
    """(class, n, lower_whisker, first_quartile, median, third_quartile, upper_whisker, outlier_count) for the most frequent
    classes; whiskers are the outermost values within 1.5 interquartile ranges."""
    table = Table.of(df)
    t = table.position(target)
    top = top_classes(table, t, classes).select(F.col("value").alias("class"), "class_number")
    rows = table.df.select(table.value(t).alias("class"), table.finite(table.position(name)).alias("v")).where("v is not null").join(F.broadcast(top), "class")
    numbers = [r.class_number for r in top.select("class_number").collect()]
    found = quantiles_of(rows, [F.when(F.col("class_number") == k, F.col("v")) for k in numbers])
    q = table.df.sparkSession.createDataFrame([(k, *x) for k, x in zip(numbers, found, strict=True)], "class_number int, first_quartile double, median double, third_quartile double")
    reach = (F.col("third_quartile") - F.col("first_quartile")) * 1.5
    inside = F.col("v").between(F.col("first_quartile") - reach, F.col("third_quartile") + reach)
    found = rows.join(F.broadcast(q), "class_number").groupBy("class", "class_number", "first_quartile", "median", "third_quartile").agg(F.count("*").alias("n"), F.min(F.when(inside, F.col("v"))).alias("lower_whisker"), F.max(F.when(inside, F.col("v"))).alias("upper_whisker"), F.count_if(~inside).alias("outlier_count"))
    return found.where("lower_whisker is not null").orderBy("class_number").select(F.col("class").cast("string").alias("class"), "n", "lower_whisker", "first_quartile", "median", "third_quartile", "upper_whisker", "outlier_count")


def single_box(df: DataFrame | Table, name: str) -> DataFrame:
    """(column_name, lower_whisker, first_quartile, median, third_quartile, upper_whisker, outlier_count, outlier_percentage)."""
    table = Table.of(df)
    v = table.finite(table.position(name))
    bound = outliers(table, [name]).join(quartiles(table, [name]).drop("interquartile_range"), "column_name").first()
    if bound is None or bound.lower_bound is None:
        return table.df.sparkSession.createDataFrame([], "column_name string, lower_whisker double, first_quartile double, median double, third_quartile double, upper_whisker double, outlier_count long, outlier_percentage double")
    inside = F.when(v.between(bound.lower_bound, bound.upper_bound), v)
    return table.df.agg(F.min(inside).alias("lower_whisker"), F.max(inside).alias("upper_whisker")).select(
        F.lit(name).alias("column_name"), "lower_whisker", F.lit(bound.first_quartile).alias("first_quartile"), F.lit(bound["median"]).alias("median"), F.lit(bound.third_quartile).alias("third_quartile"), "upper_whisker", F.lit(bound.outlier_count).alias("outlier_count"), F.lit(bound.outlier_percentage).alias("outlier_percentage")
    )
