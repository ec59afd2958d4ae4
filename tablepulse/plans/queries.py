"""The named queries of the engine and, where SQL can express one, the same in DuckDB's SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.functions import text as T
from tablepulse.functions.dates import read_text
from tablepulse.operators import assess, categorical, facts, numeric, samples, scoring
from tablepulse.operators.frame import Table, evenly_spaced
from tablepulse.operators.jobs import together
from tablepulse.operators.quality import CATALOGUE, executions_frame, findings_frame
from tablepulse.operators.semantic import infer_types, types_frame
from tablepulse.plans.analysis import Analysis, analyze_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "benchmark", "conversations", "embeddings")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many places (sums in another order differ in the last ones), whole numbers as long."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(c) for c in df.columns))


# Inputs with nulls, infinities and repeats, which the tables lack: the same expressions in both dialects.

DERIVED: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "li_null": ("lineitem", [("l_linenumber", "l_linenumber"), ("l_discount", "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_discount END"), ("l_tax", "l_tax")]),
    "li_inf": ("lineitem", [("l_discount", "CASE WHEN l_linenumber = 7 THEN CAST('Infinity' AS DOUBLE) WHEN l_linenumber = 6 THEN CAST('-Infinity' AS DOUBLE) WHEN l_linenumber = 5 THEN NULL ELSE l_discount - 0.05 END"), ("l_tax", "l_tax")]),
    "ev_dup": ("events", [("event_type", "event_type"), ("u", "user_id % 10")]),
    "cat_messy": ("lineitem", [("flag", "CASE WHEN l_linenumber % 3 = 0 THEN lower(l_returnflag) WHEN l_linenumber % 3 = 1 THEN concat(' ', l_returnflag) ELSE l_returnflag END")]),
    "messy": (
        "events",
        [
            ("event_id", "CASE WHEN event_id % 50 = 3 THEN NULL WHEN event_id % 40 = 1 THEN event_id - 1 ELSE event_id END"),
            ("value", "CASE WHEN user_id % 9 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN user_id % 7 = 0 THEN NULL ELSE value END"),
            ("event_type", "CASE WHEN event_id % 3 = 0 THEN upper(event_type) WHEN event_id % 3 = 1 THEN concat(' ', event_type) ELSE event_type END"),
            ("note", "CAST(NULL AS STRING)"),
            ("version", "1"),
            ("day_of", "CASE WHEN user_id % 5 = 0 THEN NULL ELSE substr(CAST(ts AS STRING), 1, 10) END"),
        ],
    ),
}
PADDED = (" version ",)


def derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name == "labels_left":
        return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")
    if name not in DERIVED:
        return read(spark, sf, name)
    table, columns = DERIVED[name]
    return read(spark, sf, table).selectExpr(*(f"{e} AS {c}" for c, e in columns))


def input_sql(name: str) -> str:
    if name == "labels_left":
        return "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
    if name not in DERIVED:
        return name
    table, columns = DERIVED[name]
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns)} FROM {table})"


COLUMNS = {
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split(),
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
    "labels_left": "doc_id lang source n_chars quality toxic".split(),
    "events": "event_id ts user_id event_type value props".split(),
    "messy": [c for c, _ in DERIVED["messy"][1]],
    "ev_dup": ["event_type", "u"],
    "documents": "doc_id text lang source n_chars".split(),
}


# Facts


def _facts_sql(name: str) -> str:
    rows = [
        f"SELECT {i} AS position, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count({c}) AS non_null_count, count(DISTINCT {c}) AS distinct_count, "
        f"round(CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) - count({c})) * 100.0 / count(*) END::DOUBLE, 6) AS missing_percentage, round((count(DISTINCT {c})::DOUBLE / nullif(count({c}), 0))::DOUBLE, 6) AS distinct_ratio FROM t"
        for i, c in enumerate(COLUMNS[name])
    ]
    return f"WITH t AS (SELECT * FROM {input_sql(name)}) " + " UNION ALL ".join(rows)


for _name in ("lineitem", "orders", "labels_left", "events", "messy"):
    query(f"column_facts_{_name}", _facts_sql(_name))(lambda s, d, n=_name: rounded(facts.column_facts(derived(s, d, n)).drop("dtype")))


def _summary_sql(name: str) -> str:
    n, missing = len(COLUMNS[name]), " + ".join(f"count(*) - count({c})" for c in COLUMNS[name])
    keys = ", ".join(COLUMNS[name])
    return (
        f"WITH t AS (SELECT * FROM {input_sql(name)}), g AS (SELECT count(*) AS c FROM t GROUP BY {keys}) SELECT count(*) AS row_count, {n}::BIGINT AS column_count, count(*) * {n} AS cell_count, ({missing})::BIGINT AS missing_cell_count, "
        f"round((({missing}) * 100.0 / (count(*) * {n}))::DOUBLE, 6) AS missing_percentage, (SELECT sum(c - 1)::BIGINT FROM g) AS duplicate_row_count, round(((SELECT sum(c - 1) FROM g) * 100.0 / count(*))::DOUBLE, 6) AS duplicate_row_percentage FROM t"
    )


for _name in ("orders", "labels_left", "ev_dup", "messy"):
    query(f"dataset_summary_{_name}", _summary_sql(_name))(lambda s, d, n=_name: rounded(facts.dataset_summary(derived(s, d, n)).drop("data_bytes")))

_MISSING = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {i}::BIGINT AS position, count(*) - count({c}) AS null_count, count({c}) AS non_null_count, round(((count(*) - count({c})) * 100.0 / count(*))::DOUBLE, 6) AS missing_percentage FROM t" for i, c in enumerate(COLUMNS["labels_left"]))
query("missingness_by_column", f"WITH t AS (SELECT * FROM {input_sql('labels_left')}) {_MISSING}")(lambda s, d: rounded(facts.missing_counts(derived(s, d, "labels_left"))))
query("missingness_ranking", f"WITH t AS (SELECT * FROM {input_sql('labels_left')}) SELECT * FROM ({_MISSING}) ORDER BY missing_percentage DESC, position LIMIT 5")(lambda s, d: rounded(samples.missing_ranking(derived(s, d, "labels_left"))))
query("duplicate_flags", f"SELECT event_id, event_type, u, row_number() OVER (PARTITION BY event_type, u ORDER BY event_id) > 1 AS is_duplicate FROM (SELECT event_id, event_type, user_id % 10 AS u FROM events)")(
    lambda s, d: facts.duplicate_flags(read(s, d, "events").select("event_id", "event_type", (F.col("user_id") % 10).alias("u")), "event_id")
)
query("duplicate_rows_summary", f"WITH g AS (SELECT count(*) AS c FROM {input_sql('ev_dup')} GROUP BY event_type, u) SELECT sum(c)::BIGINT AS row_count, sum(c - 1)::BIGINT AS duplicate_row_count, round((sum(c - 1) * 100.0 / sum(c))::DOUBLE, 6) AS duplicate_row_percentage FROM g")(lambda s, d: rounded(facts.duplicate_rows(derived(s, d, "ev_dup"))))
query("identifier_duplicates", "SELECT count(o_custkey) AS non_null_count, count(o_custkey) - count(DISTINCT o_custkey) AS duplicate_identifier_count, round(((count(o_custkey) - count(DISTINCT o_custkey)) * 100.0 / count(o_custkey))::DOUBLE, 6) AS duplicate_percentage FROM orders")(
    lambda s, d: rounded(facts.identifier_duplicates(read(s, d, "orders"), "o_custkey"))
)


# Numbers

_FINITE = "{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < 'Infinity'::DOUBLE"


def _moments_sql(name: str, column: str) -> str:
    f = f"(CASE WHEN {_FINITE.format(c=column)} THEN {column} END)"
    return (
        f"SELECT '{column}' AS column_name, count({f}) AS finite_count, count(*) FILTER ({column} = 'Infinity'::DOUBLE) AS positive_infinity_count, count(*) FILTER ({column} = '-Infinity'::DOUBLE) AS negative_infinity_count, "
        f"count(*) FILTER ({f} = 0) AS zero_count, count(*) FILTER ({f} > 0) AS positive_count, count(*) FILTER ({f} < 0) AS negative_count, round(min({f})::DOUBLE, 6) AS minimum, round(max({f})::DOUBLE, 6) AS maximum, round(avg({f})::DOUBLE, 6) AS mean, "
        f"round(var_samp({f})::DOUBLE, 4) AS variance, round(stddev_samp({f})::DOUBLE, 6) AS standard_deviation, round(coalesce(skewness({f}), 0.0)::DOUBLE, 6) AS skewness, round(coalesce(kurtosis({f}), 0.0)::DOUBLE, 6) AS kurtosis FROM {input_sql(name)}"
    )


def _moments(df: DataFrame, *names: str) -> DataFrame:
    found = numeric.moments(df, list(names)).drop("position", "non_numeric_count")
    return rounded(found.withColumn("variance", F.round("variance", 4)))


_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
query("numeric_moments", " UNION ALL ".join(_moments_sql("lineitem", c) for c in _FOUR))(lambda s, d: _moments(read(s, d, "lineitem"), *_FOUR))
query("nonfinite_counts", _moments_sql("li_inf", "l_discount"))(lambda s, d: _moments(derived(s, d, "li_inf"), "l_discount"))
query("sign_counts", _moments_sql("customer", "c_acctbal"))(lambda s, d: _moments(read(s, d, "customer"), "c_acctbal"))
query("numeric_extrema", " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c}) AS minimum, max({c}) AS maximum FROM {t}" for t, c in (("events", "value"), ("part", "p_retailprice"))))(
    lambda s, d: numeric.moments(read(s, d, "events"), ["value"]).unionByName(numeric.moments(read(s, d, "part"), ["p_retailprice"])).select("column_name", "minimum", "maximum")
)

_Q = "SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.25)::DOUBLE, 6) AS first_quartile, round(quantile_cont({c}, 0.5)::DOUBLE, 6) AS median, round(quantile_cont({c}, 0.75)::DOUBLE, 6) AS third_quartile, round((quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))::DOUBLE, 6) AS interquartile_range FROM {t}"
query("numeric_quartiles", " UNION ALL ".join(_Q.format(c=c, t="lineitem") for c in _FOUR))(lambda s, d: rounded(numeric.quartiles(read(s, d, "lineitem"), list(_FOUR))))


def _picks_sql(how: str) -> str:
    one = {
        "lower": "max(v) FILTER (k = floor(h))", "higher": "max(v) FILTER (k = ceil(h))", "midpoint": "(max(v) FILTER (k = floor(h)) + max(v) FILTER (k = ceil(h))) / 2",
        "nearest": "max(v) FILTER (k = CASE WHEN h - floor(h) > 0.5 OR (h - floor(h) = 0.5 AND floor(h) % 2 = 1) THEN ceil(h) ELSE floor(h) END)",
    }[how]
    return (
        "WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders), q AS (SELECT p, p * (n - 1) AS h, v, k FROM s, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) AS ps(p)), "
        f"r AS (SELECT p, round(({one})::DOUBLE, 6) AS x FROM q GROUP BY p, h) SELECT 'o_totalprice' AS column_name, max(x) FILTER (p = 0.25) AS first_quartile, max(x) FILTER (p = 0.5) AS median, max(x) FILTER (p = 0.75) AS third_quartile, round((max(x) FILTER (p = 0.75) - max(x) FILTER (p = 0.25))::DOUBLE, 4) AS interquartile_range FROM r"
    )


for _how in ("lower", "higher", "midpoint", "nearest"):
    query(f"quartiles_{_how}", _picks_sql(_how))(lambda s, d, h=_how: rounded(numeric.quartiles(read(s, d, "orders"), ["o_totalprice"], h).withColumn("interquartile_range", F.round("interquartile_range", 4))))


# Categories, dates, texts


def _counts_sql(table: str, column: str) -> str:
    return f"SELECT {column} AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1"


def _frequencies_sql(table: str, column: str, k: int) -> str:
    return f"WITH c AS ({_counts_sql(table, column)}) SELECT row_number() OVER (ORDER BY n DESC, value) AS rank, value, n, round((n * 100.0 / (SELECT sum(n) FROM c))::DOUBLE, 6) AS percentage FROM c ORDER BY n DESC, value LIMIT {k}"


for _t, _c, _k in (("events", "event_type", 10), ("part", "p_brand", 10), ("customer", "c_mktsegment", 2)):
    query(f"category_frequencies_{_c}", _frequencies_sql(_t, _c, _k))(lambda s, d, t=_t, c=_c, k=_k: rounded(categorical.frequencies(read(s, d, t), c, k).select("rank", "value", "n", "percentage")))


def _category_sql(table: str, column: str, k: int = 10) -> str:
    return (
        f"WITH c AS ({_counts_sql(table, column)}), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank FROM c), t AS (SELECT sum(n) AS total FROM c) SELECT '{column}' AS column_name, max(total)::BIGINT AS non_null_count, count(*) AS category_count, max(value) FILTER (rank = 1) AS mode, max(n) FILTER (rank = 1) AS mode_count, "
        f"round((max(n) * 100.0 / max(total))::DOUBLE, 6) AS top_category_share, (max(total) - sum(n) FILTER (rank <= {k}))::BIGINT AS other_value_count, round((-sum(n / total * log2(n / total)))::DOUBLE, 6) AS entropy_bits, count(*) > greatest(20, floor(max(total) * 0.5)) AS high_cardinality FROM o, t"
    )


_CATEGORIES = (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("part", "p_type"), ("part", "p_name"), ("customer", "c_mktsegment"), ("events", "event_type"))
query("category_diagnostics", " UNION ALL ".join(f"SELECT * FROM ({_category_sql(t, c)})" for t, c in _CATEGORIES))(lambda s, d: rounded(facts.union([categorical.category_summary(read(s, d, t), [c for u, c in _CATEGORIES if u == t]) for t in dict.fromkeys(t for t, _ in _CATEGORIES)])))
query("category_collisions", f"WITH c AS ({_counts_sql(input_sql('cat_messy'), 'flag')}), g AS (SELECT lower(trim(value)) AS k, count(*) AS forms, sum(n) AS n FROM c GROUP BY 1) SELECT sum(n)::BIGINT AS non_null_count, count(*) FILTER (forms > 1) AS collision_groups, coalesce(sum(n) FILTER (forms > 1), 0)::BIGINT AS affected_rows FROM g")(
    lambda s, d: rounded(categorical.collisions(derived(s, d, "cat_messy"), "flag").drop("column_name"))
)


def _range_sql(table: str, column: str) -> str:
    shown = lambda x: f"replace(CAST({x} AS VARCHAR), ' ', 'T')"
    return f"SELECT '{column}' AS column_name, count({column}) AS parsed_count, 0::BIGINT AS unparsed_count, 0::BIGINT AS ambiguous_count, 'naive' AS timezone_state, {shown(f'min({column})')} AS earliest, {shown(f'max({column})')} AS latest, round((date_diff('microsecond', min({column}), max({column})) / 1e6)::DOUBLE, 6) AS span_seconds FROM {table}"


def _range(df: DataFrame, column: str) -> DataFrame:
    return rounded(categorical.datetime_summary(df, column))


query("datetime_range_orders", _range_sql("orders", "o_orderdate"))(lambda s, d: _range(read(s, d, "orders"), "o_orderdate"))
query("datetime_range_events", "SELECT * REPLACE (rtrim(rtrim(earliest, '0'), '.') AS earliest, rtrim(rtrim(latest, '0'), '.') AS latest) FROM (" + _range_sql("events", "ts") + ")")(
    lambda s, d: _range(read(s, d, "events"), "ts").withColumns({c: F.regexp_replace(F.regexp_replace(c, "0+$", ""), "[.]$", "") for c in ("earliest", "latest")})
)
_DATES = "CASE WHEN o_orderkey % 4 = 0 THEN {iso} WHEN o_orderkey % 4 = 1 THEN {mdy} WHEN o_orderkey % 4 = 2 THEN {ymd} ELSE 'no date' END"
query(
    "datetime_text_parse",
    f"WITH t AS (SELECT {_DATES.format(iso="strftime(o_orderdate, '%Y-%m-%d')", mdy="strftime(o_orderdate, '%m/%d/%Y')", ymd="strftime(o_orderdate, '%Y/%m/%d')")} AS v, o_orderdate AS x, o_orderkey % 4 AS k FROM orders), "
    "r AS (SELECT CASE WHEN k = 3 THEN 'unparsed' WHEN k = 1 AND day(x) <= 12 AND day(x) <> month(x) THEN 'ambiguous' ELSE 'naive' END AS state, x FROM t) SELECT state, count(*) AS n, strftime(min(x) FILTER (state = 'naive'), '%Y-%m-%d') AS earliest FROM r GROUP BY state",
)(lambda s, d: _parsed_dates(s, d))


def _parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    expression = _DATES.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", mdy="date_format(o_orderdate, 'MM/dd/yyyy')", ymd="date_format(o_orderdate, 'yyyy/MM/dd')")
    counts = read(spark, sf, "orders").selectExpr(f"{expression} AS v").groupBy("v").agg(F.count("*").alias("n"))
    states = counts.select("n", read_text(F.col("v")).alias("x"))
    return states.groupBy(F.col("x.state").alias("state")).agg(F.sum("n").alias("n"), F.date_format(F.timestamp_micros(F.min("x.micros")), "yyyy-MM-dd").alias("earliest"))


_TEXTS = (("documents", "text"), ("conversations", "text"), ("pages", "url"))
query("text_lengths", " UNION ALL ".join(f"SELECT '{t}' AS source_table, '{c}' AS column_name, min(length({c})) AS minimum_length, max(length({c})) AS maximum_length, round(avg(length({c}))::DOUBLE, 6) AS average_length, round(median(length({c}))::DOUBLE, 6) AS median_length, count(*) FILTER ({c} = '') AS empty_string_count, count(*) FILTER (regexp_full_match({c}, '\\s+')) AS whitespace_only_count FROM {t}" for t, c in _TEXTS))(
    lambda s, d: rounded(facts.union([categorical.text_summary(read(s, d, t), [c]).select(F.lit(t).alias("source_table"), "*") for t, c in _TEXTS]))
)
query("free_text_features", "SELECT count(*) AS n, round(avg(length(text))::DOUBLE, 6) AS average_length, round(avg(regexp_matches(text, '\\s')::INT)::DOUBLE, 6) AS whitespace_share, round(avg(regexp_matches(text, '[^\\pL\\pM\\pN_\\s]')::INT)::DOUBLE, 6) AS punctuation_share FROM documents")(
    lambda s, d: rounded(samples.text_features(read(s, d, "documents"), "text"))
)
_PATTERNS = {"uuid": T.UUID, "structured_code": T.STRUCTURED_CODE, "iso_date": T.ISO_DATE, "slash_date": T.SLASH_DATE}
_CODE_SQL = "regexp_full_match(v, '[A-Za-z0-9]+([-_][A-Za-z0-9]+)*') AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')"
query(
    "pattern_shares",
    "WITH t AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN substr(md5(s_name), 1, 8) || '-1234-1234-1234-' || substr(md5(s_name), 1, 12) WHEN s_suppkey % 4 = 1 THEN 'LN-' || s_suppkey WHEN s_suppkey % 4 = 2 THEN '2024-1-5 ' ELSE '1/2/2024' END AS w FROM supplier), u AS (SELECT trim(w) AS v FROM t) "
    f"SELECT count(*) AS n, count(*) FILTER (regexp_full_match(v, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}')) AS uuid, count(*) FILTER ({_CODE_SQL}) AS structured_code, count(*) FILTER (regexp_full_match(v, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')) AS iso_date, count(*) FILTER (regexp_full_match(v, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}')) AS slash_date FROM u",
)(
    lambda s, d: samples.pattern_shares(
        read(s, d, "supplier").selectExpr("CASE WHEN s_suppkey % 4 = 0 THEN substr(md5(s_name), 1, 8) || '-1234-1234-1234-' || substr(md5(s_name), 1, 12) WHEN s_suppkey % 4 = 1 THEN 'LN-' || s_suppkey WHEN s_suppkey % 4 = 2 THEN '2024-1-5 ' ELSE '1/2/2024' END AS w"), "w", _PATTERNS
    )
)
_NAMES_SQL = " UNION ".join(f"SELECT column_name AS name FROM (DESCRIBE {t})" for t in TABLES)
query("name_tokens", f"SELECT name, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x)))), ' ') AS tokens FROM ({_NAMES_SQL})")(
    lambda s, d: s.createDataFrame([(n,) for n in sorted({c for t in TABLES for c in read(s, d, t).columns})], "name string").select("name", F.array_join(T.name_tokens_column(F.col("name")), " ").alias("tokens"))
)


# Samples

_N = 1000
query("evenly_spaced_sample", f"WITH t AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM events) SELECT pos, event_id, value FROM t WHERE n <= {_N} OR pos IN (SELECT (i * (n - 1)) // {_N - 1} FROM range({_N}) r(i), (SELECT count(*) AS n FROM events))")(
    lambda s, d: evenly_spaced(read(s, d, "events").select("event_id", "value"), _N, "event_id").select(F.col("_pos").alias("pos"), "event_id", "value")
)
query("first_values", "SELECT event_id - 0 AS position, value FROM events ORDER BY event_id LIMIT 5000")(lambda s, d: samples.first_values(read(s, d, "events"), "value"))
query("monotonic_identifier", "WITH t AS (SELECT event_id > lag(event_id) OVER (ORDER BY event_id) AS up FROM events) SELECT least(count(*), 10000) AS inspected, coalesce(bool_and(up), true) AS strictly_increasing FROM t")(lambda s, d: samples.rising(read(s, d, "events"), "event_id", "event_id"))
query(
    "scatter_sample",
    "WITH t AS (SELECT o_totalprice AS x, o_custkey::DOUBLE AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders) SELECT pos, x, y FROM t WHERE n <= 400 OR pos IN (SELECT (i * (n - 1)) // 399 FROM range(400) r(i), (SELECT count(*) AS n FROM orders))",
)(lambda s, d: samples.scatter(read(s, d, "orders"), "o_totalprice", "o_custkey", order=("o_orderkey",)).select(F.col("_pos").alias("pos"), "x", "y"))
query(
    "missing_heatmap",
    f"WITH t AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM {input_sql('labels_left')}), p AS (SELECT * FROM t WHERE pos IN (SELECT (i * (n - 1)) // 59 FROM range(60) r(i), (SELECT count(*) AS n FROM documents))) "
    + " UNION ALL ".join(f"SELECT pos + 1 AS row_number, '{c}' AS column_name, {c} IS NULL AS missing FROM p" for c in COLUMNS["labels_left"]),
)(lambda s, d: samples.missing_map(derived(s, d, "labels_left"), order=("doc_id",)))


# Relations and distributions


def _pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def _pearson_sql(table: str, names: list[str]) -> str:
    return " UNION ALL ".join(f'SELECT \'{a}\' AS "left", \'{b}\' AS "right", round(corr({a}, {b})::DOUBLE, 6) AS coefficient, count(*) AS observation_count FROM {table}' for a, b in _pairs(names))


_LI = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PART = ["p_partkey", "p_size", "p_retailprice"]
query("pearson_pairs_lineitem", _pearson_sql("lineitem", _LI))(lambda s, d: rounded(numeric.correlations(read(s, d, "lineitem"), _LI)))
query("pearson_pairs_part", _pearson_sql("part", _PART))(lambda s, d: rounded(numeric.correlations(read(s, d, "part"), _PART)))
_STRONG = "(SELECT l_quantity, l_quantity * 2 + l_tax AS double_quantity, -l_quantity * l_quantity AS minus_square, l_discount FROM lineitem)"
query("strong_correlations", f"SELECT * FROM ({_pearson_sql(_STRONG, ['l_quantity', 'double_quantity', 'minus_square', 'l_discount'])}) WHERE abs(coefficient) >= 0.8")(
    lambda s, d: rounded(numeric.correlations(read(s, d, "lineitem").selectExpr("l_quantity", "l_quantity * 2 + l_tax AS double_quantity", "-l_quantity * l_quantity AS minus_square", "l_discount"), ["l_quantity", "double_quantity", "minus_square", "l_discount"]).where(F.abs("coefficient") >= numeric.STRONG))
)


def _outlier_sql(name: str, column: str) -> str:
    return (
        f"WITH t AS (SELECT {column} AS v FROM {input_sql(name)} WHERE {_FINITE.format(c=column)}), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM t) SELECT '{column}' AS column_name, count(*) AS finite_count, round(max(a - 1.5 * (b - a))::DOUBLE, 6) AS lower_bound, round(max(b + 1.5 * (b - a))::DOUBLE, 6) AS upper_bound, "
        "count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS outlier_count, round((count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) * 100.0 / count(*))::DOUBLE, 6) AS outlier_percentage FROM t, q"
    )


_OUT = (("events", "value"), ("messy", "value"), ("documents", "n_chars"), ("lineitem", "l_extendedprice"))
query("iqr_outliers", " UNION ALL ".join(f"SELECT '{t}' AS source_table, * FROM ({_outlier_sql(t, c)})" for t, c in _OUT))(lambda s, d: rounded(facts.union(together(s, *(lambda t=t, c=c: numeric.outliers(derived(s, d, t), [c]).select(F.lit(t).alias("source_table"), "*") for t, c in _OUT)))))
_SKEW = (("events", "value"), ("documents", "n_chars"), ("customer", "c_acctbal"))
query("skew_labels", " UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN abs(skewness({c})) < 0.5 THEN 'approximately symmetric' WHEN abs(skewness({c})) < 1 THEN 'moderately skewed' ELSE 'strongly skewed' END AS skew FROM {t}" for t, c in _SKEW))(
    lambda s, d: facts.union(together(s, *(lambda t=t, c=c: numeric.moments(read(s, d, t), [c]).select("column_name", numeric.skew_label(F.col("skewness")).alias("skew")) for t, c in _SKEW)))
)
query(
    "histogram_totalprice",
    "WITH t AS (SELECT o_totalprice AS v FROM orders), s AS (SELECT count(*) AS n, greatest(max(abs(v)), 1.0) AS scale, min(v) AS lo, max(v) AS hi FROM t), b AS (SELECT *, least(24, greatest(1, ceil(sqrt(n))))::BIGINT AS bins, lo / scale AS a, hi / scale AS z FROM s), w AS (SELECT *, (z - a) / bins AS width FROM b), "
    "c AS (SELECT least(bins - 1, floor((v / scale - a) / width))::BIGINT AS bin, count(*) AS n FROM t, w GROUP BY 1) SELECT i AS bin, coalesce(c.n, 0) AS count, round(((a + i * width) * scale)::DOUBLE, 4) AS low, round((least(z, a + (i + 1) * width) * scale)::DOUBLE, 4) AS high FROM w, range(24) r(i) LEFT JOIN c ON c.bin = i WHERE i < bins",
)(lambda s, d: rounded(numeric.histogram(read(s, d, "orders"), "o_totalprice"), 4))
_BOX = "min(v) FILTER (v BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS lower_whisker, round(max(a)::DOUBLE, 6) AS first_quartile, round(max(m)::DOUBLE, 6) AS median, round(max(b)::DOUBLE, 6) AS third_quartile, max(v) FILTER (v BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS upper_whisker, count(*) FILTER (NOT v BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS outlier_count"
query("grouped_box_by_priority", f"WITH t AS (SELECT o_orderpriority AS class, o_totalprice AS v FROM orders), q AS (SELECT class, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM t GROUP BY class) SELECT class, count(*) AS n, {_BOX} FROM t JOIN q USING (class) GROUP BY class")(
    lambda s, d: rounded(numeric.grouped_boxes(read(s, d, "orders"), "o_totalprice", "o_orderpriority"))
)
query("single_box_value", f"WITH t AS (SELECT value AS v FROM events), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM t) SELECT 'value' AS column_name, {_BOX}, round((count(*) FILTER (NOT v BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) * 100.0 / count(*))::DOUBLE, 6) AS outlier_percentage FROM t, q")(
    lambda s, d: rounded(numeric.single_box(read(s, d, "events"), "value"))
)
query("freq_top10_other", f"WITH c AS ({_counts_sql('part', 'p_brand')}), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank FROM c) SELECT rank, value AS label, n FROM o WHERE rank <= 10 UNION ALL SELECT 11, 'Other (remaining categories)', sum(n)::BIGINT FROM o WHERE rank > 10 HAVING sum(n) > 0")(
    lambda s, d: rounded(samples.top_and_other(read(s, d, "part"), "p_brand"))
)


# Semantic types, checks, scores

#: What the rules are to see in the tables, told by hand: columns in order with their kind (number, text, moment, nested) and
#: what the name hints at.
_SEEN = {
    "region": "r_regionkey:number r_name:text",
    "nation": "n_nationkey:number n_name:text n_regionkey:number",
    "customer": "c_custkey:number c_name:text c_nationkey:number c_acctbal:number c_mktsegment:text",
    "supplier": "s_suppkey:number s_name:text s_nationkey:number s_acctbal:number",
    "part": "p_partkey:number p_name:text p_brand:text p_type:text:category p_size:number p_retailprice:number",
    "orders": "o_orderkey:number o_custkey:number o_orderstatus:text o_totalprice:number o_orderdate:moment o_orderpriority:text",
    "lineitem": "l_orderkey:number l_partkey:number l_suppkey:number l_linenumber:number l_quantity:number l_extendedprice:number l_discount:number l_tax:number l_returnflag:text l_linestatus:text l_shipdate:moment",
    "events": "event_id:number:identifier ts:moment user_id:number:identifier event_type:text:category value:number:continuous props:text",
    "documents": "doc_id:number:identifier text:text:prose lang:text source:text n_chars:number",
    "labels": "doc_id:number:identifier quality:number toxic:number",
    "pages": "page_id:number:identifier url:text html:text",
    "benchmark": "item_id:number:identifier text:text:prose",
    "conversations": "conv_id:number:identifier turn:number role:text text:text:prose",
    "embeddings": "vec_id:number:identifier embedding:nested label:number:category",
    "messy": "event_id:number:identifier value:number:continuous event_type:text:category note:text version:number day_of:text",
}


def _semantic_sql(table: str, only: tuple[str, ...] = ()) -> str:
    """The rules as CASE over counts of each column's present values. Identifiers here rise in file order."""
    rows = []
    for i, (name, kind, *hint) in enumerate(x.split(":") for x in _SEEN[table].split() if not only or x.split(":")[0] in only):
        h, c = (hint or [""])[0], f"{name}::DOUBLE" if kind == "number" else name
        number = f"bool_and({c} = floor({c})) AS whole, min({c}) = 0 AND max({c}) = 1 AS flag" if kind == "number" else "true AS whole, false AS flag"
        text = f"avg(length({c})) AS size, avg(regexp_matches({c}, '\\s')::INT) AS spaced, avg(regexp_matches({c}, '[.!?;:,]')::INT) AS marked, avg(regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')::INT) AS dated" if kind == "text" else "0 AS size, 0 AS spaced, 0 AS marked, 0 AS dated"
        distinct = "NULL" if kind == "nested" else f"count(DISTINCT {c})"
        rows.append(f"SELECT {i} AS position, '{name}' AS column_name, '{kind}' AS kind, '{h}' AS hint, count({name}) AS n, {distinct} AS d, {number}, {text} FROM {input_sql(table)}")
    seen = " UNION ALL ".join(rows)
    return f"""WITH seen AS (SELECT *, d * 1.0 / n AS ratio, n > 10000 AS sampled FROM ({seen})), told AS (
  SELECT *, CASE WHEN kind = 'nested' THEN 'unknown' WHEN n = 0 THEN 'empty' WHEN d = 1 THEN 'constant' WHEN kind = 'moment' OR dated >= 0.95 THEN 'datetime'
    WHEN kind = 'number' AND hint = 'identifier' AND n >= 4 AND ratio >= 0.8 THEN 'identifier'
    WHEN kind = 'number' AND whole AND hint <> 'continuous' AND (d <= 20 OR (ratio <= 0.05 AND hint = 'category')) THEN 'numeric_discrete'
    WHEN kind = 'number' THEN 'numeric_continuous'
    WHEN (size >= 40 AND (ratio >= 0.5 OR greatest(spaced, marked) >= 0.5)) OR (hint = 'prose' AND size >= 20 AND greatest(spaced, marked) >= 0.5) THEN 'free_text'
    WHEN d < n AND (d <= 20 OR (ratio <= 0.05 AND hint = 'category')) THEN 'categorical' ELSE 'unknown' END AS semantic_type FROM seen
), sure AS (
  SELECT *, CASE WHEN semantic_type = 'constant' THEN 4 WHEN semantic_type = 'unknown' THEN 1 WHEN semantic_type = 'datetime' THEN 3
    WHEN semantic_type = 'identifier' THEN CASE WHEN ratio >= 0.98 AND NOT sampled THEN 3 ELSE 2 END
    WHEN semantic_type = 'numeric_continuous' AND NOT whole AND NOT sampled THEN 3 ELSE 2 END AS level FROM told
)
SELECT position::INT AS position, column_name, semantic_type, CASE WHEN level = 4 THEN 'high' WHEN level - (n < 10)::INT >= 3 THEN 'high' WHEN level - (n < 10 AND NOT (flag AND kind = 'number'))::INT = 2 THEN 'medium' ELSE 'low' END AS confidence, sampled AND kind <> 'nested' AS sampled,
  concat_ws(',', CASE WHEN kind = 'nested' THEN 'UNSUPPORTED_VALUES' WHEN semantic_type = 'identifier' THEN 'MULTIPLE_PLAUSIBLE_TYPES' WHEN flag AND d = 2 THEN 'BINARY_NUMERIC_AMBIGUITY' END,
    CASE WHEN semantic_type = 'identifier' AND ratio < 0.98 THEN 'DUPLICATE_IDENTIFIER_VALUES' END, CASE WHEN n < 10 AND semantic_type <> 'constant' THEN 'INSUFFICIENT_OBSERVATIONS' END) AS warnings
FROM sure"""


for _t in TABLES:
    query(f"semantic_types_{_t}", _semantic_sql(_t))(lambda s, d, t=_t: types_frame(read(s, d, t), infer_types(read(s, d, t))).select("position", "column_name", "semantic_type", "confidence", "sampled", F.array_join("warnings", ",").alias("warnings")))

_ANALYSES: dict[tuple, Analysis] = {}
#: Analyses that are kept.
_KEPT = 8


def _files(spark: SparkSession, sf: str) -> tuple:
    """What a folder holds: path, length and time of change of each file."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf)
    files, found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def analysis(spark: SparkSession, sf: str, name: str) -> Analysis:
    """Several queries show parts of one analysis; it is made once for each session and state of the folder's files."""
    key = (spark.sparkContext.applicationId, sf, name, _files(spark, sf))
    if key not in _ANALYSES:
        df = derived(spark, sf, name)
        names = [PADDED[0] if name == "messy" and c == "version" else c for c in df.columns]
        found = analyze_table(Table.of(df, names), name)
        for old in list(_ANALYSES)[: 1 - _KEPT]:
            del _ANALYSES[old]
        _ANALYSES[key] = found
    return _ANALYSES[key]


def _severity_sql(p: str) -> str:
    return f"CASE WHEN {p} <= 5 THEN 'low' WHEN {p} <= 20 THEN 'medium' WHEN {p} <= 40 THEN 'high' ELSE 'critical' END"


def _findings_sql() -> str:
    """All findings on messy, from its columns' known types: event_id identifier, value continuous, event_type categorical, note empty, version constant, day_of a date."""
    t = COLUMNS["messy"]
    shown = {c: (PADDED[0] if c == "version" else c) for c in t}
    finding = "SELECT '{id}' AS check_id, '{dim}' AS dimension, {col} AS column_name, {sev} AS severity, {a} AS affected, {p} AS population, '{fam}' AS family, {root} AS root_cause FROM t {having}"

    def one(check: str, dim: str, col: str | None, a: str, p: str, fam: str, sev: str | None = None, root: str = "NULL", having: str | None = None, structural: bool = False) -> str:
        pct = f"({a}) * 100.0 / ({p})"
        return finding.format(id=check, dim=dim, col="NULL" if col is None else f"'{shown[col]}'", sev=sev or _severity_sql(pct), a="NULL" if structural else f"({a})::BIGINT", p="NULL" if structural else f"({p})::BIGINT", fam=fam, root=root, having=having or f"HAVING ({a}) > 0")

    missing = lambda c: f"count(*) - count({c})"
    cells = " + ".join(missing(c) for c in t)
    inf = "count(*) FILTER (value = 'Infinity'::DOUBLE)"
    rows = [
        one("DQ_COMPLETENESS_DATASET_MISSINGNESS", "completeness", None, cells, f"count(*) * {len(t)}", "completeness_missingness"),
        *(one("DQ_COMPLETENESS_COLUMN_MISSINGNESS", "completeness", c, missing(c), "count(*)", "completeness_missingness", root="'identifier_missingness'" if c == "event_id" else "NULL", having=f"HAVING {missing(c)} > 0 AND count({c}) > 0") for c in t),
        *(one("DQ_COMPLETENESS_EMPTY_COLUMN", "completeness", c, "count(*)", "count(*)", "empty_column", "'high'", having=f"HAVING count({c}) = 0") for c in t),
        one("DQ_UNIQUENESS_DUPLICATE_ROWS", "uniqueness", None, "(SELECT sum(c - 1) FROM g)", "count(*)", "duplicate_rows"),
        one("DQ_UNIQUENESS_IDENTIFIER_VALUES", "uniqueness", "event_id", "count(event_id) - count(DISTINCT event_id)", "count(event_id)", "identifier_uniqueness"),
        one("DQ_VALIDITY_NONFINITE_NUMERIC", "validity", "value", inf, "count(*)", "nonfinite_numeric"),
        one("DQ_CONSISTENCY_COLUMN_NAME_WHITESPACE", "consistency", None, "1", str(len(t)), "column_label_consistency", "'medium'"),
        one("DQ_CONSISTENCY_CATEGORY_NORMALIZATION", "consistency", "event_type", "(SELECT sum(n) FROM k WHERE forms > 1)", "count(event_type)", "category_consistency", "'low'"),
        one("DQ_INTEGRITY_IDENTIFIER_MISSINGNESS", "integrity", "event_id", missing("event_id"), "count(*)", "identifier_missingness", root="'identifier_missingness'"),
        *(one("DQ_READINESS_CONSTANT_COLUMN", "analytical_readiness", c, "1", "1", "constant_column", "'medium'", having=f"HAVING count(*) > 1 AND count({c}) > 0 AND count(DISTINCT {c}) = 1", structural=True) for c in t if c != "event_id"),
        one("DQ_READINESS_HIGH_CARDINALITY", "analytical_readiness", "event_type", "1", "1", "high_cardinality", "'medium'", having="HAVING count(event_type) >= 10 AND count(DISTINCT event_type) >= 0.9 * count(event_type)", structural=True),
    ]
    return f"t AS (SELECT * FROM {input_sql('messy')}), g AS (SELECT count(*) AS c FROM t GROUP BY {', '.join(t)}), k AS (SELECT lower(trim(event_type)) AS v, count(DISTINCT event_type) AS forms, count(*) AS n FROM t WHERE event_type IS NOT NULL GROUP BY 1), f AS ({' UNION ALL '.join(rows)})"


_F = "WITH " + _findings_sql()
_SHOWN = "check_id, dimension, column_name, severity, affected, population, round((affected * 100.0 / population)::DOUBLE, 6) AS affected_percentage, family, root_cause"


def _found(spark: SparkSession, sf: str) -> DataFrame:
    a = analysis(spark, sf, "messy")
    return findings_frame(a.table, a.quality)


def _shown(df: DataFrame) -> DataFrame:
    return rounded(df.select("check_id", "dimension", "column_name", "severity", "affected", "population", "affected_percentage", "family", "root_cause"))


query("check_findings", f"{_F} SELECT {_SHOWN} FROM f")(lambda s, d: _shown(_found(s, d)))
for _check in CATALOGUE:
    _id = _check[0]
    if _id == "DQ_READINESS_HIGH_CARDINALITY":  # nothing of messy is so; addresses taken as categories are
        continue
    query(f"check_{_id.lower()}", f"{_F} SELECT {_SHOWN} FROM f WHERE check_id = '{_id}'")(lambda s, d, i=_id: _shown(_found(s, d).where(F.col("check_id") == i)))



def _near_unique(spark: SparkSession, sf: str) -> DataFrame:
    a = analyze_table(read(spark, sf, "pages").select("page_id", "url"), "pages", confirmed={"url": "categorical"})
    return _shown(findings_frame(a.table, a.quality).where("check_id = 'DQ_READINESS_HIGH_CARDINALITY'"))


query(
    "check_dq_readiness_high_cardinality",
    "SELECT 'DQ_READINESS_HIGH_CARDINALITY' AS check_id, 'analytical_readiness' AS dimension, 'url' AS column_name, 'medium' AS severity, NULL::BIGINT AS affected, NULL::BIGINT AS population, NULL::DOUBLE AS affected_percentage, 'high_cardinality' AS family, NULL::VARCHAR AS root_cause FROM pages HAVING count(url) >= 10 AND count(DISTINCT url) >= 0.9 * count(url)",
)(_near_unique)

#: On messy: checks of columns that apply to some types only, and the columns they apply to.
_SOME = {"DQ_UNIQUENESS_IDENTIFIER_VALUES": 1, "DQ_VALIDITY_NONFINITE_NUMERIC": 1, "DQ_CONSISTENCY_CATEGORY_NORMALIZATION": 1, "DQ_INTEGRITY_IDENTIFIER_MISSINGNESS": 1, "DQ_READINESS_HIGH_CARDINALITY": 1}
_RUNS = ", ".join(f"('{i}', '{dim}', {1 if scope == 'dataset' else len(COLUMNS['messy'])}, {1 if scope == 'dataset' else _SOME.get(i, len(COLUMNS['messy']))})" for i, _, dim, scope, *_ in CATALOGUE)
_COUNTS = "sum(targets)::BIGINT AS total, sum(ran)::BIGINT AS executed, sum(ran - bad)::BIGINT AS passed, sum(bad)::BIGINT AS failed, 0::BIGINT AS skipped, sum(targets - ran)::BIGINT AS not_applicable, 0::BIGINT AS errors, sum(bad)::BIGINT AS finding_count"
_RUN_SQL = f"{_F}, c AS (SELECT check_id, dimension, targets, ran, (SELECT count(*) FROM f WHERE f.check_id = x.check_id) AS bad FROM (VALUES {_RUNS}) x(check_id, dimension, targets, ran))"


def _run_summary(spark: SparkSession, sf: str) -> DataFrame:
    a = analysis(spark, sf, "messy")
    rows = executions_frame(a.table, a.quality)
    of = lambda c, v: F.count_if(F.col(c) == v)
    return rows.groupingSets([[], ["dimension"]], "dimension").agg(
        F.count("*").alias("total"), of("status", "executed").alias("executed"), of("outcome", "pass").alias("passed"), of("outcome", "fail").alias("failed"), of("status", "skipped").alias("skipped"),
        of("status", "not_applicable").alias("not_applicable"), of("status", "error").alias("errors"), F.sum("finding_count").alias("finding_count"),
    ).withColumn("dimension", F.coalesce("dimension", F.lit("total")))


query("check_run_summary", f"{_RUN_SQL} SELECT coalesce(dimension, 'total') AS dimension, {_COUNTS} FROM c GROUP BY GROUPING SETS ((), (dimension))")(_run_summary)

_BASE = "CASE severity WHEN 'low' THEN 0.20 WHEN 'medium' THEN 0.40 WHEN 'high' THEN 0.55 ELSE 0.80 END"
_PRICED = f"p AS (SELECT *, coalesce(root_cause, family) AS penalty_group, coalesce(column_name, '') AS target, coalesce(affected * 1.0 / population, 1.0)::DOUBLE AS prevalence, least(100.0, {_BASE} * (0.25 + 0.75 * coalesce(affected * 1.0 / population, 1.0)) * 100)::DOUBLE AS points FROM f), m AS (SELECT *, max(points) OVER (PARTITION BY penalty_group, target) AS most FROM p)"
# Of equal penalties the one with the larger id counts; ids are digests, so the query shows points and not which of two equals counts.
_APPLIED = "a AS (SELECT *, points = most AND row_number() OVER (PARTITION BY penalty_group, target ORDER BY points DESC, dimension) = 1 AS applied FROM m)"


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a = analysis(spark, sf, "messy")
    found = _found(spark, sf).select(F.lit("messy").alias("run"), "*", F.coalesce("column_name", F.lit("")).alias("target"))
    return scoring.penalty_points(found), executions_frame(a.table, a.quality).select(F.lit("messy").alias("run"), "*")


def _group_points(spark: SparkSession, sf: str) -> DataFrame:
    p = _scored(spark, sf)[0]
    return rounded(p.groupBy("penalty_group", "target").agg(F.count("*").alias("findings"), F.count_if("applied").alias("applied"), F.max("points").alias("points")))


query("penalty_points", f"{_F}, {_PRICED} SELECT penalty_group, target, count(*) AS findings, 1::BIGINT AS applied, round(max(points), 6) AS points FROM p GROUP BY penalty_group, target")(_group_points)

_WEIGHTS = "(VALUES ('completeness', 0.20), ('uniqueness', 0.15), ('validity', 0.20), ('consistency', 0.15), ('integrity', 0.20), ('analytical_readiness', 0.10)) w(dimension, w)"


def _dimension_sql() -> str:
    """Identifier missingness is found in completeness and integrity at one price; which of the two pays depends on the ids, so both are left out here."""
    return f"{_RUN_SQL.replace('WITH ', 'WITH ', 1)}, {_PRICED}, lost AS (SELECT dimension, sum(points) AS lost FROM p WHERE penalty_group <> 'identifier_missingness' GROUP BY dimension) SELECT w.dimension, (SELECT sum(ran) FROM c WHERE c.dimension = w.dimension)::BIGINT AS checks, round(greatest(0.0, 100 - coalesce(lost, 0))::DOUBLE, 6) AS score, round(w.w::DOUBLE, 6) AS weight FROM {_WEIGHTS} LEFT JOIN lost ON lost.dimension = w.dimension"


query("dimension_scores", _dimension_sql())(lambda s, d: (lambda p, e: rounded(scoring.dimension_scores(p.where("penalty_group <> 'identifier_missingness'"), e).drop("run")))(*_scored(s, d)))
query("overall_health", f"SELECT round(sum(score * weight)::DOUBLE, 6) AS overall, CASE WHEN sum(score * weight) >= 90 THEN 'excellent' WHEN sum(score * weight) >= 75 THEN 'good' WHEN sum(score * weight) >= 60 THEN 'needs_attention' WHEN sum(score * weight) >= 40 THEN 'poor' ELSE 'critical' END AS band FROM ({_dimension_sql()})")(
    lambda s, d: (lambda p, e: rounded(scoring.overall_health(scoring.dimension_scores(p.where("penalty_group <> 'identifier_missingness'"), e)).drop("run")))(*_scored(s, d))
)


def _health(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of messy. Its identifier's gaps have one price in completeness and in integrity, and the ids say which of the two
    pays; completeness is at zero either way, so integrity is left out here, and counts as whole in overall."""
    h = analysis(spark, sf, "messy").health
    lost = next(x.weight * (100 - x.score) for x in h.dimensions if x.dimension == "integrity")
    rows = [(x.dimension, x.score, x.checks, x.weight) for x in h.dimensions if x.dimension != "integrity"]
    return rounded(spark.createDataFrame([*rows, ("overall", h.overall + lost, None, 1.0)], "dimension string, score double, checks long, weight double"))


query(
    "health_scores",
    f"{_RUN_SQL}, {_PRICED}, lost AS (SELECT dimension, sum(points) AS lost FROM p WHERE dimension <> 'integrity' GROUP BY dimension), "
    f"s AS (SELECT w.dimension, greatest(0.0, 100 - coalesce(lost, 0))::DOUBLE AS score, (SELECT sum(ran) FROM c WHERE c.dimension = w.dimension)::BIGINT AS checks, w.w::DOUBLE AS weight FROM {_WEIGHTS} LEFT JOIN lost ON lost.dimension = w.dimension) "
    "SELECT dimension, round(score, 6) AS score, checks, round(weight, 6) AS weight FROM s WHERE dimension <> 'integrity' UNION ALL SELECT 'overall', round(sum(score * weight), 6), NULL, 1.0 FROM s",
)(_health)

_ACTION = " ".join(f"WHEN '{f}' THEN '{a[0]}'" for f, a in assess.ACTIONS.items())
_RANK = "max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END)"
query("recommendations_grouped", f"{_F} SELECT family, coalesce(column_name, '') AS target, dimension, CASE {_RANK} WHEN 4 THEN 'urgent' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority, CASE family {_ACTION} END AS action, count(*) AS source_findings FROM f GROUP BY family, column_name, dimension")(
    lambda s, d: scoring.recommendations(_scored(s, d)[0]).select("family", "target", "dimension", "priority", "action", "source_findings")
)
query("issue_matrix", f"{_F}, n AS (SELECT column_name, dimension, max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS r, count(*) AS n FROM f WHERE column_name IS NOT NULL GROUP BY ALL) SELECT c.column_name, w.dimension, coalesce(r, 0)::BIGINT AS severity_rank, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT column_name FROM n) c, {_WEIGHTS} LEFT JOIN n ON n.column_name = c.column_name AND n.dimension = w.dimension")(
    lambda s, d: rounded(scoring.issue_matrix(_found(s, d)))
)
query("affected_columns", f"{_F} SELECT column_name, {_RANK}::BIGINT AS severity_rank, count(*) AS n FROM f WHERE column_name IS NOT NULL GROUP BY column_name ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")(lambda s, d: rounded(scoring.affected_columns(_found(s, d))))
query("finding_counts", f"{_F} SELECT severity, dimension, count(*) AS n FROM f GROUP BY severity, dimension")(lambda s, d: _found(s, d).groupBy("severity", "dimension").agg(F.count("*").alias("n")))


# Readiness, targets, insights


def _readiness_sql(name: str, usable: int, unusable: int, categories: list[str], numbers: list[str]) -> str:
    t = COLUMNS[name]
    n, missing = len(t), " + ".join(f"count(*) - count({c})" for c in t)
    high = " + ".join(f"(SELECT (count(DISTINCT {c}) > greatest(20, floor(count({c}) * 0.5)))::INT FROM t)" for c in categories) or "0"
    spread = " + ".join(f"(SELECT (count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) > 0)::INT FROM t, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM t))" for c in numbers) or "0"
    rows = (
        ("data_sufficiency", 0.15, "(SELECT least(100.0, 40.0 + least(count(*), 1000) / 10.0) FROM t)"), ("data_completeness", 0.20, f"(SELECT 100 - ({missing}) * 100.0 / (count(*) * {n}) FROM t)"), ("feature_usability", 0.20, f"(100.0 * {usable} / {n})"),
        ("type_readiness", 0.15, f"(100.0 * (1 - {unusable} / {n}))"), ("cardinality_risk", 0.10, f"(100.0 * (1 - ({high}) / {max(1, len(categories))}))"), ("distribution_risk", 0.10, f"(100.0 * (1 - ({spread}) / {max(1, len(numbers))}))"),
        ("data_integrity", 0.10, f"(SELECT 100 - sum(c - 1) * 100.0 / sum(c) FROM (SELECT count(*) AS c FROM t GROUP BY {', '.join(t)}))"),
    )
    return f"WITH t AS (SELECT * FROM {input_sql(name)}) " + " UNION ALL ".join(f"SELECT '{k}' AS dimension, round({e}::DOUBLE, 6) AS score, {w}::DOUBLE AS weight" for k, w, e in rows)


def _readiness(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return rounded(spark.createDataFrame([(x.name, x.score, x.weight) for x in analysis(spark, sf, name).readiness.dimensions], "dimension string, score double, weight double"))


#: Known types of the columns: usable ones, unusable ones, categorical and numeric ones.
_READY = {
    "documents": (3, 1, ["lang", "source"], ["n_chars"]),
    "orders": (6, 0, ["o_orderstatus", "o_orderpriority"], ["o_orderkey", "o_custkey", "o_totalprice"]),
}
for _name, _args in _READY.items():
    query(f"readiness_dimensions_{_name}", _readiness_sql(_name, *_args))(lambda s, d, n=_name: _readiness(s, d, n))
    query(f"readiness_overall_{_name}", f"SELECT round(sum(score * weight)::DOUBLE, 3) AS overall FROM ({_readiness_sql(_name, *_args)})")(lambda s, d, n=_name: s.createDataFrame([(analysis(s, d, n).readiness.overall,)], "overall double"))


def _target_sql(table: str, column: str, number: bool) -> str:
    kind = f"CASE WHEN count(DISTINCT {column}) > 10 THEN 'regression_candidate' ELSE 'classification_candidate' END" if number else "'classification_candidate'"
    least = f"CASE WHEN count(DISTINCT {column}) > 1 THEN (SELECT min(n) FROM (SELECT count(*) AS n FROM t WHERE {column} IS NOT NULL GROUP BY {column})) / count({column}) END"
    return f"WITH t AS (SELECT * FROM {input_sql(table)}) SELECT '{column}' AS target, {kind} AS kind, count(*) - count({column}) AS missing_count, count(DISTINCT {column}) AS cardinality, round(({least})::DOUBLE, 6) AS minority_ratio, count(DISTINCT {column}) <= 1 AS constant, count(DISTINCT {column}) >= 0.95 * count({column}) AS identifier_like FROM t"


def _target(spark: SparkSession, sf: str, table: str, column: str) -> DataFrame:
    x = assess.analyze_target(derived(spark, sf, table), column)
    return rounded(spark.createDataFrame([(x.target, x.kind, x.missing_count, x.cardinality, x.minority_ratio, x.constant, x.identifier_like)], "target string, kind string, missing_count long, cardinality long, minority_ratio double, constant boolean, identifier_like boolean"))


for _t, _c, _number in (("labels_left", "toxic", True), ("orders", "o_totalprice", True), ("orders", "o_orderstatus", False)):
    query(f"target_analysis_{_c}", _target_sql(_t, _c, _number))(lambda s, d, t=_t, c=_c: _target(s, d, t, c))


def _insights(spark: SparkSession, sf: str) -> DataFrame:
    """Ids are digests that break ties only, so equal importance shares a rank here."""
    found = analysis(spark, sf, "messy").insights
    rows = [(1 + sum(y.importance > x.importance for y in found), x.family, x.importance, ", ".join(x.columns)) for x in found]
    return spark.createDataFrame(rows, "rank long, family string, importance int, columns string")


_CROWDED = "SELECT 'cardinality', 58, 'event_type' FROM t HAVING count(DISTINCT event_type) > greatest(20, floor(count(event_type) * 0.5))"
query(
    "insights_ranked",
    f"{_F} SELECT rank() OVER (ORDER BY importance DESC) AS rank, family, importance, columns FROM ("
    "SELECT 'quality' AS family, CASE WHEN severity IN ('high', 'critical') THEN 90 ELSE 65 END AS importance, coalesce(column_name, '') AS columns FROM f "
    f"UNION ALL SELECT 'outliers', 60, 'value' FROM ({_outlier_sql('messy', 'value')}) WHERE outlier_count > 0 UNION ALL {_CROWDED})",
)(_insights)
query(
    "insight_counts",
    f"{_F} SELECT 'quality' AS family, CASE WHEN severity IN ('high', 'critical') THEN 90 ELSE 65 END AS importance, count(*) AS n FROM f GROUP BY 1, 2 UNION ALL SELECT 'outliers', 60, 1 FROM ({_outlier_sql('messy', 'value')}) WHERE outlier_count > 0",
)(lambda s, d: s.createDataFrame([(x.family, x.importance) for x in analysis(s, d, "messy").insights], "family string, importance int").groupBy("family", "importance").agg(F.count("*").alias("n")))
query("type_histogram", f"SELECT semantic_type AS effective_type, count(*) AS n FROM ({_semantic_sql('messy')}) GROUP BY 1")(lambda s, d: facts.type_histogram(types_frame(analysis(s, d, "messy").table, list(analysis(s, d, "messy").profile.types))))


def _charts(spark: SparkSession, sf: str) -> DataFrame:
    from tablepulse.operators.charts import marks_frame, overview, report_charts

    a = analysis(spark, sf, "messy")
    return marks_frame(a, report_charts(a) + overview())


query("chart_marks")(_charts)


def _marks(spark: SparkSession, sf: str, name: str, spec: str, **given: str) -> DataFrame:
    from tablepulse.operators.charts import Wanted, marks

    return rounded(marks(analysis(spark, sf, name), Wanted(spec, **given)).select("label", "value", "detail"))


def _counted(column: str, values: tuple[str, ...], source: str) -> str:
    listed = ", ".join(f"('{v}')" for v in values)
    title = "array_to_string(list_transform(string_split(w.v, '_'), lambda x: upper(x[1]) || x[2:]), ' ')"
    return f"{_F} SELECT {title} AS label, count({column})::DOUBLE AS value, '' AS detail FROM (VALUES {listed}) w(v) LEFT JOIN ({source}) ON {column} = w.v GROUP BY w.v"


_DIMENSIONS = ("completeness", "uniqueness", "validity", "consistency", "integrity", "analytical_readiness")
_TITLED = "array_to_string(list_transform(string_split(dimension, '_'), lambda x: upper(x[1]) || x[2:]), ' ')"
_HEALTH = SQL["health_scores"]
_CELLS = " UNION ALL ".join(f"SELECT {i} AS place, '{PADDED[0] if c == 'version' else c}' AS label, count(*) - count({c}) AS missing, count(*) AS n FROM t" for i, c in enumerate(COLUMNS["messy"]))
query("chart_severities", _counted("severity", ("critical", "high", "medium", "low"), "SELECT severity FROM f"))(lambda s, d: _marks(s, d, "messy", "severities"))
query("chart_action_dimensions", _counted("dimension", _DIMENSIONS, "SELECT DISTINCT family, column_name, dimension FROM f"))(lambda s, d: _marks(s, d, "messy", "action_dimensions"))
query("chart_column_findings", _counted("dimension", _DIMENSIONS, "SELECT dimension FROM f WHERE column_name = 'event_id'"))(lambda s, d: _marks(s, d, "messy", "column_findings", column="event_id"))
query("chart_types", f"SELECT array_to_string(list_transform(string_split(semantic_type, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS label, count(*)::DOUBLE AS value, '' AS detail FROM ({_semantic_sql('messy')}) GROUP BY 1")(lambda s, d: _marks(s, d, "messy", "types"))
query("chart_missing_most", f"{_F} SELECT label, round((missing * 100.0 / n)::DOUBLE, 6) AS value, format('{{:,}}', missing) || ' missing' AS detail FROM ({_CELLS}) ORDER BY missing DESC, place LIMIT 5")(lambda s, d: _marks(s, d, "messy", "missing_most"))
query("chart_present", f"{_F}, x AS (SELECT count(day_of) AS a, count(*) - count(day_of) AS b, count(*) AS n FROM t) SELECT 'Present' AS label, a::DOUBLE AS value, printf('%.1f%%', 100 - b * 100.0 / n) AS detail FROM x UNION ALL SELECT 'Missing', b::DOUBLE, printf('%.1f%%', b * 100.0 / n) FROM x")(lambda s, d: _marks(s, d, "messy", "present", column="day_of"))
query("chart_quality", f"SELECT {_TITLED} AS label, score AS value, '' AS detail FROM ({_HEALTH}) WHERE dimension <> 'overall'")(lambda s, d: _marks(s, d, "messy", "quality").where("label <> 'Integrity'"))
query("chart_health", f"SELECT 'Data health' AS label, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Needs Attention' WHEN score >= 40 THEN 'Poor' ELSE 'Critical' END AS detail FROM ({_HEALTH}) WHERE dimension = 'overall'")(lambda s, d: _marks(s, d, "messy", "health").select("label", "detail"))
query("chart_readiness", f"SELECT 'Readiness' AS label, overall AS value FROM ({SQL['readiness_overall_orders']})")(lambda s, d: _marks(s, d, "orders", "readiness").select("label", F.round("value", 3).alias("value")))
query("chart_prepared", f"SELECT array_to_string(list_transform(string_split(dimension, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS label, score AS value FROM ({SQL['readiness_dimensions_orders']})")(lambda s, d: _marks(s, d, "orders", "prepared").select("label", F.round("value", 3).alias("value")))


# The shapes of the published baseline: a hundred thousand rows at sf0.1

_THREE = ("value", "event_type", "user_id")


def _profile_of_three(spark: SparkSession, sf: str) -> DataFrame:
    from tablepulse.operators.profile import profile_frame, profile_table

    table = Table.of(read(spark, sf, "events").select(*_THREE))
    return profile_frame(table, profile_table(table, infer_types(table)))


_X3 = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{kind}' AS kind, count(*) AS row_count, count(*) - count({c}) AS null_count, count({c}) AS non_null_count, round(((count(*) - count({c})) * 100.0 / count(*))::DOUBLE, 6) AS missing_percentage, count(DISTINCT {c}) AS distinct_count, round((count(DISTINCT {c}) * 1.0 / count({c}))::DOUBLE, 6) AS cardinality_ratio, '' AS warnings FROM events"
    for i, (c, kind) in enumerate((("value", "numeric"), ("event_type", "categorical"), ("user_id", "numeric")))
)
query("profile_events_x3", f"SELECT x.*, y.semantic_type AS effective_type FROM ({_X3}) x JOIN ({_semantic_sql('events', _THREE)}) y USING (column_name)")(lambda s, d: rounded(_profile_of_three(s, d).drop("dtype").withColumn("warnings", F.array_join("warnings", ","))))
_X4 = ("event_id", "value", "event_type", "user_id")
_RANKED = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(_X4))
query("semantic_events_x4", f"SELECT CASE column_name {_RANKED} END AS position, column_name, semantic_type FROM ({_semantic_sql('events', _X4)})")(lambda s, d: (lambda df: types_frame(df, infer_types(df)).select("position", "column_name", "semantic_type"))(read(s, d, "events").select(*_X4)))
query(
    "duplicate_rows_events",
    "WITH g AS (SELECT count(*) AS c FROM events GROUP BY value, event_type, user_id) SELECT sum(c)::BIGINT AS row_count, sum(c - 1)::BIGINT AS duplicate_row_count, round((sum(c - 1) * 100.0 / sum(c))::DOUBLE, 6) AS duplicate_row_percentage FROM g",
)(lambda s, d: rounded(facts.duplicate_rows(read(s, d, "events").select(*_THREE))))
