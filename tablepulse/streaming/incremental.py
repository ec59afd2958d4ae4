"""Facts of a stream: windowed counts with a watermark, and column facts kept up to date batch by batch.

Facts of a batch are counts, extremes, means and squared distances, which can be merged; only those of the batch are computed, and
they are merged with the stored ones, so no row is read twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepulse.functions.dates import native_micros
from tablepulse.operators.frame import Table
from tablepulse.operators.lineage import shared_dir
from tablepulse.plans.queries import query, read


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """(start, event_type, n, total, missing) of each window; rows later than the watermark are left out. Times without zone count as UTC."""
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        events = events.withColumn("ts", F.timestamp_micros(native_micros(F.col("ts"), "timestamp_ntz")))
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(F.col("value").isNull()).alias("missing")).select(F.col("w.start").alias("start"), "event_type", "n", "total", "missing")


PARTS = ("row_count", "null_count", "finite_count", "minimum", "maximum", "mean", "m2")


def partial_facts(batch: DataFrame) -> DataFrame:
    """What can be merged, of each column: position, column_name, row_count, null_count and, of finite numbers, count, extremes, mean and the
    sum of squared distances from it (m2)."""
    table = Table.of(batch)
    columns = []
    for i, name in enumerate(table.names):
        v = table.finite(i) if table.is_numeric(i) else F.lit(None).cast("double")
        facts = (F.lit(i), F.lit(name), F.count("*"), F.count_if(table.missing(i)), F.count(v), F.min(v), F.max(v), F.avg(v), F.var_pop(v) * F.count(v))
        columns.append(F.struct(*(c.alias(n) for c, n in zip(facts, ("position", "column_name", *PARTS), strict=True))))
    return table.df.agg(F.array(*columns).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def added(parts: DataFrame) -> DataFrame:
    """Parts of each column as one part. Distances are taken from the common mean (Chan, Golub, LeVeque), so that none of them is the
    difference of two large sums: m2 of all is the sum of the parts' m2 and of n (mean - common mean)^2."""
    key = ["position", "column_name"]
    # the common mean is a sum of shifts from one of the means, for the same reason
    near = F.first("mean", ignorenulls=True).over(Window.partitionBy(*key).orderBy("mean").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shift = F.col("finite_count") * (F.col("mean") - F.col("near"))
    common = F.col("near") + F.sum(shift).over(Window.partitionBy(*key)) / F.sum("finite_count").over(Window.partitionBy(*key))
    near_rows = parts.withColumn("near", near).withColumn("common", F.when(F.sum("finite_count").over(Window.partitionBy(*key)) > 0, common))
    apart = F.col("finite_count") * F.pow(F.col("mean") - F.col("common"), F.lit(2))
    sums = [F.sum(c).alias(c) for c in ("row_count", "null_count", "finite_count")]
    ends = [F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum")]
    return near_rows.groupBy(*key).agg(*sums, *ends, F.first("common", ignorenulls=True).alias("mean"), F.sum(F.col("m2") + apart).alias("m2"))


def merged(parts: DataFrame) -> DataFrame:
    """Facts of all batches together, with mean and variance. parts: one row for each column and stored batch."""
    variance = F.when(F.col("finite_count") > 1, F.col("m2") / (F.col("finite_count") - 1))
    return added(parts).select("position", "column_name", "row_count", "null_count", "finite_count", "minimum", "maximum", "mean", variance.alias("variance"))


#: Stored batches after which they are written as one.
STORED = 32


class Batches:
    """Numbered batches in a folder; a batch that comes again replaces itself. Every STORED of them are written as one, under the number of
    the last, and names what it covers, so that what a look reads doesn't grow with the stream; folders that are covered are then removed."""

    def __init__(self, path: str, add: Callable[[DataFrame], DataFrame]) -> None:
        self.path, self.add = path, add

    def _folders(self, spark: SparkSession) -> dict[str, list[int]]:
        """Numbers below batch= (single ones) and upto= (merged ones), ascending."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return {kind: sorted(int(n.split("=")[1]) for n in done if n.startswith(f"{kind}=")) for kind in ("batch", "upto")}

    def stored(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """All batches (up to one), each once, with column batch."""
        found = self._folders(spark)
        last = max((n for n in found["upto"] if upto is None or n <= upto), default=-1)
        names = [f"upto={last}"] * (last >= 0) + [f"batch={n}" for n in found["batch"] if n > last and (upto is None or n <= upto)]
        return reduce(DataFrame.unionByName, (spark.read.parquet(f"{self.path}/{n}").withColumn("batch", F.lit(int(n.split("=")[1])).cast("long")) for n in names))

    def write(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        found = self._folders(spark)
        last = max(found["upto"], default=-1)
        single = [n for n in found["batch"] if last < n < number]  # the present one may still come again
        if len(single) >= STORED:
            self.add(self.stored(spark, single[-1])).write.mode("overwrite").parquet(f"{self.path}/upto={single[-1]}")
            for gone in [*(f"batch={n}" for n in found["batch"] if n <= single[-1]), *(f"upto={n}" for n in found["upto"])]:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{gone}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class FactsSink:
    """A foreachBatch sink: writes each batch's partial facts under its number, so a batch that comes again replaces itself."""

    def __init__(self, path: str) -> None:
        self.batches = Batches(path, lambda parts: added(parts).coalesce(1))

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.batches.write(partial_facts(batch).coalesce(1), number)

    def facts(self, spark: SparkSession) -> DataFrame:
        return merged(self.batches.stored(spark).drop("batch"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4()}"


def _run(spark: SparkSession, sf: str, make) -> DataFrame:  # noqa: ANN001
    schema = read(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").load(sf)
    return make(source)


class LatestSink:
    """A foreachBatch sink for a stream in update mode: a batch's changed rows are written under its number; of rows with one
    key the last batch's counts. Nothing is held on the driver."""

    def __init__(self, path: str, *key: str) -> None:
        self.key = key
        self.batches = Batches(path, self._latest)

    def _latest(self, rows: DataFrame) -> DataFrame:
        facts = [c for c in rows.columns if c not in (*self.key, "batch")]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*facts), "batch").alias("x")).select(*self.key, "x.*")

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.batches.write(batch, number)

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._latest(self.batches.stored(spark))


def streamed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """All windows of the events, by a stream that runs until nothing is left."""
    sink = LatestSink(_folder(spark, "counts"), "start", "event_type")
    counts = _run(spark, sf, lambda s: windowed_counts(s))
    running = counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", _folder(spark, "counts")).trigger(availableNow=True).start()
    running.awaitTermination()
    return sink.rows(spark)


def streamed_facts(spark: SparkSession, sf: str) -> DataFrame:
    sink = FactsSink(_folder(spark, "facts"))
    running = _run(spark, sf, lambda s: s.withColumn("shifted", F.col("value") + 1e9)).writeStream.foreachBatch(sink).option("checkpointLocation", _folder(spark, "facts")).trigger(availableNow=True).start()
    running.awaitTermination()
    return sink.facts(spark)


query(
    "streaming_windowed_counts",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value)::DOUBLE, 4) AS total, count(*) - count(value) AS missing FROM events GROUP BY 1, 2",
)(lambda s, d: streamed_counts(s, d).select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("start") / 86_400).cast("int")).cast("string").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "missing"))
_FACTS = "SELECT '{n}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, round(min({c})::DOUBLE, 6) AS minimum, round(max({c})::DOUBLE, 6) AS maximum, round(avg({c})::DOUBLE, {m}) AS mean, round(var_samp({c})::DOUBLE, 2) AS variance FROM events"
query("streaming_column_facts", f"{_FACTS.format(n='value', c='value', m=6)} UNION ALL {_FACTS.format(n='shifted', c='(value + 1e9)', m=4)}")(
    lambda s, d: (
        streamed_facts(s, d)
        .where("column_name IN ('value', 'shifted')")
        .select("column_name", "row_count", "null_count", *(F.round(c, 6).alias(c) for c in ("minimum", "maximum")), F.when(F.col("column_name") == "value", F.round("mean", 6)).otherwise(F.round("mean", 4)).alias("mean"), F.round("variance", 2).alias("variance"))
    )
)
