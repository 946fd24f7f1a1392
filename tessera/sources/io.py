"""Readers and writers: typed CSV ingest, format dispatch, keyed reads, idempotent sinks."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import exists, options_digest

#: Daily price file: names and types of its columns (fixed values).
OHLC_SCHEMA = T.StructType([
    T.StructField("PERMNO", T.LongType()), T.StructField("HdrCUSIP", T.StringType()), T.StructField("Ticker", T.StringType()), T.StructField("PERMCO", T.LongType()),
    T.StructField("DlyCalDt", T.StringType()), T.StructField("DlyCap", T.DoubleType()), T.StructField("DlyRet", T.DoubleType()), T.StructField("DlyRetx", T.DoubleType()),
    T.StructField("DlyVol", T.DoubleType()), T.StructField("DlyClose", T.DoubleType()), T.StructField("DlyLow", T.DoubleType()), T.StructField("DlyHigh", T.DoubleType()), T.StructField("DlyOpen", T.DoubleType()),
])
#: Columns of a second daily source and the names they get; caps are float and total shares times price (fixed values).
DSF_COLUMNS = {"oprc": "DlyOpen", "high": "DlyHigh", "low": "DlyLow", "prc": "DlyClose", "svol": "DlyVol", "ret": "DlyRet", "float": "DlyFloatCap", "totcap": "DlyTotalCap"}
OHLC_COLUMNS = ("PERMNO", "DlyCalDt", "DlyCap", "DlyRet", "DlyVol", "DlyClose", "DlyLow", "DlyHigh", "DlyOpen")


def read_ohlc_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed scan of daily price files, only the columns that are used; splits take the place of chunks."""
    return spark.read.schema(OHLC_SCHEMA).csv(path, header=True).select(*OHLC_COLUMNS).withColumn("DlyCalDt", F.to_date("DlyCalDt"))


def map_dsf(df: DataFrame) -> DataFrame:
    """Rows of the second source as daily prices with both caps; DlyCap is the float one. A code is digits, as a number.

    Without a cap column it raises ``KeyError``.
    """
    missing = [c for c in ("float", "totcap") if c not in df.columns]
    if missing:
        raise KeyError(f"no cap columns {missing}")
    out = df.select(F.col("SecuCode").cast("long").alias("PERMNO"), F.to_date("date").alias("DlyCalDt"), *(F.col(c).cast("double").alias(n) for c, n in DSF_COLUMNS.items()))
    return out.withColumn("DlyCap", F.col("DlyFloatCap"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A supplied daily price table of one series: date, open, high, low, close, volume, in any case and order."""
    d = read_table(spark, path)
    names = {c.lower(): c for c in d.columns}
    missing = [c for c in ("date", "close") if c not in names]
    if missing:
        raise KeyError(f"no columns {missing}")
    return d.select(F.to_date(names["date"]).alias("date"), *(F.col(names[c]).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume") if c in names))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By extension: csv (whose types are inferred by a scan where no ``schema`` is given), parquet (also gzipped), json,
    orc, or Arrow files (feather, ft), which tasks read a record batch at a time."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=schema is None, schema=schema)
    if kind in ("parquet", "gzip", "gz", "pq"):
        return spark.read.parquet(path)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind == "orc":
        return spark.read.orc(path)
    if kind in ("feather", "ft", "arrow"):
        return _read_arrow(spark, path)
    raise ValueError(f"unknown format: {path}")


def _read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files below ``path``: each is a row of Spark's binary files, and a task hands its record batches on. The first
    file's schema is that of all."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("content")

    def head(parts):
        for batch in parts:
            for data in batch.column(0):
                with pa.ipc.open_file(pa.BufferReader(data.as_buffer())) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([f.schema.serialize().to_pybytes()], pa.binary())], ["schema"])
                return

    first = files.mapInArrow(head, "schema binary").first()
    if first is None:
        raise ValueError(f"no file: {path}")
    schema = pa.ipc.read_schema(pa.BufferReader(first["schema"]))

    def run(parts):
        for batch in parts:
            for data in batch.column(0):
                with pa.ipc.open_file(pa.BufferReader(data.as_buffer())) as f:
                    for i in range(f.num_record_batches):
                        yield f.get_batch(i).select(schema.names)

    return files.mapInArrow(run, from_arrow_schema(schema))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    if not duplicate_keys(df, *keys).isEmpty():
        raise ValueError(f"keys {keys} are not unique")
    return df


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``, which must break ties."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def read_entity(df: DataFrame, entity, column: str = "entity") -> DataFrame:
    return df.where(F.col(column) == entity)


def read_row(df: DataFrame, entity, date, columns: tuple[str, str] = ("entity", "date")):
    """The one row of an entity at a date; an error if there is none."""
    row = df.where((F.col(columns[0]) == entity) & (F.col(columns[1]) == F.lit(date).cast("date"))).first()
    if row is None:
        raise KeyError((entity, date))
    return row


def entities(df: DataFrame, column: str = "entity") -> DataFrame:
    return df.select(column).distinct()


def append_columns(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("entity", "date")) -> DataFrame:
    """A block of columns onto a panel, by key; keys must be the same on both sides."""
    return left.join(right, list(keys), "inner")


def reconcile(parts: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """Row counts of two outputs that must agree, by ``by``, and whether they do."""
    a, b = parts.groupBy(by).agg(F.count("*").alias("n_parts")), labels.groupBy(by).agg(F.count("*").alias("n_labels"))
    return a.join(b, by, "full").select(by, F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.coalesce("n_labels", F.lit(0)).alias("n_labels")).withColumn("agree", F.col("n_parts") == F.col("n_labels"))


def write_panel(df: DataFrame, path: str, entity: str = "entity", date: str = "date") -> None:
    """Parquet clustered by entity and sorted by date: a read of one entity skips row groups by their statistics."""
    df.repartitionByRange(F.col(entity)).sortWithinPartitions(entity, date).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, entity: str = "entity", date: str = "date") -> None:
    """A table bucketed by entity, so later joins on it do not shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, entity).sortBy(entity, date).saveAsTable(name)


def write_by_scheme(df: DataFrame, path: str, column: str = "scheme") -> None:
    """One folder per weighting scheme."""
    df.repartition(column).write.mode("overwrite").partitionBy(column).parquet(path)


def write_dual(df: DataFrame, path: str) -> None:
    """Parquet for machines and CSV for people."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.coalesce(1).write.mode("overwrite").csv(f"{path}.csv", header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_run_meta(path: str, **meta) -> None:
    Path(path).write_text(json.dumps(meta, indent=1, default=str, sort_keys=True))


def resumed(spark: SparkSession, path: str, make, **options) -> DataFrame:
    """The table at ``path``, if it is complete and was made with these options; else ``make()`` is written there first.

    Spark's committer sets its marker last, and the options' digest follows as a file that readers pass over, so a run
    that was cut off, or one with other options, is done again.
    """
    mark = f"{path}/_options"
    digest = options_digest(options)
    done = exists(spark, f"{path}/_SUCCESS") and exists(spark, f"{mark}/_SUCCESS") and spark.read.text(mark).first()[0] == digest
    if not done:
        make().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return spark.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, or on this machine where Spark runs on it alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
    return f"{where}/tessera-scratch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_performance(perf: DataFrame, path: str) -> None:
    """A long performance table, a folder for each weighting scheme."""
    write_by_scheme(perf, path)


def read_performance(spark: SparkSession, path: str, scheme: str | None = None) -> DataFrame:
    """A stored performance table, or one scheme of it; an error if the scheme has no rows."""
    d = spark.read.parquet(path)
    if scheme is None:
        return d
    d = d.where(F.col("scheme") == scheme)
    if d.isEmpty():
        raise KeyError(scheme)
    return d


def performance_cell(perf: DataFrame, scheme: str, grp: int, metric: str) -> float | None:
    """One value of a performance table; an error if there is no such row."""
    row = perf.where((F.col("scheme") == scheme) & (F.col("grp") == grp) & (F.col("metric") == metric)).select("value").first()
    if row is None:
        raise KeyError((scheme, grp, metric))
    return row["value"]
