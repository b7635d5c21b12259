"""Table readers and writers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import require_columns


def utc(spark: SparkSession) -> SparkSession:
    """Times are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def nan_to_null(df: DataFrame) -> DataFrame:
    """A stored NaN is a missing value."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats}) if floats else df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = utc(spark).read.parquet(path)
    return nan_to_null(require_columns(df, columns, path).select(*columns) if columns else df)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and an explicit schema, so ids stay text."""
    return nan_to_null(utc(spark).read.schema(schema).csv(path, header=True))


def load_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        return read_parquet(spark, path)
    if suffix == ".csv":
        if schema is None:
            raise ValueError("a csv table needs a schema")
        return read_csv(spark, path, schema)
    raise ValueError(f"unsupported table format: {suffix}")


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", columns)


def read_regime(spark: SparkSession, path: str, regime: str) -> DataFrame:
    """One regime of a dataset partitioned by ``regime``: only its folder is listed and read."""
    return read_parquet(spark, path).where(F.col("regime") == regime)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def replace_table(df: DataFrame, path: str) -> int:
    """Write beside the target, check the row count, then swap the two by renaming.

    The input is computed once, its rows are counted while they are written, and
    ``df`` may read the target: nothing of it changes before the copy is whole.
    A reader sees the old or the new table; a failed check leaves the old one
    and no staging folder.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    staging, old = f"{path}__staging", f"{path}__old"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    rows = Observation("rows")
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(staging)
    expected = rows.get["n"]
    found = spark.read.parquet(staging).count()
    if found != expected:
        fs.delete(at(staging), True)
        raise RuntimeError(f"staged {found} rows, expected {expected}; target left as it was")
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise RuntimeError("the target cannot be moved aside")
    if not fs.rename(at(staging), at(path)):
        fs.rename(at(old), at(path))
        raise RuntimeError("the staged table cannot take the target's place; target left as it was")
    fs.delete(at(old), True)
    spark.catalog.refreshByPath(path)
    return expected
