"""Gold tables and intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or an own folder where that is unset and all runs in one process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_stocktide_folder", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark._stocktide_folder = "file://" + tempfile.mkdtemp(prefix="stocktide-")
    return path.rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back: cuts lineage for frames that several branches read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_gold(tables: dict[str, DataFrame], folder: str, csv: bool = True) -> None:
    """Each table as Parquet and, for other tools, as CSV with a header."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        if csv:
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def read_gold(spark: SparkSession, folder: str, name: str, required: bool = True) -> DataFrame | None:
    """Parquet, else CSV; a missing optional table is None, a missing required one an error."""
    for kind in ("parquet", "csv"):
        path = f"{folder}/{name}.{kind}"
        if exists(spark, path):
            return spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).option("inferSchema", True).csv(path)
    if required:
        raise FileNotFoundError(f"{folder}/{name}")
    return None


def log_run(df_or_values, spark: SparkSession, path: str, run_id: str) -> None:
    """Appends parameters and metrics as (run_id, key, value)."""
    rows = [(run_id, str(k), str(v)) for k, v in df_or_values.items()]
    spark.createDataFrame(rows, "run_id string, key string, value string").write.mode("append").parquet(path)


def json_records(df: DataFrame, places: int = 5) -> DataFrame:
    """One JSON text a row: doubles rounded, dates in ISO form, NULLs written as null."""
    cols = [F.round(c, places).alias(c) if t in ("double", "float") else F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def columnar_json(df: DataFrame, key: str, date: str, values: list[str], places: int = 2) -> DataFrame:
    """A row for each key: its dates and, for each value, its numbers in order of date."""
    g = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.date_format(date, "yyyy-MM-dd").alias("d"), *(F.round(v, places).alias(v) for v in values)))).alias("x"))
    return g.select(F.to_json(F.struct(F.col(key).alias("id"), F.col("x.d").alias("dates"), *(F.col(f"x.{v}").alias(v) for v in values))).alias("json"))
