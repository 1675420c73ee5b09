"""Validation of what files hold: a manifest of shapes and checksums, and what differs from it.

A file has its SHA-256 (read whole by the binaryFile source). A table has its columns, its rows, and order-free checksums: sum and exclusive or of
the rows' hashes, and for each column the sum of hashes of (key, value), so that rows may lie in any order or file. From these one lost, doubled or
added row and a changed column are told apart without a second copy of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import m5

MANIFEST = "kind string, name string, part string, rows long, total decimal(38,0), parity long, text string"


def _row_hash(df: DataFrame):
    return F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")) for c in df.columns))


def _total(h):
    return F.sum(h.cast("decimal(38,0)"))


def table_checksums(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """MANIFEST rows of one table: itself (its columns as text), and each column that is no key."""
    h = _row_hash(df)
    whole = df.agg(F.count("*").alias("rows"), _total(h).alias("total"), F.bit_xor(h).alias("parity")).select(F.lit("table").alias("kind"), F.lit(name).alias("name"), F.lit("").alias("part"), "rows", F.coalesce("total", F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"), F.coalesce("parity", F.lit(0)).alias("parity"), F.lit("\n".join(f"{c} {t}" for c, t in df.dtypes)).alias("text"))
    rest = [c for c in df.columns if c not in keys]
    long = df.select(*(F.col(f"`{c}`") for c in keys), *(F.col(f"`{c}`").cast("string").alias(c) for c in rest)).unpivot(keys, rest, "_column", "_value")
    cell = F.xxhash64(*(F.col(k) for k in keys), F.col("_column"), F.coalesce("_value", F.lit("\0null")))
    columns = long.groupBy(F.col("_column").alias("part")).agg(F.count("*").alias("rows"), _total(cell).cast("decimal(38,0)").alias("total"), F.bit_xor(cell).alias("parity"))
    return whole.unionByName(columns.select(F.lit("column").alias("kind"), F.lit(name).alias("name"), "part", "rows", "total", "parity", F.lit("").alias("text")))


def file_checksums(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.lit("file").alias("kind"), F.substring_index("path", "/", -1).alias("name"), F.lit("").alias("part"), F.col("length").alias("rows"), F.lit(0).cast("decimal(38,0)").alias("total"), F.lit(0).cast("long").alias("parity"), F.sha2("content", 256).alias("text"))


def manifest(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], folder: str | None = None) -> DataFrame:
    """tables: name -> (table, its key). MANIFEST rows, to be written beside the data."""
    out = spark.createDataFrame([], MANIFEST) if folder is None else file_checksums(spark, folder).select(*(c.split()[0] for c in MANIFEST.split(", ")))
    for name, (df, keys) in tables.items():
        out = out.unionByName(table_checksums(df, name, keys))
    return out


def differences(known: DataFrame, now: DataFrame) -> list[str]:
    """What differs between two manifests, in order of names: empty if nothing does. Both are a row a file, table and column."""
    of = lambda m: {(r.kind, r.name, r.part): r for r in m.collect()}
    a, b, said = of(known), of(now), []
    for kind, name, part in sorted(set(a) | set(b)):
        old, new = a.get((kind, name, part)), b.get((kind, name, part))
        if old is None or new is None:
            if kind != "column" or ("table", name, "") in a and ("table", name, "") in b:
                said.append(f"{kind} {name}{f'.{part}' if part else ''} {'was not there' if old is None else 'is missing'}")
        elif kind == "file" and old.text != new.text:
            said.append(f"file {name}: contents changed, {old.rows} bytes before, {new.rows} now")
        elif kind == "table":
            if old.text != new.text:
                said.append(f"table {name}: columns changed")  # rows are then not comparable by their hashes
            more, moved, flipped = new.rows - old.rows, new.total - old.total, old.parity ^ new.parity
            if more:
                one = abs(more) == 1 and old.text == new.text and moved == more * flipped
                said.append(f"table {name}: {abs(more)} row{'s' * (abs(more) > 1)} {'more' if more > 0 else 'fewer'} than {old.rows}" + (f", the one of hash {flipped}" if one else ""))
            elif old.text == new.text and (moved or flipped):
                changed = sorted(p for k, n, p in set(a) & set(b) if k == "column" and n == name and (a[k, n, p].total, a[k, n, p].parity) != (b[k, n, p].total, b[k, n, p].parity))
                said.append(f"table {name}: values changed in {', '.join(changed) or 'its key'}")
    return said


#: The raw files' tables and their keys.
KEYS = {"sales": ["item_id", "store_id"], "calendar": ["date"], "prices": ["store_id", "item_id", "wm_yr_wk"]}


def raw_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Of the raw files and the tables in them."""
    return manifest(spark, {n: (df, KEYS[n]) for n, df in zip(KEYS, m5.load(spark, folder), strict=True)}, folder)


def verify(spark: SparkSession, folder: str, path: str) -> list[str]:
    """What differs from the manifest at path, and what is wrong with shapes and keys; empty if nothing is."""
    return differences(spark.read.parquet(path), raw_manifest(spark, folder)) + m5.validate(*m5.load(spark, folder))


def rows_of_hash(df: DataFrame, value: int) -> DataFrame:
    """The rows that a difference names by their hash; a doubled row comes twice."""
    return df.where(_row_hash(df) == value)
