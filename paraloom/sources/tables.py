"""Reading the tables of a data folder, and writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.session import ship


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table; with ``columns``, only these (others never leave the file)."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet", single_file: bool = False) -> str:
    """Write a result table, keeping its column order; CSV doubles quotes and keeps line breaks.

    ``single_file`` is for small reports only.
    """
    path = f"{folder}/{name}"
    out = df.coalesce(1) if single_file else df
    if fmt == "csv":
        nested = [c for c, kind in out.dtypes if kind.startswith(("array", "map", "struct"))]
        out = out.withColumns({c: F.to_json(c) for c in nested}) if nested else out
        out.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        out.write.mode("overwrite").parquet(path)
    return path
