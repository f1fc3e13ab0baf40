"""Sinks: spreadsheets, JSON documents, and a spool that keeps some days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spreadsheet_cell(column: Column) -> Column:
    """Text of a value: blank for null, and never a formula."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Stable columns, CRLF line ends, header, formula cells made text."""
    safe = df.select(*[spreadsheet_cell(F.col(c)).alias(c) for c in columns])
    safe.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def json_documents(df: DataFrame, key: str) -> DataFrame:
    """``key, document``: one JSON object a row, fields in the order of their names."""
    names = sorted(c for c in df.columns if c != key)
    return df.select(key, F.to_json(F.struct(key, *names)).alias("document"))


def append_spool(df: DataFrame, path: str, day: Column) -> None:
    """Append rows to a Parquet spool partitioned by ``day``."""
    df.withColumn("day", day.cast("date")).write.mode("append").partitionBy("day").parquet(path)


def prune_spool(spark: SparkSession, path: str, today: date, days: int = 7) -> list[str]:
    """Delete the day partitions older than ``days``; returns those that went."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    gone = []
    oldest = (today - timedelta(days=days)).isoformat()
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < oldest:
            fs.delete(status.getPath(), True)
            gone.append(name[4:])
    return sorted(gone)


def load_rules(path: str) -> list[tuple[str, dict]]:
    """Ordered (pattern, values) rules of a small JSON file; rules with values that are no numbers >= 0 are refused."""
    import json

    with open(path, encoding="utf-8") as f:
        rules = json.load(f).get("rules", {})
    for pattern, values in rules.items():
        for name, value in values.items():
            if isinstance(value, bool) or not isinstance(value, int | float) or value != value or value < 0:
                raise ValueError(f"{pattern}.{name} is no number of at least 0")
    return list(rules.items())
