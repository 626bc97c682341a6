"""Writers: Parquet by year or quarter, CSV, JSON manifests, Markdown reports and plots."""

from __future__ import annotations

import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_bytes

UNKNOWN = "unknown"
#: Tasks, and so files, a year or quarter is written by, at most.
SALTS = 16


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Zstandard Parquet."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_by_year(df: DataFrame, path: str, date: str = "application_date") -> None:
    """One directory per year of ``date``; rows without one go to ``unknown``."""
    _partitioned(df.withColumn("application_year", F.coalesce(F.year(date).cast("string"), F.lit(UNKNOWN))), path, "application_year")


def write_by_quarter(df: DataFrame, path: str, quarter: str = "quarter") -> None:
    """One directory per quarter; rows without one go to ``unknown``."""
    key = "application_quarter"
    _partitioned(df.withColumn(key, F.coalesce(quarter, F.lit(UNKNOWN))), path, key)


def _partitioned(df: DataFrame, path: str, key: str) -> None:
    # A period is spread over SALTS tasks, so that none is one task; a range would sample and so run the plan twice.
    df.repartition(F.col(key), F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).write.mode("overwrite").option("compression", "zstd").partitionBy(key).parquet(path)


def read_known(spark, path: str, key: str = "application_year") -> DataFrame:
    """A partitioned table without its ``unknown`` directory, which is never listed into the scan."""
    return spark.read.parquet(path).where(F.col(key).cast("string") != UNKNOWN)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in UTF-8. A byte-order mark is put before the first column name, as spreadsheets expect."""
    named = [F.col(c).alias(("﻿" if i == 0 else "") + c) for i, c in enumerate(df.columns)]
    df.select(*named).write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """A manifest, summary or checkpoint document, on the file system of ``path``."""
    write_bytes(spark, path, json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True, default=str).encode())


def fingerprint(spark, path: str) -> dict:
    """Files, bytes and latest change of an input, by which a finished stage is recognised."""
    row = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").cast("string").alias("changed")
    )
    return row.first().asDict()


def markdown_table(df: DataFrame) -> str:
    """All rows as a Markdown table; meant for summaries."""
    rows = df.collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)


def write_report(spark: SparkSession, path: str, title: str, facts: dict, tables: dict[str, DataFrame]) -> None:
    """A Markdown report of single facts and small tables."""
    parts = [f"# {title}", *[f"- {k}: {v}" for k, v in facts.items()], *[f"## {k}\n\n{markdown_table(t)}" for k, t in tables.items()]]
    write_bytes(spark, path, ("\n\n".join(parts) + "\n").encode())


def write_plots(metrics: DataFrame, columns: list[str], path: str, order: str = "quarter") -> bool:
    """Line plots of a quarterly table; False where the plotting library is missing."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return False
    frame = metrics.select(order, *columns).orderBy(order).toPandas()
    fig, axes = plt.subplots(-(-len(columns) // 2), 2, figsize=(12, 3 * -(-len(columns) // 2)), squeeze=False)
    for ax, c in zip(axes.flat, columns):
        ax.plot(frame[order], frame[c])
        ax.set_title(c)
        ax.set_xticks(frame[order][:: max(1, len(frame) // 8)])
    fig.tight_layout()
    image = io.BytesIO()
    fig.savefig(image, format="png")
    plt.close(fig)
    write_bytes(metrics.sparkSession, path, image.getvalue())
    return True
