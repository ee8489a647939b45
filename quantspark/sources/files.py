"""CSV, JSON and YAML sources, report sinks, and Parquet rewriting."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV files by a given schema, which spares the pass that would infer one; broken lines are an error."""
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a given schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_report(df: DataFrame, path: str, kind: str = "csv", files: int | None = None) -> None:
    """A report as CSV with a header or as JSON lines, in as many files as df has parts unless fewer are asked for."""
    rows = df.coalesce(files) if files else df
    if kind == "csv":
        rows.write.option("header", True).csv(path)
    elif kind == "json":
        rows.write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError("kind must be csv or json")


def read_dimension(spark: SparkSession, text: str, key: str, value: str, kind: str = "json") -> DataFrame:
    """(key, value) rows of a small mapping, name to name or to a list of names, given as JSON or YAML text."""
    if kind == "yaml":
        import yaml

        entries = yaml.safe_load(text) or {}
    else:
        entries = json.loads(text)
    rows = [(str(k), str(v)) for k, values in entries.items() for v in (values if isinstance(values, list) else [values])]
    return spark.createDataFrame(rows, f"{key} string, {value} string")


def rewrite_parquet(df: DataFrame, path: str, by: Sequence[str] = (), order: Sequence[str] = (), codec: str = "zstd") -> DataFrame:
    """df as Parquet in folders by some columns, each part sorted so that row groups can be skipped; read back."""
    rows = df.sortWithinPartitions(*by, *order) if by or order else df
    rows.write.option("compression", codec).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def write_posts(posts: DataFrame, path: str) -> None:
    """Posts as JSON lines in folders by subreddit and day; authors leave as hashes only."""
    rows = posts.withColumn("author_id", F.coalesce("author_id", F.sha2("author", 256))).drop("author")
    rows = rows.withColumns({"date": F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd"), "place": F.col("subreddit")})
    rows.write.mode("append").partitionBy("place", "date").json(path)


def run_batches(stream: DataFrame, folder: str, name: str, on_batch: Callable[[DataFrame, int], None]) -> None:
    """Calls on_batch(rows, number) for each micro-batch of everything available; a batch may come twice after a loss, so
    on_batch should write by its number."""
    state = scratch(folder, name)
    stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
