"""File sources and sinks: JSON lines with malformed rows counted, CSV matrices, sorted exports, artifact indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines); empty lines and comment headers are skipped."""
    lines = spark.read.text(path).filter(~F.trim("value").rlike("^(#.*)?$"))
    parsed = lines.select("value", F.from_json("value", schema).alias("r"), F.expr("try_parse_json(value)").isNull().alias("bad"))
    return parsed.filter("not bad").select("r.*"), parsed.filter("bad").select("value")


def read_matrix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV matrix; empty cells are NULL."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="")


def write_sorted(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Columns in name order, the keys first."""
    keys = [c for c in ("wallet", "row_id") if c in df.columns]
    out = df.select(*keys, *sorted(c for c in df.columns if c not in keys))
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path) if kind == "json" else writer.parquet(path)


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys old lacks, each key once, below those of old."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def artifact_index(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 of the files of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
