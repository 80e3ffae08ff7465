"""JSON lines, delimited tables and the stored index: strict readers, committed writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import exists
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Strict: a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def unknown_fields(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(field, rows): fields of the file that the schema does not name, from the lines as they are."""
    keys = spark.read.text(path).filter(F.trim("value") != "").select(F.explode(F.json_object_keys("value")).alias("field"))
    return keys.filter(~F.col("field").isin(schema.fieldNames())).groupBy("field").agg(F.count(F.lit(1)).alias("rows"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Committed as a whole or not at all."""
    df.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str, columns: list[str], sep: str = ",", strict: bool = True) -> DataFrame:
    """A delimited table with a header, all text; not strict: short rows are filled with '' and extra cells dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("enforceSchema", not strict)
    df = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)
    return df if strict else df.select(*[F.coalesce(F.regexp_replace(c, "^﻿", ""), F.lit("")).alias(c) for c in columns])


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("lineSep", "\n").option("escape", '"').csv(path)


def pruned(spark: SparkSession, path: str, keep: list[str]) -> DataFrame:
    """A columnar table with only the columns asked for; a ``year=`` folder is a column that prunes."""
    return spark.read.parquet(path).select(*keep)


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, bytes) of files, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"))


def complete(df: DataFrame, stored: dict[str, int]) -> bool:
    """Whether a table still has the rows and digest it was stored with."""
    from lexmill.operators.catalog import manifest

    row = manifest(df, *df.columns).first()
    return {"rows": row["rows"], "digest": row["digest"]} == stored


def append_only_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows of ``df`` whose key a stored table does not have yet; all where nothing is stored.  A table that cannot be read is an error."""
    spark = df.sparkSession
    if not exists(spark, path):
        return df
    return df.join(spark.read.parquet(path).select(key), key, "left_anti")
