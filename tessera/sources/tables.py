"""Table readers and writers with explicit schemas."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WRITERS = ("jsonl", "parquet", "csv")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder (SRC3); Catalyst prunes the columns."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, names: Iterable[str], register: bool = False) -> dict[str, DataFrame]:
    """Only the named tables of a folder, lazily (SRC1, SRC2); optionally as temporary views."""
    tables = {name: read_table(spark, folder, name) for name in names}
    if register:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under an explicit schema (SRC4): types are never inferred, lines that are no JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def resolve_input(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """``base``.parquet, else ``base``.jsonl, else FileNotFoundError (SRC5, SRC6)."""
    for suffix, read in ((".parquet", lambda p: spark.read.parquet(p)), (".jsonl", lambda p: read_jsonl(spark, p, schema))):
        try:
            return read(base + suffix)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(f"neither {base}.parquet nor {base}.jsonl")


def resolve_inputs(spark: SparkSession, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Several inputs that are all needed (SRC6): path without suffix to table; FileNotFoundError names every one that is missing."""
    found, missing = {}, []
    for base, schema in schemas.items():
        try:
            found[base] = resolve_input(spark, base, schema)
        except FileNotFoundError:
            missing.append(base)
    if missing:
        raise FileNotFoundError(f"neither Parquet nor JSON lines: {', '.join(missing)}")
    return found


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may be missing: then it is empty, and its stage does nothing (SRC7)."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def latest_per_key(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with one key, the last in ``order`` (SRC8, JON6); rows without a key are dropped."""
    kept = lines.where(F.col(key).isNotNull())
    row = F.struct(*[F.col(c) for c in lines.columns])
    return kept.groupBy(key).agg(F.max_by(row, F.col(order)).alias("_row")).select("_row.*")


def write_table(df: DataFrame, folder: str, name: str, formats: Iterable[str] = ("parquet",), single_file: bool = False) -> dict[str, str]:
    """Writes in each format (SNK1, SNK5); returns the path of each. An unknown format raises ValueError."""
    paths = {}
    for kind in formats:
        if kind not in WRITERS:
            raise ValueError(f"unknown format {kind!r}; known: {', '.join(WRITERS)}")
        out = df.coalesce(1) if single_file else df
        path = os.path.join(folder, f"{name}.{kind}")
        writer = out.write.mode("overwrite")
        if kind == "parquet":
            writer.parquet(path)
        elif kind == "jsonl":
            writer.option("ignoreNullFields", "false").json(path)
        else:
            writer.option("header", "true").option("escape", '"').csv(path)
        paths[kind] = path
    return paths


def save_tables(tables: dict[str, DataFrame], folder: str, formats: Iterable[str] = ("parquet",)) -> dict[str, dict[str, str]]:
    """A unified table and its auxiliary tables, string nulls written as '' (SNK2, SNK3)."""
    formats = tuple(formats)
    return {name: write_table(df.na.fill(""), folder, name, formats) for name, df in tables.items()}
