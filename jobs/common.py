"""What the jobs share: config files, sessions of the command line, and settings that are put back."""

from __future__ import annotations

import contextlib
import logging
from collections.abc import Iterator
from dataclasses import fields
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def read_config(spark: SparkSession, path: str, kind: type[T]) -> T:
    """A config file of one JSON object; it may be in any store that Spark reads. Names that ``kind`` lacks raise ValueError."""
    row = spark.read.json(path, multiLine=True).first()
    given = {k: v for k, v in row.asDict(recursive=True).items() if v is not None} if row else {}
    known = {f.name for f in fields(kind)}
    if set(given) - known:
        raise ValueError(f"unknown settings {sorted(set(given) - known)} in {path}; there are {sorted(known)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for a while; double underscores in the names stand for dots. What was set before is set again."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def overwrite_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that ``rows`` has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_written(spark: SparkSession, path: str, schema: str, where: str | None = None) -> DataFrame:
    """A table that may not be there yet, with the given columns; ``where`` reaches its partitions."""
    try:
        out = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        out = spark.createDataFrame([], schema)
    return out.where(where) if where else out
