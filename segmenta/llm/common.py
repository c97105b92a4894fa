"""Small helpers the operators share."""

from __future__ import annotations

import pickle
import string
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .words import per_process


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, limit_bytes: int, *columns: str) -> bool:
    """Whether the table, measured by one aggregate over it, may be broadcast."""
    per_row = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0)) + 64
    return (df.agg(F.sum(per_row.cast("long"))).first()[0] or 0) <= limit_bytes


def shared(spark: SparkSession, value) -> Callable:
    """Broadcast a value together with its class, so that executors need no installed package; call the result to get it."""
    sent, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: per_process(("shared", key), lambda: pickle.loads(sent.value))
