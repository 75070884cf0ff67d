"""Functions of columns that run in Python."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from folioforge.session import small_batches


def python_udf(kind: DataType) -> Callable[[Callable], Callable[..., Column]]:
    """As pandas_udf, but over small batches: pages are long, and each task has a worker for each step in Python."""

    def made(fn: Callable) -> Callable[..., Column]:
        udf = F.pandas_udf(kind)(fn)

        @wraps(fn)
        def call(*columns) -> Column:
            if spark := SparkSession.getActiveSession():
                small_batches(spark)
            return udf(*columns)

        return call

    return made
