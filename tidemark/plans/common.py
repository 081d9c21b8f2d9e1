"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and dates as text, so that results compare across engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def dated(sql: str, *columns: str) -> str:
    """SQL whose named date columns are text."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)}) FROM ({sql})"
