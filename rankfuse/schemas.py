"""Table schemas shared by all operators, and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

PAPER = StructType(
    [
        StructField("id", StringType(), nullable=False),
        StructField("title", StringType(), nullable=True),
        StructField("references", ArrayType(StringType()), nullable=True),
    ]
)
QUERY = StructType([StructField("query_id", StringType()), StructField("query", StringType())])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise ValueError naming the missing columns; runs no job."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; have {df.columns}")
    return df
