"""What deleted rows take with them: rows that refer to them, found by joins along the references.

Deleted rows carry `root`, the key of the row whose delete takes them along. Keys are unique; a null reference refers to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def referring(children: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """Children that refer to deleted rows, with their `root`."""
    return children.join(gone.select(F.col(key).alias(column), "root"), column)


def survivors(children: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """Children that refer to no deleted row."""
    return children.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(*children.columns)
