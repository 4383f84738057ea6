"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nearby_engine.session import fresh_folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read again: lineage ends here, a lost executor costs no recomputation, and the
    planner knows the size of what follows. A checkpoint would compute it twice."""
    path = fresh_folder(df.sparkSession, "llm")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
