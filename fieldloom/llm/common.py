"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpoint_dir

#: A side of a join is broadcast only when it has been counted and has no more rows than this.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared checkpoint folder and forget its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has, in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str):
    """A column by its plain name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose counted size is within the limit; else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def count_tokens(text):
    """Runs of characters other than space, tab, newline and carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")
