"""Names of columns that operators add."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame


def free_name(df: DataFrame, wanted: str) -> str:
    """The wanted name with as few underscores after it as make it free; as in Spark, case doesn't matter."""
    taken = {c.lower() for c in df.columns}
    longer = (wanted + "_" * n for n in count())
    return next(name for name in longer if name.lower() not in taken)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Several free names, which are different from each other if the wanted ones are and none of these is another with underscores after it."""
    return [free_name(df, w) for w in wanted]
