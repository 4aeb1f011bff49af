"""Named steps in order: each takes what the step before has given, written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.sources.formats import scratch

Step = tuple[str, Callable[[SparkSession, DataFrame], DataFrame]]


def run_steps(spark: SparkSession, first: DataFrame, steps: list[Step], again: int = 0) -> DataFrame:
    """The last step's rows. A step that fails is run again up to ``again`` times from the stored rows of
    the one before; names must differ, as errors tell a step by its name."""
    names = [name for name, _ in steps]
    if len(set(names)) < len(names):
        raise ValueError(f"two steps of one name: {names}")
    rows = first
    for name, step in steps:
        for left in range(again, -1, -1):
            path = scratch(spark, name)
            try:
                out = step(spark, rows)
                out.write.parquet(path)
                break
            except Exception as e:
                if not left:
                    raise RuntimeError(f"step {name} failed") from e
        rows = spark.read.schema(out.schema).parquet(path)
    return rows
