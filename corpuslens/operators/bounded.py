"""Helpers for small tables: look at the size first, then broadcast; else leave Spark to it."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A table up to this many rows (short ones: ids, terms, numbers) counts as small.
SMALL_ROWS = 200_000
# Up to this many values a filter is spelled out in lists that Parquet can test exactly.
SPELLED_VALUES = 1_000
# Parquet gets an exact test for so many values in one IN list; a longer list becomes min/max.
IN_LIST = 10


def settle(df: DataFrame, limit: int = SMALL_ROWS) -> tuple[DataFrame, list[dict] | None]:
    """Compute a table once if it is small: (the local table, its rows).

    One job reads at most ``limit + 1`` rows. A larger table is written to the checkpoint folder,
    so that it too is computed once, and comes back with rows ``None``.
    """
    table = df.limit(limit + 1).toArrow()
    if table.num_rows <= limit:
        return df.sparkSession.createDataFrame(table, df.schema), table.to_pylist()
    return checkpointed(df), None


def hinted(df: DataFrame, rows: list[dict] | None) -> DataFrame:
    """A broadcast hint for a table that ``settle`` found small."""
    return df if rows is None else F.broadcast(df)


def shuffled(df: DataFrame) -> DataFrame:
    """A table on its way to a join that moves both sides. Spark guesses the size of checkpoints,
    of compressed files and of what ``explode`` or Arrow functions make, at times far too low, and
    what it takes for small is gathered and hashed on the driver."""
    return df.hint("merge")


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unsized(df: DataFrame) -> DataFrame:
    """``checkpointed``, without what Spark guesses of the table. A checkpoint keeps the guess of
    its plan, and a join's guess is the product of both sides': in a loop of joins its digits
    double each time, until the driver spends its memory and minutes on one number."""
    plan = checkpointed(df)._jdf.queryExecution().analyzed()
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(
        plan.rdd(), plan.schema(), False), session)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's, or a new local one where none is named."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.split("[")[0] == "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpuslens-"))
    return named or context.getCheckpointDir()


def _either(tests: list[Column]) -> Column:
    """OR of the tests as a balanced tree, whose depth stays small for many tests."""
    if len(tests) == 1:
        return tests[0]
    middle = len(tests) // 2
    return _either(tests[:middle]) | _either(tests[middle:])


def any_of(column: str, values: list) -> Column:
    """``column IN values`` as short lists, which Parquet tests exactly."""
    ordered = sorted(set(values))
    if not ordered:
        return F.lit(False)
    size = IN_LIST
    parts = [ordered[i:i + size] for i in range(0, len(ordered), size)]
    literals = [repr(v) if isinstance(v, int) else f"'{v}'" for v in ordered]
    if any(isinstance(v, str) and ("'" in v or "\\" in v) for v in ordered):
        return _either([F.col(column).isin(part) for part in parts])
    return _either([F.expr(f"{column} IN ({', '.join(literals[i:i + size])})")
                    for i in range(0, len(literals), size)])


def among(table: DataFrame, column: str, rows: list[dict] | None) -> DataFrame:
    """A table on its way to a join on ``column`` with ``rows``: a few values are spelled out, so
    that Parquet skips what has none of them; more are left to the join."""
    if rows is None:
        return table
    values = {row[column] for row in rows}
    return table if len(values) > SPELLED_VALUES else table.filter(any_of(column, list(values)))
