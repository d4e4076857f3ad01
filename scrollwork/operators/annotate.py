"""A hook for verdicts that a user's function gives (a model, a service, a person's list), kept in a table that can be replayed.

The function gets batches of rows and returns verdict rows. What it said is written once; later runs read it from the table and ask only
about rows that are new, whose content has changed, or whose batch failed before.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

ROWS = 256


def _told(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def annotate(rows: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], verdict: str, path: str, tries: int = 2, version: str = "1") -> DataFrame:
    """Verdicts for ``rows``: ``key``, the columns of ``verdict`` (a DDL string) and ``failed`` (the error, else null), one row per distinct row.

    ``fn`` gets up to ``ROWS`` distinct rows as pandas with all columns of ``rows`` and returns the verdict columns under the batch's index,
    so keys need not be distinct or exact in pandas; a row that it leaves out has null verdicts. A batch that raises is tried ``tries`` times, then each of its rows is written with the error and asked about again
    in the next run. ``version`` names the function; another version asks anew. Task retries write nothing twice, as a run's rows appear
    with its commit only. Keys with different contents are rows of their own; null keys are kept. Column names of ``rows`` and ``verdict`` must differ.
    """
    spark = rows.sparkSession
    schema = spark.createDataFrame([], verdict).schema
    names = schema.names
    clash = sorted(set(names) & set(rows.columns))
    if clash:
        raise ValueError(f"verdict columns {clash} are columns of the rows")
    cols = rows.columns
    print_of = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    asked = rows.select(*cols, print_of.alias("__print")).dropDuplicates(["__print"])
    told = _told(spark, path)
    left = asked
    if told is not None:
        done = told.filter((F.col("version") == version) & F.col("failed").isNull()).select(F.col("print").alias("__print"))
        left = asked.join(done, "__print", "left_anti")

    def ask(batches):
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.iloc[at : at + ROWS].reset_index(drop=True)
                error = None
                for _ in range(tries):
                    try:
                        got = fn(batch[cols].copy())
                        said = got.loc[~got.index.duplicated(), names].astype(object).reindex(batch.index)
                        error = None
                        break
                    except Exception as e:  # the user's function may fail in any way; the error is kept with the rows
                        error = f"{type(e).__name__}: {e}"[:500]
                if error is not None:
                    said = pd.DataFrame({n: [None] * len(batch) for n in names}, dtype=object)
                yield pd.concat([batch[["__print"]].rename(columns={"__print": "print"}), said.where(said.notna(), None), pd.DataFrame({"failed": [error] * len(batch)}, dtype=object)], axis=1)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    # verdicts go by fingerprint; the key is joined back from the rows and never comes out of pandas
    new = left.select(*cols, "__print").mapInPandas(ask, f"print string, {kinds}, failed string")
    new.withColumn("version", F.lit(version)).withColumn("told_at", F.current_timestamp()).write.mode("append").parquet(path)
    told = spark.read.parquet(path).filter(F.col("version") == version)
    # an answer beats failures, a later row an earlier one
    last = told.groupBy("print").agg(F.max_by(F.struct(*names, "failed"), F.struct(F.col("failed").isNull(), "told_at")).alias("v"))
    return asked.join(last, asked["__print"] == last["print"]).select(key, *[F.col(f"v.{n}").alias(n) for n in [*names, "failed"]])
