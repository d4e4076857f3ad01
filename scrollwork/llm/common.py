"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scrollwork.session import scratch, small_batches  # noqa: F401 (operators take it from here)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: ``[\x20\x09-\x0D]``
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read on from there: later stages start from files
    that every executor sees, however many executors were lost before."""
    path = scratch(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_text(df: DataFrame, *ids: str) -> DataFrame:
    """Ids as text on their way through pandas, where whole numbers beside a null would become floats; cast them back behind it."""
    return df.withColumns({c: F.col(c).cast("string") for c in ids})


def fold(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids are in fold 0."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in; it lowers nothing else there."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only, null text as the empty text; other columns cannot clash with working names."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
