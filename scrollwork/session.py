"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Applied only when this library builds the session (tests, bench). On a cluster
# the submitted configuration wins and nothing here is touched.
LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "scrollwork", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        for key, value in LOCAL_DEFAULTS.items():
            builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Without that setting, a plain local session (driver and executors in one process) gets one temporary
    folder, removed when the session's process ends. Any other master raises.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="scrollwork-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share out rows whose input has fewer splits than there are cores, before heavy work per row.

    A large table arrives in many splits and is returned as it is; a file of one row group
    would otherwise keep every pattern match in a single task.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, key)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by hash in three shares a core, however the input is split.

    For narrow rows that cost milliseconds each: a compact file has fewer row groups than cores, and splits without
    a row group are empty, so the number of splits tells nothing about how the work is shared out.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def deal_wide(df: DataFrame, *keys: str) -> DataFrame:
    """As ``deal``, and in no fewer shares than a shuffle has: for rows of any width that cost milliseconds each, which an
    adaptive plan would put together by their bytes. Sides dealt by the same keys join as they are."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


#: Spark's own bound on the bytes of a batch that goes to Python
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame, size: str = "8m") -> None:
    """Let Python tasks take rows in batches of about ``size`` bytes, where their arrays are many times larger than the texts.
    A bound that the session has set itself stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) in ("67108864", "67108864b", "64m", "64MB"):
        conf.set(BATCH_BYTES, size)
