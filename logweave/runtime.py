"""Session helpers: table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast a side only when it has at most this many rows *and* bytes.
BROADCAST_ROWS = 200_000


def session(app: str = "logweave", cores: str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE)."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOGWEAVE_DRIVER_MEMORY", "6g"))
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts.

    The cluster names a shared one in ``spark.checkpoint.dir``; it is taken from
    the session. Only where nothing is set (tests in local mode) a temporary
    folder is made; on a cluster that is an error, as executors could not see it.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="logweave-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: ends lineage,
    survives the loss of executors, and pins non-deterministic columns.

    A checkpoint keeps the optimizer's size estimate. Of a self join that is the
    product of both sides, so a loop of joins would square it every round until
    the number itself takes minutes to multiply. The rows are therefore wrapped
    anew, without the estimate; AQE plans by the sizes it measures.
    """
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    rows = done._jdf.queryExecution().toRdd()
    fresh = df.sparkSession._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False)
    return DataFrame(fresh, df.sparkSession)


def strip(column):
    """``column`` without outer white space of any kind (not only blanks)."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
