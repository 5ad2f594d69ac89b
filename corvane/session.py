"""Session, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "corvane", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's own settings win."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORVANE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let the Python workers find this package where it is not installed: its root goes on their path."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory; the scan stays lazy, so filters and columns are pushed into Parquet."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's own setting. Only a local session, as in tests, gets a temporary one; on a cluster a
    folder of the driver's machine would be lost to the others, so a missing setting raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corvane-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, so a lost executor costs one stage, not the job."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def checked_broadcast_rows(df: DataFrame, most: int, what: str) -> list:
    """Collect a table that is small by contract. One row beyond `most` raises: nothing is dropped and nothing grows unseen."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; it may not be broadcast")
    return rows


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` to 2 x `most` rows, or all there are, with the smallest hashes of their key: the same rows in every run. The choice is a
    filter, so partitions send only what belongs to the sample."""
    n = df.count()
    space = 1 << 40
    return df if n <= 2 * most else df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(space)) < F.lit(space * 2 * most // n))


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """A table that is cut or cheap to count, with a hint to broadcast it if it has at most `most` rows; else a join shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
