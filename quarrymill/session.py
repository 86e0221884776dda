"""Sessions, table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 20_000


def get_spark(master: str = "local[*]", partitions: int = 8, **conf) -> SparkSession:
    """A session with UTC time, ANSI SQL and adaptive execution."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.pathsep.join(dict.fromkeys([home, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    os.environ["PYTHONPATH"] = path  # Python workers of a local session find the package from any folder; on a cluster it is installed or sent along
    b = SparkSession.builder.master(master).appName("quarrymill")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`; columns and filters are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table for work that costs much CPU a row: a table of fewer files than there are cores is dealt out to all of them.
    Larger tables have enough partitions and stay as they are. For scans only: it asks for the partitions without running anything."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.rdd().getNumPartitions() >= n else scan.repartition(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: spark.checkpoint.dir; a temporary one only where it is unset and Spark is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="quarrymill-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends and executors may be lost."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read back: as `cut`, in encoded columns, for what is read several times."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def within(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `most` rows; reads no more than that."""
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it was counted to be small; else as it is, for a shuffled join."""
    return F.broadcast(df) if within(df, most) else df
