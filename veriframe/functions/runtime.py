"""Cutting lineage, the shared folder for it, and clearing that folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application below the one that spark.checkpoint.dir names. Where the setting is unset, below a temporary folder on a local master; elsewhere an error, since executors don't see each other's disks."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_folder(spark: SparkSession) -> str:
    """The folder that holds all that this application wrote between jobs."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='veriframe-')}")
        path = _own[0]
    return f"{path.rstrip('/')}/veriframe/{spark.sparkContext.applicationId}"


def table_name(spark: SparkSession, name: str) -> str:
    """A new name for a table of this application in the session's catalogue."""
    return f"{_table_prefix(spark)}{re.sub(r'[^a-z0-9]+', '_', name.lower())}_{uuid.uuid4().hex}"


def _table_prefix(spark: SparkSession) -> str:
    return f"veriframe_{re.sub(r'[^a-z0-9]+', '_', spark.sparkContext.applicationId.lower())}_"


def clear(spark: SparkSession) -> int:
    """Removes what this application wrote between jobs: its folder, and its tables in the current catalogue, whose number is returned.

    For callers to use when the results that they want are written: frames made before can't be read afterwards. Other applications' folders and tables stay.
    """
    mine = [t.name for t in spark.catalog.listTables() if t.name.startswith(_table_prefix(spark))]
    for name in mine:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(mine)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a shared folder and read from there: a cut of the lineage that keeps column pruning and outlives executors."""
    path = shared_folder(df.sparkSession, "core")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
