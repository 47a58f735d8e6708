"""Steps that are written once and read several times, in the folder that the whole cluster shares; rows dealt to tasks by key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a temporary one on a local master; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written and read back: what follows does not run its steps again, and its rows survive the executors that made them."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_turn(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """``rows`` for a pass over sorted rows: those of one key in one task, by key and ``order``. They are dealt by a hash of the keys: a
    repartition by the keys themselves is left out where a join has dealt them so before, and that join may turn out at run time as
    one that does not."""
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
