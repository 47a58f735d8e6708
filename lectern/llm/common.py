"""What the operators of this subpackage share: tables, word pattern, materialised cuts."""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage,
    and the rows survive the executors that made them."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written ``tables`` that are no longer read, and let Spark drop the shuffle files of finished steps."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        for f in t.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(conf).delete(folder, True)
    gc.collect()
    jvm.System.gc()


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def lowered(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8").lower().decode("utf-8")


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with other names for its columns that clash with ``names``, and what gives them their names back."""
    taken = {n.lower() for n in names}
    clash = {c: f"_aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in taken}
    return docs.withColumnsRenamed(clash), lambda out: out.withColumnsRenamed({v: k for k, v in clash.items()})
