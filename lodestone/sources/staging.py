"""Tables staged in the folder that driver and executors share.

A staged table cuts lineage: it is written once as Parquet below ``spark.checkpoint.dir`` and read
back, so what a plan repeats is computed once, and a lost executor costs the reading of a file.

Defined cases: an empty table is staged as one; a local session without that setting gets a
temporary folder of its own, any other session must name the folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """URI of the shared folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not named:
            named = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestone-engine-")
    return f"{named.rstrip('/')}/lodestone-engine/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestone-engine/" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(hadoop).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged; results that still read it must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
