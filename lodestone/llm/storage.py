"""The shared folder of a session and the tables that operators stage in it.

A staged table cuts lineage: it is written once as Parquet under the folder that
the cluster names in ``spark.checkpoint.dir`` and read back, so a lost executor
costs the re-read of a file and not a recomputation of everything before it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    Read from the session. A session that names none must be a local one: for it a temporary
    folder of this machine is made, once for each application. On a cluster it is an error, as
    executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDERS:
            _OWN_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-shared-")
        named = _OWN_FOLDERS[app]
    return named if "://" in named else "file://" + named if named.startswith("/") else named


def own_folder(spark: SparkSession) -> str:
    """Where this application stages its tables."""
    return f"{shared_folder(spark).rstrip('/')}/lodestone/{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, tag: str) -> str:
    return f"{own_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged; results that still read it must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_folder(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``stage`` once nothing reads it any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestone/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Partitions to deal packed blocks into: the session's shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def row_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit key of a row's id and text (null text counts as empty), the same in every scan."""
    return F.xxhash64(doc_id.cast("string"), F.coalesce(text, F.lit("")))


def whole_number_ids(df: DataFrame, id_col: str) -> Column:
    """The id column as long. Ids of any other kind than whole numbers are refused, never turned into null."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{id_col} is of type {kind}; this operator needs ids that are whole numbers")
    return F.col(id_col).cast("long")
