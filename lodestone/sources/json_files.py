"""Small JSON files of settings and registries, and overrides as tables.

A file is written aside and then renamed over the old one, so a reader sees the old or the new
content, never half of one.

Defined cases: a missing or damaged file gives the default; entries that are no objects or have no
id are left out; an empty registry gives empty tables.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

EDIT = "record_id string, content string, source_hash string, doc_id string, file_path string, updated_at string"
DELETION = "record_id string, source_hash string, doc_id string, file_path string, updated_at string"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write(spark: SparkSession, path: str, payload: object) -> None:
    """Put a JSON file in place."""
    fs, aside = _path(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    full = fs.makeQualified(aside)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(full, fs.makeQualified(_path(spark, path)[1]), how)


def load(spark: SparkSession, path: str, default: object = None, strict: bool = False) -> object:
    """The content of a JSON file. ``strict``: a damaged file is an error and not the default."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return default
    row = spark.read.text(path, wholetext=True).first()
    try:
        return json.loads(row[0]) if row else default
    except ValueError:
        if strict:
            raise
        return default


def overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edits, deletions) of an overrides file."""
    payload = load(spark, path)
    tables = []
    for kind, schema in (("edits", EDIT), ("deletions", DELETION)):
        entries = payload.get(kind) if isinstance(payload, dict) else None
        good = [(i, e) for i, e in (entries if isinstance(entries, dict) else {}).items() if i and isinstance(e, dict)]
        names = [c.split()[0] for c in schema.split(", ")]
        tables.append(spark.createDataFrame([tuple(i if n == "record_id" else None if e.get(n) is None else str(e[n]) for n in names) for i, e in good], schema))
    return tables[0], tables[1]


def write_overrides(spark: SparkSession, path: str, edits: DataFrame, deletions: DataFrame) -> None:
    """Write an overrides file, a bounded list of changes made by hand; rows without an id are left out."""
    rows = lambda df: {r["record_id"]: r.asDict() for r in df.collect() if r["record_id"]}
    write(spark, path, {"version": 1, "edits": rows(edits), "deletions": rows(deletions)})
