"""Incremental loads: artifact rows that arrive as files, merged batch by batch.

A load is idempotent (upsert by key), so a replayed batch changes nothing, and a
stream with a checkpoint of its own gives each file's effect once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repograph.operators.upsert import upsert
from repograph.plans.graph import KEEP, SETS
from repograph.schema import KEYS, TABLES


def merge_into(spark: SparkSession, folder: str, table: str, batch: DataFrame) -> None:
    """Merges a batch of rows into the snapshot folder/table. The new snapshot is written beside the old one
    and only then becomes current: a table can't be overwritten while it is read."""
    at = current(spark, folder, table)
    existing = spark.read.schema(TABLES[table]).parquet(at) if at else None
    version = f"{folder}/{table}/v-{uuid.uuid4().hex}"
    merged = upsert(existing, batch.select([f.name for f in TABLES[table]]), KEYS[table], KEEP.get(table, ()), SETS[table])
    merged.write.parquet(version)
    number = spark.createDataFrame([(version, 0 if not at else _number(spark, folder, table) + 1)], "path string, number long")
    number.coalesce(1).write.mode("append").parquet(f"{folder}/{table}/_current")


def _versions(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("path string, number long").parquet(f"{folder}/{table}/_current")
    except AnalysisException:
        return None


def current(spark: SparkSession, folder: str, table: str) -> str | None:
    """The path of the table's current snapshot."""
    found = _versions(spark, folder, table)
    row = found.orderBy(F.col("number").desc()).first() if found is not None else None
    return row["path"] if row else None


def _number(spark: SparkSession, folder: str, table: str) -> int:
    return _versions(spark, folder, table).agg(F.max("number")).first()[0]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    at = current(spark, folder, table)
    return spark.read.schema(TABLES[table]).parquet(at) if at else spark.createDataFrame([], TABLES[table])


def ingest(spark: SparkSession, source: str, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Merges JSON lines that arrive in source into folder/table until there are no more; start it again for
    what has come since."""
    rows = spark.readStream.schema(TABLES[table]).option("maxFilesPerTrigger", 100).json(source)
    return (
        rows.writeStream.foreachBatch(lambda batch, _: merge_into(batch.sparkSession, folder, table, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
