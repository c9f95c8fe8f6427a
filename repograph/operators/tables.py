"""Written tables: where a loop or a table with several readers cuts its lineage.

They lie in one folder for each application, under spark.checkpoint.dir, which goes when the
application ends. Inside `scratch` they go earlier: when the block ends, but for those kept.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables that are written at the same time at most.
SIDE_BY_SIDE = 6

_open: list[dict[str, str]] = []
_known: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it falls back to a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master.startswith("local") and "cluster" not in master:
            at = tempfile.mkdtemp(prefix="repograph-")
            spark.sparkContext.setCheckpointDir(at)
        else:
            at = spark.conf.get("spark.sql.warehouse.dir")
    return at.rstrip("/")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _folder(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/repograph/{spark.sparkContext.applicationId}"
    if folder not in _known:
        _known.add(folder)
        files, place = _files(spark, folder)
        files.mkdirs(place)
        files.deleteOnExit(place)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: a lost executor costs only the tasks that it ran."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    if _open:
        _open[-1][path] = path
    return out


def together(calls: dict) -> dict:
    """The results of several calls (name -> function) that write tables; their jobs run side by side."""
    with ThreadPoolExecutor(max_workers=SIDE_BY_SIDE) as pool:
        running = {name: pool.submit(call) for name, call in calls.items()}
        return {name: r.result() for name, r in running.items()}


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_table", None)
        if path is not None:
            files, place = _files(t.sparkSession, path)
            files.delete(place, True)
            for block in _open:
                block.pop(path, None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """Yields keep: tables written in the block are deleted at its end, but for those given to keep, which
    belong to the block around this one, if there is one."""
    inside: dict[str, str] = {}
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._table)
        return table

    _open.append(inside)
    try:
        yield keep
    finally:
        _open.remove(inside)
        for path in kept:
            inside.pop(path, None)
            if _open:
                _open[-1][path] = path
        for path in inside:
            files, place = _files(spark, path)
            files.delete(place, True)


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)
