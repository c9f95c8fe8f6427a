"""Keyed, idempotent upsert on immutable tables.

upsert(existing, new, ...) gives the merged snapshot: one row per key. A column is
either `keep` (the last value that isn't null wins), `sets` (string arrays: their
sorted union) or, by default, `last` (the last writer wins, null or not). `new` comes
after `existing`; within one of them a column named in `order` decides, else the
greatest row, so that the result never depends on how rows lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_union(name: str):
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(name, F.array().cast("array<string>"))))))


def upsert(
    existing: DataFrame | None,
    new: DataFrame,
    key: Sequence[str],
    keep: Sequence[str] = (),
    sets: Sequence[str] = (),
    order: str | None = None,
) -> DataFrame:
    def staged(df: DataFrame, n: int) -> DataFrame:
        last = F.struct(F.lit(n), *([F.col(order)] if order else []), *(F.col(c).cast("string") for c in names if c not in key and c not in sets))
        return df.select(*names, last.alias("__at"))

    columns = new.columns if existing is None else existing.columns
    names = [c for c in columns if c != order or c in key]
    missing = [c for c in names if c not in new.columns]
    keep = {*keep, *missing}  # what the new rows don't tell stays as it is
    if existing is None:
        rows = staged(new, 1)
    else:
        full = new.select("*", *(F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in missing))
        rows = staged(existing, 0).unionByName(staged(full, 1))
    out = []
    for c in names:
        if c in key:
            continue
        if c in sets:
            out.append(set_union(c).alias(c))
        elif c in keep:
            out.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c))
        else:
            out.append(F.max_by(F.struct(c), "__at")[c].alias(c))
    merged = rows.groupBy(*key).agg(*out) if out else rows.select(*key).distinct()
    return merged.select(*names)


def only_between(edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """The edges both of whose ends exist."""
    return edges.join(src.select(F.col("id").alias("src")), "src", "left_semi").join(
        dst.select(F.col("id").alias("dst")), "dst", "left_semi"
    ).select(edges.columns)


def without(table: DataFrame, ids: DataFrame, columns: Sequence[str] = ("id",)) -> DataFrame:
    """Rows none of whose columns is in ids (one column, id): a delete with incident edges."""
    for c in columns:
        table = table.join(ids.select(F.col("id").alias(c)), c, "left_anti").select(table.columns)
    return table


def duplicates(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their count."""
    return table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
