"""What several corpus operators share: written tables, skew-proof lookups, batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.operators.tables import discard, scratch, written  # noqa: F401

#: White space of the contracts: space and the control characters 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: A key is hot above this share of the rows; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 1000

BATCH_BYTES = 4 << 20

#: Parts that hot rows, already answered, are spread over.
SPREAD = 4096


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as none of the columns has (Spark ignores case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def whole(docs: DataFrame) -> Column:
    """A row's columns as one struct, so that no name of theirs meets one of an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def unpacked(df: DataFrame, row: str, columns: Iterable[str]) -> DataFrame:
    """The columns that `whole` put into the struct column row."""
    return df.select(*(F.col(row)[c].alias(c) for c in columns))


def bounded(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of at most BATCH_BYTES from now on. One value for all operators, which only lowers
    the session's; rows of any size make no large batch then, nor many small ones tiny ones."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def slices(batches, rows: int = 256) -> Iterator:
    """Arrow batches (which Spark bounds in bytes) in slices of few rows, so that what is made of one is small too."""
    for b in batches:
        for begin in range(0, b.num_rows, rows):
            yield b.slice(begin, rows)


def attach(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, spread: Column) -> DataFrame:
    """Left join of big with small (one row per key, already written) on key.

    weight is the number of rows of big with that key and total their sum. Keys
    above HOT_SHARE of total number at most 1 / HOT_SHARE = 1,000, so that broadcast is
    bounded by arithmetic. Their rows are answered from it; then, with a salt that
    nothing matches, they pass the shuffled join evenly spread. Any other key has
    under a thousandth of the rows.
    """
    payload = [c for c in small.columns if c != key]
    hot = small.where(F.col(weight) > F.lit(int(total * HOT_SHARE))).select(
        F.col(key).alias("__hk"), F.struct(*payload).alias("__hot")
    )
    cold = small.select(F.col(key).alias("__ck"), F.lit(0).alias("__cs"), F.struct(*payload).alias("__cold"))
    seen = big.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left").drop("__hk")
    seen = seen.withColumn(
        "__salt", F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(spread, F.lit(SPREAD))).cast("int")
    )
    met = seen.join(cold, (F.col(key) == F.col("__ck")) & (F.col("__salt") == F.col("__cs")), "left")
    keep = [F.col(c) for c in big.columns]
    return met.select(*keep, *(F.coalesce(F.col("__hot")[c], F.col("__cold")[c]).alias(c) for c in payload))


def share_of(h: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return h / F.lit(2.0**64) + 0.5


def enough(rows: int, total: int) -> float:
    """The share of total that holds four times the wanted rows: a filter on hashes ahead of taking the least,
    so that tasks send a sample's rows on, and not each as many as the whole sample has."""
    return min(1.0, 4.0 * rows / max(1, total))
