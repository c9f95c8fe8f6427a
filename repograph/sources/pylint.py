"""Import cycles as a linter reports them, from its captured output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed pattern of the message.
MESSAGE = r"R0401:\s*Cyclic import\s*\(([^)]*)\)"


def chains(output: DataFrame) -> DataFrame:
    """output (a column text) with chain, the module names of each reported cycle."""
    each = output.withColumn("__c", F.explode(F.regexp_extract_all("text", F.lit(MESSAGE), F.lit(1))))
    return each.withColumn("chain", F.filter(F.transform(F.split("__c", "->"), lambda m: F.trim(m)), lambda m: m != "")).drop("__c", "text")


def members(output: DataFrame) -> DataFrame:
    """Distinct modules in any reported cycle (with the other columns of output)."""
    return chains(output).withColumn("module", F.explode("chain")).drop("chain").distinct()
