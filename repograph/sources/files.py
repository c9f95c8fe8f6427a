"""Trees of source files as DataFrames, and which files are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that source scans and manifest scans skip (fixed values).
SKIP_DIRS = [".git", ".venv", "venv", "node_modules", "vendor", "dist", "build", "__pycache__", ".tox", ".mypy_cache", "testdata"]
MANIFEST_SKIP_DIRS = ["vendor", "node_modules", ".venv", "venv", "testdata", "dist", "build", ".git"]

FILE = "root string, path string, text string"


def glob_pattern(glob: str) -> str:
    """A path glob (** any directories, * within one) as a regular expression for whole paths."""
    import re

    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^(?:{out})$"


def excluded(path: Column, parts: list[str] | None = None, globs: list[str] | None = None) -> Column:
    """Whether a part of the path is in parts, or a glob matches it."""
    out = F.arrays_overlap(F.split(path, "/"), F.lit(parts)) if parts else F.lit(False)
    for g in globs or []:
        out = out | F.regexp_like(path, F.lit(glob_pattern(g)))
    return out


def read_tree(spark: SparkSession, base: str, glob: str, skip: list[str] | None = None, globs: list[str] | None = None) -> DataFrame:
    """root, path, text of the files under base/{root}/ whose name fits glob. Left out before they are read:
    paths through a directory of skip, and those that a pattern of globs matches."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
    plain = F.regexp_replace("path", "^[a-z][a-z0-9+.-]*:/+", "/")
    at = base.split("://", 1)[-1].rstrip("/")
    at = at.removeprefix("file:")
    rel = F.expr(f"substring(plain, {len(at) + 2})")
    rows = found.withColumn("plain", plain).withColumn("rel", rel)
    rows = rows.select(F.substring_index("rel", "/", 1).alias("root"), F.expr("substring(rel, length(substring_index(rel, '/', 1)) + 2)").alias("path"), "content")
    kept = rows.where((F.col("path") != "") & ~excluded(F.col("path"), skip if skip is not None else SKIP_DIRS, globs))
    return kept.select("root", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def of_repos(files: DataFrame, repos: DataFrame) -> DataFrame:
    """repo, path, text: files of configured roots, their paths relative to the configured subpath."""
    sub = F.coalesce("subpath", F.lit(""))
    met = files.join(repos.select(F.col("dir").alias("root"), F.col("id").alias("repo"), "subpath", "ecosystem"), "root")
    prefix = F.when(sub == "", F.lit("")).otherwise(F.concat(F.regexp_replace(sub, "/+$", ""), F.lit("/")))
    met = met.withColumn("prefix", prefix).where(F.col("path").startswith(F.col("prefix")))
    return met.select("repo", "ecosystem", F.expr("substring(path, length(prefix) + 1)").alias("path"), "text")
