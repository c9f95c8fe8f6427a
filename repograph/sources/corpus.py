"""The corpus configuration: which repositories, what they publish, which commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.functions import ids

REPO = (
    "corpus string, ecosystem string, dir string, url string, ref string, publishes array<string>, tier string,"
    " subpath string, manifest_subpath string, dist string"
)
LOCK = "corpus string, dir string, url string, sha string, subpath string"


def _load(text: str) -> dict:
    import yaml

    return yaml.safe_load(text) or {}


def repos(spark: SparkSession, text: str, corpus: str | None = None, tiers: tuple[str, ...] | None = None) -> DataFrame:
    """One row per repository of the configuration, with its id; of one corpus and some tiers if named."""
    rows = []
    for name, c in (_load(text).get("corpora") or {}).items():
        for r in c.get("repos") or []:
            rows.append(
                (name, c.get("ecosystem"), r["id"], r["url"], r.get("ref"), list(r.get("publishes") or []), r.get("tier"), r.get("subpath"), r.get("manifest_subpath"), r.get("dist"))
            )
    df = spark.createDataFrame(rows, REPO)
    if corpus is not None:
        df = df.where(F.col("corpus") == corpus)
    if tiers:
        df = df.where(F.col("tier").isin(*tiers))
    return df.withColumn("id", ids.repo_id(F.col("url"), F.col("dist")))


def excluded_globs(text: str) -> list[str]:
    return list((_load(text).get("exclude") or {}).get("globs") or [])


def lock(spark: SparkSession, text: str) -> DataFrame:
    rows = [
        (corpus, name, r.get("url"), r.get("sha"), r.get("subpath"))
        for corpus, repos in _load(text).items() if isinstance(repos, dict)
        for name, r in repos.items() if isinstance(r, dict)
    ]
    return spark.createDataFrame(rows, LOCK)


def repo_rows(repos: DataFrame, locked: DataFrame | None = None, provenance: DataFrame | None = None, extractor: str | None = None) -> DataFrame:
    """Repo rows. The commit is the artifact's own (provenance: dir, commit), else the locked one."""
    df = repos
    none = F.lit(None).cast("string")
    for table, name in ((provenance, "p_commit"), (locked, "l_commit")):
        if table is None:
            df = df.withColumn(name, none)
        else:
            column = "commit" if "commit" in table.columns else "sha"
            df = df.join(table.select("dir", F.col(column).alias(name)).dropDuplicates(["dir"]), "dir", "left")
    extractors = F.array(F.lit(extractor)) if extractor else F.array().cast("array<string>")
    return df.select(
        "id", F.coalesce(F.nullif("dist", F.lit("")), "dir").alias("name"), "url", F.coalesce("p_commit", "l_commit").alias("commit"), "ecosystem", "corpus", extractors.alias("extractors")
    )


def published(repos: DataFrame) -> DataFrame:
    """Package rows that the repositories publish: repo, id, name, ecosystem, relation."""
    each = repos.select(F.col("id").alias("repo"), "ecosystem", F.explode("publishes").alias("raw"))
    eco = F.col("ecosystem")
    return each.select(
        "repo", ids.package_id(eco, F.col("raw")).alias("id"), ids.package_name(eco, F.col("raw")).alias("name"), "ecosystem",
        F.lit("PUBLISHES").alias("relation"), F.lit(None).cast("string").alias("version_spec"), F.lit(None).cast("string").alias("source"),
    ).distinct()
