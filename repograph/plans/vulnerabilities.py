"""Advisories to graph rows, and what they mean for each declared dependency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.functions import ids, versions
from repograph.operators.tables import written

#: Names of the advisory database for the ecosystems (fixed values).
ECOSYSTEMS = {"python": "PyPI", "go": "Go"}
SUMMARY_CHARS = 400

#: An advisory document as the database serves it.
ADVISORY = """struct<id: string, aliases: array<string>, summary: string, published: string, modified: string, withdrawn: string,
 database_specific: struct<severity: string, cwe_ids: array<string>>, severity: array<struct<type: string, score: string>>,
 affected: array<struct<package: struct<name: string, ecosystem: string>, versions: array<string>,
 ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string, last_affected: string, `limit`: string>>>>>>>"""
INTERVAL = "struct<introduced: string, fixed: string, last_affected: string>"


def vulnerabilities(advisories: DataFrame) -> DataFrame:
    """advisories: ecosystem, name, doc (ADVISORY). One row per advisory id, however many packages it names."""
    d = F.col("doc")
    scores = F.filter(F.transform(d["severity"], lambda s: s["score"]), lambda s: F.coalesce(s, F.lit("")) != "")
    return advisories.where(F.coalesce(d["id"], F.lit("")) != "").select(
        d["id"].alias("id"),
        F.get(F.filter(d["aliases"], lambda a: a.startswith("CVE-")), F.lit(0)).alias("cve"),
        F.coalesce(d["aliases"], F.array().cast("array<string>")).alias("aliases"),
        F.left(F.coalesce(d["summary"], F.lit("")), F.lit(SUMMARY_CHARS)).alias("summary"),
        d["database_specific"]["severity"].alias("severity"),
        F.try_element_at(scores, F.lit(-1)).alias("cvss"),
        F.coalesce(d["database_specific"]["cwe_ids"], F.array().cast("array<string>")).alias("cwes"),
        d["published"].alias("published"), d["modified"].alias("modified"), d["withdrawn"].alias("withdrawn"),
    ).dropDuplicates(["id"])


def intervals(events):
    """An events array as its intervals: each `introduced` opens one; without any, the first starts at 0.

    The fold's state is the finished intervals and the open one."""
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast(f"array<{INTERVAL}>").alias("done"), F.lit(None).cast(INTERVAL).alias("open"))

    def bound(low, high, last):
        return F.struct(low.alias("introduced"), high.alias("fixed"), last.alias("last_affected"))

    def step(state, e):
        closed = F.when(state["open"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        low = F.when(state["open"].isNull(), F.lit("0")).otherwise(state["open"]["introduced"])
        high = F.when(e["fixed"].isNotNull(), e["fixed"]).when(e["last_affected"].isNotNull(), state["open"]["fixed"]).otherwise(
            F.coalesce(e["limit"], state["open"]["fixed"])
        )
        last = F.when(e["fixed"].isNull() & e["last_affected"].isNotNull(), e["last_affected"]).otherwise(state["open"]["last_affected"])
        opened = F.struct(closed.alias("done"), bound(e["introduced"], none, none).alias("open"))
        changed = F.struct(state["done"].alias("done"), bound(low, high, last).alias("open"))
        return F.when(e["introduced"].isNotNull(), opened).otherwise(changed).cast(f"struct<done: array<{INTERVAL}>, open: {INTERVAL}>")

    return F.aggregate(
        F.coalesce(events, F.array().cast("array<struct<introduced: string, fixed: string, last_affected: string, limit: string>>")),
        start,
        step,
        lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))),
    )


def affected(advisories: DataFrame) -> DataFrame:
    """One row per (advisory, package, interval): vuln, ecosystem, name, introduced, fixed, last_affected, versions.
    The ecosystem must match exactly, the name without case. An entry without ranges is unbounded."""
    known = F.create_map(*(F.lit(x) for kv in ECOSYSTEMS.items() for x in kv))
    entry = advisories.select("ecosystem", "name", F.col("doc.id").alias("vuln"), F.explode("doc.affected").alias("a")).where(
        (F.col("a.package.ecosystem") == known[F.col("ecosystem")]) & (F.lower("a.package.name") == F.lower("name"))
    )
    unbounded = F.array(F.struct(*(F.lit(None).cast("string").alias(n) for n in ("introduced", "fixed", "last_affected"))))
    found = F.when(F.coalesce(F.size("a.ranges"), F.lit(0)) <= 0, unbounded).otherwise(
        F.flatten(F.transform("a.ranges", lambda r: intervals(r["events"])))
    )
    return entry.select(
        "vuln", "ecosystem", "name", F.coalesce("a.versions", F.array().cast("array<string>")).alias("versions"), F.explode(found).alias("i")
    ).select("vuln", "ecosystem", "name", "i.*", "versions")


def affects(entries: DataFrame) -> DataFrame:
    return entries.select(
        F.col("vuln").alias("src"), ids.package_id(F.col("ecosystem"), F.col("name")).alias("dst"), "introduced", "fixed", "last_affected",
        F.size("versions").alias("version_count"),
    ).distinct()


def declarations(graph) -> DataFrame:
    """repo, package, ecosystem, name, version_spec of what repositories declare."""
    pkg = graph["Package"].select(F.col("id").alias("package"), "name", "ecosystem")
    return graph["DEPENDS_ON"].select(F.col("src").alias("repo"), F.col("dst").alias("package"), "version_spec").join(pkg, "package")


def assessed(declared: DataFrame, entries: DataFrame) -> DataFrame:
    """AFFECTED_BY rows, not_affected ones too. entries: vuln, package, introduced, fixed, last_affected, versions."""
    per = entries.groupBy("vuln", "package").agg(
        F.array_sort(F.collect_list(F.struct("introduced", "fixed", "last_affected", "versions"))).alias("affects")
    )
    met = written(
        declared.join(per, "package").select(F.col("repo").alias("src"), F.col("vuln").alias("dst"), "package", "ecosystem", F.col("version_spec").alias("declared"), "affects"), "declared"
    )
    # Many declarations and advisories say the same: each case is decided once.
    spec, eco = F.col("declared"), F.col("ecosystem")
    # They are few bytes but much work, so the number of tasks doesn't follow their size.
    parts = met.sparkSession.sparkContext.defaultParallelism
    cases = met.select("declared", "ecosystem", "affects").distinct().repartition(parts).select(
        spec.alias("s"), eco.alias("e"), F.col("affects").alias("a"), versions.assess(spec, eco, F.col("affects")).alias("v"), versions.pinned(spec, eco).alias("resolved")
    )
    same = F.col("declared").eqNullSafe(F.col("s")) & F.col("ecosystem").eqNullSafe(F.col("e")) & (F.col("affects") == F.col("a"))
    return met.join(written(cases, "cases"), same).select("src", "dst", "package", "v.status", "v.reason", "declared", "resolved")


def load(graph, advisories: DataFrame):
    """Replaces the layer: Vulnerability, AFFECTS and AFFECTED_BY."""
    graph.drop_vulnerabilities()
    graph["Vulnerability"] = vulnerabilities(advisories)
    entries = affected(advisories)
    graph["AFFECTS"] = affects(entries)
    keyed = entries.withColumn("package", ids.package_id(F.col("ecosystem"), F.col("name"))).drop("ecosystem", "name")
    graph["AFFECTED_BY"] = assessed(declarations(graph), keyed)
    return graph.settle("Vulnerability", "AFFECTS", "AFFECTED_BY")


def assess_graph(graph):
    """AFFECTED_BY from the graph's own AFFECTS (which holds no version lists)."""
    entries = graph["AFFECTS"].select(
        F.col("src").alias("vuln"), F.col("dst").alias("package"), "introduced", "fixed", "last_affected", F.array().cast("array<string>").alias("versions")
    )
    graph["AFFECTED_BY"] = assessed(declarations(graph), entries)
    return graph.settle("AFFECTED_BY")


def histogram(graph) -> DataFrame:
    return graph["AFFECTED_BY"].groupBy("status").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "status")
