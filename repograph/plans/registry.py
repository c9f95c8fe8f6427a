"""The registered queries of the graph engine and their DuckDB counterparts.

Every query reads the graph that the adapter makes of a folder's tables. Arrays are
joined to text, so that results compare across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from repograph.operators import link, traverse
from repograph.plans import adapter, extracts, named, oracles, scoring, vulnerabilities

CORPUS = "ASIA"
_derived: dict = {}


def flat(df: DataFrame, separators: dict | None = None) -> DataFrame:
    out = []
    for f in df.schema:
        c = F.col(f.name)
        out.append(F.array_join(c, (separators or {}).get(f.name, ",")).alias(f.name) if isinstance(f.dataType, ArrayType) else c)
    return df.select(*out)


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    """A result that several queries read, made once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _derived:
        _derived[key] = make()
    return _derived[key]


def _graph(spark, sf_dir):
    return adapter.graph(spark, sf_dir)


def changed(spark: SparkSession, sf_dir: str) -> str:
    """The symbol with the most callers."""

    def find():
        g = _graph(spark, sf_dir)
        n = g.edges("CALLS", "CALLS_CROSS_REPO").groupBy("dst").agg(F.count("*").alias("n"))
        row = n.orderBy(F.col("n").desc(), "dst").first()
        return row["dst"] if row else ""

    return _once(spark, sf_dir, "changed", find)


def lib_repo(spark: SparkSession, sf_dir: str) -> str:
    """The repository whose symbols the others use most."""

    def find():
        g = _graph(spark, sf_dir)
        e = g.edges("CALLS_CROSS_REPO", "IMPORTS_CROSS_REPO").join(g["Symbol"].select(F.col("id").alias("dst"), "repo"), "dst")
        row = e.groupBy("repo").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "repo").first()
        return row["repo"] if row else ""

    return _once(spark, sf_dir, "lib", find)


def _assessed(spark, sf_dir):
    g = _graph(spark, sf_dir)
    _once(spark, sf_dir, "assessed", lambda: vulnerabilities.assess_graph(g))
    return g


def _algorithm(spark, sf_dir, name):
    from repograph.operators.tables import written

    return _once(spark, sf_dir, name, lambda: written(getattr(named, name)(_graph(spark, sf_dir)), name))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(named.q01(_graph(spark, sf_dir), changed(spark, sf_dir)))


def _with_changed(query, **how):
    return lambda spark, d: flat(query(_graph(spark, d), changed(spark, d)), **how)


def _plain(query, **how):
    return lambda spark, d: flat(query(_graph(spark, d)), **how)


def _scores(spark, d):
    g = _graph(spark, d)
    arms = scoring.predicted(g).withColumn("arm", F.lit("unified")).union(scoring.predicted_with_source(g).withColumn("arm", F.lit("unified+source")))
    return scoring.score(arms, scoring.truth_from_imports(g))


def queries() -> dict:
    chain = {"separators": {"call_chain": " <- ", "citations": " <- "}}
    q = {
        "q01_blast_radius": _with_changed(named.q01),
        "q02_single_repo_control": _with_changed(named.q02),
        "q03_evidence_path": _with_changed(named.q03, **chain),
        "q04_fan_in": lambda s, d: flat(named.q04(_graph(s, d), lib_repo(s, d))),
        "q05_dangling": _plain(named.q05),
        "q06_confidence_audit": _plain(named.q06),
        "q07_overview": _plain(named.q07),
        "q08_undeclared": _plain(named.q08),
        "q09_symbol_agreement": lambda s, d: named.q09(_graph(s, d), CORPUS),
        "q10_call_agreement": lambda s, d: named.q10(_graph(s, d), CORPUS),
        "q11_trust": _with_changed(named.q11),
        "q12_spanning_communities": lambda s, d: flat(named.q12(_graph(s, d), _algorithm(s, d, "community_table"))),
        "q13_chokepoints": lambda s, d: named.q13(_graph(s, d), _algorithm(s, d, "betweenness_table"), _algorithm(s, d, "community_table")),
        "q14_fragile_seams": lambda s, d: named.q14(_graph(s, d), _algorithm(s, d, "articulation_table"), _algorithm(s, d, "betweenness_table")),
        "q15_cycles": _plain(named.q15, separators={"longest_cycle": " > "}),
        "q16_test_impact": _with_changed(named.q16),
        "q17_cross_boundary_cycles": _plain(named.q17),
        "q18_reachable_vulnerabilities": lambda s, d: flat(named.q18(_assessed(s, d))),
        "q19_phantom_dependencies": _plain(named.q19),
        "l01_depends_on_repo": lambda s, d: flat(link.depends_on_repo(_graph(s, d)).select("src", "dst", "via", "confidence")),
        "l02_go_prefix": lambda s, d: link.resolve_go(_graph(s, d)).select("src", "dst", "pkgdir", "confidence"),
        "l03_python_package": lambda s, d: link.resolve_python_package(_graph(s, d)).select("src", "dst", "candidates", "ambiguous", "confidence"),
        "l04_python_module": lambda s, d: link.resolve_python_module(_graph(s, d)).select("src", "dst", "providers", "ambiguous", "confidence"),
        "l05_file_imports": lambda s, d: link.imports_file_cross_repo(_graph(s, d)).select("src", "dst", "via_module", "line", "context", "guarded"),
        "l06_call_lift": lambda s, d: flat(link.calls_cross_repo(_graph(s, d), _graph(s, d)["RESOLVES_TO"]).select("src", "dst", "confidence", "extractors")),
        "l07_import_lift": lambda s, d: link.imports_cross_repo(_graph(s, d), _graph(s, d)["RESOLVES_TO"]).select("src", "dst", "confidence", "via_module", "line", "context"),
        "l08_report": _plain(link.report),
        "g01_reach": lambda s, d: traverse.reach(_graph(s, d).edges("CALLS", "CALLS_CROSS_REPO"), s.createDataFrame([(changed(s, d),)], "id string"), 6),
        "g05_communities": lambda s, d: _algorithm(s, d, "community_table"),
        "g06_betweenness": lambda s, d: _algorithm(s, d, "betweenness_table").select("id", F.round("betweenness", 4).alias("betweenness")),
        "g07_pagerank": lambda s, d: named.pagerank_table(_graph(s, d)).select("id", F.round("pagerank", 4).alias("pagerank")),
        "g08_articulation": lambda s, d: _algorithm(s, d, "articulation_table"),
        "v06_assessment": lambda s, d: _assessed(s, d)["AFFECTED_BY"].select("src", "dst", "package", "status", "declared"),
        "v_histogram": lambda s, d: vulnerabilities.histogram(_assessed(s, d)),
        "c06_scores": _scores,
        "c08_stats": lambda s, d: _assessed(s, d).stats(),
    }
    for name in named.PROJECTIONS:
        q[f"g09_scc_{name}"] = lambda s, d, n=name: named.cycle_members(_graph(s, d), n).select("id", "component", "repo")
    return q | extracts.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.build() | extracts.oracle_sql()
