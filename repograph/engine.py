"""The engine's verbs: load, enrich, link, gds, vulns, query, score, score_cycles, stats, inspect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.functions import ids
from repograph.operators import link as linking
from repograph.operators.tables import together, written
from repograph.plans import named, scoring, vulnerabilities
from repograph.plans.graph import Graph
from repograph.sources import artifacts, corpus, files, manifests, osv, pylint, pysource

#: Queries by their numbers, and the parameters that they need.
QUERIES = {f"q{n}": getattr(named, f"q{n:02d}") for n in range(1, 20)}
NEEDS = {"q12": ("community",), "q13": ("between", "community"), "q14": ("points", "between")}


class Engine:
    """A graph, the corpus configuration that it is of, and where artifacts and checkouts lie:
    {artifacts}/{extractor}/{corpus}/{repo}/{file} and {sources}/{repo}/…"""

    def __init__(self, spark: SparkSession, config: str = "corpora: {}", artifacts_dir: str = "", sources_dir: str = "", graph: Graph | None = None) -> None:
        self.spark, self.config, self.artifacts_dir, self.sources_dir = spark, config, artifacts_dir, sources_dir
        self.graph = graph or Graph(spark)
        self._tables: dict[str, DataFrame] = {}

    def repos(self, name: str, tiers: tuple[str, ...] | None = None) -> DataFrame:
        return corpus.repos(self.spark, self.config, name, tiers)

    def sources(self, name: str, glob: str, skip: list[str] | None = None) -> DataFrame:
        """repo, ecosystem, path, text of the corpus's checked-out files."""
        found = files.read_tree(self.spark, self.sources_dir, glob, skip, corpus.excluded_globs(self.config))
        return files.of_repos(found, self.repos(name))

    def load(self, name: str, extractor: str, lock: str = "", replace: bool = False, missing_ok: bool = True) -> dict[str, int]:
        """Loads one extractor's artifacts of a corpus, and the manifests. A repository without an artifact is skipped."""
        x, g = artifacts.EXTRACTORS[extractor], self.graph
        repos = self.repos(name)
        locked = corpus.lock(self.spark, lock).where(F.col("corpus") == name) if lock else None
        if replace:
            g.drop_repo(repos)
        g.load("Repo", corpus.repo_rows(repos, locked, self._provenance(f"{self.artifacts_dir}/{extractor}/{name}"), extractor))
        g.load_packages(corpus.published(repos))
        declared = self._manifests(name, repos)
        if declared is not None:
            g.load_packages(manifests.package_rows(declared))
        at = {r.dir: f"{self.artifacts_dir}/{extractor}/{name}/{r.dir}/{x.artifact}" for r in repos.select("dir").distinct().collect()}  # a configuration's
        there = {d: path for d, path in at.items() if self._exists(path)}
        if len(there) < len(at) and not missing_ok:
            raise FileNotFoundError(", ".join(f"{extractor}/{name}/{d}" for d in sorted(set(at) - set(there))))
        if there:
            self._load_artifacts(x, sorted(there.values()), repos, name)
        return {"repos": len(there), **{r["name"]: r["rows"] for r in g.stats().collect()}}

    def _load_artifacts(self, x, paths: list[str], repos: DataFrame, name: str) -> None:
        """All artifacts at once: each is parsed once, and the graph's tables are written once."""
        g = self.graph
        told = artifacts.of_repos(x.read(self.spark, *paths), repos)
        told = together({n: lambda n=n: written(told[n], n) for n in told})
        g.load_files(x.files(told))
        g.load_symbols(x.symbols(told))
        g.load("CALLS", x.calls(told))
        g.load("IMPORTS", artifacts.go_import_contexts(x.file_imports(told)))
        g.load_external_refs(x.external_refs(told, bindings=self._bindings(name)), "USES" if x.anchor == "symbol" else "IMPORTS_EXT")
        g.settle()

    def _provenance(self, base: str) -> DataFrame | None:
        """What the artifacts say they were made of: their own commit comes before a locked one."""
        return artifacts.read_provenance(self.spark, base) if self._exists(base) else None

    def _exists(self, path: str) -> bool:
        """Whether there is such a file in whatever store the path names."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _bindings(self, name: str) -> DataFrame | None:
        if not self.sources_dir:
            return None
        own = self.sources(name, "*.{py,go}")
        return pysource.bindings(pysource.statements(own), own)

    def _manifests(self, name: str, repos: DataFrame) -> DataFrame | None:
        if not self.sources_dir:
            return None
        place = repos.withColumn("subpath", F.coalesce("manifest_subpath", "subpath"))
        found = files.of_repos(files.read_tree(self.spark, self.sources_dir, "*", files.MANIFEST_SKIP_DIRS), place)
        found = written(found.where(F.regexp_like("path", F.lit(r"(^|/)(requirements[^/]*\.txt|pyproject\.toml|go\.mod)$"))), "manifests")
        python, go = found.where("ecosystem = 'python'"), found.where("ecosystem = 'go'")
        return manifests.python_dependencies(python).unionByName(manifests.go_dependencies(go))

    def enrich(self, name: str, goscan_dir: str = "") -> Graph:
        """Adds what the sources say: module names, contexts of imports, external references."""
        g = self.graph
        python = written(self.sources(name, "*.py").where("ecosystem = 'python'"), "sources")
        stated = written(pysource.statements(python), "statements")
        index = written(pysource.module_index(python), "modules")
        g.set_modules(pysource.module_rows(index))
        g.load("IMPORTS", pysource.classified_imports(stated, index))
        g.load_external_refs(pysource.external_imports(stated), "IMPORTS_EXT")
        if goscan_dir:
            g.load_external_refs(artifacts.goscan_external_refs(self._goscan(name, goscan_dir)), "IMPORTS_EXT")
        return g.settle()

    def _goscan(self, name: str, base: str) -> dict[str, DataFrame]:
        """refs and defs of all scans {base}/{corpus}/{repo}.json."""
        repos = self.repos(name).where("ecosystem = 'go'")
        docs = artifacts.read_json(self.spark, [f"{base}/{name}/{r.dir}.json" for r in repos.collect()], artifacts.GOSCAN)
        told = docs.withColumn("of_dir", F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1))
        return artifacts.of_repos({n: artifacts.part(told, n) for n in ("refs", "defs")}, repos)

    def link(self, nested: bool = False) -> DataFrame:
        linking.link(self.graph, nested)
        return linking.report(self.graph)

    def gds(self) -> dict[str, DataFrame]:
        """The whole-graph algorithms' results, each a written table by id."""
        g = self.graph
        self._tables = {
            "community": written(named.community_table(g), "community"), "between": written(named.betweenness_table(g), "between"),
            "pagerank": written(named.pagerank_table(g), "pagerank"), "points": written(named.articulation_table(g), "points"),
        }
        return self._tables

    def vulns(self, advisories: DataFrame | None = None) -> DataFrame:
        """Assesses declared packages against advisories (ecosystem, name, doc), fetched if none are given."""
        if advisories is None:
            advisories = osv.fetch(vulnerabilities.declarations(self.graph).select("ecosystem", "name"))
        vulnerabilities.load(self.graph, written(advisories, "advisories"))
        return vulnerabilities.histogram(self.graph)

    def query(self, name: str, **params) -> DataFrame:
        """q1 … q19. Those over algorithms' results run `gds` first if nothing has."""
        if name not in QUERIES:
            raise KeyError(f"no query {name}; there are {', '.join(QUERIES)}")
        if name in NEEDS:
            if not self._tables:
                self.gds()
            params = {n: self._tables[n] for n in NEEDS[name]} | params
        return QUERIES[name](self.graph, **params)

    def truth(self, name: str, goscan_dir: str = "") -> DataFrame:
        """The edges that must be found, from sources alone."""
        repos = self.repos(name)
        pub = corpus.published(repos).select(F.col("repo").alias("dst_repo"), "name", "ecosystem")
        if goscan_dir:
            scan = self._goscan(name, goscan_dir)
            return scoring.truth_go(artifacts.goscan_refs(scan), pub.where("ecosystem = 'go'").select("dst_repo", "name"), artifacts.goscan_defs(scan))
        stated = written(pysource.statements(self.sources(name, "*.py")), "statements")
        surface = pysource.importable(stated).select(F.col("repo").alias("dst_repo"), "symbol")
        return scoring.truth_python(pysource.imported(stated), pub.where("ecosystem = 'python'").select("dst_repo", "name"), surface)

    def score(self, name: str, truth: DataFrame | None = None) -> DataFrame:
        """All arms at symbol level against the truth; those empty by construction are labelled so."""
        ids_ = [r.id for r in self.repos(name).collect()]
        t = written(truth if truth is not None else self.truth(name), "truth")
        g = self.graph
        arms = scoring.predicted(g, ids_).withColumn("arm", F.lit("unified")).unionByName(
            scoring.predicted_with_source(g, ids_).withColumn("arm", F.lit("unified+source"))
        )
        for x in artifacts.EXTRACTORS:
            arms = arms.unionByName(scoring.predicted_by(g, x, ids_).withColumn("arm", F.lit(f"artifact:{x}")))
        found = scoring.score(arms, t)
        claimed = found.select("arm")
        names = ["unified", "unified+source", *(f"artifact:{x}" for x in artifacts.EXTRACTORS)]
        silent = [n for n in names if n not in {r.arm for r in claimed.collect()}]
        return found.unionByName(scoring.empty_arms(t, ["raw (by construction)", "single-tool (by construction)", "manifest-only (by construction)", *silent]))

    def score_cycles(self, output: DataFrame, name: str) -> DataFrame:
        """Modules in import cycles by five arms against a linter's captured output (repo, text)."""
        index = pysource.module_index(self.sources(name, "*.py"))
        modules = index.select(ids.file_id(F.col("repo"), F.col("path")).alias("id"), "module")
        arms = None
        for arm in ("modules", "modules_core", "modules_all_ctx", "modules_all_design", "modules_design"):
            rows = named.cycle_members(self.graph, arm).join(modules, "id").select(F.lit(arm).alias("arm"), "module")
            arms = rows if arms is None else arms.union(rows)
        return scoring.cycle_scores(arms, pylint.members(output).select("module"))

    def stats(self) -> DataFrame:
        return self.graph.stats()

    def inspect(self, path: str, schema: str, array: str, column: str) -> DataFrame:
        """The commonest values of a field of an artifact's rows."""
        df = artifacts.read_json(self.spark, path, schema).select(F.explode(array).alias("x")).select("x.*")
        return artifacts.inspect(df, column)

    def validate(self, changed: str, lib_repo: str, name: str) -> dict[str, int]:
        """Runs every query and says how many rows each has: the smoke matrix for one corpus."""
        params = {"q4": {"lib_repo": lib_repo}, "q9": {"corpus": name}, "q10": {"corpus": name}}
        params |= {q: {"changed": changed} for q in ("q1", "q2", "q3", "q11", "q16")}
        return {q: self.query(q, **params.get(q, {})).count() for q in QUERIES}
