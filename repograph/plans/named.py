"""The nineteen named queries. Each takes a Graph and parameters and returns a DataFrame.

Results are ordered with a total tie-break; slices of collected lists are of the sorted list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.functions.ids import last_segment
from repograph.operators import articulation, communities, cycles, link, rank, traverse
from repograph.operators.components import strongly_connected
from repograph.operators.link import prefixes
from repograph.operators.numbering import numbered, weighted
from repograph.operators.tables import written

#: Fixed values that results must equal.
TEST_PATH = r"(?i).*(_test\.go|test_.*\.py|.*_test\.py|/tests?/.*|.*\.spec\..*)"
UNSHIPPED = (r"(?i).*(^|/)(tests?|conftest)(/|\.|_).*", r"(?i).*(_test\.py|test_.*\.py)$")
MISS, THIRD_PARTY = "RESOLUTION MISS - fix the linking pass", "genuine third-party, expected"
EVIDENCE = {3: "corroborated by all three", 2: "two of three", 1: "single extractor - verify"}
SEVERITIES = ("CRITICAL", "HIGH", "MODERATE", "LOW")
NO_IMPORT = "no direct import - may still be used transitively"
ACT, RESOLVE = "REACHABLE and affected - act on this", "reachable, but status needs the version resolved"
TEST_ONLY = "test-only - a CI dependency gap, not shipped exposure"
SHIPPED = "SHIPPED CODE imports an undeclared package with known CVEs"


def _full(x: Column, pattern: str) -> Column:
    """The whole string matches."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return F.regexp_like(x, F.lit(f"{flags}^(?:{pattern.removeprefix('(?i)')})$"))


def _sorted_set(x) -> Column:
    return F.array_sort(F.collect_set(x))


def _symbols(graph) -> DataFrame:
    return graph["Symbol"].select("id", "repo", "path", "qname", "start_line")


def _start(graph, changed: str) -> DataFrame:
    return graph["Symbol"].where(F.col("id") == changed).select("id", "repo", "path", "qname", "start_line")


def _callers(graph, changed: str, depth: int, *types: str) -> DataFrame:
    """repo, path of the symbols that reach `changed`."""
    reached = traverse.reach(graph.edges(*types), _start(graph, changed).select("id"), depth)
    return reached.join(_symbols(graph), "id").select("id", "repo", "path")


def _importers(graph, changed: str) -> DataFrame:
    to = graph["IMPORTS_CROSS_REPO"].where(F.col("dst") == changed)
    return to.join(graph["File"].select(F.col("id").alias("src"), "repo", "path"), "src")


def q01(graph, changed: str, depth: int = 6) -> DataFrame:
    """Blast radius across repositories: impacted files by repository, over calls or imports."""
    calls = _callers(graph, changed, depth, "CALLS", "CALLS_CROSS_REPO").select("repo", "path", F.lit("call-path").alias("via"))
    rows = calls.union(_importers(graph, changed).select("repo", "path", F.lit("import").alias("via"))).distinct()
    origin = _start(graph, changed).select(F.col("repo").alias("origin"))
    out = rows.groupBy("repo").agg(F.countDistinct("path").alias("impacted_files"), _sorted_set("via").alias("reached_via"))
    return (
        out.join(F.broadcast(origin))  # one row
        .select(F.col("repo").alias("impacted_repo"), "impacted_files", "reached_via", (F.col("repo") != F.col("origin")).alias("is_cross_repo"))
        .orderBy(F.col("is_cross_repo").desc(), F.col("impacted_files").desc(), "impacted_repo")
    )


def q02(graph, changed: str, depth: int = 6) -> DataFrame:
    """The control: the same within the repository, over calls only."""
    calls = _callers(graph, changed, depth, "CALLS")
    own = _start(graph, changed).select(F.col("repo").alias("scope"))
    return calls.join(F.broadcast(own), F.col("repo") == F.col("scope")).groupBy("scope").agg(
        F.countDistinct("path").alias("impacted_files_single_repo")
    )


def q03(graph, changed: str, depth: int = 6) -> DataFrame:
    """The best evidence path for each impacted repository."""
    edges = graph["CALLS"].select("src", "dst", F.col("confidence").alias("conf")).union(graph["CALLS_CROSS_REPO"].select("src", "dst", "confidence"))
    start = _start(graph, changed)
    best = traverse.best_paths(edges, start.select("id"), depth)
    site = lambda path, line: F.concat(path, F.lit(":"), F.coalesce(line.cast("string"), F.lit("?")))
    # the names on a chain, caller first
    own = start.select(F.col("repo").alias("origin"))
    ends = best.join(_symbols(graph).select("id", "repo"), "id").join(F.broadcast(own)).where("repo <> origin")
    # one best row for each repository before names are fetched
    order = F.struct(-F.round("conf", 6), "hops", "chain")
    top = ends.groupBy("repo").agg(F.min_by(F.struct("hops", "conf", "chain"), order).alias("b")).select("repo", "b.*")
    steps = top.select("repo", "hops", "conf", F.posexplode(F.reverse("chain")).alias("at", "id")).join(_symbols(graph).drop("repo"), "id")
    named = steps.groupBy("repo", "hops", "conf").agg(
        F.array_sort(F.collect_list(F.struct("at", "qname", site(F.col("path"), F.col("start_line")).alias("site")))).alias("s")
    ).select("repo", "hops", "conf", F.col("s.qname").alias("chain"), F.col("s.site").alias("citations"))
    target = F.broadcast(start.select(F.col("repo").alias("origin"), F.col("path").alias("to_path"), F.col("qname").alias("to_qname"), F.col("start_line").alias("to_line")))
    imports = _importers(graph, changed).join(target).where("repo <> origin").select(
        "repo", F.lit(1).alias("hops"), F.coalesce("confidence", F.lit(1.0)).alias("conf"), F.array("path", "to_qname").alias("chain"),
        F.array(site(F.col("path"), F.col("line")), site(F.col("to_path"), F.col("to_line"))).alias("citations"),
    )
    key = F.struct(-F.round("conf", 6), "hops", "chain", "citations")
    out = named.union(imports).groupBy("repo").agg(F.min_by(F.struct("hops", "chain", "citations", "conf"), key).alias("b"))
    return out.select(
        F.col("repo").alias("impacted_repo"), "b.hops", F.col("b.chain").alias("call_chain"), "b.citations", F.round("b.conf", 6).alias("path_confidence")
    ).orderBy(F.col("path_confidence").desc(), "hops", "impacted_repo")


def _consumers(graph) -> DataFrame:
    """dst (symbol), src, repo of the consumer over both cross-repository edges."""
    a = graph["CALLS_CROSS_REPO"].select("src", "dst").join(graph["Symbol"].select(F.col("id").alias("src"), "repo"), "src")
    b = graph["IMPORTS_CROSS_REPO"].select("src", "dst").join(graph["File"].select(F.col("id").alias("src"), "repo"), "src")
    return a.select("src", "dst", "repo").union(b.select("src", "dst", "repo"))


def q04(graph, lib_repo: str, limit: int = 25) -> DataFrame:
    """Fan-in of a shared library's symbols."""
    target = graph["Symbol"].where(F.col("repo") == lib_repo).select(F.col("id").alias("dst"), "qname", "path")
    met = _consumers(graph).join(target, "dst")
    out = met.groupBy("dst", "qname", "path").agg(
        F.countDistinct("repo").alias("consuming_repos"), F.countDistinct("src").alias("consuming_symbols"), _sorted_set("repo").alias("consumers")
    )
    return out.orderBy(F.col("consuming_repos").desc(), F.col("consuming_symbols").desc(), "dst").limit(limit).select(
        F.col("qname").alias("symbol"), F.col("path").alias("defined_in"), "consuming_repos", "consuming_symbols", "consumers"
    )


def q05(graph, limit: int = 30, loose: bool = False) -> DataFrame:
    """Unresolved references, and whether a repository of the corpus publishes what they name.

    A module matches a package at a / boundary; with loose, as any string prefix."""
    refs = graph["ExternalRef"].join(graph["RESOLVES_TO"].select(F.col("src").alias("id")), "id", "left_anti").select(
        "id", "module", F.coalesce("root_module", "module").alias("name")
    )
    pub = graph["PUBLISHES"].select(F.col("dst").alias("p"), F.col("src").alias("publisher")).join(
        graph["Package"].select(F.col("id").alias("p"), F.col("name").alias("package")), "p"
    ).select("publisher", "package")
    if loose:
        met = refs.join(pub, (F.col("package") == F.col("name")) | F.col("module").startswith(F.col("package")))
    else:
        keys = F.array_distinct(F.concat(F.array("name"), F.coalesce(prefixes(F.col("module")), F.array().cast("array<string>"))))
        met = refs.withColumn("key", F.explode(keys)).join(pub, F.col("key") == F.col("package"))
    hits = met.groupBy("id").agg(F.count("*").alias("n"))
    each = refs.join(hits, "id", "left").select("name", F.coalesce("n", F.lit(1)).alias("n"), F.col("n").isNotNull().alias("in_corpus"))
    out = each.groupBy(F.col("name").alias("module"), "in_corpus").agg(F.sum("n").alias("unresolved_refs"))
    return out.select(
        "module", "unresolved_refs", "in_corpus", F.when(F.col("in_corpus"), MISS).otherwise(THIRD_PARTY).alias("verdict")
    ).orderBy(F.col("in_corpus").desc(), F.col("unresolved_refs").desc(), "module").limit(limit)


def _percent(counts: DataFrame, n: str, name: str) -> DataFrame:
    """Adds the share of the total, in percent. The total is one aggregate row, joined on: no task gets all rows."""
    total = counts.agg(F.sum(n).alias("__total"))
    return counts.join(F.broadcast(total)).withColumn(name, F.round(100.0 * F.col(n) / F.col("__total"), 1)).drop("__total")


def q06(graph) -> DataFrame:
    """How the cross-repository calls were inferred, and how sure that is."""
    counts = graph["CALLS_CROSS_REPO"].groupBy(F.col("method").alias("inference_method"), "confidence").agg(F.count("*").alias("edges"))
    return _percent(counts, "edges", "pct_of_cross_repo").orderBy(F.col("confidence").desc_nulls_first(), F.col("edges").desc(), "inference_method")


def q07(graph) -> DataFrame:
    """What the corpus holds, by repository."""
    symbols = graph["Symbol"].groupBy("repo").agg(F.count("*").alias("symbols"))
    files = graph["File"].groupBy("repo").agg(F.count("*").alias("files"))
    zero = F.lit(0)
    return (
        graph["Repo"].select(F.col("id").alias("repo"), "commit", F.col("extractors").alias("extracted_by"))
        .join(symbols, "repo", "left").join(files, "repo", "left")
        .select("repo", "commit", F.coalesce("files", zero).alias("files"), F.coalesce("symbols", zero).alias("symbols"), "extracted_by")
        .orderBy(F.col("symbols").desc(), "repo")
    )


def q08(graph) -> DataFrame:
    """Repositories that import from one that their manifest doesn't declare."""
    files = graph["File"].select(F.col("id").alias("src"), F.col("repo").alias("consumer"), "path")
    targets = graph["Symbol"].select(F.col("id").alias("dst"), F.col("repo").alias("publisher"), "name")
    met = graph["IMPORTS_CROSS_REPO"].select("src", "dst").join(files, "src").join(targets, "dst")
    declared = graph["DEPENDS_ON_REPO"].select(F.col("src").alias("consumer"), F.col("dst").alias("publisher"))
    met = met.join(declared, ["consumer", "publisher"], "left_anti")
    out = met.groupBy("consumer", F.col("publisher").alias("undeclared_dependency")).agg(
        F.countDistinct("path").alias("importing_files"),
        F.slice(_sorted_set("name"), 1, 8).alias("example_symbols"), F.slice(_sorted_set("path"), 1, 5).alias("example_files"),
    )
    return out.orderBy(F.col("importing_files").desc(), "consumer", "undeclared_dependency")


def _agreement(rows: DataFrame, name: str) -> DataFrame:
    who = F.array_sort("extractors")
    found_by = F.when(F.col("votes") == 3, "all three").when(F.col("votes") == 1, F.concat(F.lit("only "), F.get("who", F.lit(0)))).otherwise(F.array_join("who", " + "))
    counts = rows.groupBy(who.alias("who")).agg(F.count("*").alias(name)).withColumn("votes", F.size("who"))
    return _percent(counts, name, "pct").select("votes", found_by.alias("found_by"), name, "pct").orderBy(
        F.col("votes").desc(), F.col(name).desc(), "found_by"
    )


def _in_corpus(graph, corpus: str) -> DataFrame:
    return graph["Repo"].where(F.col("corpus") == corpus).select(F.col("id").alias("repo"))


def q09(graph, corpus: str) -> DataFrame:
    """Which extractors agree on symbols."""
    return _agreement(graph["Symbol"].join(_in_corpus(graph, corpus), "repo", "left_semi"), "symbols")


def q10(graph, corpus: str) -> DataFrame:
    """Which extractors agree on calls."""
    own = graph["Symbol"].join(_in_corpus(graph, corpus), "repo", "left_semi").select(F.col("id").alias("src"))
    return _agreement(graph["CALLS"].join(own, "src", "left_semi"), "call_edges")


def q11(graph, changed: str, depth: int = 4) -> DataFrame:
    """Blast radius by the trust of its best path: the least number of extractors on it."""
    edges = graph["CALLS"].select("src", "dst", F.size("extractors").alias("votes"))
    best = traverse.widest(edges, _start(graph, changed).select("id"), depth)
    paths = best.join(_symbols(graph), "id").groupBy("path").agg(F.max("votes").alias("votes"))
    said = F.when(F.col("votes") == 3, EVIDENCE[3]).when(F.col("votes") == 2, EVIDENCE[2]).otherwise(EVIDENCE[1])
    return paths.groupBy(said.alias("evidence")).agg(F.count("*").alias("impacted_files")).orderBy("evidence")


# graph algorithms over the whole organisation

ORG = ("CALLS", "CALLS_CROSS_REPO", "IMPORTS_CROSS_REPO", "DECLARES")


def org_graph(graph) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the undirected projection: symbols and files, calls, imports of symbols, declarations.
    Nodes are numbered, once for all algorithms that run on a graph."""
    if "org" not in graph.memo:
        nodes = graph["Symbol"].select("id").union(graph["File"].select("id"))
        graph.memo["org"] = numbered(graph.edges(*ORG).select("src", "dst"), nodes)
    return graph.memo["org"]


def _numbered_org(graph) -> tuple[DataFrame, DataFrame]:
    """org_graph of a graph whose cross-repository edges nobody has read yet: ends become numbers before edges meet
    references, so that neither those tables nor long ids of their pairs are made. Not written."""
    own = graph["Symbol"].select("id", "repo").union(graph["File"].select("id", "repo"))
    nodes = written(own.groupBy("id").agg(F.min("repo").alias("repo")).orderBy("id").withColumn("n", F.monotonically_increasing_id()), "numbers")
    end = lambda name, n, repo: nodes.select(F.col("id").alias(name), F.col("n").alias(n), F.col("repo").alias(repo))
    to = written(graph["RESOLVES_TO"].select(F.col("src").alias("ref"), "dst").join(end("dst", "d", "there"), "dst").select("ref", "d", "there"), "targets")
    edges = None
    for name in ("CALLS", "DECLARES"):
        e = graph[name].select("src", "dst").join(end("src", "s", "here"), "src").join(end("dst", "d", "there"), "dst").select("s", "d")
        edges = e if edges is None else edges.unionByName(e)
    for name in ("USES", "IMPORTS_EXT"):
        e = graph[name].select("src", F.col("dst").alias("ref")).join(end("src", "s", "here"), "src").select("ref", "s", "here")
        edges = edges.unionByName(e.join(to, "ref").where("here <> there").select("s", "d").distinct())
    return edges.select(F.col("s").alias("src"), F.col("d").alias("dst")), nodes.select("id", "n")


def org_pairs(graph) -> tuple[DataFrame, DataFrame]:
    """(weighted pairs a, b, w; nodes) of the same projection."""
    if "org-pairs" not in graph.memo:
        whole = {"CALLS_CROSS_REPO", "IMPORTS_CROSS_REPO"} <= set(graph.later)
        edges, nodes = _numbered_org(graph) if whole else org_graph(graph)
        graph.memo["org-pairs"] = weighted(edges), nodes
    return graph.memo["org-pairs"]


def community_table(graph, **how) -> DataFrame:
    return communities.of_pairs(*org_pairs(graph), **how)


def betweenness_table(graph, samples: int = 2000, seed: int = 42) -> DataFrame:
    pairs, nodes = org_pairs(graph)
    return rank.betweenness(rank.both_ways(pairs), nodes, samples, seed)


def pagerank_table(graph, rounds: int = 20) -> DataFrame:
    pairs, nodes = org_pairs(graph)
    return rank.pagerank_of_pairs(pairs, nodes, rounds)


def articulation_table(graph) -> DataFrame:
    return articulation.of_pairs(*org_pairs(graph))


def q12(graph, community: DataFrame, limit: int = 20) -> DataFrame:
    """Communities that span repositories. community: id, community."""
    s = graph["Symbol"].select("id", "repo").join(community, "id")
    out = s.groupBy("community").agg(F.count("*").alias("members"), F.collect_set("repo").alias("r"))
    names = F.array_sort(F.array_distinct(F.transform("r", last_segment)))
    return out.where(F.size("r") > 1).select("community", "members", F.size("r").alias("repos_spanned"), names.alias("repos")).orderBy(
        F.col("repos_spanned").desc(), F.col("members").desc(), "community"
    ).limit(limit)


def q13(graph, between: DataFrame, community: DataFrame, limit: int = 20) -> DataFrame:
    """Chokepoints: symbols by betweenness."""
    s = graph["Symbol"].select("id", "repo", "qname", "path").join(between.where("betweenness > 0"), "id").join(community, "id", "left")
    top = s.orderBy(F.col("betweenness").desc(), "id").limit(limit)
    return top.select(
        last_segment(F.col("repo")).alias("repo"), F.col("qname").alias("symbol"), F.col("path").alias("defined_in"), F.round("betweenness").alias("betweenness"), "community"
    )


def q14(graph, points: DataFrame, between: DataFrame, limit: int = 20) -> DataFrame:
    """Fragile seams: articulation points that several repositories consume."""
    used = _consumers(graph).groupBy(F.col("dst").alias("id")).agg(F.countDistinct("repo").alias("consuming_repos")).where("consuming_repos >= 2")
    s = graph["Symbol"].select("id", "repo", "qname", "path").join(used, "id").join(points.where("is_articulation > 0"), "id", "left_semi").join(between, "id", "left")
    top = s.orderBy(F.col("consuming_repos").desc(), F.coalesce("betweenness", F.lit(0.0)).desc(), "id").limit(limit)
    return top.select(
        last_segment(F.col("repo")).alias("defined_in"), F.col("qname").alias("symbol"), "path", "consuming_repos",
        F.round(F.coalesce("betweenness", F.lit(0.0))).alias("betweenness"),
    )


# dependency cycles

LANGUAGES = ("py", "go")


def _files(graph) -> DataFrame:
    return graph["File"].where(F.col("language").isin(*LANGUAGES)).select("id", "path", "repo")


def projection(graph, name: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of one of the module projections.

    modules: toplevel; modules_core: without package facades (__init__.py); modules_all_ctx: any known
    context; modules_all_design: toplevel and typing; modules_design: these without facades;
    modules_xrepo: toplevel within repositories, across them, and through imported symbols."""
    files = _files(graph)
    contexts = {"modules": ("toplevel",), "modules_core": ("toplevel",), "modules_all_design": ("toplevel", "typing"), "modules_design": ("toplevel", "typing"), "modules_xrepo": ("toplevel",)}
    known = F.col("context").isin(*contexts[name]) if name in contexts else F.col("context").isNotNull()
    edges = graph["IMPORTS"].where(known).select("src", "dst")
    if name in ("modules_core", "modules_design"):
        files = files.where(~F.col("path").endswith("__init__.py"))
    if name == "modules_xrepo":
        edges = edges.union(graph["IMPORTS_FILE_CROSS_REPO"].where("context = 'toplevel'").select("src", "dst")).union(_symbol_imports(graph))
    ids = files.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.select("src", "dst").distinct(), ids


def _symbol_imports(graph) -> DataFrame:
    """src, dst: files that import a symbol of another repository at their top level, and the symbol's file."""
    by_symbol = link.rows(graph, "IMPORTS_CROSS_REPO").where("context = 'toplevel'").select("src", F.col("dst").alias("symbol"))
    home = graph["DECLARES"].select(F.col("src").alias("dst"), F.col("dst").alias("symbol"))
    return by_symbol.join(home, "symbol").select("src", "dst")


#: Begins the names of nodes that stand for a module's files; they are greater than any file's id.
HUB = "~hub:"


def _reachable(graph) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) with the paths between files of modules_xrepo: a module's importers in a repository lead to a node
    of their own, and it to the module's files in the others, instead of each importer to each file."""
    files = _files(graph)
    c = link.module_imports(graph).where("context = 'toplevel'").join(files.select(F.col("id").alias("src")), "src", "left_semi")
    hub = F.concat(F.lit(HUB), "via_module", F.lit(":"), "consumer_repo")
    way_in = c.select("src", hub.alias("dst"))
    have = files.join(graph["File"].select("id", F.col("module").alias("via_module")), "id").where("via_module is not null")
    way_out = c.select("via_module", "consumer_repo").distinct().join(have, "via_module").where("consumer_repo <> repo").select(hub.alias("src"), F.col("id").alias("dst"))
    ids = files.select("id")
    plain = graph["IMPORTS"].where("context = 'toplevel'").select("src", "dst").union(_symbol_imports(graph))
    plain = plain.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()
    return plain.union(way_in).union(way_out), ids


PROJECTIONS = ("modules", "modules_core", "modules_all_ctx", "modules_all_design", "modules_design", "modules_xrepo")


def scc(graph, name: str) -> DataFrame:
    """id, component of a projection; found once for a graph as it is."""
    key = f"scc-{name}"
    if key not in graph.memo:
        graph.memo[key] = written(strongly_connected(*(_reachable(graph) if name == "modules_xrepo" and "IMPORTS_FILE_CROSS_REPO" in graph.later else projection(graph, name))), key)
    return graph.memo[key]


def cycle_members(graph, name: str) -> DataFrame:
    """id, component, repo, path of the files in components of more than one."""
    c = scc(graph, name)
    big = c.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return c.join(big, "component").join(_files(graph), "id").select("id", "component", "repo", "path", "n")


def q15(graph, longest: int = 10) -> DataFrame:
    """Circular dependencies: components, their elementary cycles, and the same seen with facades and at design time."""
    core, runtime, design = scc(graph, "modules_core"), scc(graph, "modules"), scc(graph, "modules_design")
    size = lambda c, name: c.groupBy("component").agg(F.count("*").alias(name))
    big = size(core, "core_modules").where("core_modules > 1")
    members = core.join(big, "component")
    edges, _ = projection(graph, "modules_core")
    found = cycles.elementary(edges, members.select("id", "component"), longest)
    best = found.groupBy("component").agg(
        F.count("*").alias("cycles"), F.max("length").alias("longest"), F.min_by("path", F.struct(-F.col("length"), "path")).alias("worst")
    )
    # the greatest component that a member is in, as seen by the other projections
    seen = members.select("id", "component", "core_modules").join(runtime.withColumnRenamed("component", "r"), "id", "left").join(
        design.withColumnRenamed("component", "d"), "id", "left"
    ).join(_files(graph).select("id", "repo"), "id")
    per = seen.groupBy("component", "core_modules").agg(F.min("repo").alias("repo"), F.max("r").alias("r"), F.max("d").alias("d"))
    per = per.join(best, "component").join(size(runtime, "entangled_with_facades").withColumnRenamed("component", "r"), "r", "left")
    per = per.join(size(design, "design_time_modules").withColumnRenamed("component", "d"), "d", "left")
    steps = per.select("component", F.posexplode("worst").alias("at", "id")).join(_files(graph).select("id", "path"), "id")
    named = steps.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]).alias("longest_cycle"))
    return per.join(named, "component").orderBy(F.col("core_modules").desc(), F.col("cycles").desc(), "component").select(
        last_segment(F.col("repo")).alias("repo"), "core_modules", "cycles", "longest",
        F.coalesce("entangled_with_facades", F.lit(0)).alias("entangled_with_facades"), F.coalesce("design_time_modules", F.lit(0)).alias("design_time_modules"), "longest_cycle",
    )


def q16(graph, changed: str, depth: int = 5, pattern: str = TEST_PATH) -> DataFrame:
    """Tests that a change impacts, by repository."""
    rows = _callers(graph, changed, depth, "CALLS", "CALLS_CROSS_REPO").select("repo", "path").union(_importers(graph, changed).select("repo", "path")).distinct()
    out = rows.where(_full(F.col("path"), pattern)).groupBy(F.col("repo").alias("id")).agg(
        F.countDistinct("path").alias("test_files"), F.slice(_sorted_set("path"), 1, 4).alias("examples")
    )
    return out.select(last_segment(F.col("id")).alias("repo"), "test_files", "examples").orderBy(F.col("test_files").desc(), "repo")


def q17(graph) -> DataFrame:
    """Pairs of repositories that import each other, and the cheaper direction to cut."""
    own = graph["File"].select(F.col("id").alias("src"), F.col("repo").alias("a"), "path")
    if "IMPORTS_FILE_CROSS_REPO" in graph.later:  # an import of a module counts for each file that has it; its site is the same for all
        to = link.providers_by_repo(graph).withColumnRenamed("provider_repo", "b")
        x = link.module_imports(graph).where("context = 'toplevel'").join(to, "via_module").where("consumer_repo <> b").join(own, "src")
    else:
        other = graph["File"].select(F.col("id").alias("dst"), F.col("repo").alias("b"))
        x = graph["IMPORTS_FILE_CROSS_REPO"].where("context = 'toplevel'").join(own, "src").join(other, "dst").withColumn("providers", F.lit(1))
    site = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    soft = F.coalesce("guarded", F.lit(False))
    flow = written(
        x.groupBy("a", "b").agg(
            F.sum("providers").alias("edges"), _sorted_set(F.when(~soft, site)).alias("hard"), _sorted_set(F.when(soft, site)).alias("guarded")
        ),
        "flows",
    )
    back = flow.select(F.col("a").alias("b"), F.col("b").alias("a"), *(F.col(c).alias(f"back_{c}") for c in ("edges", "hard", "guarded")))
    pairs = flow.where("a < b").join(back, ["a", "b"])
    dep = graph["DEPENDS_ON_REPO"].select("src", "dst")
    both = dep.join(dep.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").select(
        F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("declared_both_ways")
    )
    # files of a pair's two repositories in a common component: per component and repository first, then per pair
    c = scc(graph, "modules_xrepo").join(graph["File"].select("id", "repo"), "id").groupBy("component", "repo").agg(F.count("*").alias("n"))
    c = written(c, "by-repo")
    shared = pairs.select("a", "b").join(c.select("component", F.col("repo").alias("a"), F.col("n").alias("na")), "a")  # only pairs that there are
    shared = shared.join(c.select("component", F.col("repo").alias("b"), F.col("n").alias("nb")), ["component", "b"]).groupBy("a", "b").agg(F.sum(F.col("na") + F.col("nb")).alias("entangled_modules"), F.count("*").alias("spanning_components"))
    met = pairs.join(both, ["a", "b"], "left").join(shared, ["a", "b"], "left")
    cut_back = F.col("back_edges") <= F.col("edges")
    na, nb = last_segment(F.col("a")), last_segment(F.col("b"))
    arrow = F.lit(" -> ")
    return met.select(
        na.alias("distribution_a"), nb.alias("distribution_b"), F.col("edges").alias("a_to_b_imports"), F.col("back_edges").alias("b_to_a_imports"),
        F.coalesce("declared_both_ways", F.lit(False)).alias("declared_both_ways"), F.coalesce("entangled_modules", F.lit(0)).alias("entangled_modules"),
        F.coalesce("spanning_components", F.lit(0)).alias("spanning_components"),
        F.when(cut_back, F.concat(nb, arrow, na)).otherwise(F.concat(na, arrow, nb)).alias("cut_direction"),
        F.when(cut_back, F.col("back_hard")).otherwise(F.col("hard")).alias("cut_sites_must_fix"),
        F.when(cut_back, F.col("back_guarded")).otherwise(F.col("guarded")).alias("cut_sites_already_guarded"),
    ).orderBy(F.col("entangled_modules").desc(), F.col("a_to_b_imports").desc(), "distribution_a", "distribution_b")


def q18(graph, limit: int = 30) -> DataFrame:
    """Vulnerabilities that declared dependencies may have, and whether the code imports them."""
    v = graph["Vulnerability"].where("withdrawn is null").select(F.col("id").alias("dst"), F.coalesce("cve", "id").alias("advisory"), "severity")
    pkg = graph["Package"].select(F.col("id").alias("package"), "name")
    a = graph["AFFECTED_BY"].where(F.col("status").isin("affected", "indeterminate")).join(v, "dst").join(pkg, "package")
    out = a.groupBy("src", "name", "advisory", "status", "declared").agg(F.collect_set("severity").alias("found"))
    files = graph["File"].select(F.col("id").alias("f"), F.col("repo").alias("src"), "path")
    refs = graph["ExternalRef"].select(F.col("id").alias("dst"), F.col("root_module").alias("name"), "symbol")
    imports = graph["IMPORTS_EXT"].where("context = 'toplevel'").select(F.col("src").alias("f"), "dst", "line").join(refs, "dst").join(files, "f")
    used = imports.groupBy("src", "name").agg(
        F.countDistinct("f").alias("n"), F.slice(_sorted_set(F.concat("path", F.lit(":"), F.col("line").cast("string"))), 1, 4).alias("sites"),
        F.slice(_sorted_set("symbol"), 1, 6).alias("symbols"),
    )
    met = out.join(used, ["src", "name"], "left")
    none = F.array().cast("array<string>")
    n = F.coalesce("n", F.lit(0))
    severity = F.get(F.filter(F.lit(list(SEVERITIES)), lambda s: F.array_contains("found", s)), F.lit(0))
    place = F.when(severity == "CRITICAL", 0).when(severity == "HIGH", 1).when(severity == "MODERATE", 2).otherwise(3)
    said = F.when(n == 0, NO_IMPORT).when(F.col("status") == "affected", ACT).otherwise(RESOLVE)
    rows = met.select(
        "src", last_segment(F.col("src")).alias("repo"), F.col("name").alias("package"), "advisory", severity.alias("severity"), "status", "declared",
        n.alias("importing_files"), said.alias("assessment"), F.coalesce("symbols", none).alias("symbols_used"), F.coalesce("sites", none).alias("import_sites"), place.alias("place"),
    )
    return rows.orderBy(
        F.when(F.col("status") == "affected", 0).otherwise(1), "place", F.col("importing_files").desc(), "src", "package", "advisory", "status", "declared"
    ).limit(limit).drop("src", "place")


def q19(graph, limit: int = 20) -> DataFrame:
    """Imports of vulnerable packages that the repository neither declares nor publishes."""
    live = graph["Vulnerability"].where("withdrawn is null").select(F.col("id").alias("v"), F.coalesce("cve", "id").alias("advisory"))
    pkg = graph["Package"].select(F.col("id").alias("package"), F.col("name").alias("root_module"))
    bad = graph["AFFECTS"].select(F.col("src").alias("v"), F.col("dst").alias("package")).distinct().join(live, "v").join(pkg, "package")
    told = bad.groupBy("package", "root_module").agg(F.countDistinct("v").alias("advisories"), F.slice(_sorted_set("advisory"), 1, 5).alias("examples"))
    files = graph["File"].select(F.col("id").alias("src"), "repo", "path")
    refs = graph["ExternalRef"].select(F.col("id").alias("dst"), "root_module").where("root_module is not null")
    imports = graph["IMPORTS_EXT"].where("context = 'toplevel'").select("src", "dst").join(refs, "dst").join(files, "src")
    paths = imports.groupBy("repo", "root_module").agg(_sorted_set("path").alias("paths"))
    met = paths.join(told, "root_module")
    for edge in ("DEPENDS_ON", "PUBLISHES"):
        known = graph[edge].select(F.col("src").alias("repo"), F.col("dst").alias("package"))
        met = met.join(known, ["repo", "package"], "left_anti")
    shipped = F.filter("paths", lambda p: ~_full(p, UNSHIPPED[0]) & ~F.regexp_like(p, F.lit(f"(?i)^(?:{UNSHIPPED[1].removeprefix('(?i)')})")))
    rows = met.withColumn("shipped", shipped)
    return rows.orderBy(F.size("shipped").desc(), F.col("advisories").desc(), "repo", "package").limit(limit).select(
        last_segment(F.col("repo")).alias("repo"), F.col("root_module").alias("undeclared_package"), "advisories", "examples",
        F.size("shipped").alias("shipped_files"), F.size("paths").alias("total_files"),
        F.when(F.size("shipped") == 0, TEST_ONLY).otherwise(SHIPPED).alias("assessment"), F.slice("shipped", 1, 4).alias("example_files"),
    )
