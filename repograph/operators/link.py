"""Derived edges across repositories: repository dependencies, resolution of external
references, and their lifts to files and symbols.

Every join is an equi-join on ids, names or modules. The longest-prefix match turns a
module path into its prefixes at / boundaries and joins these with the published names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repograph.functions.ids import strength
from repograph.operators.tables import together, written
from repograph.operators.upsert import set_union


#: Tasks that the importers of a module are dealt over.
SALTS = 32


def prefixes(path: Column) -> Column:
    """a/b/c as [a, a/b, a/b/c]."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def longest_prefix(left: DataFrame, path: str, right: DataFrame, name: str, key: list[str]) -> DataFrame:
    """left joined with the rows of right whose name is the longest prefix of path at a boundary.
    key identifies a row of left; of equal names the least other columns win."""
    each = left.withColumn("__prefix", F.explode(prefixes(F.col(path))))
    met = each.join(right, each["__prefix"] == right[name])
    rest = [F.col(c) for c in right.columns if c != name]
    best = W.partitionBy(*key).orderBy(F.length(name).desc(), *rest)
    return met.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "__prefix")


def depends_on_repo(graph) -> DataFrame:
    """A repository depends on the publisher of a package that it declares."""
    pkg = graph["Package"].select(F.col("id").alias("dst"), F.col("name"))
    dep = graph["DEPENDS_ON"].select(F.col("src").alias("consumer"), "dst")
    pub = graph["PUBLISHES"].select(F.col("src").alias("publisher"), "dst")
    met = dep.join(pub, "dst").where("consumer <> publisher").join(pkg, "dst")
    return met.groupBy(F.col("consumer").alias("src"), F.col("publisher").alias("dst")).agg(
        F.array_sort(F.collect_set("name")).alias("via"),
        F.lit("manifest").alias("method"), F.lit(1.0).alias("confidence"), F.lit(True).alias("cross_repo"),
    )


def _published(graph, ecosystem: str) -> DataFrame:
    pkg = graph["Package"].where(F.col("ecosystem") == ecosystem).select(F.col("id").alias("dst"), F.col("name").alias("package"))
    return graph["PUBLISHES"].join(pkg, "dst").select(F.col("src").alias("publisher"), "package")


def _targets(graph) -> DataFrame:
    return graph["Symbol"].where("exported").select(
        F.col("id").alias("dst"), F.col("name").alias("target"), F.col("repo").alias("publisher"), "path", "kind", F.col("file")
    )


def resolve_go(graph, nested: bool = False) -> DataFrame:
    """By the longest published module path; the symbol must be exported, no method, and in the package's
    own directory (with nested, in one below too)."""
    refs = graph["ExternalRef"].where("ecosystem = 'go' and module is not null and symbol is not null").select(
        F.col("id").alias("src"), "module", "symbol"
    )
    best = longest_prefix(refs, "module", _published(graph, "go"), "package", ["src"])
    best = best.withColumn("pkgdir", F.expr("substring(module, length(package) + 2)"))
    target = _targets(graph).where("kind is null or kind <> 'method'")
    met = best.join(target, (best["publisher"] == target["publisher"]) & (best["symbol"] == target["target"]))
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    inside = directory == F.col("pkgdir")
    if nested:
        inside = F.when(F.col("pkgdir") == "", ~F.col("path").contains("/")).otherwise(F.col("path").startswith(F.concat("pkgdir", F.lit("/"))))
    return met.where(inside).select(
        "src", "dst", F.lit("go-module-prefix").alias("method"), F.lit(1.0).alias("confidence"), "pkgdir",
        F.lit(None).cast("boolean").alias("ambiguous"), F.lit(None).cast("long").alias("candidates"), F.lit(None).cast("long").alias("providers"),
    )


def resolve_python_package(graph) -> DataFrame:
    """By root package and symbol name; 0.8 if it is the only candidate, else 0.5."""
    refs = graph["ExternalRef"].where("ecosystem = 'python' and symbol is not null").select(
        F.col("id").alias("src"), F.col("root_module").alias("package"), F.col("symbol").alias("target")
    )
    met = refs.join(_published(graph, "python"), "package").join(_targets(graph), ["publisher", "target"])
    one = met.select("src", "dst").distinct().withColumn("candidates", F.count("*").over(W.partitionBy("src")))
    return one.select(
        "src", "dst", F.lit("python-package-symbol").alias("method"),
        F.when(F.col("candidates") == 1, 0.8).otherwise(0.5).alias("confidence"), F.lit(None).cast("string").alias("pkgdir"),
        (F.col("candidates") > 1).alias("ambiguous"), "candidates", F.lit(None).cast("long").alias("providers"),
    )


def resolve_python_module(graph) -> DataFrame:
    """By the exact module path of a file, for refs that another repository imports; 1.0 if one file provides it."""
    refs = graph["ExternalRef"].where("ecosystem = 'python' and symbol is not null and module is not null").select(
        F.col("id").alias("src"), "module", F.col("symbol").alias("target")
    )
    files = graph["File"].where("module is not null").select(F.col("id").alias("file"), "module", F.col("repo").alias("provider"))
    importing = graph["IMPORTS_EXT"].select(F.col("src").alias("file"), F.col("dst").alias("src")).join(
        graph["File"].select(F.col("id").alias("file"), F.col("repo").alias("consumer")), "file"
    ).select("src", "consumer").distinct()
    # Whether some importer lies in another repository than the provider follows from the least and the greatest.
    span = importing.groupBy("src").agg(F.min("consumer").alias("low"), F.max("consumer").alias("high"))
    # by module and name at once: files that share a module don't meet all its references
    targets = _targets(graph).select("dst", "target", "file").join(files, "file")
    met = refs.join(targets, ["module", "target"]).join(span, "src").where("low <> provider or high <> provider")
    found = met.select("src", "dst", "file").distinct()
    many = found.groupBy("src").agg(F.countDistinct("file").alias("providers"))
    return found.select("src", "dst").distinct().join(many, "src").select(
        "src", "dst", F.lit("python-module-path").alias("method"),
        F.when(F.col("providers") == 1, 1.0).otherwise(0.6).alias("confidence"), F.lit(None).cast("string").alias("pkgdir"),
        (F.col("providers") > 1).alias("ambiguous"), F.lit(None).cast("long").alias("candidates"), "providers",
    )


def resolves_to(graph, nested: bool = False) -> DataFrame:
    """The three rules in order; the first that makes an edge keeps its values, all are named in methods."""
    rules = (resolve_go(graph, nested), resolve_python_package(graph), resolve_python_module(graph))
    rows = None
    for n, r in enumerate(rules):
        r = r.withColumn("rule", F.lit(n))
        rows = r if rows is None else rows.unionByName(r)
    values = ("method", "confidence", "pkgdir", "ambiguous", "candidates", "providers")
    first = F.min_by(F.struct(*values), "rule")
    merged = rows.groupBy("src", "dst").agg(first.alias("v"), F.array_sort(F.collect_set("method")).alias("methods"))
    return merged.select("src", "dst", "v.*", "methods", F.lit(True).alias("cross_repo"))


def module_imports(graph) -> DataFrame:
    """src, consumer_repo, via_module, line, context, guarded: a file's strongest import of each Python module that
    some file provides; made once for a graph as it is."""
    if "module-imports" not in graph.memo:
        refs = graph["ExternalRef"].where("ecosystem = 'python' and module is not null").select(F.col("id").alias("dst"), F.col("module").alias("via_module"))
        refs = refs.join(_providers(graph).select("via_module").distinct(), "via_module", "left_semi")
        consumers = graph["File"].select(F.col("id").alias("src"), F.col("repo").alias("consumer_repo"))
        met = graph["IMPORTS_EXT"].select("src", "dst", "line", "context", "guarded").join(refs, "dst").join(consumers, "src")
        best = F.min_by(
            F.struct("line", F.coalesce("context", F.lit("toplevel")).alias("context"), F.coalesce("guarded", F.lit(False)).alias("guarded")),
            F.struct(-strength(F.col("context"), F.col("guarded")), F.coalesce("line", F.lit(2**31 - 1))),
        )
        rows = met.groupBy("src", "consumer_repo", "via_module").agg(best.alias("v")).select("src", "consumer_repo", "via_module", "v.*")
        graph.memo["module-imports"] = written(rows, "module-imports")
    return graph.memo["module-imports"]


def _providers(graph) -> DataFrame:
    return graph["File"].where("module is not null").select(F.col("id").alias("provider"), F.col("module").alias("via_module"), F.col("repo").alias("provider_repo"))


def providers_by_repo(graph) -> DataFrame:
    """via_module, provider_repo, providers: how many files of a repository have each module."""
    return _providers(graph).groupBy("via_module", "provider_repo").agg(F.count("*").alias("providers"))


def imports_file_cross_repo(graph) -> DataFrame:
    """Files whose module another repository's file imports; of several imports the strongest. A file has one module, so
    a pair's imports are those of that module. The importers of a module are dealt over SALTS tasks; nothing is sorted after."""
    salt = F.pmod(F.hash("src"), F.lit(SALTS))
    to = _providers(graph).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = module_imports(graph).withColumn("salt", salt).join(to, ["via_module", "salt"]).where("consumer_repo <> provider_repo")
    return met.select(
        "src", F.col("provider").alias("dst"), F.lit("python-module-path").alias("method"), F.lit(1.0).alias("confidence"), "via_module", "line", "context", "guarded", F.lit(True).alias("cross_repo")
    )


def count_file_imports(graph) -> DataFrame:
    """n: the rows of imports_file_cross_repo, counted by module and repository without making them."""
    users = module_imports(graph).groupBy("via_module", "consumer_repo").agg(F.count("*").alias("users"))
    met = users.join(providers_by_repo(graph), "via_module").where("consumer_repo <> provider_repo")
    return met.agg(F.coalesce(F.sum(F.col("users") * F.col("providers")), F.lit(0)).alias("n"))


def _lift(graph, resolved: DataFrame, edge: str, anchor: str) -> DataFrame:
    """(anchor) -edge-> ref -RESOLVES_TO-> symbol in another repository."""
    refs = graph["ExternalRef"].select(F.col("id").alias("ref"), F.col("module").alias("via_module"))
    other = graph["Symbol"].select(F.col("id").alias("dst"), F.col("repo").alias("dst_repo"))
    to = resolved.select(F.col("src").alias("ref"), "dst", "confidence").join(refs, "ref").join(other, "dst")
    own = graph[anchor].select(F.col("id").alias("src"), F.col("repo").alias("src_repo"))
    # the edges meet what there is for a reference once, and by source last: sums by (src, dst) need no shuffle after it
    return graph[edge].withColumnRenamed("dst", "ref").join(to, "ref").drop("ref").join(own, "src").where("src_repo <> dst_repo")


def calls_cross_repo(graph, resolved: DataFrame) -> DataFrame:
    """Calls through a resolved reference. Of several, the greatest confidence, then the least module."""
    met = _lift(graph, resolved, "USES", "Symbol")
    best = F.min_by(F.struct("confidence", "via_module"), F.struct(-F.col("confidence"), "via_module"))
    return met.groupBy("src", "dst").agg(best.alias("v"), set_union("extractors").alias("extractors")).select(
        "src", "dst", F.lit("package-lift").alias("method"), "v.confidence", "v.via_module", F.lit(True).alias("cross_repo"), "extractors"
    )


def imports_cross_repo(graph, resolved: DataFrame) -> DataFrame:
    """File to symbol through a resolved import. Of several: confidence, then module, then line."""
    met = _lift(graph, resolved, "IMPORTS_EXT", "File")
    best = F.min_by(
        F.struct("confidence", "via_module", "line", "context"),
        F.struct(-F.col("confidence"), "via_module", F.coalesce("line", F.lit(2**31 - 1)), "context"),
    )
    return met.groupBy("src", "dst").agg(best.alias("v")).select(
        "src", "dst", F.lit("source-import").alias("method"), "v.confidence", "v.via_module", "v.line", "v.context", F.lit(True).alias("cross_repo")
    )


def link(graph, nested: bool = False):
    """Derives all five edge tables, each written once as several queries read it."""
    first = {"DEPENDS_ON_REPO": depends_on_repo, "RESOLVES_TO": lambda g: resolves_to(g, nested), "IMPORTS_FILE_CROSS_REPO": imports_file_cross_repo}
    then = {"CALLS_CROSS_REPO": calls_cross_repo, "IMPORTS_CROSS_REPO": imports_cross_repo}
    for name, table in together({n: lambda n=n, f=f: written(f(graph), n) for n, f in first.items()}).items():
        graph[name] = table
    for name, table in together({n: lambda n=n, f=f: written(f(graph, graph["RESOLVES_TO"]), n) for n, f in then.items()}).items():
        graph[name] = table
    return graph


def link_later(graph):
    """link, but each table only when it is first read."""
    graph.later |= {
        "DEPENDS_ON_REPO": lambda: written(depends_on_repo(graph), "DEPENDS_ON_REPO"),
        "RESOLVES_TO": lambda: written(resolves_to(graph), "RESOLVES_TO"),
        "IMPORTS_FILE_CROSS_REPO": lambda: written(imports_file_cross_repo(graph), "IMPORTS_FILE_CROSS_REPO"),
        "CALLS_CROSS_REPO": lambda: written(calls_cross_repo(graph, graph["RESOLVES_TO"]), "CALLS_CROSS_REPO"),
        "IMPORTS_CROSS_REPO": lambda: written(imports_cross_repo(graph, graph["RESOLVES_TO"]), "IMPORTS_CROSS_REPO"),
    }
    return graph


def rows(graph, name: str) -> DataFrame:
    """A derived table, which isn't written for a single reader."""
    if name == "CALLS_CROSS_REPO" and name in graph.later:
        return calls_cross_repo(graph, graph["RESOLVES_TO"])
    if name == "IMPORTS_CROSS_REPO" and name in graph.later:
        return imports_cross_repo(graph, graph["RESOLVES_TO"])
    return graph[name]


def report(graph) -> DataFrame:
    """Edges and mean confidence by relationship and method."""
    out = None
    for name in ("RESOLVES_TO", "DEPENDS_ON_REPO", "IMPORTS_FILE_CROSS_REPO", "CALLS_CROSS_REPO", "IMPORTS_CROSS_REPO"):
        if name == "IMPORTS_FILE_CROSS_REPO" and name in graph.later:
            some = count_file_imports(graph).where("n > 0")
            told = some.select(F.lit(name).alias("relationship"), F.lit("python-module-path").alias("method"), F.col("n").alias("edges"), F.lit(1.0).alias("avg_confidence"))
        else:
            told = rows(graph, name).where("cross_repo").groupBy(F.lit(name).alias("relationship"), "method").agg(F.count("*").alias("edges"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))
        out = told if out is None else out.unionByName(told)
    return out.orderBy(F.col("edges").desc(), "relationship", "method")
