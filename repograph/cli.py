"""python -m repograph.cli VERB: the engine's verbs over a snapshot folder."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="repograph")
    p.add_argument("--graph", required=True, help="snapshot folder of the graph")
    p.add_argument("--config", help="corpus configuration (YAML)")
    p.add_argument("--lock", help="lock file with pinned commits")
    p.add_argument("--artifacts", default="", help="folder of extractor artifacts")
    p.add_argument("--sources", default="", help="folder of checkouts")
    p.add_argument("--goscan", default="", help="folder of Go scans")
    v = p.add_subparsers(dest="verb", required=True)
    v.add_parser("init", help="write an empty snapshot")
    load = v.add_parser("load")
    load.add_argument("corpus")
    load.add_argument("--extractor", required=True)
    load.add_argument("--replace", action="store_true")
    for name in ("enrich", "score"):
        v.add_parser(name).add_argument("corpus")
    v.add_parser("link").add_argument("--nested", action="store_true")
    for name in ("gds", "stats"):
        v.add_parser(name)
    v.add_parser("vulns").add_argument("--saved", help="JSON lines of saved responses")
    q = v.add_parser("query")
    q.add_argument("name")
    q.add_argument("--param", action="append", default=[], metavar="KEY=VALUE")
    cycles = v.add_parser("score-cycles")
    cycles.add_argument("corpus")
    cycles.add_argument("--output", required=True, help="captured linter output")
    look = v.add_parser("inspect")
    for a in ("path", "schema", "array", "column"):
        look.add_argument(a)
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    from pyspark.sql import SparkSession

    from repograph.engine import Engine
    from repograph.plans.graph import Graph
    from repograph.sources import artifacts, osv

    spark = spark or SparkSession.builder.appName("repograph").getOrCreate()
    text = lambda path: open(path, encoding="utf-8").read() if path else ""  # noqa: E731, SIM115
    if a.verb == "init":
        print(json.dumps(Graph(spark).write(a.graph)))
        return 0
    e = Engine(spark, text(a.config) or "corpora: {}", a.artifacts, a.sources, Graph.read(spark, a.graph).settle())
    out = None
    if a.verb == "load":
        print(json.dumps(e.load(a.corpus, a.extractor, text(a.lock), a.replace)))
    elif a.verb == "enrich":
        e.enrich(a.corpus, a.goscan)
    elif a.verb == "link":
        out = e.link(a.nested)
    elif a.verb == "gds":
        for name, table in e.gds().items():
            table.write.mode("overwrite").parquet(f"{a.graph}/_{name}")
    elif a.verb == "vulns":
        out = e.vulns(osv.read_saved(spark, a.saved) if a.saved else None)
    elif a.verb == "query":
        out = e.query(a.name, **dict(x.split("=", 1) for x in a.param))
    elif a.verb == "score":
        out = e.score(a.corpus, e.truth(a.corpus, a.goscan))
    elif a.verb == "score-cycles":
        from pyspark.sql import functions as F

        out = e.score_cycles(spark.read.text(a.output, wholetext=True).select(F.col("value").alias("text")), a.corpus)
    elif a.verb == "inspect":
        out = e.inspect(a.path, getattr(artifacts, a.schema.upper()), a.array, a.column)
    else:
        out = e.stats()
    if a.verb in ("load", "enrich", "link", "vulns"):
        e.graph.write(a.graph)
    if out is not None:
        for row in out.toJSON().toLocalIterator():
            print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
