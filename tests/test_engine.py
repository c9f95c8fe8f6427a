"""Loading, snapshots, deletes, streams, scores, the command line, and every registered query against DuckDB."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from repograph import cli
from repograph.engine import Engine
from repograph.operators.upsert import upsert
from repograph.plans import registry, scoring
from repograph.plans.graph import Graph
from repograph.streaming import ingest
from tests.test_sources import CORPUS, GITNEXUS, GRAPHIFY

SF = "/root/testdata/sf0.001"


def test_upsert(spark):
    s = "id string, last string, keep string, votes array<string>"
    old = spark.createDataFrame([("a", "1", "k", ["x"]), ("b", "1", None, None)], s)
    new = spark.createDataFrame([("a", None, None, ["y", "x"]), ("c", "2", "z", [])], s)
    once = upsert(old, new, ["id"], keep=["keep"], sets=["votes"])
    want = {("a", None, "k", ("x", "y")), ("b", "1", None, ()), ("c", "2", "z", ())}
    rows = lambda df: {(r.id, r.last, r.keep, tuple(r.votes)) for r in df.collect()}
    assert rows(once) == want and rows(upsert(once, new, ["id"], keep=["keep"], sets=["votes"])) == want


@pytest.fixture(scope="module")
def corpus_dirs(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    for repo in ("one", "two"):
        at = base / "artifacts" / "graphify" / "a" / repo
        at.mkdir(parents=True)
        (at / "graph.json").write_text(json.dumps(GRAPHIFY))
    at = base / "artifacts" / "gitnexus" / "a" / "one"
    at.mkdir(parents=True)
    (at / "graph.json").write_text(json.dumps(GITNEXUS))
    tree = {
        "one/src/d.py": "class Driver:\n    def close(self): ...\n", "one/src/e.py": "from .d import Driver\ndef connect(): ...\n", "one/pyproject.toml": "[project]\ndependencies = []\n",
        "one/src/__init__.py": "", "two/backend/app.py": "from one_pkg.d import Driver\nfrom one_pkg import connect\n", "two/backend/requirements.txt": "one-pkg==1.0\n",
        "two/backend/src/e.py": "from one_pkg.d import Session\n", "two/backend/src/d.py": "",
    }
    for path, text in tree.items():
        (base / "sources" / path).parent.mkdir(parents=True, exist_ok=True)
        (base / "sources" / path).write_text(text)
    return base


@pytest.fixture(scope="module")
def engine(spark, corpus_dirs):
    e = Engine(spark, CORPUS, str(corpus_dirs / "artifacts"), str(corpus_dirs / "sources"))
    e.load("a", "graphify")
    e.load("a", "gitnexus")
    e.enrich("a")
    e.link()
    return e


def test_load_votes_and_links(engine):
    g = engine.graph
    votes = {r.qname: r.extractors for r in g["Symbol"].where("repo = 'repo:h/o/one'").collect()}
    assert votes == {"Driver": ["gitnexus", "graphify"], "Driver.close": ["gitnexus", "graphify"], "connect": ["gitnexus", "graphify"]}
    assert [(r.src, r.dst) for r in g["DEPENDS_ON_REPO"].collect()] == [("repo:h/o/two", "repo:h/o/one")]
    crossing = {(r.src.rsplit(":", 1)[1], r.dst.split("#")[1]) for r in g["IMPORTS_CROSS_REPO"].collect()}
    assert crossing == set()  # app.py is in no artifact; e.py imports a name that nothing declares
    assert {r.symbol for r in g["ExternalRef"].where("array_contains(extractors, 'source')").collect()} == {"Session"}
    assert g.broken_keys().count() == 0


def test_loading_again_changes_nothing(engine):
    before = {r["name"]: r["rows"] for r in engine.stats().collect()}
    engine.load("a", "graphify")
    assert {r["name"]: r["rows"] for r in engine.stats().collect()} == before


def test_snapshot_round_trip_search_and_delete(engine, spark, tmp_path):
    counts = engine.graph.write(str(tmp_path / "snap"))
    assert counts == {r["name"]: r["rows"] for r in engine.stats().collect()}
    back = Graph.read(spark, str(tmp_path / "snap"))
    assert {r.qname for r in back.search("driver").collect()} == {"Driver", "Driver.close"}
    back.drop_repo(spark.createDataFrame([("repo:h/o/one",)], "id string"))
    left = {r["name"]: r["rows"] for r in back.stats().collect()}
    assert left["Repo"] == 1 and left["Symbol"] == 3 and left["CALLS"] == 3 and left["DEPENDS_ON_REPO"] == 0 and left["Package"] == counts["Package"] and left["ExternalRef"] == counts["ExternalRef"]


def test_truth_and_scores(engine, spark):
    truth = engine.truth("a")
    assert {(r.src_file, r.symbol) for r in truth.collect()} == {("app.py", "Driver"), ("app.py", "connect")}
    got = {r.arm: (r.predicted, r.truth, r.precision, r.recall, r.f1) for r in engine.score("a", truth).collect()}
    assert got["unified"] == (0, 2, None, 0.0, None) and len(got) == 8
    edge = ",".join(f"{c} string" for c in scoring.EDGE)
    t = spark.createDataFrame([("a", "f", "b", s) for s in "xyz"], edge)
    p = spark.createDataFrame([("a", "f", "b", s) for s in "xw"], edge).withColumn("arm", F.lit("arm"))
    assert [tuple(r) for r in scoring.score(p, t).collect()] == [("arm", 2, 3, 1, 1, 2, 0.5, 0.333333, 0.4)]
    assert {(r.kind, r.symbol) for r in scoring.examples(p.drop("arm"), t).collect()} == {("missed", "y"), ("missed", "z"), ("invented", "w")}


def test_merged_baseline(spark):
    files_ = spark.createDataFrame([("one", "a.py"), ("one", "b.py"), ("two", "c.py")], "repo string, source_file string")
    nodes = spark.createDataFrame([("1", "t1", "a.py", "f()"), ("2", "t1", "b.py", "g"), ("3", "t2", "c.py", "h()"), ("4", "t2", "", "k")], "id string, repo string, source_file string, label string")
    links = spark.createDataFrame([("1", "3", "calls", "a.py"), ("1", "2", "calls", "a.py"), ("4", "2", "uses", "c.py"), ("4", "1", "uses", "")], "source string, target string, relation string, source_file string")
    assert sorted(tuple(r)[:4] for r in scoring.merged_edges(nodes, links, files_).collect()) == [("one", "a.py", "two", "h"), ("two", "c.py", "one", "g")]
    alien = nodes.select(F.lit("one").alias("artifact_repo"), "id", "source_file")
    assert {r.target for r in scoring.foreign_nodes(alien, links.withColumn("artifact_repo", F.lit("one")), files_).collect()} == {"3"}


def test_go_truth(spark):
    refs = spark.createDataFrame([("app", "m.go", "x/kit/kv", "Open"), ("app", "m.go", "x/kit", "Open"), ("kit", "k.go", "x/kit/kv", "Open")], "src_repo string, src_file string, module string, symbol string")
    pub = spark.createDataFrame([("kit", "x/kit"), ("kitten", "x/kitten")], "dst_repo string, name string")
    defs = spark.createDataFrame([("kit", "kv", "Open")], "dst_repo string, pkgdir string, symbol string")
    assert [tuple(r) for r in scoring.truth_go(refs, pub, defs).collect()] == [("app", "m.go", "kit", "Open")]


def test_cycle_scores(engine, spark):
    out = spark.createDataFrame([("R0401: Cyclic import (src.d -> src.e)",)], "text string")
    assert engine.score_cycles(out, "a").count() == 0  # nothing claims a cycle
    found = spark.createDataFrame([("arm", "m"), ("arm", "n")], "arm string, module string")
    assert [tuple(r) for r in scoring.cycle_scores(found, spark.createDataFrame([("m",)], "module string")).collect()] == [("arm", 2, 1, 1, 0.5, 1.0)]


def test_several_artifacts_scans_and_provenance(spark, tmp_path):
    """Two Go repositories' databases and scans at once; the commit that an artifact was made of comes before the locked one."""
    import sqlite3

    config = "corpora:\n  g:\n    ecosystem: go\n    repos:\n" + "".join(f'      - {{id: {r}, url: "https://h/o/{r}", publishes: [x/{r}]}}\n' for r in ("kit", "app"))
    for r, name in (("kit", "Open"), ("app", "main")):
        at = tmp_path / "artifacts" / "codegraph" / "g" / r
        at.mkdir(parents=True)
        with sqlite3.connect(str(at / "codegraph.db")) as c:
            c.execute("CREATE TABLE nodes (id TEXT, kind TEXT, name TEXT, qualified_name TEXT, file_path TEXT, start_line INT, end_line INT, docstring TEXT, signature TEXT)")
            c.execute("CREATE TABLE edges (source TEXT, target TEXT, kind TEXT, line INT, provenance TEXT)")
            c.execute("CREATE TABLE files (path TEXT, language TEXT)")
            c.execute("CREATE TABLE unresolved_refs (reference_name TEXT, file_path TEXT, line INT)")
            c.execute("INSERT INTO nodes VALUES ('n', 'function', ?, ?, 'kv/a.go', 1, 2, NULL, NULL)", (name, name))
            c.execute("INSERT INTO files VALUES ('kv/a.go', 'go')")
    (tmp_path / "artifacts" / "codegraph" / "g" / "kit" / "provenance.json").write_text(json.dumps({"commit": "own"}))
    scans = tmp_path / "scans" / "g"
    scans.mkdir(parents=True)
    (scans / "kit.json").write_text(json.dumps({"refs": [], "defs": [{"file": "kv/a.go", "name": "Open"}]}))
    (scans / "app.json").write_text(json.dumps({"refs": [{"file": "kv/a.go", "module": "x/kit/kv", "symbol": "Open", "line": 4}], "defs": []}))
    (tmp_path / "sources").mkdir()
    (tmp_path / "sources" / "kit").mkdir()
    (tmp_path / "sources" / "kit" / "go.mod").write_text("module x/kit\n")
    e = Engine(spark, config, str(tmp_path / "artifacts"), str(tmp_path / "sources"))
    assert e.load("g", "codegraph", "g:\n  kit: {url: u, sha: locked}\n  app: {url: u, sha: locked}\n")["repos"] == 2
    assert {r.name: r.commit for r in e.graph["Repo"].collect()} == {"kit": "own", "app": "locked"}
    assert {r.id for r in e.graph["Symbol"].collect()} == {"sym:repo:h/o/kit:kv/a.go#Open", "sym:repo:h/o/app:kv/a.go#main"}
    e.enrich("g", str(tmp_path / "scans"))
    assert [(r.src, r.dst) for r in e.graph["IMPORTS_EXT"].collect()] == [("file:repo:h/o/app:kv/a.go", "ext:go:x/kit/kv#Open")]
    assert [tuple(r) for r in e.truth("g", str(tmp_path / "scans")).collect()] == [("repo:h/o/app", "kv/a.go", "repo:h/o/kit", "Open")]


def test_streamed_batches_merge(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "graph")
    source.mkdir()
    row = {"id": "r1", "name": "one", "extractors": ["x"]}
    (source / "1.json").write_text(json.dumps(row))
    ingest.ingest(spark, str(source), folder, "Repo", str(tmp_path / "ck")).awaitTermination()
    (source / "2.json").write_text(json.dumps(row | {"name": "uno", "extractors": ["y"]}) + "\n" + json.dumps({"id": "r2"}))
    ingest.ingest(spark, str(source), folder, "Repo", str(tmp_path / "ck")).awaitTermination()
    assert {(r.id, r.name, tuple(r.extractors)) for r in ingest.read(spark, folder, "Repo").collect()} == {("r1", "uno", ("x", "y")), ("r2", None, ())}
    assert ingest.read(spark, folder, "File").count() == 0


def test_command_line(spark, corpus_dirs, tmp_path, capsys):
    (tmp_path / "corpus.yaml").write_text(CORPUS)
    base = ["--graph", str(tmp_path / "g"), "--config", str(tmp_path / "corpus.yaml"), "--artifacts", str(corpus_dirs / "artifacts"), "--sources", str(corpus_dirs / "sources")]
    run = lambda *args: cli.main([*base, *args], spark)
    assert run("init") == run("load", "a", "--extractor", "graphify") == run("enrich", "a") == run("link") == 0
    capsys.readouterr()
    assert run("query", "q7") == 0
    assert {json.loads(x)["repo"] for x in capsys.readouterr().out.splitlines()} == {"repo:h/o/one", "repo:h/o/two"}
    assert run("query", "q2", "--param", "changed=sym:repo:h/o/one:src/d.py#Driver.close") == 0
    assert json.loads(capsys.readouterr().out) == {"scope": "repo:h/o/one", "impacted_files_single_repo": 2}
    with pytest.raises(KeyError):
        run("query", "q99")


def test_smoke_matrix(engine):
    counts = engine.validate("sym:repo:h/o/one:src/d.py#Driver.close", "repo:h/o/one", "a")
    assert set(counts) == {f"q{n}" for n in range(1, 20)} and counts["q7"] == 2


ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_registered_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        return
    want = duck.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    expected = sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == expected
