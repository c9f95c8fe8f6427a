"""Sources and mappers over small hand-written inputs."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from repograph.functions import ids
from repograph.sources import artifacts, corpus, files, manifests, osv, pylint, pysource

REPO = "repo:h/o/r"


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, want", [("a/b.py", "py"), ("./x/./y.GO", "go"), ("Makefile", "unknown"), ("a.b/c", "unknown"), ("\\w\\z.Py", "py")]
)
def test_language(spark, path, want):
    assert one(spark, path, ids.language) == want


def test_ids(spark):
    assert one(spark, "https://github.com/a/b.git", ids.repo_id) == "repo:github.com/a/b"
    assert one(spark, "https://github.com/a/b/", lambda c: ids.repo_id(c, F.lit("dist"))) == "repo:github.com/a/b/dist"
    assert one(spark, "./././x/y", ids.norm_path) == "x/y"
    assert one(spark, " Some_chain..Two-_4j ", lambda c: ids.package_id(F.lit("python"), c)) == "pkg:python:some-chain-two-4j"
    assert one(spark, "GitHub.com/X_y", lambda c: ids.package_id(F.lit("go"), c)) == "pkg:go:GitHub.com/X_y"
    assert one(spark, None, lambda c: ids.external_ref_id(F.lit("python"), c, F.lit("S"))) == "ext:python:<unknown>#S"
    assert one(spark, "a_b.c", lambda c: ids.root_module(F.lit("python"), c)) == "a-b"
    assert one(spark, "L12-L20", ids.line_of) == 12 and one(spark, None, ids.line_of) is None
    assert [one(spark, n, lambda c: ids.exported(c, F.lit("go"))) for n in ("Éa", "a", "")] == [True, False, False]
    assert [one(spark, n, lambda c: ids.exported(c, F.lit("python"))) for n in ("a", "_a")] == [True, False]


@pytest.mark.parametrize(
    "line, want",
    [
        ("graphlib>=5,<6  # x", ("graphlib", None, ">=5,<6")), ("a.b[c,d]==1.0", ("a.b", "[c,d]", "==1.0")), ("plain", ("plain", None, None)), ("# no", None), ("-r x.txt", None),
        ("git+https://x", None), ("", None), ("x ~= 1.2 ; python_version < '3'", ("x", None, "~= 1.2 ; python_version < '3'")), ("two words", None),
    ],
)
def test_requirement(spark, line, want):
    got = one(spark, line, ids.requirement)
    assert (tuple(got) if got else None) == want


def test_manifests(spark):
    rows = [
        (REPO, "requirements.txt", "Alpha>=1\nbeta\n-e .\n"), (REPO, "sub/requirements-dev.txt", "alpha==9\ngamma~=2\n"),
        (REPO, "pyproject.toml", '[project]\ndependencies = ["delta[x]>=3", "beta<2"]\n'), (REPO, "bad/pyproject.toml", "not = [toml"),
    ]
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    got = {(r.name, r.version_spec, r.source) for r in manifests.dependencies(df, "python").collect()}
    assert got == {("Alpha", ">=1", "requirements.txt"), ("beta", None, "requirements.txt"), ("gamma", "~=2", "sub/requirements-dev.txt"), ("delta", ">=3", "pyproject.toml")}
    assert {r.id for r in manifests.package_rows(manifests.dependencies(df, "python")).collect()} == {f"pkg:python:{n}" for n in ("alpha", "beta", "gamma", "delta")}


GO_MOD = """module example.org/own // here

go 1.22
require example.org/one v1.0.0
require (
	example.org/two v2.0.0 // indirect
	example.org/three v1.99.0 // placeholder
	example.org/local v0.1.0
	// example.org/comment v1
)
replace example.org/three => example.org/fork v3.3.0
replace (
	example.org/local => ./pkg/local
)
"""


def test_go_mod(spark):
    df = spark.createDataFrame([(REPO, "go.mod", GO_MOD)], "repo string, path string, text string")
    got = {(r.name, r.version_spec) for r in manifests.dependencies(df, "go").collect()}
    assert got == {("example.org/one", "v1.0.0"), ("example.org/fork", "v3.3.0")}
    assert [r.module for r in manifests.module_paths(df).collect()] == ["example.org/own"]
    assert ("module", 0, "example.org/own", None, None, None) in manifests.go_directives(GO_MOD)
    with pytest.raises(ValueError, match="unsupported"):
        manifests.dependencies(df, "cobol")


SOURCE = '''
import os.path as p, a.b
from x.y import One, two as deux
from x.all import *
from typing import TYPE_CHECKING
if TYPE_CHECKING:
    from x import Typed
else:
    from x import Real
if not TYPE_CHECKING:
    from x import Runtime
def f():
    from x import Later
    try:
        from x import LaterGuarded
    except ImportError:
        pass
class C:
    from x import InClass
try:
    from x import Maybe
except (ValueError, ModuleNotFoundError):
    from z import Fallback
try:
    from x import Bare
except:
    pass
try:
    from x import Unguarded
except KeyError:
    pass
from . import sibling
from ..up import Thing
VALUE, _hidden = 1, 2
CONST: int = 3
'''


def test_contexts():
    got = {s[3]: (s[6], s[7]) for s in pysource.statements_of(SOURCE) if s[0] == "from"}
    assert got["Typed"] == ("typing", False) and got["Real"] == ("toplevel", False) and got["Runtime"] == ("toplevel", False)
    assert got["Later"] == ("deferred", False) and got["LaterGuarded"] == ("deferred", True) and got["InClass"] == ("toplevel", False)
    assert got["Maybe"] == ("toplevel", True) and got["Fallback"] == ("toplevel", True) and got["Bare"] == ("toplevel", True) and got["Unguarded"] == ("toplevel", False)
    defs = {s[3] for s in pysource.statements_of(SOURCE) if s[0] == "def"}
    assert {"f", "C", "CONST", "One", "deux", "sibling", "Thing"} <= defs and "_hidden" not in defs
    assert pysource.statements_of("def broken(:") == []


TREE = {
    "src/pkg/__init__.py": "from .core import Core\nfrom . import util",
    "src/pkg/core.py": "from pkg.util import helper\nimport pkg.sub.deep\nfrom other.lib import Thing",
    "src/pkg/util.py": "if TYPE_CHECKING:\n    from .core import Core\ndef g():\n    from .core import Core\n",
    "src/pkg/sub/__init__.py": "",
    "src/pkg/sub/deep.py": "from ..core import Core\nfrom ...nowhere import x\ntry:\n    from .. import util\nexcept ImportError:\n    util = None\n",
    "script.py": "import pkg",
    "broken.py": "def (",
}


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([(REPO, p, t) for p, t in TREE.items()], "repo string, path string, text string")


def test_module_index(tree):
    got = {r.module: (r.path, r.is_package) for r in pysource.module_index(tree).collect()}
    assert got == {
        "pkg": ("src/pkg/__init__.py", True), "pkg.core": ("src/pkg/core.py", False), "pkg.util": ("src/pkg/util.py", False), "pkg.sub": ("src/pkg/sub/__init__.py", True),
        "pkg.sub.deep": ("src/pkg/sub/deep.py", False), "script": ("script.py", False), "broken": ("broken.py", False),
    }


def test_classified_imports(tree):
    stated = pysource.statements(tree)
    rows = pysource.classified_imports(stated, pysource.module_index(tree)).collect()
    short = lambda x: x.removeprefix(f"file:{REPO}:").removeprefix("src/pkg/")
    got = {(short(r.src), short(r.dst)): (r.context, r.guarded, r.line) for r in rows}
    assert got == {
        ("__init__.py", "core.py"): ("toplevel", False, 1), ("__init__.py", "util.py"): ("toplevel", False, 2), ("core.py", "util.py"): ("toplevel", False, 1),
        ("core.py", "sub/deep.py"): ("toplevel", False, 2), ("util.py", "core.py"): ("typing", False, 2), ("sub/deep.py", "core.py"): ("toplevel", False, 1),
        ("sub/deep.py", "__init__.py"): ("toplevel", True, 4), ("sub/deep.py", "util.py"): ("toplevel", True, 4), ("script.py", "__init__.py"): ("toplevel", False, 1),
    }


def test_external_imports_and_bindings(tree, spark):
    stated = pysource.statements(tree)
    got = {(r.module, r.symbol, r.root_module, r.context) for r in pysource.external_imports(stated).collect()}
    assert got == {("pkg.util", "helper", "pkg", "toplevel"), ("other.lib", "Thing", "other", "toplevel")}
    bound = {(r.path, r.bound): r.module for r in pysource.bindings(stated).collect()}
    assert bound["src/pkg/core.py", "Thing"] == "other.lib" and bound["src/pkg/core.py", "pkg"] == "pkg.sub.deep" and bound["src/pkg/__init__.py", "Core"] == ".core"
    go = 'package x\nimport "fmt"\nimport (\n  ring "example.org/kit/ring2"\n\t"example.org/kit/user"\n)\nfunc f() {}\nimport "late"\n'
    assert pysource.go_imports_of(go) == [("fmt", "fmt"), ("ring", "example.org/kit/ring2"), ("user", "example.org/kit/user")]
    assert {r.symbol for r in pysource.importable(stated).collect()} >= {"Core", "util", "g"}


# one tiny repository as three extractors tell it: class Driver with a method close, function connect that calls both

GRAPHIFY = {
    "nodes": [
        {"id": "f", "label": "d.py", "file_type": "code", "source_file": "src/d.py", "source_location": "L1"}, {"id": "g", "label": "e.py", "file_type": "code", "source_file": "src/e.py"},
        {"id": "c", "label": "Driver", "file_type": "code", "source_file": "src/d.py", "source_location": "L3"}, {"id": "m", "label": ".close()", "file_type": "code", "source_file": "src/d.py", "source_location": "L5"},
        {"id": "n", "label": "connect()", "file_type": "code", "source_file": "src/e.py", "source_location": "L2", "_callable": True}, {"id": "x", "label": "Session", "file_type": "code", "source_file": ""},
        {"id": "y", "label": "helper()", "file_type": "code", "source_file": ""}, {"id": "z", "label": "note", "file_type": "rationale", "source_file": "README.md"}, {"id": "w", "label": "Who", "file_type": "code", "source_file": ""},
    ],
    "links": [
        {"source": "c", "target": "m", "relation": "method", "confidence": "EXTRACTED", "source_file": "src/d.py", "source_location": "L5"},
        {"source": "n", "target": "c", "relation": "calls", "confidence": "INFERRED", "source_file": "src/e.py", "source_location": "L4"},
        {"source": "n", "target": "m", "relation": "indirect_call", "confidence": "EXTRACTED", "source_file": "src/e.py", "source_location": "L5"},
        {"source": "g", "target": "f", "relation": "imports_from", "source_file": "src/e.py"}, {"source": "f", "target": "f", "relation": "imports", "source_file": "src/d.py"},
        {"source": "n", "target": "x", "relation": "uses", "source_file": "src/e.py"}, {"source": "n", "target": "y", "relation": "uses", "source_file": "src/e.py"}, {"source": "n", "target": "w", "relation": "references", "source_file": "src/e.py"},
    ],
}


def test_graphify(spark, tmp_path):
    (tmp_path / "graph.json").write_text(json.dumps(GRAPHIFY))
    x = artifacts.EXTRACTORS["graphify"]
    doc = x.read(spark, str(tmp_path / "graph.json"))
    assert {r.path for r in x.files(doc, REPO, "python").collect()} == {"src/d.py", "src/e.py"}
    symbols = {r.qname: r for r in x.symbols(doc, REPO, "python").collect()}
    assert {q: (s.name, s.kind, s.start_line) for q, s in symbols.items()} == {"Driver": ("Driver", "class", 3), "Driver.close": ("close", "method", 5), "connect": ("connect", "function", 2)}
    assert symbols["Driver.close"].id == f"sym:{REPO}:src/d.py#Driver.close" and symbols["connect"].file == f"file:{REPO}:src/e.py"
    calls = {(r.src.split("#")[1], r.dst.split("#")[1]): (r.confidence, r.evidence) for r in x.calls(doc, REPO, "python").collect()}
    assert calls == {("Driver", "Driver.close"): (1.0, "src/d.py:L5"), ("connect", "Driver"): (0.7, "src/e.py:L4"), ("connect", "Driver.close"): (0.5, "src/e.py:L5")}
    assert [(r.src, r.dst) for r in x.file_imports(doc, REPO, "python").collect()] == [(f"file:{REPO}:src/e.py", f"file:{REPO}:src/d.py")]
    bound = spark.createDataFrame([("src/e.py", "Session", "graphlib.work"), ("src/e.py", "helper", ".local")], "path string, bound string, module string")
    refs = {(r.id, r.root_module) for r in x.external_refs(doc, REPO, "python", bound).collect()}
    assert refs == {("ext:python:graphlib.work#Session", "graphlib"), ("ext:python:<unknown>#Who", None)}


def test_codegraph(spark, tmp_path):
    at = str(tmp_path / "codegraph.db")
    with sqlite3.connect(at) as c:
        c.execute("CREATE TABLE nodes (id TEXT, kind TEXT, name TEXT, qualified_name TEXT, file_path TEXT, language TEXT, start_line INT, end_line INT, docstring TEXT, signature TEXT, is_exported INT)")
        c.execute("CREATE TABLE edges (source TEXT, target TEXT, kind TEXT, metadata TEXT, line INT, col INT, provenance TEXT)")
        c.execute("CREATE TABLE files (path TEXT, content_hash TEXT, language TEXT, size INT, node_count INT)")
        c.execute("CREATE TABLE unresolved_refs (from_node_id TEXT, reference_name TEXT, reference_kind TEXT, file_path TEXT, line INT)")
        n = lambda i, kind, name, q, path="src/d.py", line=1, sig=None: c.execute("INSERT INTO nodes VALUES (?,?,?,?,?,?,?,?,?,?,?)", (i, kind, name, q, path, "python", line, line + 1, None, sig, 1))
        n("c", "class", "Driver", "Driver", line=3)
        n("m", "method", "close", "Driver::close", line=5)
        n("n", "function", "connect", None, "src/e.py", 2)
        n("f", "file", "d.py", None)
        n("i", "import", "work", "graphlib.work", "src/e.py", 1, "from graphlib.work import (Session, Tx as T,\n  *)")
        n("j", "import", "rel", ".rel", "src/e.py", 1, "from .rel import Y")
        n("k", "import", "graphlib", "graphlib", "src/e.py", 1, "import graphlib")
        for e in (("n", "c", "calls", None), ("n", "m", "instantiates", "dynamic"), ("n", "f", "calls", None), ("c", "m", "contains", None)):
            c.execute("INSERT INTO edges VALUES (?,?,?,NULL,7,0,?)", e)
        c.execute("INSERT INTO files VALUES ('src/d.py','','python',1,1)")
        c.execute("INSERT INTO unresolved_refs VALUES ('n','work.Open','call','src/e.py',9), ('n','work.shut','call','src/e.py',9), ('n','local.X','call','src/e.py',9), ('n','plain','call','src/e.py',9)")
    x = artifacts.EXTRACTORS["codegraph"]
    db = x.read(spark, at)
    assert [r.language for r in x.files(db, REPO, "python").collect()] == ["py"]
    assert {r.qname: r.kind for r in x.symbols(db, REPO, "python").collect()} == {"Driver": "class", "Driver.close": "method", "connect": "function"}
    calls = {(r.src.split("#")[1], r.dst.split("#")[1]): (r.confidence, r.evidence) for r in x.calls(db, REPO, "python").collect()}
    assert calls == {("connect", "Driver"): (1.0, "src/e.py:7"), ("connect", "Driver.close"): (0.5, "src/e.py:7")}
    assert x.file_imports(db, REPO, "python").count() == 0
    assert {(r.id, r.line) for r in x.external_refs(db, REPO, "python").collect()} == {("ext:python:graphlib.work#Session", 1), ("ext:python:graphlib.work#Tx", 1)}
    with sqlite3.connect(at) as c:
        c.execute("UPDATE nodes SET qualified_name = 'example.org/kit/work' WHERE id = 'i'")
    assert [(r.module, r.symbol) for r in x.external_refs(db, REPO, "go").collect()] == [("example.org/kit/work", "Open")]


GITNEXUS = {
    "nodes": [
        {"id": "Class:src/d.py:Driver", "name": "Driver", "path": "src/d.py", "sl": "3", "el": "9", "label": "Class"}, {"id": "Method:src/d.py:Driver.close#1", "name": "close", "path": "src/d.py", "sl": "x", "el": "", "label": "Method"},
        {"id": "Function:src/e.py:connect", "name": "connect", "path": "src/e.py", "sl": "2", "el": "4", "label": "Function"},
    ],
    "files": [{"id": "File:src/d.py", "name": "d.py", "path": "src/d.py"}, {"id": "File:src/e.py", "name": "e.py", "path": "src/e.py"}],
    "edges": [
        {"src": "Function:src/e.py:connect", "dst": "Class:src/d.py:Driver", "type": "CALLS", "conf": "0.9"}, {"src": "Function:src/e.py:connect", "dst": "Method:src/d.py:Driver.close#1", "type": "CALLS", "conf": "0"},
        {"src": "Class:src/d.py:Driver", "dst": "Method:src/d.py:Driver.close#1", "type": "HAS_METHOD", "conf": "1"}, {"src": "File:src/e.py", "dst": "File:src/d.py", "type": "IMPORTS", "conf": "1"},
        {"src": "File:src/e.py", "dst": "File:src/e.py", "type": "IMPORTS", "conf": "1"},
    ],
}


def test_gitnexus(spark, tmp_path):
    (tmp_path / "graph.json").write_text(json.dumps(GITNEXUS))
    x = artifacts.EXTRACTORS["gitnexus"]
    doc = x.read(spark, str(tmp_path / "graph.json"))
    assert {r.qname: (r.kind, r.start_line, r.end_line) for r in x.symbols(doc, REPO, "python").collect()} == {"Driver": ("class", 3, 9), "Driver.close": ("method", None, None), "connect": ("function", 2, 4)}
    assert {(r.src.split("#")[1], r.dst.split("#")[1]): r.confidence for r in x.calls(doc, REPO, "python").collect()} == {("connect", "Driver"): 0.9, ("connect", "Driver.close"): 0.8}
    assert x.file_imports(doc, REPO, "python").count() == 1 and x.files(doc, REPO, "python").count() == 2
    assert x.external_refs(doc, REPO, "python").count() == 0


def test_gitnexus_export(spark):
    table = "| id | name |\n|---|---|\n| a | b |\n| broken |\n| c | d |\nrest"
    df = spark.createDataFrame([("Class", table), ("None", "nothing")], "label string, markdown string")
    assert sorted((r.label, r.cells["id"], r.cells["name"]) for r in artifacts.markdown_rows(df).collect()) == [("Class", "a", "b"), ("Class", "c", "d")]
    assert artifacts.last_result('{"log": 1}\n{"markdown": "x"} noise [') == {"markdown": "x"} and artifacts.last_result("noise") is None
    empty = spark.createDataFrame([], "src string, dst string, type string, conf string")
    nodes = spark.createDataFrame([], "id string, name string, path string, sl string, el string, exp string, label string")
    with pytest.raises(Exception, match="no edges"):
        artifacts.gitnexus_document(nodes, nodes.select("id", "name", "path"), empty).collect()


def test_goscan(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"refs": [{"file": "a/x.go", "module": "m/kv", "symbol": "Open", "line": 4}] * 2, "defs": [{"file": "kv/y.go", "name": "Open"}, {"file": "z.go", "name": "Z"}], "files": 2, "root": "r"}))
    doc = artifacts.read_json(spark, str(tmp_path / "s.json"), artifacts.GOSCAN)
    (r,) = artifacts.goscan_external_refs(doc, REPO).collect()
    assert (r.id, r.root_module, r.context, r.line) == ("ext:go:m/kv#Open", "m/kv", "toplevel", 4)
    assert {(d.pkgdir, d.symbol) for d in artifacts.goscan_defs(doc, REPO).collect()} == {("kv", "Open"), ("", "Z")}


CORPUS = """
corpora:
  a:
    ecosystem: python
    repos:
      - {id: one, url: "https://h/o/one", ref: main, publishes: [One_Pkg], tier: core}
      - {id: two, url: "https://h/o/two", publishes: [], tier: full, subpath: backend}
exclude:
  globs: ["**/vendor/**", "*.pb.go"]
"""


def test_corpus(spark):
    df = corpus.repos(spark, CORPUS, "a")
    assert {r.id for r in df.collect()} == {"repo:h/o/one", "repo:h/o/two"}
    assert corpus.repos(spark, CORPUS, tiers=("core",)).count() == 1
    lock = corpus.lock(spark, "a:\n  one: {url: u, sha: abc}\n_locked_at: now\n")
    rows = {r.name: r.commit for r in corpus.repo_rows(df, lock).collect()}
    assert rows == {"one": "abc", "two": None}
    assert [r.id for r in corpus.published(df).collect()] == ["pkg:python:one-pkg"]
    assert corpus.excluded_globs(CORPUS) == ["**/vendor/**", "*.pb.go"]


def test_tree_leaves_out_what_it_should(spark, tmp_path):
    for p in ("one/src/a.py", "one/vendor/b.py", "one/x.txt", "two/backend/c.py", "two/d.py", "two/backend/gen/e.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"# {p}")
    found = files.read_tree(spark, str(tmp_path), "*.py", globs=["**/gen/**"])
    assert {(r.root, r.path, r.text) for r in found.collect()} == {("one", "src/a.py", "# one/src/a.py"), ("two", "backend/c.py", "# two/backend/c.py"), ("two", "d.py", "# two/d.py")}
    own = files.of_repos(found, corpus.repos(spark, CORPUS))
    assert {(r.repo, r.path) for r in own.collect()} == {("repo:h/o/one", "src/a.py"), ("repo:h/o/two", "c.py")}


def test_pylint(spark):
    df = spark.createDataFrame([("r", "a.py:1:0: R0401: Cyclic import (p.a -> p.b) (cyclic-import)\nx R0401: Cyclic import (p.b -> p.c -> p.d) (c)")], "repo string, text string")
    assert sorted(r.module for r in pylint.members(df).collect()) == ["p.a", "p.b", "p.c", "p.d"]


def test_osv_fetch(spark):
    """Against a service on this machine that fails for one package and breaks off for another."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    class Answers(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            package = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["package"]
            if package["name"] == "cut":
                self.connection.close()
                return
            body = json.dumps({"vulns": [{"id": "V-" + package["ecosystem"]}]}).encode() if package["name"] != "text" else b"no document"
            self.send_response(500 if package["name"] == "down" else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = spark.createDataFrame([("python", n) for n in ("a", "down", "cut", "text", "b")] + [("cobol", "z"), ("go", "g")], "ecosystem string, name string")
        got = osv.fetch(df, timeout=2, parts=1, url=f"http://127.0.0.1:{server.server_port}/v1/query").collect()
    finally:
        server.shutdown()
    assert sorted((r.name, r.doc.id) for r in got) == [("a", "V-PyPI"), ("b", "V-PyPI"), ("g", "V-Go")]


def test_go_imports_end_with_the_declarations():
    go = """// import "not/this"
/* package x */ package main; import a "x/a"
import (
\t. "x/dot" // import "c"
\t_ `x/raw`
\t"x/v2/plain"; b "x/b"
)
const s = `
import "in/text"
`
"""
    assert pysource.go_imports_of(go) == [("a", "x/a"), (".", "x/dot"), ("_", "x/raw"), ("plain", "x/v2/plain"), ("b", "x/b")]
    assert pysource.go_imports_of("") == [] and pysource.go_imports_of(None) == []


def test_last_result_among_logs():
    said = '[INFO] start {\n{"markdown": "| a |", "of": [1, {"error": 2}]}\n{"log": "}"} [oops\n'
    assert artifacts.last_result(said) == {"markdown": "| a |", "of": [1, {"error": 2}]}
    assert artifacts.last_result(said + "[]") == [] and artifacts.last_result('{"a": "[1') is None
