"""The named queries on hand-built graphs, with their rows written out."""

import pytest
from pyspark.sql import functions as F

from repograph.operators import link
from repograph.plans import named, vulnerabilities
from repograph.plans.graph import Graph


def make(spark, **tables):
    g = Graph(spark)
    for name, rows in tables.items():
        g[name] = spark.createDataFrame(rows[1:], rows[0])
    return g


def sym(repo, name, path=None, line=1, ext=("a",), kind="function", exported=True):
    path = path or f"{name}.py"
    return (f"s:{repo}:{name}", name, name, kind, path, f"r/{repo}", f"f:{repo}:{path}", line, exported, list(ext))


SYM = "id string, name string, qname string, kind string, path string, repo string, file string, start_line int, exported boolean, extractors array<string>"
CALL = "src string, dst string, confidence double, extractors array<string>"
XIMP = "src string, dst string, confidence double, line int, context string"
FILE = "id string, path string, repo string, language string, module string"


def files_of(symbols):
    rows = {s[6]: (s[6], s[4], s[5], s[4].rsplit(".", 1)[-1], None) for s in symbols}
    return [FILE, *rows.values()]


@pytest.fixture(scope="module")
def fan_in(spark):
    """Library symbol L; a -> b -> L within; repositories x (a call), y and z (imports); L -> a closes a cycle;
    a chain c7 -> … -> c1 -> L of which c7 is one hop too far."""
    symbols = [sym("lib", "L", line=None), sym("lib", "a"), sym("lib", "b"), sym("x", "t", "tests/test_t.py", 7), *[sym("w", f"c{i}") for i in range(1, 8)]]
    calls = [CALL, ("s:lib:a", "s:lib:b", 1.0, ["a", "b", "c"]), ("s:lib:b", "s:lib:L", 0.5, ["a"]), ("s:lib:L", "s:lib:a", 1.0, ["a"])]
    calls += [(f"s:w:c{i + 1}", f"s:w:c{i}", 1.0, ["a"]) for i in range(1, 7)]
    cross = [CALL, ("s:x:t", "s:lib:b", 0.8, ["a"]), ("s:w:c1", "s:lib:L", 1.0, ["a"])]
    f = files_of(symbols) + [("f:y:m.py", "m.py", "r/y", "py", None), ("f:z:n.spec.ts", "n.spec.ts", "r/z", "ts", None)]
    imports = [XIMP, ("f:y:m.py", "s:lib:L", 1.0, 3, "toplevel"), ("f:z:n.spec.ts", "s:lib:L", 0.6, None, "toplevel")]
    return make(spark, Symbol=[SYM, *symbols], File=f, CALLS=calls, CALLS_CROSS_REPO=cross, IMPORTS_CROSS_REPO=imports)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_q01_q02(fan_in):
    assert rows(named.q01(fan_in, "s:lib:L")) == [
        ("r/w", 6, ["call-path"], True), ("r/x", 1, ["call-path"], True), ("r/y", 1, ["import"], True), ("r/z", 1, ["import"], True), ("r/lib", 3, ["call-path"], False)
    ]
    assert rows(named.q02(fan_in, "s:lib:L")) == [("r/lib", 3)]
    assert rows(named.q02(fan_in, "s:x:t")) == [] and rows(named.q01(fan_in, "s:none")) == []


def test_q03(fan_in):
    got = {r.impacted_repo: (r.hops, r.call_chain, r.citations, r.path_confidence) for r in named.q03(fan_in, "s:lib:L").collect()}
    assert got == {
        "r/x": (2, ["t", "b", "L"], ["tests/test_t.py:7", "b.py:1", "L.py:?"], 0.4), "r/w": (1, ["c1", "L"], ["c1.py:1", "L.py:?"], 1.0),
        "r/y": (1, ["m.py", "L"], ["m.py:3", "L.py:?"], 1.0), "r/z": (1, ["n.spec.ts", "L"], ["n.spec.ts:?", "L.py:?"], 0.6),
    }


def test_q04_q16(fan_in):
    assert rows(named.q04(fan_in, "r/lib")) == [("L", "L.py", 3, 3, ["r/w", "r/y", "r/z"]), ("b", "b.py", 1, 1, ["r/x"])]
    assert rows(named.q16(fan_in, "s:lib:L")) == [("x", 1, ["tests/test_t.py"]), ("z", 1, ["n.spec.ts"])]


def test_q16_needs_a_slash_before_tests(fan_in, spark):
    df = spark.createDataFrame([(p,) for p in ("tests/a.py", "x/tests/a.py", "a_test.go", "test_a.py", "A_TEST.PY", "latest.py")], "p string")
    got = {r.p for r in df.where(named._full(F.col("p"), named.TEST_PATH)).collect()}
    assert got == {"x/tests/a.py", "a_test.go", "test_a.py", "A_TEST.PY"}


def test_q09_q10_q11(spark):
    symbols = [sym("u", "T"), sym("u", "m", ext="abc"), sym("u", "n", ext="ab"), sym("u", "o", ext="abc"), sym("v", "other")]
    calls = [CALL, ("s:u:m", "s:u:T", 1.0, list("abc")), ("s:u:n", "s:u:T", 1.0, list("ab")), ("s:u:o", "s:u:m", 1.0, list("abc")), ("s:u:o", "s:u:n", 1.0, list("a")), ("s:u:T", "s:u:T", 1.0, ["b"])]
    g = make(spark, Symbol=[SYM, *symbols], CALLS=calls, Repo=["id string, corpus string", ("r/u", "k"), ("r/v", "other")])
    assert rows(named.q11(g, "s:u:T")) == [("corroborated by all three", 2), ("single extractor - verify", 1), ("two of three", 1)]
    assert rows(named.q09(g, "k")) == [(3, "all three", 2, 50.0), (2, "a + b", 1, 25.0), (1, "only a", 1, 25.0)]
    got = rows(named.q10(g, "k"))
    assert got == [(3, "all three", 2, 40.0), (2, "a + b", 1, 20.0), (1, "only a", 1, 20.0), (1, "only b", 1, 20.0)] and sum(r[3] for r in got) == 100


def test_links(spark):
    repo = ["id string, ecosystem string", *[(f"r/{x}", "python") for x in "abc"], *[(f"r/{x}", "go") for x in ("kit", "kitten", "app")]]
    pkg = ["id string, name string, ecosystem string", ("p:root", "root", "python"), ("p:kit", "x/kit", "go"), ("p:kitten", "x/kitten", "go")]
    pub = ["src string, dst string", ("r/a", "p:root"), ("r/b", "p:root"), ("r/kit", "p:kit"), ("r/kitten", "p:kitten")]
    dep = ["src string, dst string, version_spec string", ("r/c", "p:root", "==1"), ("r/a", "p:root", None), ("r/app", "p:kit", "v1")]
    symbols = [
        sym("a", "Unique", "root/one.py"), sym("a", "Twice", "root/one.py"), sym("b", "Twice", "root/two.py"), sym("a", "_private", "root/one.py", exported=False),
        sym("kit", "Open", "kv/open.go"), sym("kit", "Nested", "kv/consul/x.go"), sym("kit", "Method", "kv/open.go", kind="method"), sym("kit", "Root", "root.go"), sym("kitten", "Open", "kv/open.go"), sym("app", "main", "main.go"),
    ]
    refs = ["id string, module string, root_module string, symbol string, ecosystem string"]
    refs += [(f"e:{m}#{s}", m, m.split(".")[0] if eco == "python" else m, s, eco) for m, s, eco in (
        ("root.one", "Unique", "python"), ("root", "Twice", "python"), ("root.one", "_private", "python"), ("root.two", "Twice", "python"), ("third.x", "Y", "python"),
        ("x/kit/kv", "Open", "go"), ("x/kit/kv", "Nested", "go"), ("x/kit/kv", "Method", "go"), ("x/kit", "Root", "go"), ("x/kitten/kv", "Open", "go"), ("x/other", "Open", "go"),
    )]
    f = [FILE, ("f:c:m.py", "m.py", "r/c", "py", None), ("f:a:root/one.py", "root/one.py", "r/a", "py", "root.one"), ("f:b:root/two.py", "root/two.py", "r/b", "py", "root.two"), ("f:app:main.go", "main.go", "r/app", "go", None)]
    ext = ["src string, dst string, line int, context string, guarded boolean"]
    ext += [("f:c:m.py", "e:root.one#Unique", 1, "deferred", False), ("f:c:m.py", "e:root.one#_private", 9, "toplevel", True), ("f:c:m.py", "e:root.two#Twice", 2, "typing", False), ("f:app:main.go", "e:x/kit/kv#Open", 3, "toplevel", False)]
    uses = ["src string, dst string, extractors array<string>", ("s:app:main", "e:x/kit/kv#Open", ["t"]), ("s:kit:Open", "e:x/kit#Root", ["t"])]
    home = ["src string, dst string", *[(s[6], s[0]) for s in symbols]]
    g = make(spark, Repo=repo, Package=pkg, PUBLISHES=pub, DEPENDS_ON=dep, Symbol=[SYM, *symbols], ExternalRef=refs, File=f, IMPORTS_EXT=ext, USES=uses, DECLARES=home)
    assert sorted(rows(link.depends_on_repo(g).select("src", "dst", "via"))) == [("r/a", "r/b", ["root"]), ("r/app", "r/kit", ["x/kit"]), ("r/c", "r/a", ["root"]), ("r/c", "r/b", ["root"])]
    go = {(r.src, r.dst, r.pkgdir) for r in link.resolve_go(g).collect()}
    assert go == {("e:x/kit/kv#Open", "s:kit:Open", "kv"), ("e:x/kit#Root", "s:kit:Root", ""), ("e:x/kitten/kv#Open", "s:kitten:Open", "kv")}
    assert {(r.src, r.dst) for r in link.resolve_go(g, nested=True).collect()} - {x[:2] for x in go} == {("e:x/kit/kv#Nested", "s:kit:Nested")}
    link.link(g)
    got = {(r.src, r.dst): (r.method, r.confidence, r.methods) for r in g["RESOLVES_TO"].where("src like 'e:root%'").collect()}
    assert got == {
        ("e:root.one#Unique", "s:a:Unique"): ("python-package-symbol", 0.8, ["python-module-path", "python-package-symbol"]), ("e:root#Twice", "s:a:Twice"): ("python-package-symbol", 0.5, ["python-package-symbol"]),
        ("e:root#Twice", "s:b:Twice"): ("python-package-symbol", 0.5, ["python-package-symbol"]), ("e:root.two#Twice", "s:a:Twice"): ("python-package-symbol", 0.5, ["python-package-symbol"]),
        ("e:root.two#Twice", "s:b:Twice"): ("python-package-symbol", 0.5, ["python-module-path", "python-package-symbol"]),
    }
    x = {(r.src, r.dst): (r.context, r.guarded, r.line) for r in g["IMPORTS_FILE_CROSS_REPO"].collect()}
    assert x == {("f:c:m.py", "f:a:root/one.py"): ("toplevel", True, 9), ("f:c:m.py", "f:b:root/two.py"): ("typing", False, 2)}
    assert rows(g["CALLS_CROSS_REPO"].select("src", "dst", "extractors")) == [("s:app:main", "s:kit:Open", ["t"])]
    assert {(r.src, r.dst) for r in g["IMPORTS_CROSS_REPO"].collect()} == {("f:c:m.py", "s:a:Unique"), ("f:c:m.py", "s:a:Twice"), ("f:c:m.py", "s:b:Twice"), ("f:app:main.go", "s:kit:Open")}
    assert {r.consumer for r in named.q08(g).collect()} == set()
    q5 = {r.module: (r.unresolved_refs, r.in_corpus) for r in named.q05(g).collect()}
    assert q5 == {"root": (2, True), "third": (1, False), "x/kit/kv": (2, True), "x/other": (1, False)}
    assert {r.module: r.in_corpus for r in named.q05(g, loose=True).collect()}["x/kit/kv"]
    assert sum(r.edges for r in link.report(g).collect()) == sum(g[t].count() for t in ("RESOLVES_TO", "DEPENDS_ON_REPO", "IMPORTS_FILE_CROSS_REPO", "CALLS_CROSS_REPO", "IMPORTS_CROSS_REPO"))


IMP = "src string, dst string, context string, guarded boolean, line int"


def test_q15_facades_and_contexts(spark):
    f = [FILE, *[(x, f"p/{x}.py", "r/p", "py", None) for x in "abcdef"], ("i", "p/__init__.py", "r/p", "py", None), ("m1", "m1.md", "r/p", "md", None), ("m2", "m2.md", "r/p", "md", None)]
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("a", "i"), ("i", "d"), ("d", "a"), ("m1", "m2"), ("m2", "m1")]
    imports = [IMP, *[(a, b, "toplevel", False, 1) for a, b in e], ("c", "e", "toplevel", False, 1), ("e", "a", "typing", False, 1), ("f", "a", "deferred", False, 1), ("a", "f", "toplevel", False, 1)]
    g = make(spark, File=f, IMPORTS=imports)
    assert rows(named.q15(g)) == [("p", 3, 2, 3, 5, 4, ["p/a.py", "p/b.py", "p/c.py", "p/a.py"])]
    assert {r.id for r in named.cycle_members(g, "modules_all_ctx").collect()} == set("abcdefi")


def test_q17_cut(spark):
    f = [FILE, *[(f"{r}{i}", f"{r}{i}.py", f"r/{r}", "py", None) for r in "ab" for i in range(4)]]
    x = ["src string, dst string, context string, guarded boolean, line int"]
    x += [("a0", "b0", "toplevel", False, 1), ("a1", "b1", "toplevel", False, 2), ("a2", "b2", "toplevel", False, 3), ("a3", "b3", "toplevel", False, 4), ("a3", "b0", "typing", False, 9)]
    x += [("b0", "a0", "toplevel", False, 5), ("b1", "a1", "toplevel", True, 6), ("b2", "a0", "toplevel", False, None)]
    dep = ["src string, dst string", ("r/a", "r/b"), ("r/b", "r/a")]
    g = make(spark, File=f, IMPORTS_FILE_CROSS_REPO=x, DEPENDS_ON_REPO=dep)
    assert rows(named.q17(g)) == [("a", "b", 4, 3, True, 4, 2, "b -> a", ["b0.py:5"], ["b1.py:6"])]


def test_q18_q19(spark):
    f = [FILE, ("m", "src/m.py", "r/one", "py", None), ("t", "tests/t.py", "r/one", "py", None), ("n", "tests/n.py", "r/two", "py", None)]
    refs = ["id string, root_module string, symbol string", ("e1", "pkg", "S"), ("e2", "pkg", "T"), ("e3", "ghost", "G")]
    ext = ["src string, dst string, line int, context string", ("m", "e1", 4, "toplevel"), ("t", "e2", None, "toplevel"), ("m", "e3", 1, "toplevel"), ("t", "e3", 1, "toplevel"), ("n", "e3", 2, "toplevel"), ("n", "e1", 1, "deferred")]
    pkg = ["id string, name string, ecosystem string", ("p", "pkg", "python"), ("g", "ghost", "python")]
    v = ["id string, cve string, severity string, withdrawn string", ("V1", "CVE-1", "LOW", None), ("V2", "CVE-1", "HIGH", None), ("V3", None, None, None), ("V4", "CVE-4", "CRITICAL", "2020")]
    dep = ["src string, dst string, version_spec string", ("r/one", "p", "==1.5"), ("r/two", "p", ">=1")]
    aff = ["src string, dst string, introduced string, fixed string, last_affected string", *[(i, "p", "1.0", "2.0", None) for i in ("V1", "V2", "V4")], ("V3", "p", "0", None, "1.5"), ("V1", "g", None, None, None), ("V3", "g", None, None, None)]
    g = make(spark, File=f, ExternalRef=refs, IMPORTS_EXT=ext, Package=pkg, Vulnerability=v, DEPENDS_ON=dep, AFFECTS=aff)
    vulnerabilities.assess_graph(g)
    status = {(r.src, r.dst): r.status for r in g["AFFECTED_BY"].collect()}
    assert {k: s for k, s in status.items() if k[0] == "r/one"} == {("r/one", f"V{i}"): "affected" for i in range(1, 5)}
    assert {s for k, s in status.items() if k[0] == "r/two"} == {"indeterminate"}
    got = [(r.repo, r.advisory, r.severity, r.status, r.importing_files, r.assessment, r.symbols_used, r.import_sites) for r in named.q18(g).collect()]
    assert got == [
        ("one", "CVE-1", "HIGH", "affected", 2, named.ACT, ["S", "T"], ["src/m.py:4"]), ("one", "V3", None, "affected", 2, named.ACT, ["S", "T"], ["src/m.py:4"]),
        ("two", "CVE-1", "HIGH", "indeterminate", 0, named.NO_IMPORT, [], []), ("two", "V3", None, "indeterminate", 0, named.NO_IMPORT, [], []),
    ]
    assert rows(named.q19(g)) == [
        ("one", "ghost", 2, ["CVE-1", "V3"], 1, 2, named.SHIPPED, ["src/m.py"]), ("two", "ghost", 2, ["CVE-1", "V3"], 0, 1, named.TEST_ONLY, [])
    ]


def test_q06_q07(spark):
    cross = [CALL.replace("confidence", "confidence") + ", method string", ("a", "b", 1.0, None, "m"), ("a", "c", 0.5, None, "m"), ("a", "d", 0.5, None, "m")]
    symbols = [sym("u", "T")]
    g = make(spark, CALLS_CROSS_REPO=cross, Repo=["id string, commit string, extractors array<string>", ("r/u", "c1", ["x"]), ("r/empty", None, None)], Symbol=[SYM, *symbols], File=files_of(symbols))
    assert rows(named.q06(g)) == [("m", 1.0, 1, 33.3), ("m", 0.5, 2, 66.7)]
    assert rows(named.q07(g)) == [("r/u", "c1", 1, 1, ["x"]), ("r/empty", None, 0, 0, None)]


def test_q12_q13_q14(spark):
    symbols = [sym("u", "A"), sym("v", "B"), sym("u", "C")]
    g = make(spark, Symbol=[SYM, *symbols], File=files_of(symbols), IMPORTS_CROSS_REPO=[XIMP, ("f:v:B.py", "s:u:A", 1.0, 1, "toplevel")], CALLS_CROSS_REPO=[CALL, ("s:v:B", "s:u:A", 1.0, [])])
    community = spark.createDataFrame([("s:u:A", "k"), ("s:v:B", "k"), ("s:u:C", "alone")], "id string, community string")
    between = spark.createDataFrame([("s:u:A", 2.5), ("s:v:B", 0.0)], "id string, betweenness double")
    points = spark.createDataFrame([("s:u:A", 1), ("s:v:B", 0)], "id string, is_articulation int")
    assert rows(named.q12(g, community)) == [("k", 2, 2, ["u", "v"])]
    assert rows(named.q13(g, between, community)) == [("u", "A", "A.py", 3.0, "k")]
    assert rows(named.q14(g, points, between)) == []
    g["CALLS_CROSS_REPO"] = spark.createDataFrame([("s:w:Z", "s:u:A")], "src string, dst string")
    g["Symbol"] = spark.createDataFrame([*symbols, sym("w", "Z")], SYM)
    assert rows(named.q14(g, points, between)) == [("u", "A", "A.py", 2, 3.0)]
