"""DuckDB SQL for the registered queries, over the adapter's tables.

Written from the queries' contracts, apart from the DataFrame code: links are derived
again in SQL, traversals are recursive or unrolled, components are a closure.
"""

from __future__ import annotations

from repograph.plans.adapter import TABLES, names_in, ordered
from repograph.plans.named import (
    ACT,
    EVIDENCE,
    MISS,
    NO_IMPORT,
    RESOLVE,
    SHIPPED,
    TEST_ONLY,
    THIRD_PARTY,
)

#: Derived tables, as further common table expressions.
DERIVED = {
    "d_dep": """
        SELECT d.src, p.repo AS dst, string_agg(DISTINCT p.name, ',' ORDER BY p.name) AS via
        FROM {a_depends} d JOIN {a_publishes} p ON d.dst = p.dst WHERE d.src <> p.repo GROUP BY d.src, p.repo""",
    "d_go": """
        SELECT src, dst, 1.0 AS confidence, 1 AS rule, pkgdir FROM (
            SELECT b.id AS src, s.id AS dst, b.pkgdir, s.path FROM (
                SELECT r.id, r.symbol, p.repo AS publisher, substring(r.module, length(p.name) + 2) AS pkgdir,
                       row_number() OVER (PARTITION BY r.id ORDER BY length(p.name) DESC, p.repo) AS n
                FROM {a_ref} r JOIN {a_publish} p ON p.ecosystem = 'go' AND (r.module = p.name OR starts_with(r.module, p.name || '/'))
                WHERE r.ecosystem = 'go') b
            JOIN {a_symbol} s ON s.repo = b.publisher AND s.name = b.symbol AND s.exported AND s.kind <> 'method' WHERE b.n = 1) x
        WHERE CASE WHEN strpos(path, '/') > 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END = pkgdir""",
    "d_py": """
        SELECT src, dst, CASE WHEN n = 1 THEN 0.8 ELSE 0.5 END AS confidence, 2 AS rule, n FROM (
            SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM (
                SELECT DISTINCT r.id AS src, s.id AS dst FROM {a_ref} r JOIN {a_publish} p ON p.ecosystem = 'python' AND p.name = r.root_module
                JOIN {a_symbol} s ON s.repo = p.repo AND s.name = r.symbol AND s.exported WHERE r.ecosystem = 'python') x) y""",
    "d_mod": """
        SELECT src, dst, CASE WHEN n = 1 THEN 1.0 ELSE 0.6 END AS confidence, 3 AS rule, n FROM (
            SELECT src, dst, (SELECT count(DISTINCT z.file) FROM {d_modhit} z WHERE z.src = x.src) AS n FROM {d_modhit} x) y""",
    "d_modhit": """
        SELECT DISTINCT r.id AS src, s.id AS dst, f.id AS file FROM {a_ref} r JOIN {a_file} f ON f.module = r.module JOIN {a_symbol} s ON s.file = f.id AND s.name = r.symbol AND s.exported
        WHERE r.ecosystem = 'python' AND EXISTS (SELECT 1 FROM {a_imports_ext} i WHERE i.dst = r.id AND i.repo <> f.repo)""",
    "d_res": """
        SELECT src, dst, arg_min(confidence, rule) AS confidence, CASE min(rule) WHEN 1 THEN 'go-module-prefix' WHEN 2 THEN 'python-package-symbol' ELSE 'python-module-path' END AS method
        FROM (SELECT src, dst, confidence, rule FROM {d_go} UNION ALL SELECT src, dst, confidence, rule FROM {d_py} UNION ALL SELECT src, dst, confidence, rule FROM {d_mod}) u GROUP BY src, dst""",
    "d_xfile": """
        SELECT src, dst, module AS via_module, line, context, guarded FROM (
            SELECT i.src, f.id AS dst, r.module, i.line, i.context, i.guarded, i.repo, row_number() OVER (PARTITION BY i.src, f.id ORDER BY
                CASE WHEN i.context = 'toplevel' AND NOT i.guarded THEN 4 WHEN i.context = 'toplevel' THEN 3 WHEN i.context = 'typing' THEN 2 ELSE 1 END DESC, r.module, i.line NULLS LAST) AS n
            FROM {a_imports_ext} i JOIN {a_ref} r ON r.id = i.dst AND r.ecosystem = 'python' JOIN {a_file} f ON f.module = r.module WHERE f.repo <> i.repo) x WHERE n = 1""",
    "d_xcall": """
        SELECT u.src, r.dst, max(r.confidence) AS confidence, string_agg(DISTINCT u.ext, ',' ORDER BY u.ext) AS ext
        FROM {a_uses} u JOIN {d_res} r ON r.src = u.dst JOIN {a_symbol} a ON a.id = u.src JOIN {a_symbol} b ON b.id = r.dst WHERE a.repo <> b.repo GROUP BY u.src, r.dst""",
    "d_ximp": """
        SELECT src, dst, confidence, line, context, module FROM (
            SELECT i.src, r.dst, r.confidence, i.line, i.context, e.module, row_number() OVER (PARTITION BY i.src, r.dst ORDER BY r.confidence DESC, e.module, i.line NULLS LAST, i.context) AS n
            FROM {a_imports_ext} i JOIN {d_res} r ON r.src = i.dst JOIN {a_ref} e ON e.id = i.dst JOIN {a_symbol} b ON b.id = r.dst WHERE i.repo <> b.repo) x WHERE n = 1""",
    "d_changed": """
        SELECT dst AS id FROM (SELECT dst, count(*) AS n FROM (SELECT src, dst FROM {a_call} UNION ALL SELECT src, dst FROM {d_xcall}) e GROUP BY dst) t ORDER BY n DESC, id LIMIT 1""",
    "d_lib": """
        SELECT repo FROM (SELECT s.repo, count(*) AS n FROM (SELECT dst FROM {d_xcall} UNION ALL SELECT dst FROM {d_ximp}) e JOIN {a_symbol} s ON s.id = e.dst GROUP BY s.repo) t ORDER BY n DESC, repo LIMIT 1""",
    "d_both": "SELECT src, dst FROM {a_call} UNION SELECT src, dst FROM {d_xcall}",
    "d_imp_files": "SELECT f.repo, f.path, i.line, i.confidence FROM {d_ximp} i JOIN {a_file} f ON f.id = i.src WHERE i.dst = (SELECT id FROM {d_changed})",
    "d_consumers": "SELECT c.src, c.dst, s.repo FROM {d_xcall} c JOIN {a_symbol} s ON s.id = c.src UNION ALL SELECT i.src, i.dst, f.repo FROM {d_ximp} i JOIN {a_file} f ON f.id = i.src",
    "d_status": """
        SELECT d.src AS repo, d.dst AS package, v.id AS vuln, d.version_spec AS declared, d.name,
               CASE WHEN d.version_spec IS NULL OR d.pin IS NULL THEN 'indeterminate' WHEN v.lo <= d.pin AND (v.hi IS NULL OR d.pin < v.hi) THEN 'affected' ELSE 'not_affected' END AS status
        FROM {a_depends} d JOIN {a_vuln} v ON v.package = d.dst""",
}


def _reach(name: str, edges: str, depth: int) -> str:
    return (
        f"{name}(id, hop) AS (SELECT id, 0 FROM {{d_changed}} UNION SELECT e.src, r.hop + 1 FROM {name} r JOIN {{{edges}}} e ON e.dst = r.id WHERE r.hop < {depth})"
    )


def _closure(edges: str) -> str:
    """comp(id, component) of the directed edges that the SQL `edges` gives (src, dst)."""
    return f"""edge AS ({edges}), clo(a, b) AS (SELECT src, dst FROM edge UNION SELECT c.a, e.dst FROM clo c JOIN edge e ON e.src = c.b),
    comp AS (SELECT f.id, least(f.id, coalesce(min(c.b), f.id)) AS component FROM {{a_file}} f LEFT JOIN (
        SELECT c.a, c.b FROM clo c JOIN clo d ON c.a = d.b AND c.b = d.a) c ON c.a = f.id GROUP BY f.id)"""


def _projection(name: str) -> str:
    context = {
        "modules": "i.context = 'toplevel'", "modules_core": "i.context = 'toplevel'", "modules_all_ctx": "i.context IS NOT NULL",
        "modules_all_design": "i.context IN ('toplevel', 'typing')", "modules_design": "i.context IN ('toplevel', 'typing')", "modules_xrepo": "i.context = 'toplevel'",
    }[name]
    sql = f"SELECT DISTINCT i.src, i.dst FROM {{a_import}} i JOIN {{a_file}} a ON a.id = i.src JOIN {{a_file}} b ON b.id = i.dst WHERE {context}"
    if name in ("modules_core", "modules_design"):
        sql += " AND NOT ends_with(a.path, '__init__.py') AND NOT ends_with(b.path, '__init__.py')"
    if name == "modules_xrepo":
        sql += """ UNION SELECT src, dst FROM {d_xfile} WHERE context = 'toplevel'
            UNION SELECT i.src, s.file FROM {d_ximp} i JOIN {a_symbol} s ON s.id = i.dst WHERE i.context = 'toplevel'"""
    return sql


def full(sql: str, recursive: str = "") -> str:
    """sql with all common table expressions that it needs before it, {names} resolved."""
    tables = TABLES | DERIVED
    wanted = names_in(recursive) + names_in(sql)
    known = [n for n in ordered(wanted, tables)]
    ctes = [f"{n} AS MATERIALIZED ({tables[n]})" for n in known]
    if recursive:
        ctes.append(recursive)
    text = (("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" if ctes else "") + sql
    for n in set(names_in(text)):
        text = text.replace("{" + n + "}", n)
    return text


TEST = r"(?i)^(.*(_test\.go|test_.*\.py|.*_test\.py|/tests?/.*|.*\.spec\..*))$"


def _agreement(rows: str, name: str) -> str:
    return f"""SELECT len(string_split(ext, ',')) AS votes, CASE len(string_split(ext, ',')) WHEN 3 THEN 'all three' WHEN 1 THEN 'only ' || ext ELSE replace(ext, ',', ' + ') END AS found_by,
        count(*) AS {name}, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM ({rows}) x GROUP BY ext"""


def _best_paths(depth: int = 6) -> str:
    """One row per reached symbol by level: the most confident shortest path, then the least chain."""
    out = [
        "pe AS (SELECT src, dst, max(coalesce(c, 1.0)) AS c FROM (SELECT src, dst, confidence AS c FROM {a_call} UNION ALL SELECT src, dst, confidence FROM {d_xcall}) e GROUP BY src, dst)",
        "l0 AS (SELECT id, 0 AS hops, CAST(1.0 AS DOUBLE) AS conf, [id] AS chain FROM {d_changed})",
    ]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(k))
        out.append(
            f"""l{k} AS (SELECT id, {k} AS hops, conf, chain FROM (
                SELECT e.src AS id, p.conf * e.c AS conf, list_append(p.chain, e.src) AS chain,
                       row_number() OVER (PARTITION BY e.src ORDER BY round(p.conf * e.c, 6) DESC, list_append(p.chain, e.src)) AS n
                FROM l{k - 1} p JOIN pe e ON e.dst = p.id WHERE e.src NOT IN ({seen})) x WHERE n = 1)"""
        )
    out.append("best AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, depth + 1)) + ")")
    return ",\n".join(out)


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["q01_blast_radius"] = full(
        """SELECT x.repo AS impacted_repo, count(DISTINCT x.path) AS impacted_files, string_agg(DISTINCT x.via, ',' ORDER BY x.via) AS reached_via, x.repo <> c.repo AS is_cross_repo
        FROM (SELECT s.repo, s.path, 'call-path' AS via FROM r JOIN {a_symbol} s ON s.id = r.id WHERE r.hop > 0 UNION SELECT repo, path, 'import' FROM {d_imp_files}) x,
             (SELECT s.repo FROM {a_symbol} s JOIN {d_changed} d ON d.id = s.id) c GROUP BY x.repo, c.repo""",
        _reach("r", "d_both", 6),
    )
    q["q02_single_repo_control"] = full(
        """SELECT c.repo AS scope, count(DISTINCT s.path) AS impacted_files_single_repo FROM r JOIN {a_symbol} s ON s.id = r.id, (SELECT s.repo FROM {a_symbol} s JOIN {d_changed} d ON d.id = s.id) c
        WHERE r.hop > 0 AND s.repo = c.repo GROUP BY c.repo""",
        _reach("r", "a_call", 6),
    )
    q["q03_evidence_path"] = full(
        """SELECT impacted_repo, hops, array_to_string(chain, ' <- ') AS call_chain, array_to_string(citations, ' <- ') AS citations, round(conf, 6) AS path_confidence FROM (
            SELECT *, row_number() OVER (PARTITION BY impacted_repo ORDER BY round(conf, 6) DESC, hops, chain, citations) AS n FROM (
                SELECT impacted_repo, hops, chain, citations, conf FROM named UNION ALL
                SELECT i.repo, 1, [i.path, c.qname], [i.path || ':' || coalesce(CAST(i.line AS VARCHAR), '?'), c.path || ':' || coalesce(CAST(c.start_line AS VARCHAR), '?')], coalesce(i.confidence, 1.0)
                FROM {d_imp_files} i, (SELECT s.* FROM {a_symbol} s JOIN {d_changed} d ON d.id = s.id) c WHERE i.repo <> c.repo) u) y WHERE n = 1""",
        _best_paths()
        + """, top AS (SELECT * FROM (SELECT s.repo AS impacted_repo, b.*, row_number() OVER (PARTITION BY s.repo ORDER BY round(b.conf, 6) DESC, b.hops, b.chain) AS n
                FROM best b JOIN {a_symbol} s ON s.id = b.id WHERE s.repo <> (SELECT s.repo FROM {a_symbol} s JOIN {d_changed} d ON d.id = s.id)) x WHERE n = 1),
        named AS (SELECT t.impacted_repo, t.hops, t.conf, list(s.qname ORDER BY t.at) AS chain, list(s.path || ':' || coalesce(CAST(s.start_line AS VARCHAR), '?') ORDER BY t.at) AS citations
                FROM (SELECT impacted_repo, hops, conf, unnest(list_reverse(chain)) AS id, unnest(range(len(chain))) AS at FROM top) t JOIN {a_symbol} s ON s.id = t.id GROUP BY ALL)""",
    )
    q["q04_fan_in"] = full(
        """SELECT s.qname AS symbol, s.path AS defined_in, count(DISTINCT c.repo) AS consuming_repos, count(DISTINCT c.src) AS consuming_symbols, string_agg(DISTINCT c.repo, ',' ORDER BY c.repo) AS consumers
        FROM {d_consumers} c JOIN {a_symbol} s ON s.id = c.dst WHERE s.repo = (SELECT repo FROM {d_lib}) GROUP BY s.id, s.qname, s.path ORDER BY consuming_repos DESC, consuming_symbols DESC, s.id LIMIT 25"""
    )
    q["q05_dangling"] = full(
        f"""SELECT module, CAST(sum(n) AS BIGINT) AS unresolved_refs, in_corpus, CASE WHEN in_corpus THEN '{MISS}' ELSE '{THIRD_PARTY}' END AS verdict FROM (
            SELECT coalesce(r.root_module, r.module) AS module, CASE WHEN count(p.repo) = 0 THEN 1 ELSE count(p.repo) END AS n, count(p.repo) > 0 AS in_corpus
            FROM {{a_ref}} r LEFT JOIN {{a_publish}} p ON p.name = coalesce(r.root_module, r.module) OR p.name = r.module OR starts_with(r.module, p.name || '/')
            WHERE r.id NOT IN (SELECT src FROM {{d_res}}) GROUP BY r.id, r.root_module, r.module) x
        GROUP BY module, in_corpus ORDER BY in_corpus DESC, unresolved_refs DESC, module LIMIT 30"""
    )
    q["q06_confidence_audit"] = full(
        "SELECT 'package-lift' AS inference_method, CAST(confidence AS DOUBLE) AS confidence, count(*) AS edges, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct_of_cross_repo FROM {d_xcall} GROUP BY confidence"
    )
    q["q07_overview"] = full(
        """SELECT r.id AS repo, r.commit_id AS commit, (SELECT count(*) FROM {a_file} f WHERE f.repo = r.id) AS files, (SELECT count(*) FROM {a_symbol} s WHERE s.repo = r.id) AS symbols, r.ext AS extracted_by FROM {a_repo} r"""
    )
    q["q08_undeclared"] = full(
        """SELECT i.repo AS consumer, s.repo AS undeclared_dependency, count(DISTINCT i.path) AS importing_files,
            array_to_string(list_slice(list_sort(list(DISTINCT s.name)), 1, 8), ',') AS example_symbols, array_to_string(list_slice(list_sort(list(DISTINCT i.path)), 1, 5), ',') AS example_files
        FROM (SELECT x.dst, f.repo, f.path FROM {d_ximp} x JOIN {a_file} f ON f.id = x.src) i JOIN {a_symbol} s ON s.id = i.dst
        WHERE NOT EXISTS (SELECT 1 FROM {d_dep} d WHERE d.src = i.repo AND d.dst = s.repo) GROUP BY i.repo, s.repo"""
    )
    q["q09_symbol_agreement"] = full(_agreement("SELECT s.ext FROM {a_symbol} s JOIN {a_repo} r ON r.id = s.repo WHERE r.corpus = 'ASIA'", "symbols"))
    q["q10_call_agreement"] = full(_agreement("SELECT c.ext FROM {a_call} c JOIN {a_symbol} s ON s.id = c.src JOIN {a_repo} r ON r.id = s.repo WHERE r.corpus = 'ASIA'", "call_edges"))
    q["q11_trust"] = full(
        f"""SELECT CASE v WHEN 3 THEN '{EVIDENCE[3]}' WHEN 2 THEN '{EVIDENCE[2]}' ELSE '{EVIDENCE[1]}' END AS evidence, count(*) AS impacted_files FROM (
            SELECT s.path, max(w.votes) AS v FROM w JOIN {{a_symbol}} s ON s.id = w.id WHERE w.hop > 0 GROUP BY s.path) x GROUP BY v""",
        """w(id, hop, votes) AS (SELECT id, 0, 3 FROM {d_changed} UNION SELECT c.src, w.hop + 1, least(w.votes, CAST(len(string_split(c.ext, ',')) AS INTEGER)) FROM w JOIN {a_call} c ON c.dst = w.id WHERE w.hop < 4)""",
    )
    q["q15_cycles"] = full(
        """SELECT string_split(m.repo, '/')[-1] AS repo, m.n AS core_modules, CAST(k.cycles AS BIGINT) AS cycles, k.longest, (SELECT count(*) FROM comp_r c WHERE c.component = m.rc) AS entangled_with_facades,
            (SELECT count(*) FROM comp_d c WHERE c.component = m.dc) AS design_time_modules, (SELECT string_agg(f.path, ' > ' ORDER BY t.at) FROM (SELECT unnest(k.worst) AS id, unnest(range(len(k.worst))) AS at) t JOIN {a_file} f ON f.id = t.id) AS longest_cycle
        FROM (SELECT c.component, count(*) AS n, min(f.repo) AS repo, max(r.component) AS rc, max(d.component) AS dc FROM comp c JOIN {a_file} f ON f.id = c.id JOIN comp_r r ON r.id = c.id JOIN comp_d d ON d.id = c.id GROUP BY c.component HAVING count(*) > 1) m
        JOIN (SELECT component, count(*) AS cycles, CAST(max(len(path) - 1) AS INTEGER) AS longest, arg_min(path, (-len(path), path)) AS worst FROM cyc GROUP BY component) k ON k.component = m.component""",
        _closure(_projection("modules_core"))
        + ","
        + _closure(_projection("modules")).replace("edge", "edge_r").replace("clo(", "clo_r(").replace("clo ", "clo_r ").replace("comp AS", "comp_r AS")
        + ","
        + _closure(_projection("modules_design")).replace("edge", "edge_d").replace("clo(", "clo_d(").replace("clo ", "clo_d ").replace("comp AS", "comp_d AS")
        + """, ins AS (SELECT e.src, e.dst, a.component FROM edge e JOIN comp a ON a.id = e.src JOIN comp b ON b.id = e.dst WHERE a.component = b.component AND e.src <> e.dst),
        walk(component, path) AS (SELECT component, [src, dst] FROM ins WHERE src < dst UNION ALL
            SELECT w.component, list_append(w.path, i.dst) FROM walk w JOIN ins i ON i.src = w.path[-1] AND i.component = w.component
            WHERE w.path[1] <> w.path[-1] AND len(w.path) <= 10 AND i.dst >= w.path[1] AND (i.dst = w.path[1] OR NOT list_contains(w.path, i.dst))),
        cyc AS (SELECT * FROM walk WHERE path[1] = path[-1])""",
    )
    q["q16_test_impact"] = full(
        f"""SELECT string_split(repo, '/')[-1] AS repo, count(DISTINCT path) AS test_files, array_to_string(list_slice(list_sort(list(DISTINCT path)), 1, 4), ',') AS examples FROM (
            SELECT s.repo, s.path FROM r JOIN {{a_symbol}} s ON s.id = r.id WHERE r.hop > 0 UNION SELECT repo, path FROM {{d_imp_files}}) x WHERE regexp_matches(path, '{TEST}') GROUP BY x.repo""",
        _reach("r", "d_both", 5),
    )
    q["q17_cross_boundary_cycles"] = full(
        """SELECT string_split(f.a, '/')[-1] AS distribution_a, string_split(f.b, '/')[-1] AS distribution_b, f.edges AS a_to_b_imports, k.edges AS b_to_a_imports,
            (EXISTS (SELECT 1 FROM {d_dep} d WHERE d.src = f.a AND d.dst = f.b) AND EXISTS (SELECT 1 FROM {d_dep} d WHERE d.src = f.b AND d.dst = f.a)) AS declared_both_ways,
            CAST(coalesce((SELECT sum(n) FROM (SELECT c.component, count(*) AS n, count(DISTINCT x.repo) AS r FROM comp c JOIN {a_file} x ON x.id = c.id WHERE x.repo IN (f.a, f.b) GROUP BY c.component) y WHERE r > 1), 0) AS BIGINT) AS entangled_modules,
            CAST(coalesce((SELECT count(*) FROM (SELECT c.component, count(*) AS n, count(DISTINCT x.repo) AS r FROM comp c JOIN {a_file} x ON x.id = c.id WHERE x.repo IN (f.a, f.b) GROUP BY c.component) y WHERE r > 1), 0) AS BIGINT) AS spanning_components,
            CASE WHEN k.edges <= f.edges THEN string_split(f.b, '/')[-1] || ' -> ' || string_split(f.a, '/')[-1] ELSE string_split(f.a, '/')[-1] || ' -> ' || string_split(f.b, '/')[-1] END AS cut_direction,
            coalesce(CASE WHEN k.edges <= f.edges THEN k.hard ELSE f.hard END, '') AS cut_sites_must_fix, coalesce(CASE WHEN k.edges <= f.edges THEN k.soft ELSE f.soft END, '') AS cut_sites_already_guarded
        FROM flow f JOIN flow k ON k.a = f.b AND k.b = f.a WHERE f.a < f.b""",
        _closure(_projection("modules_xrepo"))
        + """, flow AS (SELECT p.repo AS a, q.repo AS b, count(*) AS edges, string_agg(DISTINCT CASE WHEN NOT x.guarded THEN p.path || ':' || x.line END, ',' ORDER BY CASE WHEN NOT x.guarded THEN p.path || ':' || x.line END) AS hard,
                string_agg(DISTINCT CASE WHEN x.guarded THEN p.path || ':' || x.line END, ',' ORDER BY CASE WHEN x.guarded THEN p.path || ':' || x.line END) AS soft
            FROM {d_xfile} x JOIN {a_file} p ON p.id = x.src JOIN {a_file} q ON q.id = x.dst WHERE x.context = 'toplevel' GROUP BY p.repo, q.repo)""",
    )
    q["q18_reachable_vulnerabilities"] = full(
        f"""SELECT string_split(z.repo, '/')[-1] AS repo, z.name AS package, z.advisory, z.severity, z.status, z.declared, coalesce(u.n, 0) AS importing_files,
            CASE WHEN u.n IS NULL THEN '{NO_IMPORT}' WHEN z.status = 'affected' THEN '{ACT}' ELSE '{RESOLVE}' END AS assessment, coalesce(u.symbols, '') AS symbols_used, coalesce(u.sites, '') AS import_sites
        FROM (SELECT s.repo, s.name, coalesce(v.cve, v.id) AS advisory, s.status, s.declared,
                CASE min(CASE v.severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 3 END) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MODERATE' WHEN 3 THEN 'LOW' END AS severity
              FROM {{d_status}} s JOIN {{a_vuln}} v ON v.id = s.vuln WHERE v.withdrawn IS NULL AND s.status <> 'not_affected' GROUP BY s.repo, s.name, advisory, s.status, s.declared) z
        LEFT JOIN (SELECT f.repo, e.root_module, count(DISTINCT f.id) AS n, array_to_string(list_slice(list_sort(list(DISTINCT f.path || ':' || i.line) FILTER (i.line IS NOT NULL)), 1, 4), ',') AS sites, array_to_string(list_slice(list_sort(list(DISTINCT e.symbol)), 1, 6), ',') AS symbols
              FROM {{a_imports_ext}} i JOIN {{a_ref}} e ON e.id = i.dst JOIN {{a_file}} f ON f.id = i.src WHERE i.context = 'toplevel' GROUP BY f.repo, e.root_module) u ON u.repo = z.repo AND u.root_module = z.name
        ORDER BY CASE z.status WHEN 'affected' THEN 0 ELSE 1 END, CASE z.severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 ELSE 3 END, importing_files DESC, z.repo, z.name, z.advisory, z.status, z.declared NULLS FIRST LIMIT 30"""
    )
    q["q19_phantom_dependencies"] = full(
        f"""SELECT string_split(repo, '/')[-1] AS repo, root_module AS undeclared_package, advisories, examples, len(shipped) AS shipped_files, len(paths) AS total_files,
            CASE WHEN len(shipped) = 0 THEN '{TEST_ONLY}' ELSE '{SHIPPED}' END AS assessment, array_to_string(list_slice(shipped, 1, 4), ',') AS example_files FROM (
            SELECT u.repo, u.root_module, a.package, a.advisories, a.examples, u.paths,
                [x FOR x IN u.paths IF NOT regexp_matches(x, '(?i)^(.*(^|/)(tests?|conftest)(/|\\.|_).*)$') AND NOT regexp_matches(x, '(?i)^(.*(_test\\.py|test_.*\\.py))$')] AS shipped
            FROM (SELECT f.repo, e.root_module, list_sort(list(DISTINCT f.path)) AS paths FROM {{a_imports_ext}} i JOIN {{a_ref}} e ON e.id = i.dst JOIN {{a_file}} f ON f.id = i.src WHERE i.context = 'toplevel' GROUP BY f.repo, e.root_module) u
            JOIN (SELECT p.id AS package, p.name, count(DISTINCT v.id) AS advisories, array_to_string(list_slice(list_sort(list(DISTINCT coalesce(v.cve, v.id))), 1, 5), ',') AS examples
                  FROM {{a_vuln}} v JOIN {{a_package}} p ON p.id = v.package WHERE v.withdrawn IS NULL GROUP BY p.id, p.name) a ON a.name = u.root_module
            WHERE NOT EXISTS (SELECT 1 FROM {{a_depends}} d WHERE d.src = u.repo AND d.dst = a.package) AND NOT EXISTS (SELECT 1 FROM {{a_publishes}} d WHERE d.repo = u.repo AND d.dst = a.package)) x
        ORDER BY len(shipped) DESC, advisories DESC, x.repo, package LIMIT 20"""
    )
    q["l01_depends_on_repo"] = full("SELECT src, dst, via, CAST(1.0 AS DOUBLE) AS confidence FROM {d_dep}")
    q["l02_go_prefix"] = full("SELECT src, dst, pkgdir, CAST(confidence AS DOUBLE) AS confidence FROM {d_go}")
    q["l03_python_package"] = full("SELECT src, dst, n AS candidates, n > 1 AS ambiguous, CAST(confidence AS DOUBLE) AS confidence FROM {d_py}")
    q["l04_python_module"] = full("SELECT src, dst, CAST(n AS BIGINT) AS providers, n > 1 AS ambiguous, CAST(confidence AS DOUBLE) AS confidence FROM {d_mod}")
    q["l05_file_imports"] = full("SELECT src, dst, via_module, line, context, guarded FROM {d_xfile}")
    q["l06_call_lift"] = full("SELECT src, dst, CAST(confidence AS DOUBLE) AS confidence, ext AS extractors FROM {d_xcall}")
    q["l07_import_lift"] = full("SELECT src, dst, CAST(confidence AS DOUBLE) AS confidence, module AS via_module, line, context FROM {d_ximp}")
    q["l08_report"] = full(
        """SELECT relationship, method, count(*) AS edges, round(avg(confidence), 3) AS avg_confidence FROM (
            SELECT 'RESOLVES_TO' AS relationship, method, CAST(confidence AS DOUBLE) AS confidence FROM {d_res} UNION ALL SELECT 'DEPENDS_ON_REPO', 'manifest', 1.0 FROM {d_dep} UNION ALL
            SELECT 'IMPORTS_FILE_CROSS_REPO', 'python-module-path', 1.0 FROM {d_xfile} UNION ALL SELECT 'CALLS_CROSS_REPO', 'package-lift', confidence FROM {d_xcall} UNION ALL
            SELECT 'IMPORTS_CROSS_REPO', 'source-import', confidence FROM {d_ximp}) x GROUP BY relationship, method"""
    )
    for name in ("modules", "modules_core", "modules_all_ctx", "modules_all_design", "modules_design", "modules_xrepo"):
        q[f"g09_scc_{name}"] = full("SELECT c.id, c.component, f.repo FROM comp c JOIN {a_file} f ON f.id = c.id JOIN (SELECT component FROM comp GROUP BY component HAVING count(*) > 1) k ON k.component = c.component", _closure(_projection(name)))
    q["g01_reach"] = full("SELECT id, min(hop) AS hops FROM r WHERE hop > 0 GROUP BY id", _reach("r", "d_both", 6))
    steps = ",\n".join(
        f"p{k} AS (SELECT n.id, 0.15 + 0.85 * coalesce(sum(p.rank * e.w / d.t), 0) AS rank FROM n LEFT JOIN e ON e.dst = n.id LEFT JOIN d ON d.src = e.src LEFT JOIN p{k - 1} p ON p.id = e.src GROUP BY n.id)" for k in range(1, 21)
    )
    q["g07_pagerank"] = full(
        "SELECT id, round(rank, 4) AS pagerank FROM p20",
        """u AS (SELECT src, dst FROM {a_call} UNION ALL SELECT src, dst FROM {d_xcall} UNION ALL SELECT src, dst FROM {d_ximp} UNION ALL SELECT file, id FROM {a_symbol}),
        e AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM (SELECT src, dst FROM u UNION ALL SELECT dst, src FROM u) x GROUP BY src, dst), d AS MATERIALIZED (SELECT src, sum(w) AS t FROM e GROUP BY src),
        n AS (SELECT id FROM {a_symbol} UNION ALL SELECT id FROM {a_file}), p0 AS (SELECT id, 0.15 AS rank FROM n), """
        + steps.replace("AS (SELECT n.id", "AS MATERIALIZED (SELECT n.id"),
    )
    q["v06_assessment"] = full("SELECT repo AS src, vuln AS dst, package, status, declared FROM {d_status}")
    q["v_histogram"] = full("SELECT status, count(*) AS n FROM {d_status} GROUP BY status")
    q["c08_stats"] = full(
        " UNION ALL ".join(
            f"SELECT '{n}' AS name, count(*) AS rows FROM {{{t}}}"
            for n, t in {
                "Repo": "a_repo", "File": "a_file", "Symbol": "a_symbol", "Package": "a_package", "ExternalRef": "a_ref", "Vulnerability": "a_vuln", "CONTAINS": "a_file", "DECLARES": "a_symbol",
                "IN_REPO": "a_symbol", "CALLS": "a_call", "IMPORTS": "a_import", "PUBLISHES": "a_publishes", "DEPENDS_ON": "a_depends", "USES": "a_uses", "IMPORTS_EXT": "a_imports_ext", "RESOLVES_TO": "d_res",
                "DEPENDS_ON_REPO": "d_dep", "IMPORTS_FILE_CROSS_REPO": "d_xfile", "CALLS_CROSS_REPO": "d_xcall", "IMPORTS_CROSS_REPO": "d_ximp", "AFFECTS": "a_vuln", "AFFECTED_BY": "d_status",
            }.items()
        )
    )
    truth = """truth AS (SELECT DISTINCT i.repo AS src_repo, f.path AS src_file, s.repo AS dst_repo, s.name AS symbol FROM {a_imports_ext} i JOIN {a_file} f ON f.id = i.src JOIN {a_ref} r ON r.id = i.dst
        JOIN {a_publish} p ON p.name = r.root_module AND p.ecosystem = 'python' JOIN {a_symbol} s ON s.repo = p.repo AND s.name = r.symbol AND s.exported WHERE r.ecosystem = 'python' AND s.repo <> i.repo)"""
    arms = """arms AS (SELECT DISTINCT 'unified' AS arm, a.repo AS src_repo, a.path AS src_file, b.repo AS dst_repo, b.name AS symbol FROM {d_xcall} c JOIN {a_symbol} a ON a.id = c.src JOIN {a_symbol} b ON b.id = c.dst
        UNION SELECT DISTINCT 'unified+source', a.repo, a.path, b.repo, b.name FROM {d_xcall} c JOIN {a_symbol} a ON a.id = c.src JOIN {a_symbol} b ON b.id = c.dst
        UNION SELECT DISTINCT 'unified+source', f.repo, f.path, b.repo, b.name FROM {d_ximp} c JOIN {a_file} f ON f.id = c.src JOIN {a_symbol} b ON b.id = c.dst)"""
    q["c06_scores"] = full(
        """SELECT arm, p AS predicted, t AS truth, tp, p - tp AS fp, t - tp AS fn, round(tp * 1.0 / p, 6) AS precision, round(tp * 1.0 / t, 6) AS recall, round(2.0 * tp / (p + t), 6) AS f1 FROM (
            SELECT a.arm, count(*) AS p, count(t.symbol) AS tp, (SELECT count(*) FROM truth) AS t FROM arms a LEFT JOIN truth t ON t.src_repo = a.src_repo AND t.src_file = a.src_file AND t.dst_repo = a.dst_repo AND t.symbol = a.symbol GROUP BY a.arm) x""",
        truth + "," + arms,
    )
    return q
