"""Schemas of the canonical graph: six node tables and sixteen edge tables, and their keys."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

_KINDS = {
    "s": StringType(),
    "i": IntegerType(),
    "l": LongType(),
    "d": DoubleType(),
    "b": BooleanType(),
    "a": ArrayType(StringType()),
}


def struct(said: str) -> StructType:
    """"name:s age:i" as a schema; kinds are s(tring), i(nt), l(ong), d(ouble), b(ool), a(rray of strings)."""
    return StructType([StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in said.split())])


NODES = {
    "Repo": struct("id:s name:s url:s commit:s ecosystem:s corpus:s extractors:a"),
    "File": struct("id:s path:s repo:s language:s module:s extractors:a"),
    "Symbol": struct(
        "id:s name:s qname:s kind:s kind_inferred:b path:s repo:s file:s start_line:i end_line:i exported:b docstring:s extractors:a"
    ),
    "Package": struct("id:s name:s ecosystem:s"),
    "ExternalRef": struct("id:s module:s root_module:s symbol:s ecosystem:s extractors:a"),
    "Vulnerability": struct(
        "id:s cve:s aliases:a summary:s severity:s cvss:s cwes:a published:s modified:s withdrawn:s"
    ),
}

EDGES = {
    "CONTAINS": struct("src:s dst:s"),
    "DECLARES": struct("src:s dst:s"),
    "IN_REPO": struct("src:s dst:s"),
    "CALLS": struct("src:s dst:s extractors:a confidence:d evidence:s relation:s"),
    "IMPORTS": struct("src:s dst:s extractors:a context:s guarded:b line:i"),
    "PUBLISHES": struct("src:s dst:s"),
    "DEPENDS_ON": struct("src:s dst:s version_spec:s source:s"),
    "USES": struct("src:s dst:s extractors:a"),
    "IMPORTS_EXT": struct("src:s dst:s line:i context:s guarded:b extractors:a"),
    "RESOLVES_TO": struct(
        "src:s dst:s method:s methods:a confidence:d pkgdir:s ambiguous:b candidates:l providers:l cross_repo:b"
    ),
    "DEPENDS_ON_REPO": struct("src:s dst:s via:a method:s confidence:d cross_repo:b"),
    "IMPORTS_FILE_CROSS_REPO": struct(
        "src:s dst:s method:s confidence:d via_module:s line:i context:s guarded:b cross_repo:b"
    ),
    "CALLS_CROSS_REPO": struct("src:s dst:s method:s confidence:d via_module:s cross_repo:b extractors:a"),
    "IMPORTS_CROSS_REPO": struct(
        "src:s dst:s method:s confidence:d via_module:s line:i context:s cross_repo:b"
    ),
    "AFFECTS": struct("src:s dst:s introduced:s fixed:s last_affected:s version_count:i"),
    "AFFECTED_BY": struct("src:s dst:s package:s status:s reason:s declared:s resolved:s"),
}

TABLES = NODES | EDGES

#: What identifies a row. AFFECTS has one row per disjoint interval.
KEYS = (
    dict.fromkeys(NODES, ("id",))
    | dict.fromkeys(EDGES, ("src", "dst"))
    | {"AFFECTS": ("src", "dst", "introduced", "fixed", "last_affected"), "AFFECTED_BY": ("src", "package", "dst")}
)

#: (table of src, table of dst) of each edge table; a pair of tables where either will do.
ENDS = {
    "CONTAINS": ("Repo", "File"),
    "DECLARES": ("File", "Symbol"),
    "IN_REPO": ("Symbol", "Repo"),
    "CALLS": ("Symbol", "Symbol"),
    "IMPORTS": ("File", "File"),
    "PUBLISHES": ("Repo", "Package"),
    "DEPENDS_ON": ("Repo", "Package"),
    "USES": ("Symbol", "ExternalRef"),
    "IMPORTS_EXT": ("File", "ExternalRef"),
    "RESOLVES_TO": ("ExternalRef", "Symbol"),
    "DEPENDS_ON_REPO": ("Repo", "Repo"),
    "IMPORTS_FILE_CROSS_REPO": ("File", "File"),
    "CALLS_CROSS_REPO": ("Symbol", "Symbol"),
    "IMPORTS_CROSS_REPO": ("File", "Symbol"),
    "AFFECTS": ("Vulnerability", "Package"),
    "AFFECTED_BY": ("Repo", "Vulnerability"),
}
