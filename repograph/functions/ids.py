"""Identity and normalisation as Column expressions: no Python function runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_path(path: Column) -> Column:
    """Forward slashes, no leading slash, no leading ./"""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", ""), r"^(\./)+", "")


def repo_id(url: Column, dist: Column | None = None) -> Column:
    """repo:{host}/{owner}/{name}, and /{dist} for one of several distributions in a repository."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), r"\.git$", "")
    base = F.concat(F.lit("repo:"), host, F.lit("/"), path)
    if dist is None:
        return base
    return F.when(F.coalesce(dist, F.lit("")) != "", F.concat(base, F.lit("/"), dist)).otherwise(base)


def file_id(repo: Column, path: Column) -> Column:
    return F.concat(F.lit("file:"), repo, F.lit(":"), norm_path(path))


def symbol_id(repo: Column, path: Column, qname: Column) -> Column:
    """The signature is no part of it: extractors render signatures differently."""
    return F.concat(F.lit("sym:"), repo, F.lit(":"), norm_path(path), F.lit("#"), qname)


def package_name(ecosystem: Column, name: Column) -> Column:
    """Python names compare without case and with - _ . alike; Go module paths are left alone."""
    trimmed = F.trim(name)
    return F.when(ecosystem == "python", F.lower(F.regexp_replace(trimmed, "[-_.]+", "-"))).otherwise(trimmed)


def package_id(ecosystem: Column, name: Column) -> Column:
    return F.concat(F.lit("pkg:"), ecosystem, F.lit(":"), package_name(ecosystem, name))


def external_ref_id(ecosystem: Column, module: Column, symbol: Column) -> Column:
    """An unknown module is the literal <unknown> in the id."""
    tail = F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit("#"), symbol)).otherwise(F.lit(""))
    return F.concat(F.lit("ext:"), ecosystem, F.lit(":"), F.coalesce(module, F.lit("<unknown>")), tail)


def root_module(ecosystem: Column, module: Column) -> Column:
    """The package that would provide a module: Python's top-level name, Go's whole path."""
    trimmed = F.trim(module)
    root = F.when(ecosystem == "python", package_name(ecosystem, F.substring_index(trimmed, ".", 1))).otherwise(trimmed)
    return F.when(trimmed != "", root)


def language(path: Column) -> Column:
    """The lower-cased extension, or unknown."""
    name = F.element_at(F.split(norm_path(path), "/"), -1)
    found = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(found != "", found).otherwise("unknown")


def exported(name: Column, ecosystem: Column) -> Column:
    """Go: upper-case initial. Python: no leading underscore. An empty name is not exported."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(False)).otherwise(
        F.when(ecosystem == "go", F.regexp_like(name, F.lit(r"^\p{Lu}"))).otherwise(~name.startswith("_"))
    )


def line_of(location: Column) -> Column:
    """L12 as 12."""
    return F.regexp_extract(F.coalesce(location, F.lit("")), r"^L(\d+)", 1).try_cast("int")


#: Fixed value: a requirement line without its comment.
REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(\[[^\]]*\])?\s*([<>=!~^].*)?\s*$"


def requirement(line: Column) -> Column:
    """A requirement line as a struct (name, extras, spec); null for comments, directives and urls."""
    bare = F.trim(F.substring_index(line, "#", 1))
    ok = F.regexp_like(bare, F.lit(REQUIREMENT)) & ~bare.startswith("-") & ~bare.contains("://")
    part = lambda n: F.nullif(F.trim(F.regexp_extract(bare, REQUIREMENT, n)), F.lit(""))
    return F.when(ok, F.struct(part(1).alias("name"), part(2).alias("extras"), part(3).alias("spec")))


def path_excluded(path: Column, parts: list[str]) -> Column:
    """Whether a directory on the path is one of parts."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.lit(parts))


def last_segment(x: Column) -> Column:
    return F.element_at(F.split(x, "/"), -1)


def strength(context: Column, guarded: Column, missing: str = "toplevel") -> Column:
    """Of an import: unguarded toplevel 4, guarded toplevel 3, typing 2, deferred 1."""
    at = F.coalesce(context, F.lit(missing))
    return (
        F.when((at == "toplevel") & ~F.coalesce(guarded, F.lit(False)), 4)
        .when(at == "toplevel", 3)
        .when(at == "typing", 2)
        .otherwise(1)
    )
