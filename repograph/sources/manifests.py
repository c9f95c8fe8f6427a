"""Dependency manifests: requirements files, pyproject.toml, go.mod."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.functions import ids

DEPENDENCY = "repo string, ecosystem string, name string, version_spec string, source string"


def requirements(files: DataFrame) -> DataFrame:
    """repo, path, at, name, spec of requirements*.txt files (repo, path, text)."""
    lines = files.where(F.regexp_like("path", F.lit(r"(^|/)requirements[^/]*\.txt$"))).select("repo", "path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "line"))
    return lines.select("repo", "path", "at", ids.requirement(F.col("line")).alias("r")).where("r is not null").select("repo", "path", "at", "r.name", "r.spec")


def _toml(frames):
    import tomllib

    import pandas as pd

    for f in frames:
        rows = []
        for repo, path, text in zip(f["repo"], f["path"], f["text"], strict=True):
            try:
                found = (tomllib.loads(text or "").get("project") or {}).get("dependencies") or []
            except tomllib.TOMLDecodeError:
                continue
            rows += [(repo, path, i, str(d)) for i, d in enumerate(found)]
        yield pd.DataFrame(rows, columns=["repo", "path", "at", "line"])


def pyproject(files: DataFrame) -> DataFrame:
    """The same of pyproject.toml files: project.dependencies only; files that don't parse are skipped."""
    own = files.where(F.regexp_like("path", F.lit(r"(^|/)pyproject\.toml$"))).select("repo", "path", "text")
    lines = own.mapInPandas(_toml, "repo string, path string, at int, line string")
    return lines.select("repo", "path", "at", ids.requirement(F.col("line")).alias("r")).where("r is not null").select("repo", "path", "at", "r.name", "r.spec")


def python_dependencies(files: DataFrame) -> DataFrame:
    """DEPENDENCY rows, one per name without case: requirements come before pyproject, then path and line."""
    both = requirements(files).withColumn("p", F.lit(0)).unionByName(pyproject(files).withColumn("p", F.lit(1)))
    first = F.min_by(F.struct("name", "spec", "path"), F.struct("p", "path", "at"))
    rows = both.groupBy("repo", F.lower("name").alias("low")).agg(first.alias("d"))
    return rows.select("repo", F.lit("python").alias("ecosystem"), "d.name", F.col("d.spec").alias("version_spec"), F.col("d.path").alias("source"))


def go_directives(text: str) -> list[tuple]:
    """(kind, line number, module, version, new module, new version) of require and replace directives."""
    out, block = [], None
    for at, raw in enumerate((text or "").splitlines()):
        code, _, comment = raw.partition("//")
        words = code.split()
        if not words:
            continue
        if words[0] in ("require", "replace", "exclude", "retract") and words[1:2] == ["("]:
            block = words[0]
            continue
        if block and words[0] == ")":
            block = None
            continue
        kind, body = (block, words) if block else (words[0], words[1:])
        if kind == "require" and len(body) >= 2 and comment.strip().split(";")[0].strip() != "indirect":
            out.append(("require", at, body[0], body[1], None, None))
        elif kind == "replace" and "=>" in body:
            k = body.index("=>")
            new = body[k + 1 :]
            if k and new:
                out.append(("replace", at, body[0], None, new[0], new[1] if len(new) > 1 else None))
        elif kind == "module" and body and not block:
            out.append(("module", at, body[0].strip('"'), None, None, None))
    return out


def _go_mod(frames):
    import pandas as pd

    for f in frames:
        rows = [(repo, path, *d) for repo, path, text in zip(f["repo"], f["path"], f["text"], strict=True) for d in go_directives(text)]
        yield pd.DataFrame(rows, columns=["repo", "path", "kind", "at", "module", "version", "new_module", "new_version"])


def go_mod(files: DataFrame) -> DataFrame:
    own = files.where(F.regexp_like("path", F.lit(r"(^|/)go\.mod$"))).select("repo", "path", "text")
    return own.mapInPandas(_go_mod, "repo string, path string, kind string, at int, module string, version string, new_module string, new_version string")


def go_dependencies(files: DataFrame) -> DataFrame:
    """DEPENDENCY rows of direct requirements, replaced as the build replaces them; a replacement by a local
    directory is no dependency. The first of a module stays."""
    found = go_mod(files)
    new = found.where("kind = 'replace'").groupBy("repo", "path", "module").agg(F.max_by(F.struct("new_module", "new_version"), "at").alias("r"))
    met = found.where("kind = 'require'").select("repo", "path", "at", "module", "version").join(new, ["repo", "path", "module"], "left")
    local = F.coalesce(F.regexp_like("r.new_module", F.lit("^[./]")), F.lit(False))
    rows = met.where(~local).select("repo", "path", "at", F.coalesce("r.new_module", "module").alias("module"), F.coalesce("r.new_version", "version").alias("version"))
    one = rows.groupBy("repo", "module").agg(F.min_by(F.struct("version", "path"), F.struct("path", "at")).alias("d"))
    return one.select("repo", F.lit("go").alias("ecosystem"), F.col("module").alias("name"), F.col("d.version").alias("version_spec"), F.col("d.path").alias("source"))


def module_paths(files: DataFrame) -> DataFrame:
    """repo, module that the go.mod at the root declares."""
    text = files.where("path = 'go.mod'").select("repo", F.regexp_extract("text", r'(?m)^\s*module\s+"?([^\s"]+)', 1).alias("module"))
    return text.where("module <> ''")


def dependencies(files: DataFrame, ecosystem: str) -> DataFrame:
    if ecosystem not in ("python", "go"):
        raise ValueError(f"unsupported ecosystem: {ecosystem}")
    return python_dependencies(files) if ecosystem == "python" else go_dependencies(files)


def package_rows(found: DataFrame) -> DataFrame:
    """DEPENDENCY rows as package rows of the graph."""
    eco, name = F.col("ecosystem"), F.col("name")
    return found.select(
        "repo", ids.package_id(eco, name).alias("id"), ids.package_name(eco, name).alias("name"), "ecosystem", F.lit("DEPENDS_ON").alias("relation"), "version_spec", "source"
    )


