"""The canonical graph: a table per node label and per edge type.

Tables are immutable snapshots. Loading merges rows by key (so it can be repeated),
derived layers are overwritten, and a snapshot on disk is a folder of Parquet tables.
"""

from __future__ import annotations

from collections.abc import Iterable
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.operators.tables import empty, together, written
from repograph.operators.upsert import duplicates, only_between, upsert, without
from repograph.schema import EDGES, ENDS, KEYS, NODES, TABLES

#: Columns whose last value that isn't null wins, and set-valued columns, by table.
KEEP = {
    "File": ("module",),
    "CALLS": ("confidence", "evidence"),
    "IMPORTS": ("context", "guarded", "line"),
    "IMPORTS_EXT": ("context", "guarded", "line"),
    "ExternalRef": ("module", "root_module", "symbol"),
}
SETS = {t: tuple(f.name for f in s if f.name in ("extractors", "via", "methods")) for t, s in TABLES.items()}
DERIVED = ("RESOLVES_TO", "DEPENDS_ON_REPO", "IMPORTS_FILE_CROSS_REPO", "CALLS_CROSS_REPO", "IMPORTS_CROSS_REPO")
#: Rows of one write, for sinks that take batches.
BATCH = 5000


class Graph:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.tables = spark, dict(tables or {})
        self.memo: dict = {}  # what is derived from the tables as they are
        self.later: dict = {}  # functions that make tables which nobody has read yet
        self.lock = RLock()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        with self.lock:
            if name in self.later:
                self.tables[name] = self._told(name, self.later[name]())
                del self.later[name]
            if name not in self.tables:
                self.tables[name] = empty(self.spark, TABLES[name])
            return self.tables[name]

    def __setitem__(self, name: str, df: DataFrame) -> None:
        """Puts df in the table's schema; columns it lacks are null."""
        self.memo.clear()
        self.later.pop(name, None)
        self.tables[name] = self._told(name, df)

    def _told(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]))

    # reading and writing

    @classmethod
    def read(cls, spark: SparkSession, folder: str, names: Iterable[str] = TABLES) -> Graph:
        """A snapshot; the explicit schemas spare a look into the files."""
        return cls(spark, {n: spark.read.schema(TABLES[n]).parquet(f"{folder}/{n}") for n in names})

    def write(self, folder: str) -> dict[str, int]:
        """All tables, and how many rows each has when read back."""
        for name in TABLES:
            self[name].write.mode("overwrite").parquet(f"{folder}/{name}")
        back = Graph.read(self.spark, folder)
        return {r["name"]: r["rows"] for r in back.stats().collect()}

    def settle(self, *names: str) -> Graph:
        """Writes tables that have several readers; all of those set if none is named."""
        self.tables |= together({n: lambda n=n: written(self[n], n) for n in names or (*self.tables, *self.later)})
        return self

    # loading

    def load(self, name: str, rows: DataFrame, check_ends: bool = True, order: str | None = None) -> Graph:
        """Upserts rows. Of edges, only those whose ends exist."""
        if name in EDGES and check_ends:
            a, b = ENDS[name]
            rows = only_between(rows, self[a], self[b])
        merged = upsert(self[name], rows, KEYS[name], KEEP.get(name, ()), SETS[name], order) if KEYS[name] != KEYS["AFFECTS"] else (
            self[name].unionByName(rows, allowMissingColumns=True).dropDuplicates(list(KEYS[name]))
        )
        self[name] = merged
        return self

    def load_packages(self, rows: DataFrame) -> Graph:
        """rows: repo, id, name, ecosystem, relation (PUBLISHES or DEPENDS_ON), version_spec, source."""
        self.load("Package", rows.select("id", "name", "ecosystem"))
        edge = rows.select(F.col("repo").alias("src"), F.col("id").alias("dst"), "relation", "version_spec", "source")
        self.load("PUBLISHES", edge.where("relation = 'PUBLISHES'").select("src", "dst"))
        return self.load("DEPENDS_ON", edge.where("relation = 'DEPENDS_ON'").select("src", "dst", "version_spec", "source"))

    def load_files(self, rows: DataFrame) -> Graph:
        self.load("File", rows)
        return self.load("CONTAINS", self["File"].select(F.col("repo").alias("src"), F.col("id").alias("dst")))

    def load_symbols(self, rows: DataFrame) -> Graph:
        self.load("Symbol", rows)
        s = self["Symbol"]
        self.load("IN_REPO", s.select(F.col("id").alias("src"), F.col("repo").alias("dst")))
        return self.load("DECLARES", s.select(F.col("file").alias("src"), F.col("id").alias("dst")))

    def load_external_refs(self, rows: DataFrame, edge: str) -> Graph:
        """rows: ExternalRef columns with src, and for IMPORTS_EXT line, context, guarded. edge: USES or IMPORTS_EXT."""
        refs = [c for c in ("id", "module", "root_module", "symbol", "ecosystem", "extractors") if c in rows.columns]
        anchor = "Symbol" if edge == "USES" else "File"
        able = rows.join(self[anchor].select(F.col("id").alias("src")), "src", "left_semi")
        self.load("ExternalRef", able.select(*refs))
        names = [f.name for f in TABLES[edge] if f.name in able.columns and f.name not in ("src", "dst")]
        return self.load(edge, able.select("src", F.col("id").alias("dst"), *names))

    def set_modules(self, rows: DataFrame) -> Graph:
        """rows: id, module."""
        new = rows.select(F.col("id").alias("__id"), F.col("module").alias("__m")).dropDuplicates(["__id"])
        f = self["File"]
        met = f.join(new, f["id"] == new["__id"], "left").withColumn("module", F.coalesce("__m", "module"))
        self["File"] = met
        return self

    def drop_repo(self, repos: DataFrame) -> Graph:
        """Deletes repos (a column id) with their files, symbols and all edges at these. Packages and refs stay."""
        ids = repos.select("id")
        self.memo.clear()
        gone = {
            "Repo": ids,
            "File": self["File"].join(ids.withColumnRenamed("id", "repo"), "repo", "left_semi").select("id"),
            "Symbol": self["Symbol"].join(ids.withColumnRenamed("id", "repo"), "repo", "left_semi").select("id"),
        }
        for name, (a, b) in ENDS.items():
            for column, end in (("src", a), ("dst", b)):
                if end in gone and (name in self.tables or name in self.later):
                    self.tables[name] = without(self[name], gone[end], (column,))
        for name in gone:
            self.tables[name] = without(self[name], gone[name])
        return self

    def drop_vulnerabilities(self) -> Graph:
        for name in ("Vulnerability", "AFFECTS", "AFFECTED_BY"):
            self.later.pop(name, None)
            self.tables[name] = empty(self.spark, TABLES[name])
        return self

    # looking at it

    def stats(self) -> DataFrame:
        """name, rows of each of the 22 tables."""
        counts = [self._count(n).select(F.lit(n).alias("name"), "rows") for n in TABLES]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out

    def _count(self, name: str) -> DataFrame:
        """rows. Tables that nobody has read yet are counted without being written."""
        from repograph.operators import link

        if name == "IMPORTS_FILE_CROSS_REPO" and name in self.later:
            return link.count_file_imports(self).withColumnRenamed("n", "rows")
        return link.rows(self, name).agg(F.count("*").alias("rows"))

    def broken_keys(self) -> DataFrame:
        """Rows per table whose key isn't unique: the constraints, as a query."""
        out = None
        for name in NODES:
            bad = duplicates(self[name], KEYS[name]).select(F.lit(name).alias("name"), "id", "n")
            out = bad if out is None else out.unionByName(bad)
        return out

    def edges(self, *names: str) -> DataFrame:
        """rel, src, dst of several edge types."""
        out = None
        for n in names:
            e = self[n].select(F.lit(n).alias("rel"), "src", "dst")
            out = e if out is None else out.unionByName(e)
        return out

    def search(self, words: str) -> DataFrame:
        """Symbols with every word in name, qname or docstring, best first: the full-text index as a query."""
        s = self["Symbol"]
        text = F.lower(F.concat_ws(" ", "name", "qname", "docstring"))
        tokens = F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda t: t != ""))
        wanted = [w for w in words.lower().split() if w]
        found = s.withColumn("tokens", tokens).where(F.forall(F.lit(wanted), lambda w: F.array_contains("tokens", w)))
        return found.select("id", "name", "qname", (F.lit(len(wanted)) / F.size("tokens")).alias("score")).orderBy(
            F.col("score").desc(), "id"
        )
