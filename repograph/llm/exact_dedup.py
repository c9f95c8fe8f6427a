"""Exact deduplication by Grace hashing.

Texts are equal when identical after each run of white space becomes one space.
Every scan partition first merges its own copies, so a text that a third of all
rows hold crosses the shuffle once per scan partition. A reducer then inserts
into an open-addressing table that compares complete contents; what does not fit
its memory goes to spill files by the next bits of the hash, each of which is
processed the same way, until every bucket fits.

Defined cases: a null text counts as empty; a null doc_id never stays while its
group has another one (doc_ids sort nulls last); of rows that repeat the doc_id
that stays, one is kept (in `keep_first` that with the least JSON, if other columns
differ); an empty table gives an empty result; columns other than doc_id and text pass
through `keep_first` untouched, whatever their names, and are ignored elsewhere.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import SPACE, attach, bounded, slices, unpacked, whole, written

#: Bytes of content that one table holds; at least one entry always fits.
TABLE_BYTES = 64 << 20
FANOUT_BITS = 4


def normalised(text):
    """The column in which equal texts are identical."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


class ContentTable:
    """Open addressing with linear probing; two entries are the same only if their
    complete contents are. An entry is [content, hash, smallest id, rows, rows with that id]."""

    def __init__(self, limit: int = TABLE_BYTES) -> None:
        self.limit, self.used, self.entries = limit, 0, []
        self.slots = [-1] * 1024

    def _find(self, content: bytes, h: int) -> int:
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (i := slots[at]) >= 0:
            e = self.entries[i]
            if e[1] == h and e[0] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, content: bytes, h: int, low, rows: int, with_low: int) -> bool:
        """False if the content is new and there is no room for it."""
        at = self._find(content, h)
        if (i := self.slots[at]) >= 0:
            e = self.entries[i]
            e[3] += rows
            if low is not None and (e[2] is None or low < e[2]):
                e[2], e[4] = low, with_low
            elif low == e[2]:
                e[4] += with_low
            return True
        if self.entries and self.used + len(content) > self.limit:
            return False
        self.slots[at] = len(self.entries)
        self.entries.append([content, h, low, rows, with_low])
        self.used += len(content) + 200
        if len(self.entries) * 2 > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            for k, e in enumerate(self.entries):
                self.slots[self._find(e[0], e[1])] = k
        return True


def grace(rows: Iterable[tuple], limit: int = TABLE_BYTES, level: int = 0) -> Iterator[list]:
    """Distinct contents of (content, hash, low, rows, rows with low) tuples, in bounded memory."""
    table, files = ContentTable(limit), {}
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for content, h, low, n, m in rows:
            if table.add(content, h, low, n, m):
                continue
            part = (h >> (60 - FANOUT_BITS * level)) & ((1 << FANOUT_BITS) - 1)
            if part not in files:
                files[part] = open(f"{folder}/{part}", "w+b")  # noqa: SIM115
            pickle.dump((content, h, low, n, m), files[part], protocol=5)
        yield from table.entries
        del table
        for part in sorted(files):
            f = files[part]
            f.seek(0)
            # After the hash's last bits only full 64-bit collisions are left: no limit.
            deeper = level + 1
            yield from grace(_spilled(f), limit if FANOUT_BITS * deeper <= 60 else 1 << 62, deeper)
            f.close()


def _spilled(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _rows(batches) -> Iterator[tuple]:
    for b in slices(batches, 1024):
        d = b.to_pydict()
        for sha, text, low, n, m in zip(d["sha"], d["content"], d["low"], d["n"], d["m"], strict=True):
            yield text.encode("utf-8", "surrogatepass"), int(sha[:16], 16), low, n, m, sha


def _batch(entries: list, shas: list, with_content: bool):
    import pyarrow as pa

    cols = {"sha": pa.array(shas, pa.string())}
    if with_content:
        cols["content"] = pa.array([e[0].decode("utf-8", "surrogatepass") for e in entries], pa.string())
    cols["low"] = pa.array([e[2] for e in entries], pa.int64())
    cols["n"] = pa.array([e[3] for e in entries], pa.int64())
    cols["m"] = pa.array([e[4] for e in entries], pa.int64())
    return pa.RecordBatch.from_pydict(cols)


def _chunks(pairs: Iterable[tuple], with_content: bool):
    entries, shas, size = [], [], 0
    for e, sha in pairs:
        entries.append(e)
        shas.append(sha)
        size += len(e[0])
        if len(entries) >= 4096 or size > 8 << 20:
            yield _batch(entries, shas, with_content)
            entries, shas, size = [], [], 0
    if entries:
        yield _batch(entries, shas, with_content)


def _combine(limit: int):
    """Merges copies within a scan partition; a full table is sent on and begun anew."""

    def run(batches):
        import hashlib

        def merged():
            table = ContentTable(limit)
            for content, h, low, n, m, _ in _rows(batches):
                if not table.add(content, h, low, n, m):
                    yield from table.entries
                    table = ContentTable(limit)
                    table.add(content, h, low, n, m)
            yield from table.entries

        yield from _chunks(((e, hashlib.sha256(e[0]).hexdigest()) for e in merged()), True)

    return run


def _reduce(limit: int):
    def run(batches):
        import hashlib

        entries = grace((r[:5] for r in _rows(batches)), limit)
        yield from _chunks(((e, hashlib.sha256(e[0]).hexdigest()) for e in entries), False)

    return run


def groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct text: sha, low (doc_id that stays), n (rows), m (rows with that doc_id)."""
    content = normalised(F.col("text"))
    rows = bounded(docs).select(
        F.sha2(content, 256).alias("sha"),
        content.alias("content"),
        F.col("doc_id").cast("long").alias("low"),
        F.lit(1).cast("long").alias("n"),
        F.lit(1).cast("long").alias("m"),
    )
    merged = rows.mapInArrow(_combine(table_bytes), "sha string, content string, low long, n long, m long")
    found = merged.repartition("sha").mapInArrow(_reduce(table_bytes), "sha string, low long, n long, m long")
    return written(found, "texts")


def dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    found = groups(docs, table_bytes)
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(F.col("text")), 256).alias("sha")
    )
    met = attach(rows, found, "sha", "n", total, F.xxhash64("doc_id"))
    first = F.col("doc_id").eqNullSafe(F.col("low"))
    # Rows that repeat both text and doc_id are told apart by their place in a written table.
    out = written(
        met.select("*", first.alias("first"), F.monotonically_increasing_id().alias("place")), "members"
    )
    repeats = out.where(F.col("first") & (F.col("m") > 1))
    one = repeats.groupBy("sha").agg(F.min("place").alias("place"))
    single = out.where(~(F.col("first") & (F.col("m") > 1))).withColumn("kept", F.col("first"))
    chosen = one.select("place", F.lit(True).alias("one"))
    several = repeats.join(chosen, "place", "left").withColumn("kept", F.coalesce("one", F.lit(False)))
    names = [
        F.col("doc_id"),
        F.col("low").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("kept"),
        F.col("sha").alias("text_sha256"),
    ]
    return single.select(*names).unionByName(several.select(*names))


def keep_first(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = groups(docs, table_bytes)
    stays = found.select(F.col("sha").alias("stay"), "low", "m")
    keyed = docs.select(whole(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.sha2(normalised(F.col("text")), 256).alias("s"))
    # Keyed by (text, doc_id): only true repeats of a row share a key, however many copies a text has.
    met = keyed.join(stays, (F.col("s") == F.col("stay")) & F.col("id").eqNullSafe(F.col("low")))
    once = unpacked(met.where("m = 1"), "row", docs.columns)
    if found.where("m > 1").isEmpty():
        return once
    several = met.where("m > 1").groupBy("s").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(unpacked(several, "row", docs.columns))
