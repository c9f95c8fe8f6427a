"""Secret scan with corpus-wide ownership frequency.

Patterns propose candidates in every whole text. Their values' hashes are
aggregated over the corpus by distinct repository and owner: a value that many
owners carry is a copied example, one that stays with few owners and looks random
is a live credential. Base kinds are always reported (with their verdict); the
wider kinds, vendor tokens and opaque strings, are reported only when live.

Defined cases: a null text is empty; a null owner or repository counts as one of
its own; repeated rows give repeated results and count once per owner; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import attach, bounded, slices, written

#: Fixed patterns of the base kinds. In `assign` the letters may be of either case.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs; the required length is part of the pattern, which finds the same
#: matches as the shorter pattern with the short ones dropped.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
ASSIGN_CHARS = 12
KINDS = ("assign", "access", "hex")
#: Wider candidates of the method.
VENDOR = (
    r"(?<![A-Za-z0-9_])(?:gh[opsu]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)"
)
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
#: Bits per character of a live-looking value; owners of a live value at most.
LIVE_BITS = 3.0
LIVE_OWNERS = 2
LIVE_REPOSITORIES = 4

SPAN = "struct<kind: string, start: long, stop: long, hash: string, random: boolean>"


def _entropy(value: str) -> float:
    import math
    from collections import Counter

    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def find_spans(text: str) -> list[tuple]:
    """(kind, start, stop, value) of all candidates; base kinds first, then wider ones that overlap none."""
    import re

    base = [
        ("assign", *m.span(), m[2])
        for m in re.compile(ASSIGN, re.ASCII | re.IGNORECASE).finditer(text)
        if len(m[2]) >= ASSIGN_CHARS
    ]
    base += [("access", *m.span(), m[0]) for m in re.compile(ACCESS).finditer(text)]
    base += [("hex", *m.span(), m[0]) for m in re.compile(HEX).finditer(text)]
    wide = [("vendor", *m.span(), m[0]) for m in re.compile(VENDOR).finditer(text)]
    wide += [
        ("opaque", *m.span(), m[0])
        for m in re.compile(OPAQUE).finditer(text)
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])
    ]
    if wide and len(wide) + len(base) > 1:
        free, reach = [], sorted(base, key=lambda s: s[1])
        taken, last = [], -1
        for s in reach:  # merged intervals of the base spans
            if s[1] < last:
                last = max(last, s[2])
                taken[-1] = (taken[-1][0], last)
            else:
                last = s[2]
                taken.append((s[1], last))
        k, end = 0, -1
        for s in sorted(wide, key=lambda s: (s[1], s[0] != "vendor")):
            while k < len(taken) and taken[k][1] <= s[1]:
                k += 1
            if s[1] >= end and (k == len(taken) or taken[k][0] >= s[2]):
                free.append(s)
                end = s[2]
        wide = free
    return base + wide


def _digest(spans: list[str]) -> str:
    import hashlib

    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def _scan(batches):
    import hashlib

    import pyarrow as pa

    span = pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.string()), ("random", pa.bool_())]
    )
    for b in slices(batches):
        counts, digests, found = {k: [] for k in KINDS}, [], []
        for text in b.column(b.schema.get_field_index("text")).to_pylist():
            spans = find_spans(text or "")
            base = sorted(((s[1], KINDS.index(s[0]), s[2]) for s in spans if s[0] in KINDS))
            for i, k in enumerate(KINDS):
                counts[k].append(sum(1 for s in base if s[1] == i))
            digests.append(_digest([f"{KINDS[k]}:{a}:{z}" for a, k, z in base]))
            found.append(
                [
                    {
                        "kind": k, "start": a, "stop": z,
                        "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32],
                        "random": _entropy(v) >= LIVE_BITS,
                    }
                    for k, a, z, v in spans
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [b.column(i) for i in range(3)]
            + [pa.array(counts[k], pa.int64()) for k in KINDS]
            + [pa.array(digests, pa.string()), pa.array(found, pa.list_(span))],
            names=["doc_id", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def candidates(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """A written table: one row per document with its candidates, and `place`, a key of the row."""
    rows = bounded(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        repository.cast("string").alias("repository"),
        owner.cast("string").alias("owner"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(
        _scan,
        "doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long,"
        f" base_sha256 string, found array<{SPAN}>",
    )
    return written(rows.withColumn("place", F.monotonically_increasing_id()), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash, over the corpus: copies, repositories, owners, verdict."""
    each = found.select(F.explode("found").alias("s"), "repository", "owner").select(
        F.col("s.hash").alias("hash"),
        F.col("s.random").alias("random"),
        F.coalesce("repository", F.lit("\0")).alias("repository"),
        F.coalesce("owner", F.lit("\0")).alias("owner"),
    )
    # One row per (value, repository, owner) first: a value with a third of all rows shrinks in the map tasks.
    pairs = each.groupBy("hash", "repository", "owner").agg(F.count("*").alias("n"), F.max("random").alias("random"))
    per_owner = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.max("random").alias("random"))
    owners = per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("copies"), F.max("random").alias("random"))
    repos = pairs.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repositories"))
    live = F.col("random") & (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES)
    return written(
        owners.join(repos, "hash").select("hash", "copies", "repositories", "owners", live.alias("live")), "ownership"
    )


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, verdicts (of spans, in their
    order: live or example), n_live, n_example."""
    found = candidates(docs, repository, owner)
    known = ownership(found)
    total = known.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    each = found.select("place", F.explode("found").alias("s")).select("place", "s.*")
    judged = attach(each, known, "hash", "copies", total, F.xxhash64("place", "start"))
    base = F.col("kind").isin(*KINDS)
    order = F.create_map(*(F.lit(x) for k in enumerate((*KINDS, "vendor", "opaque")) for x in k[::-1]))
    said = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("stop").cast("string"))
    spans = judged.where(base | F.col("live")).groupBy("place").agg(
        F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("k"), said.alias("said"), F.when(F.col("live"), "live").otherwise("example").alias("verdict")))).alias("all"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_example"),
    )
    met = found.drop("found").join(spans, "place", "left")
    return met.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(F.col("all.said"), ","), F.lit("")).alias("spans"),
        F.coalesce(F.array_join(F.col("all.verdict"), ","), F.lit("")).alias("verdicts"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
